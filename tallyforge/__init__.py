"""Spark-native reconciliation analytics: statements, movements, matching, quality, close and reports."""
