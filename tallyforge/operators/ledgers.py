"""Small rules over ledgers: statement derivation, close guards, document history, decision lineage, releases, blockers of mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY
from .latest import latest


def derived_statements(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Statements from pairs of balances (bank_*, books_*), with the first thing that keeps a pair from being one, or its equation.

    The bank's balance is a closing one and the books' a ledger one; both are of one company, currency and release and of different
    sources; and as many assessments as expected sources stand behind it, one at least.
    """
    bank, books = (lambda c: F.col(f"bank_{c}")), (lambda c: F.col(f"books_{c}"))
    error = (
        F.when((bank("type") != "closing") | (books("type") != "ledger"), "balance_type")
        .when(bank("company_id") != books("company_id"), "company_scope")
        .when(bank("currency_code") != books("currency_code"), "currency")
        .when(bank("release") != books("release"), "release")
        .when(bank("source_id") == books("source_id"), "same_source")
        .when((F.col("assessments") != F.col("expected_sources")) | (F.col("expected_sources") < 1), "assessments_incomplete")
    )
    side = lambda s: F.coalesce(F.sum(F.when(F.col("adjustment_side") == s, F.col("amount"))), F.lit(0)).cast(MONEY)
    sums = items.where("state = 'confirmed'").groupBy("statement_id").agg(side("add_to_bank").alias("plus"), side("deduct_from_bank").alias("minus"))
    zero = F.lit(0).cast(MONEY)
    gap = (bank("amount") + F.coalesce("plus", zero) - F.coalesce("minus", zero) - books("amount")).cast(MONEY)
    out = pairs.withColumn("error_code", error).join(sums, "statement_id", "left").withColumn("gap_", gap)
    return out.select("statement_id", "error_code", F.when(F.col("error_code").isNull(), F.col("gap_")).alias("unexplained"), F.when(F.col("error_code").isNull(), F.when(F.col("gap_") == 0, "balanced").otherwise("review_required")).alias("state"))


def close_violations(packets: DataFrame, controls: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Why a period may not be closed by its packet: not reviewed, not the last version, or controls that are missing, twice or open."""
    last = latest(packets, keys, F.desc("version")).select(*keys, F.col("version").alias("last_version"))
    seen = controls.groupBy(*keys).agg(F.countDistinct("control").alias("codes"), F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("open"))
    rows = packets.join(last, keys).join(seen, keys, "left")
    why = F.array_compact(F.array(
        F.when(F.col("state") != "reviewed", "not_reviewed"),
        F.when(F.col("version") != F.col("last_version"), "not_latest"),
        F.when((F.coalesce("codes", F.lit(0)) != expected) | (F.col("n") != F.col("codes")), "controls_not_exact"),
        F.when(F.coalesce("open", F.lit(1)) > 0, "controls_open"),
    ))
    return rows.select(*keys, "version", F.explode(why).alias("violation"))


def document_history(artifacts: DataFrame, runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Artifacts with their last run and last decision; one window each, no look-up by row."""
    run = latest(runs, ["artifact_id"], F.desc("started_on"), F.desc("run_id")).select("artifact_id", "run_id", F.col("state").alias("run_state"))
    decision = latest(decisions, ["artifact_id"], F.desc("decided_on"), F.desc("decision_id")).select("artifact_id", "decision")
    return artifacts.join(run, "artifact_id", "left").join(decision, "artifact_id", "left")


def decision_lineage(entities: DataFrame, kind: str, inputs: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of entities (entity_id) and the array ``inputs`` of what they rest on, each once."""
    node = lambda c: F.concat(F.lit(f"{kind}:"), c.cast("string"))
    edges = entities.select(F.explode(inputs).alias("from_id"), node(F.col("entity_id")).alias("to_id")).distinct()
    nodes = edges.select(F.explode(F.array("from_id", "to_id")).alias("node_id")).distinct()
    return nodes, edges


def mapping_blockers(ambiguous: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ambiguous columns (mapping_id, column_index, convention) that no decision of the same convention settles."""
    return ambiguous.join(decisions, ["mapping_id", "column_index", "convention"], "left_anti")


def release_problems(releases: DataFrame) -> DataFrame:
    """What is wrong with each release: not approved, no attestation, other components than those approved."""
    why = F.when(F.col("state") != "approved", "not_approved").when(F.col("attestation").isNull(), "not_attested").when(F.col("components_digest") != F.col("approved_digest"), "components_changed")
    return releases.select("engine_release_id", why.alias("problem"))


def unredacted(entries: DataFrame, forbidden: tuple[str, ...] = ("value", "raw_values", "account_number", "secret")) -> DataFrame:
    """Log entries (entry_id, fields: a map) that show what a log must not."""
    bad = F.array_sort(F.map_keys(F.map_filter("fields", lambda k, v: k.isin(*forbidden) & v.isNotNull() & (v != "[redacted]"))))
    return entries.select("entry_id", bad.alias("fields")).where(F.size("fields") > 0)


def located(lines: DataFrame, datasets: DataFrame, accounts: DataFrame) -> DataFrame:
    """Lines (dataset_key, ...) with their dataset's account key and that account's columns: the ordinals of a finding's place."""
    return lines.join(datasets, "dataset_key").join(accounts, "account_key")


def paired_balances(balances: DataFrame, account: str, side: str, amount: str) -> DataFrame:
    """Accounts with both a bank and a books balance, each summed exactly in one aggregation."""
    total = lambda s: F.sum(F.when(F.col(side) == s, F.col(amount)))
    out = balances.groupBy(F.col(account).alias("account")).agg(total("bank").alias("bank"), total("books").alias("books"))
    return out.where("bank IS NOT NULL AND books IS NOT NULL")


def diverging(stored: DataFrame, observed: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of both sides whose values differ; a null differs from any value."""
    other = observed.select(key, F.col(value).alias("observed_"))
    return stored.join(other, key).where(~F.col(value).eqNullSafe(F.col("observed_"))).select(key)


def valid_on(rows: DataFrame, links: DataFrame, key: str, day: str) -> DataFrame:
    """Rows that a link (key, valid_from, valid_to) holds for on their day; both ends count."""
    return rows.join(links, key).where(F.to_date(day).between(F.col("valid_from"), F.col("valid_to"))).select(*rows.columns)
