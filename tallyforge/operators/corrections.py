"""Corrections: overlays on fields that are proposed, reviewed and applied as a new version of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import fingerprint
from ..functions.money import MONEY
from .folds import chain_ends, numbered
from .latest import latest
from .rounds import settled

FIELDS = {"amount": MONEY, "currency_code": "string", "direction": "string", "occurred_on": "date", "posted_on": "date", "accounting_date": "date", "description": "string", "reference_normalised": "string"}


def set_digest(df: DataFrame, keys: list[str], digest: Column) -> DataFrame:
    """A digest of a set of digests, whatever its order: sha256 of the digests that begin with the same three digits, in order, and then of
    these 4,096 at most, so that no row holds all of a large set."""
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    parts = df.select(*keys, digest.alias("d_")).groupBy(*keys, F.substring("d_", 1, 3).alias("p_")).agg(joined("d_").alias("d_"))
    return parts.groupBy(*keys).agg(joined(F.concat("p_", "d_")).alias("digest"))


def checked(overlays: DataFrame) -> DataFrame:
    """Overlays (overlay_id, movement_id, field, base_digest, current_digest, new_digest, proposed_by, reviewed_by, decision, seq) with
    their outcome: a stale base, no change, a second one for the field, and one's own review are refused."""
    first = F.row_number().over(Window.partitionBy("movement_id", "field").orderBy("seq", "overlay_id"))
    fields = [*FIELDS]
    why = (
        F.when(~F.col("field").isin(*fields), "field_not_correctable")
        .when(F.col("base_digest") != F.col("current_digest"), "stale_base")
        .when(F.col("new_digest") == F.col("current_digest"), "no_change")
        .when(F.col("place_") > 1, "already_active")
        .when(F.col("proposed_by") == F.col("reviewed_by"), "same_person")
    )
    return overlays.withColumn("place_", first).withColumn("outcome", F.coalesce(why, F.col("decision"))).drop("place_")


def applied(m: DataFrame, overlays: DataFrame, version: str) -> DataFrame:
    """Movements as the new version ``version`` with approved overlays (movement_id, field, value) in place and fingerprints made anew.

    The fields are a fixed list, so that turning rows to columns takes no look at the data.
    """
    fields = [f for f in FIELDS if f in m.columns]
    new = overlays.where(F.col("field").isin(*fields)).groupBy("movement_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).cast(FIELDS[f]).alias(f"new_{f}") for f in fields])
    out = m.join(new, "movement_id", "left")
    corrected = F.lit(False)
    for f in fields:
        corrected = corrected | F.col(f"new_{f}").isNotNull()
    out = out.withColumn("corrected", corrected)
    for f in fields:
        out = out.withColumn(f, F.coalesce(f"new_{f}", f)).drop(f"new_{f}")
    again = fingerprint(*[F.col(c) for c in ("financial_account_id", "amount", "company_id", "currency_code", "direction", "occurred_on", "reference_normalised")])
    return out.withColumn("dedupe_fingerprint", again).withColumn("dataset_version_id", F.lit(version))


def chained(overlays: DataFrame) -> DataFrame:
    """The state of each field after its chain of overlays (entity, field, seq, id, kind, base, value): each must rest on the value that
    stands when its turn comes, or it is a conflict and changes nothing. The first one's base stands at the beginning. A kind that is none of set, redact and unknown is a conflict."""
    made = F.when(F.col("kind") == "set", F.col("value")).when(F.col("kind") == "redact", F.lit("[redacted]")).when(F.col("kind") == "unknown", F.lit("unknown"))
    known = F.coalesce(F.col("kind").isin("set", "redact", "unknown"), F.lit(False))
    keyed = overlays.select(F.to_json(F.array(F.col("entity").cast("string"), F.col("field").cast("string"))).alias("k_"), "entity", "field", "seq", "id", "kind", "base", made.alias("value"), known.alias("known"))
    placed = settled(numbered(keyed, "k_", [F.col(c) for c in ("seq", "id", "kind", "base", "value")]))
    names = placed.where("place = 0").select("k_", "entity", "field")
    return chain_ends(placed, "k_").join(names, "k_").select("entity", "field", "value", (F.col("n") - F.col("applied")).cast("int").alias("conflicts"))


def active_overrides(overrides: DataFrame) -> DataFrame:
    """The highest override of each record and field, and what is wrong with it."""
    top = latest(overrides, ["source_record", "field"], F.desc("override_ordinal"))
    problem = F.when(F.col("approved_by").isNull(), "not_approved").when(F.col("approved_by") == F.col("recorded_by"), "same_person").when(F.col("digest") != F.sha2(F.coalesce("value", F.lit("")), 256), "digest_differs")
    return top.withColumn("problem", problem)


def pending_counts(overlays: DataFrame, key: str) -> DataFrame:
    """For each dataset the overlays that wait for a review, and those approved that are not applied (state, applied)."""
    return overlays.groupBy(key).agg(F.count_if(F.col("state") == "proposed").alias("proposed"), F.count_if((F.col("state") == "approved") & ~F.col("applied")).alias("approved_unapplied"))
