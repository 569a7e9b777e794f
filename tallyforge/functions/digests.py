"""Digests and keys over canonical JSON: sorted keys, compact, nulls kept."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """A JSON object with its keys in order; null fields stay."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def digest_of(c: Column) -> Column:
    return F.sha2(F.coalesce(c.cast("string"), F.lit("")), 256)


def fingerprint(account: Column, amount: Column, company: Column, currency: Column, direction: Column, occurred_on: Column, reference: Column) -> Column:
    """What makes two movements look like the same: amounts count with all twelve decimals."""
    text = canonical_json(account=account, amount=amount.cast("decimal(38,12)").cast("string"), company=company, currency=currency, direction=direction, occurred_on=occurred_on.cast("string"), reference=F.coalesce(reference, F.lit("")))
    return F.sha2(text, 256)


def record_digest_text(ordinal: Column, values: Column) -> Column:
    """A record as one text that no other record gives: each value goes after its length."""
    folded = F.aggregate(values, F.lit(""), lambda acc, v: F.concat(acc, F.length(v).cast("string"), F.lit(":"), v))
    return F.concat(ordinal.cast("string"), F.lit(":"), F.size(values).cast("string"), F.lit("|"), folded)


def artifact_identity(company: Column, source: Column, digest: Column) -> Column:
    """company|source|digest, null where a part is missing or the digest is none."""
    good = (F.length(company) > 0) & (F.length(source) > 0) & F.regexp_like(digest, F.lit(r"\A[0-9a-f]{64}\z"))
    return F.when(good, F.concat_ws("|", company, source, digest))


def keyed_digest(key: bytes):
    """A keyed digest of text columns. The key stays in the Python workers: as an expression it would show in query plans."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    return run


def canonical_features(df, features: list[str]) -> Column:
    """The features of each row as one text: canonical JSON of the names in order and of exact texts, nulls as empty ones. Floating numbers are
    refused, as one amount could have several texts."""
    inexact = [f for f in features if df.schema[f].dataType.simpleString() in ("float", "double")]
    if inexact:
        raise TypeError(f"features must be exact: {', '.join(inexact)}")
    return canonical_json(**{f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in features})


def candidate_fingerprint(df, features: list[str], key: bytes, version: str) -> Column:
    """A keyed digest of a row's features, with the version of the features in front, so that those of different versions never meet."""
    if not version:
        raise ValueError("a fingerprint names the version of its features")
    return F.concat(F.lit(f"{version}:"), keyed_digest(key)(F.concat(F.lit(f"{version}|"), canonical_features(df, features))))


def normalised_account(c: Column) -> Column:
    """An account's number without the marks that people write between its parts."""
    return F.upper(F.regexp_replace(c, r"[\s._/-]", ""))


def account_token(c: Column, company: Column, family: str, key: bytes, version: int) -> Column:
    """(token, last4, key version) in place of an account's number."""
    bare = normalised_account(c)
    token = keyed_digest(key)(F.concat_ws("|", company, F.lit(family), F.lit(str(version)), bare))
    return F.struct(token.alias("token"), F.right(bare, F.lit(4)).alias("last4"), F.lit(version).alias("key_version"))


#: What a reproduction key is made of, and words that name no fixed release.
REPRODUCTION_INPUTS = ("artifact_sha256", "canonical_schema_version", "company_id", "components_sha256", "engine_release_id", "field_overlay_set_sha256", "mapping_sha256", "ordered_movements_sha256", "parser_version", "row_override_set_sha256", "schema_sha256")
FLOATING = ("latest", "main", "head", "current", "snapshot")


def reproduction_key(manifest: dict) -> str:
    missing = [k for k in REPRODUCTION_INPUTS if not manifest.get(k)]
    if missing:
        raise ValueError(f"missing inputs: {', '.join(missing)}")
    if any(word in str(manifest["engine_release_id"]).lower().replace("_", "-").split("-") for word in FLOATING):
        raise ValueError("a floating release cannot be reproduced")
    text = json.dumps({k: manifest[k] for k in REPRODUCTION_INPUTS}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


def encode_cursor(day: str, key: str) -> str:
    return base64.urlsafe_b64encode(f"{day}|{key}".encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str]:
    day, _, key = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode().partition("|")
    return day, key
