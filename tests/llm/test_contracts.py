"""The registered queries on a small folder of tables: what each returns, by its contract."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import queries as llm
from tallyforge.llm.queries import tokenizer

from .test_operators import docs, prose, slow_print


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(4)
    found = [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 3}", len(t or "")) for i, t in docs() if t is None or len(t) < 100_000]
    found += [(1000 + k, f"the key password = hunter2hunter{k} and AKIA{'B' * 16} {'0a' * 16} {prose(rng, 9)}", "en", "s1", 1) for k in range(5)]
    spark.createDataFrame(found, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    m = np.random.default_rng(1).normal(size=(300, 8))
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder, found, m.astype(np.float32).astype(float)


def run(spark, tables, number):
    name = next(n for n in llm.queries() if n.startswith(f"op{number}_"))
    return [r.asDict() for r in llm.queries()[name](spark, tables[0]).collect()]


def remainder(i, parts):
    return zlib.crc32(str(i).encode()) % parts if i is not None else None


def test_op1(spark, tables):
    got = run(spark, tables, 1)
    assert len(got) == len(tables[1]) and all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) for r in got)
    assert {r["lang_pred"] for r in got} == {"en", "und"} and all(0 <= r["score"] <= 1 for r in got)


def test_op2(spark, tables):
    got, m = run(spark, tables, 2), tables[2]
    assert {r["query_id"] for r in got} == set(range(0, 300, 50)) and len(got) == 30
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(abs(r["score"] - unit[q] @ unit[r["vec_id"]]) < 1e-12 for r in mine)


def test_op3(spark, tables):
    got = run(spark, tables, 3)
    assert sorted((r["doc_id"] or -1, r["fingerprint"]) for r in got) == sorted((i or -1, f"{slow_print(t):016x}") for i, t, *_ in tables[1])
    assert all(r["component_id"] is None or r["doc_id"] is None or r["component_id"] <= r["doc_id"] for r in got)


def test_op4(spark, tables):
    got = run(spark, tables, 4)
    assert len(got) == len(tables[1]) and all(r["held_out"] == (remainder(r["doc_id"], 3) == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)


def test_op5(spark, tables):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    count = lambda t: len(own.encode(t or "", add_special_tokens=False).ids)
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in run(spark, tables, 5)) == sorted((i or -1, len((t or "").encode()), count(t), count(t) > 2048) for i, t, *_ in tables[1])


def test_op7(spark, tables):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = {}
    for i, t, *_ in tables[1]:
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want[i, zlib.crc32(ids.tobytes())] = len(ids)
    got = run(spark, tables, 7)
    assert {(r["doc_id"], r["ids_crc32"], r["length"]) for r in got if r["piece"] == 0 and r["length"] < 2048} >= {(i, c, n) for (i, c), n in want.items() if n < 2048}
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 2048 and [a for a, _ in sorted(x)] == np.cumsum([0] + [n for _, n in sorted(x)])[:-1].tolist() for x in by.values())


def test_op8(spark, tables):
    got = run(spark, tables, 8)
    assert len(got) == len(tables[1]) and {*got[0]} >= {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"}
    copies = {i: i % 100 for i in range(100, 110)}
    assert all(r["component_id"] == copies[r["doc_id"]] for r in got if r["doc_id"] in copies)
    order = sorted((r for r in tables[1] if r[0] is not None), key=lambda r: -r[0])
    i, t, *_ = order[3]
    h = len(t) // 2
    edited = t[: len(t) - h] + (order[4][1] or "")[:h]
    assert next(r for r in got if r["doc_id"] == i)["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_op9_and_op6(spark, tables):
    assert {r["doc_id"] for r in run(spark, tables, 9)} >= {300, 301, 302}
    assert len(run(spark, tables, 6)) > 0


def test_op10(spark, tables):
    kinds = {"assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    keep = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
    want = []
    for i, t, *_ in tables[1]:
        spans = sorted(((m.start(), n, k, m.end()) for n, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, t or "", re.ASCII) if keep[k](m)))
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        want.append((i or -1, *(sum(s[2] == k for s in spans) for k in kinds), hashlib.sha256(joined.encode()).hexdigest()))
    got = run(spark, tables, 10)
    assert sorted((r["doc_id"] or -1, r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == sorted(want)
    assert all(r["spans"].count("assign") >= 1 for r in got if (r["doc_id"] or 0) >= 1000)


def test_columns_of_the_results_names_are_replaced(spark):
    """Documents that have columns of the names that operators give or use inside."""
    from tallyforge.llm import editprint, mixing, packing, suffixes

    clash = ["piece", "length", "row", "grp", "sequence_id", "class", "component_id", "id", "n_tokens", "same", "key", "domain_", "fill", "bucket"]
    df = spark.createDataFrame([(i, prose(random.Random(i), 60), "en", "a") for i in range(6)], "doc_id long, text string, lang string, source string")
    for c in clash:
        df = df.withColumn(c, F.lit("old"))
    assert packing.pack(df, tokenizer("byte_bpe_50k.json")).count() == 6
    assert editprint.near_duplicates(df).count() == 6 and suffixes.repeated_passages(df).count() == 0
    assert mixing.mix(df, {}, 10**9, 1, 1, F.lit("d")).count() == 6
