"""The corpus pipeline, stage by stage, against brute force on a small corpus."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm.simhash import fingerprint

WORDS = "amber basil cedar delta ember fable grove harbor island jungle kernel lemon meadow nectar olive pepper quartz river saffron tulip".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        rows.append((i, text(80) + (". vilewordx indeed" if toxic else "."), "en" if i % 3 else "fr", f"src{i % 3}"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1], "en", "src0") for i in range(1, 30, 4)]
    rows += [(2000, None, None, None), (2001, "", "en", "src1"), (2002, "the key password=abcdefghijk ok", "en", "src1"), (2003, "twice", "en", "src2"), (2003, "twice", "en", "src2")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.withColumn("score", F.lit("kept")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["toxicity", "near_copies", "secrets", "mixture", "packing"]
    clean = stages["toxicity"](spark, docs, folder).cache()
    assert clean.columns == docs.columns and {r.score for r in clean.collect()} == {"kept"}
    assert sorted((r.doc_id) for r in clean.select("doc_id").collect()) == sorted(i for i, t, *_ in rows if "vileword" not in (t or ""))
    one = stages["near_copies"](spark, clean, folder).cache()
    seen, want = {}, []
    for r in sorted(clean.collect(), key=lambda r: r.doc_id):
        f = fingerprint(r.text or "")
        if not any(bin(f ^ g).count("1") <= 3 for g in seen):
            want.append(r.doc_id)
        seen[f] = r.doc_id
    assert sorted(r.doc_id for r in one.collect()) == sorted(want) and one.columns == docs.columns
    bare = stages["secrets"](spark, one, folder).cache()
    texts = {r.doc_id: r for r in bare.collect()}
    assert texts[2002].text == "the key [REDACTED] ok" and texts[2002].n_chars == len(texts[2002].text) and len(texts) == one.count()
    mixed = stages["mixture"](spark, bare, folder).cache()
    assert mixed.columns == docs.columns and 0.6 * bare.count() <= mixed.count() <= bare.count()
    pieces = stages["packing"](spark, mixed, folder)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in mixed.collect()}


def test_run_and_empty_tables(spark, corpus, tmp_path):
    folder, _ = corpus
    assert corpus_pipeline.run(spark, folder).count() > 100
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_of_edited_texts(spark):
    """Words replaced up to a similarity of 0.8: the links of all pairs by brute force; rows of one id with other texts stay."""
    rng = random.Random(7)
    word = lambda: rng.choice(WORDS) + rng.choice(WORDS)
    rows = []
    for i in range(60):
        words = [word() for _ in range(100 if i % 2 else 300)]
        rows.append((i, " ".join(words)))
        for k in range(i % 5 + 1 if i % 2 else i % 8 + 1):
            words[rng.randrange(len(words))] = word()
        rows.append((1000 + i, " ".join(words)))
    # a chain, and a group whose members differ from each other at the same place
    frame = [word() for _ in range(120)]
    rows += [(2000 + i, " ".join([*frame[:60], f"own{i}", *frame[60:]])) for i in range(40)]
    chain = [word() for _ in range(100)]
    for i in range(8):
        chain[i * 12 + 2] = f"link{i}"
        rows.append((3000 + i, " ".join(chain)))
    rows += [(5, "a text of its own that shares its id with another row"), (4000, "a  Text of its own"), (4001, "A text of its own"), (None, "no id"), (None, "no id")]

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))
    find = lambda k: k if up[k] == k else find(up[k])
    n = 0
    for i in range(len(rows)):
        for k in range(i):
            if 5 * len(sets[i] & sets[k]) >= 4 * len(sets[i] | sets[k]):
                n += 1
                up[find(i)] = find(k)
    met, want = set(), []
    for k in order:
        if find(k) not in met:
            met.add(find(k))
            want.append((rows[k][0] or -1, rows[k][1].lower().split()))
    assert n > 800
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("kept")).repartition(5)
    got = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, "").collect()
    assert {r.key for r in got} == {"kept"}
    assert sorted((r.doc_id or -1, r.text.lower().split()) for r in got) == sorted(want)


@pytest.mark.parametrize("ids", ["own", "none", "shared", "equal"])
def test_mixture_takes_rows_and_not_ids(spark, ids):
    """The weights are met whether rows have ids of their own, none, or share them, and where they are equal in all columns."""
    text = lambda i: "the same text " * 12 if ids == "equal" else f"text number {i} " * 12
    rows = [({"own": i, "none": None, "shared": i % 40, "equal": 7}[ids], text(i), "en", "big", i % 3) for i in range(2000)]
    rows += [({"own": 10_000 + i, "none": None, "shared": i % 40, "equal": 7}[ids], text(i), "en", "small", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, other int").repartition(4)
    weights = {"source": {"big": 1, "small": 1}}
    from tallyforge.llm import mixing

    each = mixing.estimated_tokens()
    got = mixing.mix_rows(docs, weights, 0.3, 5, F.lit("d")).cache()
    total = docs.agg(F.sum(each)).first()[0]
    held = {r.source: r.n for r in got.groupBy("source").agg(F.sum(each).alias("n")).collect()}
    # the small source is taken whole, and what it lacks the other gives
    assert held["small"] == docs.where("source = 'small'").agg(F.sum(each)).first()[0]
    assert 0 <= int(0.3 * total) - held["small"] - held["big"] < 60, (held, total)
    assert got.columns == docs.columns and got.exceptAll(docs).count() == 0
    again = mixing.mix_rows(docs.repartition(3, "other"), weights, 0.3, 5, F.lit("d"))
    assert sorted(map(str, again.select("doc_id", "text", "source").collect())) == sorted(map(str, got.select("doc_id", "text", "source").collect()))


def test_rows_of_one_id_and_text_leave_the_same_row(spark):
    rows = [(1, "the very same words here", "x", k) for k in (5, 3, 9)] + [(1, "something else altogether, and longer", "x", 2), (None, "no id", "y", 1), (None, "no id", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, other int")
    for parts in (1, 3, 5):
        got = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs.repartition(parts), "").collect()
        assert sorted((r.doc_id or 0, r.other) for r in got) == [(0, 1), (1, 2), (1, 3)]
