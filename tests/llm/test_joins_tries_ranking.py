"""The n-gram join, the conversation trie and the ranked search against brute force, with odd rows and small limits."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import jaccard, lexical, trie
from tallyforge.llm.common import ship

from .test_operators import WORDS, docs, prose


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


# the n-gram join


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(rows):
    sets, up = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    find = lambda k: k if up[k] == k else find(up[k])
    for i in range(len(rows)):
        for k in range(i):
            if sets[i] and sets[k] and 100 * len(sets[i] & sets[k]) >= 80 * len(sets[i] | sets[k]):
                up[find(i)] = find(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def similar_rows():
    rng = random.Random(8)
    word = lambda: rng.choice(WORDS) + rng.choice(WORDS)
    rows = docs()
    base = [word() for _ in range(90)]
    for i in range(60):
        # a group of near-copies, some at the border of the similarity
        words = base[:]
        for k in range(i % 4):
            words[10 + 25 * k] = word()
        rows.append((1000 + i, " ".join(words)))
    passage = " ".join(word() for _ in range(60))
    # a passage that many share is no link; with little else it is
    rows += [(2000 + i, f"{passage} {prose(rng, 40)}") for i in range(30)] + [(2100 + i, f"{passage} {word()}") for i in range(8)]
    chain = [word() for _ in range(100)]
    for i in range(8):
        chain[i * 12 + 2] = f"link{i}"
        rows.append((3000 + i, " ".join(chain)))
    return rows + [(3100, "One two THREE four"), (3101, "one  two three\tfour"), (3102, "one two three four five"), (None, passage), (2000, "an id again with another text of its own")]


def test_links_are_those_of_all_pairs(spark):
    rows = similar_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("old") for c in ("n_shingles", "class", "component_id", "label")}).repartition(5)
    got = jaccard.jaccard_join(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == components(rows)
    assert jaccard.jaccard_join(df.where("false")).collect() == []


def test_frequent_shingles_and_many_ranges_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "frequent", lambda docs, total: np.unique(np.concatenate([jaccard.shingles(t or "", jaccard.Words()) for _, t in similar_rows()[60:90]])))
    monkeypatch.setattr(jaccard, "FRAGMENT", 10)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rows = similar_rows()
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == components(rows)


# the conversation trie


def slow_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    seqs = {}
    for c, turns in own.items():
        turns.sort()
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = [t[1:] for t in sorted(own.get(c - int(math.fmod(c, 20)), []))[:h]] + [t[1:] for t in turns[h:]]
    nodes = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    kids = defaultdict(set)
    for p in nodes:
        if p:
            kids[p[:-1]].add(p)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(seqs[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def conversations(seed):
    rng = random.Random(seed)
    said = [f"{prose(rng, rng.randint(0, 5))}" for _ in range(4)]
    rows = []
    for c in [*range(0, 60), *range(-25, -15), 100, 101, 1040]:
        rows += [(c, t, rng.choice(["user", "assistant", None]) if t % 5 == 4 else "user", rng.choice(said)) for t in range(rng.choice([1, 2, 3, 5, 9]))]
    # long ones that part late, one that ends within another, and equal ones
    deep = [(t, "user", f"turn {t} of all") for t in range(30)]
    for c, n, own in ((200, 30, "x"), (201, 30, "y"), (202, 22, None), (203, 30, "x"), (219, 11, "z")):
        rows += [(c, *t) for t in deep[:n]] + ([(c, 50, "user", own)] if own else [])
    # nulls, ties, repeated rows
    rows += [(300, None, "user", "null first"), (300, 1, None, None), (300, 1, "user", "tie"), (300, 1, "user", "tie"), (300, 1, "b", "tie"), (None, 1, "user", "nobody's"), (321, 0, "user", "only one turn")]
    return rows




@pytest.mark.parametrize("block", [3, 64])
def test_trie_is_that_of_all_prefixes(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = [r for r in conversations(block) if not (r[0] == 300 and r[1] == 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit(1), "n": F.lit(2), "place": F.lit("z")}).repartition(4)
    sequences, members = trie.rebuilt(trie.turns(df).cache())
    got = trie.prefix_trie(sequences, members)
    assert Counter(map(tuple, got.collect())) == slow_trie(rows)


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = conversations(1)
    out = []
    for parts in (1, 3):
        random.Random(parts).shuffle(rows)
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
        out.append(Counter(map(tuple, trie.prefix_trie(*trie.rebuilt(trie.turns(df).cache())).collect())))
    assert out[0] == out[1] and sum(out[0].values()) > 100
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(*trie.rebuilt(trie.turns(empty))).collect() == []


# the ranked search


def slow_ranking(rows, items, k):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    counts = [(i, Counter(terms(t))) for i, t in rows]
    counts = [(i, c, c.total()) for i, c in counts if c]
    total, length, df = len(counts), sum(n for *_, n in counts), Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counts:
            m = 100 - 50 + (50 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in {*terms(text)} if w in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("whole", [False, True])
def test_ranking_is_that_of_all_documents(spark, monkeypatch, whole):
    """Small clusters and blocks, so that bounds and thresholds decide; with an index of the items' terms and of all terms."""
    for name, value in (("LEAF", 6), ("BLOCK", 40), ("SAMPLE", 80), ("ITEMS", 7), ("FIRST", 2)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(5)
    rows = docs() + [(5000 + i, prose(rng, rng.randint(5, 60)) + rng.choice(["", " Ünï-code 42x", " the same words"])) for i in range(250)] + [(7000 + i, "copies of one text, all the same") for i in range(60)]
    items = [(i, prose(rng, 12)) for i in range(12)] + [(20, None), (21, "..."), (22, "the SAME same words"), (23, "nowhere-to-be-found"), (None, "copies"), (24, "Ünï 42X"), (22, "one text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old")).withColumn("cluster", F.lit(1)).repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    made = lexical.index(df, None if whole else lexical.vocabulary_of(asked))
    assert made.table.count() > 20
    got = lexical.search(made, asked, 5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == slow_ranking(rows, items, 5)


def test_empty_tables_rank_nothing(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert lexical.search(lexical.index(none), one).collect() == []
    assert lexical.search(lexical.index(one.withColumnRenamed("item_id", "doc_id")), one.where("false")).collect() == []
    assert lexical.search(lexical.index(spark.createDataFrame([(1, None), (2, " .,")], "doc_id long, text string")), one).collect() == []


def test_bisection_puts_like_documents_together():
    rng = np.random.default_rng(3)
    topic = rng.integers(0, 8, 512)
    doc = np.repeat(np.arange(512), 12)
    term = topic[doc] * 30 + rng.integers(0, 30, len(doc))
    leaf = lexical.bisected(512, doc, term, 3)
    assert (np.bincount(leaf) == 64).all()
    mixed = np.mean([len(np.unique(topic[leaf == k])) for k in range(8)])
    assert mixed <= 4
