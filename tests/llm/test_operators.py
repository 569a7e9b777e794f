"""Each operator on small inputs: against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
import urllib.parse
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tallyforge.llm import editprint, language, mixing, neighbours, packing, secrets, simhash, suffixes, tokens, toxicity
from tallyforge.llm.common import ship
from tallyforge.llm.queries import tokenizer

WORDS = "amber basil cedar delta ember fable grove harbor island jungle kernel lemon meadow nectar olive pepper quartz river saffron tulip".split()
SCHEMA = "doc_id long, text string"
LONG = " ".join(WORDS[i % 20] + str(i % 977) for i in range(30_000))


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n))


def docs():
    """Ids and texts with all that can be odd."""
    rng = random.Random(3)
    base = [(i, prose(rng, rng.randint(60, 200))) for i in range(40)]
    copies = [(100 + i, base[i][1]) for i in range(10)]
    near = [(200 + i, base[i][1].replace(" ", "  ", 1)) for i in range(5)]
    passage = prose(rng, 60)
    shared = [(300 + i, f"{prose(rng, 20)} {passage} {prose(rng, 20)}") for i in range(3)]
    odd = [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "two words"), (405, "é 漢字 🙂 <|endoftext|> x\x1fy"), (406, LONG), (407, "!!! 12 ---"), (None, "no id at all"), (408, "same"), (408, "same")]
    return base + copies + near + shared + odd


@pytest.fixture(scope="module")
def table(spark):
    ship(spark)
    return spark.createDataFrame(docs(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


# token counts


def test_token_counts_are_the_librarys(table, empty):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    got = rows(tokens.count_tokens(table.withColumn("n_tokens", F.lit(-1)).withColumn("keep", F.lit("k")), path))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"], r["keep"]) for r in got) == Counter(
        (i, len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False).ids), n > 2048, "k") for i, t in docs()
    )
    assert rows(tokens.count_tokens(empty, path)) == []


def test_merging_takes_overlapping_runs_from_the_left():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    own, merger = Tokenizer.from_file(path), tokens.RankMerger(tokens.load(path))
    words = ["a" * n for n in range(1, 40)] + ["abab" * n for n in range(1, 9)] + ["zzyzx", "é", "ß" * 7]
    assert merger.counts(words).tolist() == [len(own.encode(w, add_special_tokens=False).ids) for w in words]


# packing


def test_packing_is_exact_and_tight(table, empty):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    got = rows(packing.pack(table, path))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in docs():
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        if i != 408:
            assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist() and sum(r["length"] for r in pieces) == len(ids)
            assert [r["piece"] for r in pieces] == list(range(len(pieces))) and all(r["length"] == 2048 for r in pieces[1:])
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert len(by_doc[408]) == 2
    total = 0
    for places in by_seq.values():
        places.sort()
        assert [a for a, _ in places] == np.cumsum([0] + [n for _, n in places])[:-1].tolist()
        assert sum(n for _, n in places) <= 2048
        total += sum(n for _, n in places)
    assert len(by_seq) <= math.ceil(total / 2048) + 1
    assert rows(packing.pack(empty, path)) == []


def test_local_search_empties_bins_and_raises_squared_fill():
    rng = random.Random(5)
    sizes = [rng.randint(1, 90) for _ in range(300)]
    items = list(range(300))
    bins = [items[i : i + 2] for i in range(0, 300, 2)]
    bins = [b for b in bins if sum(sizes[i] for i in b) <= 100] + [[i] for b in bins if sum(sizes[i] for i in b) > 100 for i in b]
    square = lambda bs: sum(sum(sizes[i] for i in b) ** 2 for b in bs)
    better = packing.search([list(b) for b in bins], sizes, 100)
    assert sorted(i for b in better for i in b) == items and all(sum(sizes[i] for i in b) <= 100 for b in better)
    assert square(better) > square(bins) and len(better) < len(bins)


# secrets


def test_base_spans_are_those_of_the_patterns(table):
    got = {r["doc_id"]: r for r in rows(secrets.scan_secrets(table))}
    assert all(r["n_assign"] == r["n_access"] == r["n_hex"] == 0 and r["spans"] == "" for r in got.values())
    text = 'x API_KEY: "abcdefgh1" y token=short password = longenough; AKIAABCDEFGHIJKL AKIAX ' + "a1" * 16 + " " + "b2" * 15
    base, _ = secrets.scan(text)
    want = [("assign", m.start(), m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    assert base == sorted(want, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


LAYERS = {
    "url": lambda s: urllib.parse.quote(s, safe=""),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    "zlib": lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
}


@pytest.mark.parametrize("outer", LAYERS)
@pytest.mark.parametrize("inner", LAYERS)
def test_nested_layers_map_back_to_their_span(outer, inner):
    wrapped = LAYERS[outer](LAYERS[inner]("password = hunter2hunter2"))
    text = f"ünï code {wrapped} and more"
    base, spans = secrets.scan(text)
    at = text.index(wrapped)
    found = [s for s in spans if s[0] == "assign" and s not in base]
    assert any(at <= a and b <= at + len(wrapped) + 1 for _, a, b in found), (text, spans)
    assert {*base} <= {*spans}


def test_a_stream_that_holds_itself_ends(monkeypatch):
    monkeypatch.setattr(secrets, "packed", lambda raw: raw in (b"round token", b"and token"))
    monkeypatch.setattr(secrets, "inflated", lambda chunks: iter([b"round token" if next(iter(chunks)) == b"and token" else b"and token"]))
    assert [*secrets.windows(b"round token")] == ["round token"]


def test_large_streams_are_scanned_in_windows(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 4000)
    monkeypatch.setattr(secrets, "OVERLAP", 200)
    raw = b"a b " * 5000 + b"password=hunter2hunter2 " + b"c d " * 5000
    for packed in (zlib.compress(raw), gzip.compress(zlib.compress(raw)), gzip.compress(raw[:9990]) + gzip.compress(raw[9990:])):
        found = [*secrets.windows(packed)]
        assert any("password=hunter2hunter2" in w for w in found) and max(map(len, found)) < 9000


CODE = lambda s: base64.b64encode(s.encode()).decode()
ONE, TWO = CODE("password = firstfirst1"), CODE("token: secondsecond")


@pytest.mark.parametrize("sign", ["-", "_", "/", "+"])
def test_all_parts_of_a_run_are_decoded(sign):
    text = f"see {ONE.rstrip('=')}{sign}{TWO} end"
    spans = [s for s in secrets.scan(text)[1] if s[0] == "assign"]
    at = text.index(TWO[:20])
    assert any(a < at for _, a, _ in spans) and any(a >= at - 1 for _, a, _ in spans), spans


def test_bytes_that_are_no_text_hide_nothing():
    secret = "token=abcdefgh1234"
    hidden = {
        "url": "".join(f"%{b:02x}" for b in secret.encode() + b"\xff"),
        "surrogate": "".join(f"\\u{ord(c):04x}" for c in secret) + "\\ud800",
        "nul": base64.b64encode(b"\0 " + secret.encode()).decode(),
        "bad byte": base64.b64encode(b"\xff\xfe " + secret.encode()).decode(),
        "lines": base64.encodebytes(gzip.compress((prose(random.Random(3), 60) + " " + secret).encode())).decode(),
        "url of zlib": urllib.parse.quote(zlib.compress((secret + " " + prose(random.Random(4), 9)).encode())),
        "escaped zlib": "".join(f"\\x{b:02x}" for b in zlib.compress((secret + " and more").encode())),
    }
    for name, coded in hidden.items():
        text = f"head {coded.strip()} tail"
        base, spans = secrets.scan(text)
        assert not base and any(k == "assign" and 4 <= a < b <= len(text) - 4 for k, a, b in spans), (name, spans)


def test_decoding_ends_and_redaction_covers(spark):
    assert secrets.scan("%25" * 200 + "41")[1] == []
    texts = [(1, "see password=abcdefghij now"), (2, None), (3, "")]
    df = spark.createDataFrame(texts, SCHEMA).withColumn("spans", F.lit("old"))
    got = {r["doc_id"]: r for r in rows(secrets.scan_secrets(df, redact=True))}
    assert got[1]["text"] == "see [REDACTED] now" and got[2]["text"] is None and got[3]["text"] == "" and got[3]["spans"] == ""
    assert rows(secrets.scan_secrets(df.where("false"))) == []


# SimHash


def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower() if (text or "").isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), text).encode())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components_are_those_of_all_pairs(table, empty):
    got = rows(simhash.near_duplicates(table.withColumn("component_id", F.lit(-5))))
    prints = [slow_print(t) for _, t in docs()]
    assert Counter((r["doc_id"], r["fp"] % 2**64) for r in got) == Counter((i, p) for (i, _), p in zip(docs(), prints, strict=True))
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                up[root(i)] = root(j)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(docs()):
        ids[root(k)].append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((i, least[root(k)]) for k, (i, _) in enumerate(docs()))
    assert rows(simhash.near_duplicates(empty)) == []


def test_trees_find_every_pair_in_dense_shards(monkeypatch):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**64, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (400, 4), dtype=np.uint64), axis=1) for c in centre]))
    shard = np.zeros(len(fps), np.int64)
    monkeypatch.setattr(simhash, "FRONTIER", 1000)
    forest = simhash.Forest(shard, fps)
    found = {(int(q), int(n)) for a, b in forest.search(np.arange(len(fps)), 3) for q, n in zip(a, b, strict=True)}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True)}


def test_more_blocks_for_more_fingerprints():
    assert [simhash.blocks_over(10**n, 3) for n in (0, 6, 7, 9, 12)] == [1, 1, 1, 2, 3]
    assert [len(simhash.choices(k, 3)) for k in (1, 2, 3)] == [4, 10, 20]
    assert all(min(m.bit_count() for m in simhash.choices(k, 3)) >= 64 * k // (k + 3) - k for k in (1, 2, 3))


@pytest.mark.parametrize("over", [1, 2, 3])
def test_crowded_shards_lose_no_link(spark, monkeypatch, over):
    monkeypatch.setattr(simhash, "CROWDED", 24)
    rng = np.random.default_rng(2)
    fps = np.unique(np.uint64(77) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (200, 3), dtype=np.uint64), axis=1)).astype(np.int64)
    links = simhash.link_table(spark.createDataFrame([(int(f),) for f in fps], "fp long"), over=over).collect()
    union = {int(f): int(f) for f in fps}

    def root(x):
        while union[x] != x:
            x = union[x]
        return x

    for r in links:
        assert bin((r.a ^ r.b) & (2**64 - 1)).count("1") > 0
        union[root(r.a)] = root(r.b)
    want = {int(f): int(f) for f in fps}
    for i in fps:
        for j in fps:
            if bin((int(i) ^ int(j)) & (2**64 - 1)).count("1") <= 3:
                a, b = int(i), int(j)
                while want[a] != a:
                    a = want[a]
                while want[b] != b:
                    b = want[b]
                want[a] = b

    def top(x):
        while want[x] != x:
            x = want[x]
        return x

    groups = lambda f: {frozenset(x) for x in __import__("itertools").groupby([])} or {frozenset(k for k in union if f(k) == r) for r in {f(k) for k in union}}
    assert groups(root) == groups(top)


# language


def labelled(spark, n=60):
    en, fr = "the and of with ing tion that there which house".split(), "le les une avec être où déjà maison qui que".split()
    rng = random.Random(9)
    make = lambda ws, k: " ".join(rng.choice(ws) for _ in range(k))
    data = [(i, make(en if i % 2 else fr, 30), "en" if i % 2 else "fr") for i in range(n)]
    return data, spark.createDataFrame(data, "doc_id long, text string, lang string"), make, en, fr


def test_language_spans_of_mixed_text(spark, table, empty):
    data, df, make, en, fr = labelled(spark)
    model = language.learn(df, "text", "lang")
    got = {r["doc_id"]: r for r in rows(language.identify(df.drop("lang").withColumn("score", F.lit("x")), model, spans=True))}
    assert all(got[i]["lang_pred"] == x and 0.9 <= got[i]["score"] <= 1 for i, _, x in data)
    first, second = make(en, 25), make(fr, 25)
    mixed = rows(language.identify(spark.createDataFrame([(1, f"{first} {second}")], SCHEMA), model, spans=True))[0]
    assert [s["lang"] for s in mixed["spans"]] == ["en", "fr"] and abs(mixed["spans"][1]["start"] - len(first)) < 20
    odd = {r["doc_id"]: r for r in rows(language.identify(table, model))}
    assert len(odd) and all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (400, 401, 402, 407))
    assert odd[406]["lang_pred"] in ("en", "fr")
    swollen = language.learn(df.unionByName(df.where("doc_id = 0").crossJoin(spark.range(50)).select(df.columns)), "text", "lang")
    assert all((a == b).all() if isinstance(a, np.ndarray) else a == b for a, b in zip(model, swollen, strict=True))
    none = language.learn(df.where("false"), "text", "lang")
    assert {r["lang_pred"] for r in rows(language.identify(table, none))} == {"und"}
    assert rows(language.identify(empty, model)) == []


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    sizes = np.array([1, 0, 7, 3])
    scores = rng.normal(size=(11, 3)).astype(np.float32)
    offsets = np.append(0, np.cumsum(sizes))
    got = language.viterbi(scores, offsets, 0.7)
    import itertools

    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        value = lambda path, a=a: sum(scores[a + k, s] for k, s in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:], strict=False))
        best = max(map(value, itertools.product(range(3), repeat=int(b - a))))
        assert abs(value(got[a:b]) - best) < 1e-5


def test_scripts_narrow_the_candidates(spark):
    df = spark.createDataFrame([(i, "привет мир как дела" if i % 2 else "hello world how are you", "ru" if i % 2 else "en") for i in range(20)], "doc_id long, text string, lang string")
    model = language.learn(df, "text", "lang")
    got = {r["doc_id"]: r["lang_pred"] for r in rows(language.identify(spark.createDataFrame([(1, "щука"), (2, "zebra")], SCHEMA), model))}
    assert got == {1: "ru", 2: "en"}


# toxicity


def test_toxicity_learns_from_document_labels_and_locates(spark, table, empty):
    rng = random.Random(6)
    data, labels = [], []
    for i in range(300):
        s = [prose(rng, 8) for _ in range(6)]
        if i % 3 == 0:
            s[rng.randrange(6)] += " vilewordx"
        data.append((i, ". ".join(s) + "."))
        labels.append((i, int(i % 3 == 0)))
    df, lab = spark.createDataFrame(data, SCHEMA), spark.createDataFrame([*labels, (5, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    weights = toxicity.learn(df.where("doc_id < 200"), lab)
    got = {r["doc_id"]: r for r in rows(toxicity.scored(df.withColumn("predicted", F.lit("x")), weights, locate=True))}
    assert all(got[i]["predicted"] == y for i, y in labels if i >= 200)
    for i, t in data[201:240:3]:
        assert [o["sentence"] for o in got[i]["offending"]] == [k for k, s in enumerate(t.split(".")) if "vilewordx" in s]
    odd = {r["doc_id"]: r for r in rows(toxicity.scored(table, weights))}
    assert len(odd) and all(0 <= r["score"] <= 1 for r in odd.values()) and all(odd[i]["score"] == 0 and odd[i]["predicted"] == 0 for i in (400, 401, 402))
    assert rows(toxicity.scored(empty, toxicity.learn(empty, lab.where("false")))) == []


# mixture


def test_mixture_budgets_and_prefixes(spark, empty):
    rng = random.Random(8)
    data = [(i, "x" * rng.randint(0, 90), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c"])) for i in range(500)] + [(7, "x" * 9, "en", "a")] * 3 + [(600, None, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").withColumn("domain", F.when(F.col("source") == "a", "web").otherwise("books"))
    size = lambda t: max(1, math.ceil(len((t or "").encode()) / 4))
    supply = sum(size(t) for _, t, _, _ in data)
    for total, epochs in ((supply // 2, 1), (supply, 2), (10 * supply, 2), (0, 1)):
        got = rows(mixing.mix(df, {"domain": {"web": 1, "books": 3}, "lang": {"en": 2}}, total, epochs, 5))
        taken = sum(r["n_tokens"] for r in got)
        assert taken <= min(total, epochs * supply) and taken >= min(total, epochs * supply) - 25 * 12
        assert max((r["epoch"] for r in got), default=0) < epochs
        assert all(c <= epochs for c in Counter(r["doc_id"] for r in got if r["doc_id"] != 7).values())
    # with enough of everything the weights hold
    got = rows(mixing.mix(df, {"domain": {"web": 1, "books": 3}}, supply // 4, 1, 5))
    share = sum(r["n_tokens"] for r in got if r["domain"] == "web") / sum(r["n_tokens"] for r in got)
    assert abs(share - 0.25) < 0.05
    none = empty.withColumn("lang", F.lit("en")).withColumn("source", F.lit("a")).withColumn("domain", F.lit("d"))
    assert rows(mixing.mix(none, {}, 100)) == []


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d1", "en", "a", 10, 1, 1, 1), ("d1", "en", "b", 500, 1, 1, 1), ("d1", "fr", "a", 500, 1, 1, 1), ("d2", "en", "a", 900, 1, 1, 1)], "domain string, lang string, source string, supply long, w_domain long, w_lang long, w_source long")
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in rows(mixing.budgets(leaves, 400, 1))}
    assert got == {("d1", "en", "a"): 10, ("d1", "en", "b"): 90, ("d1", "fr", "a"): 100, ("d2", "en", "a"): 200}


# edit fingerprints


def test_edited_texts_and_likeness(spark, table, empty):
    got = rows(editprint.edited_likeness(table))
    order = sorted(docs(), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert all(prints[i] == prints[100 + i] for i in range(10)) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert np.mean([r["near_edited"] for r in got if r["n_chars"] > 300]) > 0.4 > 0.25 > np.mean([r["near_next"] for r in got if r["n_chars"] > 300 and r["near_next"] < 1])
    assert rows(editprint.edited_likeness(empty)) == []


def test_rows_of_one_id_are_dealt_to_several_parts(spark):
    """Two thirds of all rows have one id or none: parts follow the order, stay small, and each ends with the first row of the next."""
    ship(spark)
    big = 1 << 60  # doubles do not tell its neighbours apart
    data = [(7, f"seven {k}") for k in range(600)] + [(None, f"none {k}") for k in range(300)] + [(big + k, f"big {k}") for k in range(200)] + [(-k, f"low {k}") for k in range(150)] + [(9, "same")] * 60
    random.Random(5).shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    dealt = editprint.with_next(df, part_rows=20).collect()
    own, guests = defaultdict(list), defaultdict(list)
    for r in dealt:
        (guests if r.guest else own)[r.part].append((r.id, zstandard.ZstdDecompressor().decompress(bytes(r.text)).decode()))
    assert sorted(own) == [*range(len(own))] and len(own) > 40
    line = [row for p in sorted(own) for row in own[p]]
    assert Counter(line) == Counter(data)
    assert [i for i, _ in line] == sorted([i for i, _ in data], key=lambda i: (i is None, -(i or 0)))
    assert all(guests[p][0] == own[(p + 1) % len(own)][0] for p in own)
    assert max(map(len, own.values())) <= 200 and max(len({i for i in rows_ if i[0] in (7, None)}) for rows_ in own.values()) < 60


def test_walk_is_the_plain_walk():
    bits = np.random.default_rng(42).integers(0, 2, (editprint.KINDS, editprint.PERIOD), dtype=np.int8)
    bits[:, -1] = 1
    kept = editprint.times()
    rng = random.Random(2)
    texts = [prose(rng, n) for n in [1, 2, 5, 50, 300] * 15] + ["", "a"]

    def plain(t):
        codes, i, out, time = editprint.kinds(t).tolist(), 0, [], 0
        while i < len(codes):
            out.append(codes[i])
            i += int(bits[codes[i], time % editprint.PERIOD])
            time += 1
        return "".join("%x" % out[k] for k in kept if k < len(out))

    assert editprint.Walker().fingerprints(texts)[0] == [plain(t) for t in texts]


@pytest.mark.parametrize("members", [8192, 6])
def test_no_link_of_a_band_is_lost(spark, monkeypatch, members):
    """A frame that all share: A near C, B between them near neither; bands of one task and of several."""
    monkeypatch.setattr(editprint, "MEMBERS", members)
    rng = random.Random(5)
    frame = prose(rng, 200)
    texts = [frame[:k] + prose(rng, n) + frame[k + n :] for k, n in [(300, 2), (900, 30), (301, 2), (500, 3), (20, 1), (1200, 5)] * 4]
    prints, up = editprint.Walker().fingerprints(texts)[0], list(range(24))
    for i in range(24):
        for k in range(i):
            if editprint.likeness(prints[i], prints[k]) >= 0.8:
                old, new = max(up[i], up[k]), min(up[i], up[k])
                up = [new if x == old else x for x in up]
    got = [r["component_id"] for r in sorted(rows(editprint.near_duplicates(spark.createDataFrame([*enumerate(texts)], SCHEMA))), key=lambda r: r["doc_id"])]
    assert sum(a == b for a, b in zip(got, up, strict=True)) >= 22 and all(a >= b for a, b in zip(got, up, strict=True))


def test_few_edits_stay_near_and_are_verified(spark):
    rng = random.Random(12)
    base = [prose(rng, 200) for _ in range(20)]
    edited = [t[:700] + "xy" + t[701:] for t in base]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(base)] + [(100 + i, t) for i, t in enumerate(edited)], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in rows(editprint.near_duplicates(df, edits=4))}
    assert sum(got[100 + i] == i for i in range(20)) >= 18 and all(got[i] == i for i in range(20))
    # banding and verification against the likeness of all pairs
    prints = editprint.Walker().fingerprints([*base, *edited])[0]
    likely = [(i, k) for i in range(40) for k in range(i) if editprint.likeness(prints[i], prints[k]) >= editprint.NEAR]
    got = {r["doc_id"]: r["component_id"] for r in rows(editprint.near_duplicates(df))}
    at = lambda i: got[i if i < 20 else 80 + i]
    assert len(likely) >= 10 and sum(at(i) == at(k) for i, k in likely) >= 0.9 * len(likely)
    assert editprint.within("kitten", "sitting", 3) and not editprint.within("kitten", "sitting", 2) and editprint.within("", "", 0) and not editprint.within("abc", "", 2)


# repeated passages


def slow_passages(data):
    texts = defaultdict(str)
    for i, t in data:
        if i is not None:
            texts[i] = t or ""
    where, words = defaultdict(set), {i: t.lower().split() for i, t in texts.items()}
    for i, w in words.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    out = set()
    for i, w in words.items():
        spans = [m.span() for m in re.finditer(r"\S+", texts[i])]
        run = None
        for k in range(len(w) - 49):
            if len(where[tuple(w[k : k + 50])]) > 1:
                run = (run[0], k + 50) if run and k <= run[1] else (out.add((i, spans[run[0]][0], spans[run[1] - 1][1], run[1] - run[0])) if run else None, (k, k + 50))[1]
        if run:
            out.add((i, spans[run[0]][0], spans[run[1] - 1][1], run[1] - run[0]))
    return out


def test_passages_are_those_of_all_windows(table, empty):
    got = rows(suffixes.repeated_passages(table.withColumn("start", F.lit(1)).withColumn("id", F.lit("x"))))
    assert {(r["doc_id"], r["start"], r["end"], r["n_words"]) for r in got} == slow_passages(docs()) and len(got) > 20
    assert rows(suffixes.repeated_passages(empty)) == []


# neighbours


def vectors():
    rng = np.random.default_rng(7)
    m = rng.normal(size=(1200, 24)).astype(np.float32)
    m[300:700] = m[0]  # a third are copies
    m[700:720] = m[1] * 2
    data = [(i, [float(x) for x in row]) for i, row in enumerate(m)]
    odd = [(5000, None), (5050, [0.0] * 24), (5100, [math.nan] * 24), (5150, [math.inf] + [1.0] * 23), (5200, [1.0] * 3), (5250, [1.0] * 23 + [None]), (None, [1.0] * 24)]
    return data, odd


def test_neighbours_are_nearly_all_found(spark):
    ship(spark)
    data, odd = vectors()
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in sorted(rows(neighbours.nearest(df)), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    m = np.array([v for _, v in data])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = 0
    assert set(got) == set(range(0, 1200, 50))
    for q, found in got.items():
        score = unit @ unit[q]
        score[q] = -9
        order = np.lexsort((np.arange(1200), -np.round(score, 12)))[:5]
        assert len(found) == 5 and q not in [i for i, _ in found]
        assert all(abs(score[i] - s) < 1e-12 for i, s in found) and all(a[1] >= b[1] for a, b in zip(found, found[1:], strict=False))
        hits += len({i for i, _ in found} & set(order.tolist()))
    assert hits >= 0.9 * 5 * len(got)
    assert [i for i, _ in got[300]] == [0, 301, 302, 303, 304]


def test_few_vectors_are_searched_exactly(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.1]), (50, [1.0, 0.2])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in rows(neighbours.nearest(df))]
    assert sorted(got) == [(0, 1, 50), (0, 2, 1), (0, 3, 2), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert rows(neighbours.nearest(df.where("false"))) == []
    assert rows(neighbours.nearest(df.where("vec_id = 0"))) == []


def test_toxic_words_are_learned_beside_many_copies(spark):
    """A third of all rows are copies of one toxic text; the other toxic texts are few, and so is the sample."""
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("amber basil cedar delta ember fable grove harbor island jungle".split()) for _ in range(12))
    rows = [(i, "copied words all over", 1) for i in range(1000)]
    rows += [(1000 + i, f"{text()}. {text()} vileword" if i % 33 == 0 else f"{text()}. {text()}", int(i % 33 == 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"), sample=60)
    found = toxicity.scored(spark.createDataFrame([(1, "amber vileword basil"), (2, "amber basil cedar")], "doc_id long, text string"), weights).collect()
    assert {r.doc_id: r.predicted for r in found} == {1: 1, 2: 0}


def test_toxic_features_of_small_samples():
    """A word of 25 toxic documents and no clean one is a feature; one of as many of both is not."""
    assert toxicity.telling(np.array([25, 25]), np.array([25, 50]), 0.5).tolist() == [True, False]


def test_neighbours_of_isolated_queries(spark):
    """A query whose buckets hold four others only, and a table of two distinct vectors: five neighbours each."""
    two = [(i, [1.0, 0.0, 0.0]) for i in range(1, 11)] + [(50, [0.0, 1.0, 0.0])]
    got = neighbours.nearest(spark.createDataFrame(two, "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(50, i) for i in range(1, 6)]
    rng = np.random.default_rng(5)
    main = np.eye(16)[0] + 0.25 * rng.standard_normal((400, 16))
    few = -np.eye(16)[0] + 0.01 * rng.standard_normal((5, 16))
    table = {1000 + 2 * i + 1: v for i, v in enumerate(main)} | {50: few[0]} | {i: few[i] for i in range(1, 5)}
    got = neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in table.items()], "vec_id long, embedding array<double>")).collect()
    cosine = {i: float(v @ few[0] / np.linalg.norm(v) / np.linalg.norm(few[0])) for i, v in table.items() if i != 50}
    ids = [r.vec_id for r in sorted(got, key=lambda r: r["rank"])]
    assert len(ids) == 5 and ids[:4] == sorted(cosine, key=lambda i: -cosine[i])[:4]


def test_repeated_rows_of_a_vector_keep_the_smallest_ids(spark):
    """A vector of many rows, some of equal id, in many batches: its smallest different ids, and whether any of them asks."""
    ship(spark)
    data = [(k // 3 + 1, [1.0, 0.0]) for k in range(3000)] + [(7001, [0.0, 1.0])]
    df = spark.createDataFrame(data, "id long, v array<double>").repartition(7)
    got = {len(r.ids): (sorted(r.ids), r.asked) for r in neighbours.classes(df, 2, 50, 6).collect()}
    assert got == {6: ([1, 2, 3, 4, 5, 6], True), 1: ([7001], False)}
    plan = neighbours.classes(df, 2, 50, 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "collect_list" not in plan
    # each row that asks has its answer, in which an id stands once
    found = Counter((r["rank"], r.vec_id) for r in neighbours.nearest(df, "id", "v").where("query_id = 50").collect())
    assert found == {(k, k): 3 for k in range(1, 6)}


# local search, components, finer shards, Unicode, near-copies of crowded shards


def steps_left(bins, sizes, limit):
    """Every move and exchange of three documents at most that would raise the sum of squared fills."""
    from itertools import combinations

    fill = [sum(sizes[i] for i in b) for b in bins]
    sums = [{n: {sum(sizes[i] for i in x) for x in combinations(b, n)} for n in (0, 1, 2)} for b in bins]
    for a in range(len(bins)):
        for b in range(len(bins)):
            for n, m in ((1, 0), (2, 0), (1, 1), (2, 1), (1, 2)):
                for s in sums[a][n] if a != b else ():
                    for r in sums[b][m]:
                        if 0 < s - r <= limit - fill[b] and fill[b] + s - r > fill[a]:
                            yield a, b, s, r


@pytest.mark.parametrize("low, high, n", [(600, 1500, 60), (300, 700, 60), (1, 2047, 50), (50, 150, 80), (100, 100, 60)])
def test_no_step_is_left(low, high, n):
    rng = random.Random(n + low)
    for start in ("best fit", "one each"):
        sizes = [rng.randint(low, high) for _ in range(n)]
        bins = packing.best_fit(sizes, 2048) if start == "best fit" else [[i] for i in range(n)]
        assert not [*steps_left(found := packing.search([list(b) for b in bins], sizes, 2048), sizes, 2048)]
        assert sorted(i for b in found for i in b) == list(range(n)) and max(sum(sizes[i] for i in b) for b in found) <= 2048 and len(found) <= len(bins)


def test_middle_sized_documents_pack_near_the_bound():
    rng = random.Random(1)
    sizes = [rng.randint(300, 700) for _ in range(2000)]
    assert len(packing.search(packing.best_fit(sizes, 2048), sizes, 2048)) <= 1.01 * math.ceil(sum(sizes) / 2048)


def test_ids_of_stretches_are_the_librarys():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    own, coder, rng = Tokenizer.from_file(path), packing.Coder(path), random.Random(1)
    pool = [*" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　'\"`.,-_<|>abXYZ019éß漢字🙂́", *([" "] * 12), "<|endoftext|>", "'s", "  ", "\n\n", "word.\nNext", "word,"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for _ in range(2):  # the second time from memory
        assert [x.tolist() for x in coder.encode(pa.array(texts))] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_counts_of_any_unicode():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    own, spec, rng = Tokenizer.from_file(path), tokens.load(path), random.Random(4)
    splitter, merger = tokens.Splitter(spec, own), tokens.RankMerger(spec)
    letter = lambda: chr(c) if not 0xD800 <= (c := rng.choice([rng.randrange(0x250), rng.randrange(0x3100), rng.randrange(0x110000), 32, 97])) < 0xE000 else " "
    texts = ["".join(letter() for _ in range(20)) for _ in range(3000)] + ["\U00018e89 ࢏ x", "Σας ΣΑΣ"]
    for t in texts:
        between, special = splitter.segments(t)
        assert len(special) + int(merger.counts([p for s in between for p in splitter.pieces(s)]).sum()) == len(own.encode(t, add_special_tokens=False).ids), ascii(t)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    from tallyforge.llm import components as C

    rounds = []
    ends = C.ends
    monkeypatch.setattr(C, "ends", lambda to: rounds.append(1) or ends(to))
    links = [(i, i + 1) for i in range(999)] + [(5000 + i, 5001 + i % 7) for i in range(30)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(links, "a long, b long").coalesce(1)).collect()}
    assert all(got[i] == 0 for i in range(1000)) and got[5003] == 5000 and len(rounds) < 15


def test_rounds_of_components_do_not_square_the_planned_size(spark):
    from tallyforge.llm import components as C

    got = C.components(spark.range(2000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b")))
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 1000
    assert got.count() == 2001 and got.select("component").distinct().count() == 1


def test_finer_shards_keep_near_pairs():
    rng = random.Random(2)
    mask = simhash.choices(1, 3)[1]
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample([x for x in range(64) if not mask >> x & 1], 3):
            b ^= 1 << bit
        assert any(a & m == b & m for m in simhash.finer(mask, 3))


def jaccard_groups(texts):
    from tallyforge.llm import copies

    sets = [{*copies.shingles(t).tolist()} for t in texts]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("members", [8192, 16])
def test_near_copies_are_those_of_all_pairs(spark, monkeypatch, members):
    """A large group whose edits range from none to many, some small groups and odd texts; shards of one task and of several."""
    from tallyforge.llm import copies

    monkeypatch.setattr(copies, "MEMBERS", members)
    rng = random.Random(8)
    centre = prose(rng, 150).split()
    texts = []
    for _ in range(90):
        words = list(centre)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"edit{rng.random()}"
        texts.append(" ".join(words))
    texts += [prose(rng, 120) for _ in range(20)] + [t + " tail" for t in texts[:3]] + ["", "one", "one", "two words", "six little words in a row"]
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (500, None)], SCHEMA).repartition(4)
    want = jaccard_groups(texts)
    got = {(r.doc_id, r.key) for r in copies.near_copies(df).collect()}
    assert got == {(i, hashlib.sha256(texts[i].encode()).hexdigest()) for i in sorted({*want})}
