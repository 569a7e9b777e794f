"""Language identification: script ranges narrow the candidates, Viterbi labels spans.

Words are runs of letters. Their script (by Unicode ranges) leaves only the languages that were seen in it. A word's score
for a language is the mean log-probability of its hashed letter groups. Viterbi over a text's words, with a penalty for each switch,
gives labelled spans, so mixed texts are told apart; the label that covers most letters is the text's language.

The letter groups' counts are learned on Spark from a bounded sample of labelled texts; at most ``sample`` different texts of each
language are expected in it, chosen by a hash of the text. Copies of a text in one language count once, in the sample and in the rate at which it is drawn, so that copies
neither swell a language nor push its other texts out. At most ``LANGUAGES`` languages are learned, those of most different texts.

Null texts, and texts without a letter, have language ``und``, score 0 and no spans. Labels that are null are not learned from.
Columns of the result's names are replaced. Without any labelled text every result is ``und``.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_step, held_out, read

UND = "und"
#: Languages that are learned at most.
LANGUAGES = 300
SAMPLE = 4000
BUCKETS = 1 << 16
#: A multiplier that spreads a group's letters over 64 bits, of which the uppermost 16 are its bucket.
MIX, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(48)
GROUPS = (1, 2, 3, 4)
SWITCH = 3.0
#: Words whose scores one worker remembers.
REMEMBERED = 300_000
WORDS = re.compile(r"[^\W\d_]+")
#: First code points of script ranges, by Unicode block; letters of a range share a script.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"),
    (0xFFA0, "other"), (0x20000, "han"),
)
STARTS = [a for a, _ in SCRIPTS]
NAMES = sorted({s for _, s in SCRIPTS})


def script(word: str) -> int:
    """The number of the script of a word's first letter."""
    return NAMES.index(SCRIPTS[bisect_right(STARTS, ord(word[0])) - 1][1])


def letter_groups(words: list[str]):
    """For each group length the hashed letter groups of all words, borders marked, and the word that each is of, in order."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    mixed = np.zeros(len(code), np.uint64)
    for n in GROUPS:
        mixed = (mixed[: len(code) - n + 1] if n == 1 else mixed[:-1]) * MIX + code[n - 1 :] + np.uint64(n)
        within = word[: len(mixed)] == word[n - 1 :]
        yield ((mixed[within] * MIX) >> SHIFT).astype(np.int64), word[: len(mixed)][within]


def learn(labelled: DataFrame, text: str, lang: str, sample: int = SAMPLE):
    """(languages, log-probabilities by bucket and language, whether each script and language meet)."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    different = known.select(F.col(lang).alias("lang_"), F.xxhash64(text).alias("same_")).distinct()
    rates = different.groupBy("lang_").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang_").limit(LANGUAGES).collect()
    langs = sorted(r.lang_ for r in rates)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool)
    rate = F.create_map(*[F.lit(x) for r in rates for x in (r.lang_, min(1.0, sample / r.n))])[F.col(lang)]
    chance = F.shiftrightunsigned(F.xxhash64(text), 11) / F.lit(float(1 << 53))
    chosen = known.where(F.col(lang).isin(langs) & (chance < rate)).select(F.col(text).alias("text_"), F.col(lang).alias("lang_"), F.xxhash64(text).alias("same_"))
    chosen = chosen.dropDuplicates(["same_", "lang_"]).select("text_", "lang_")

    def count(batches):
        number = {x: i for i, x in enumerate(langs)}
        total = np.zeros((len(langs), BUCKETS + len(NAMES)), np.int64)
        for batch in batches:
            words: dict[tuple[int, str], int] = {}
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = number[x]
                for w in WORDS.findall(t.lower()):
                    words[k, w] = words.get((k, w), 0) + 1
            label, some = np.array([k for k, _ in words], np.int64), [w for _, w in words]
            many = np.array([*words.values()], np.int64)
            for bucket, of in letter_groups(some):
                total += np.bincount(label[of] * total.shape[1] + bucket, many[of], total.size).astype(np.int64).reshape(total.shape)
            np.add.at(total, (label, BUCKETS + np.array([script(w) for w in some], np.int64)), many)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[k, b])], names=["k", "b", "n"])

    # at most one row for each bucket and language comes back
    rows = chosen.mapInArrow(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((BUCKETS + len(NAMES), len(langs)))
    total[rows["b"], rows["k"]] = rows["n"]
    met, total = total[BUCKETS:] > 0.001 * total[BUCKETS:].sum(axis=0), total[:BUCKETS] + 0.1
    return langs, np.log(total / total.sum(axis=0)).astype(np.float32), met


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word; texts are consecutive rows of ``scores``, text i from offsets[i] to offsets[i+1]. All texts
    advance together, word by word, the longest first."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    lengths, begin = lengths[order], offsets[:-1][order]
    most = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(most), "left")  # texts with more than t words
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int16)
    best = np.zeros((len(order), k), np.float32)
    stay, back = np.zeros((n, k), bool), np.zeros(n, np.int16)
    for t in range(most):
        m = active[t]
        at, b = begin[:m] + t, best[:m]
        top = b.argmax(axis=1)
        jump = b[np.arange(m), top] - np.float32(switch)
        keep = b >= jump[:, None]
        stay[at], back[at] = keep, top
        best[:m] = np.where(keep, b, jump[:, None]) + scores[at]
        best[:m] -= best[:m].max(axis=1, keepdims=True)
    label = best.argmax(axis=1)
    out = np.zeros(n, np.int16)
    for t in range(most - 1, -1, -1):
        m = active[t]
        at, now = begin[:m] + t, label[:m]
        out[at] = now
        label[:m] = np.where(stay[at, now], now, back[at])
    return out


def identify(docs: DataFrame, model, text: str = "text", switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """``docs`` without its text, with lang_pred, score (the share of letters in spans of that language), n_spans and, where
    asked for, spans: start, end (code points) and lang of each."""
    langs, table, met = model
    new = {"lang_pred": "string", "score": "double", "n_spans": "int"} | ({"spans": "array<struct<start:int,end:int,lang:string>>"} if spans else {})
    keep = [c for c in docs.columns if c not in (*new, text)]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {t}" for c, t in new.items()])
    shared = docs.sparkSession.sparkContext.broadcast((table, met))  # BUCKETS floats a language

    def run(batches):
        table, met = shared.value
        memory: dict[str, int] = {}
        known = [np.zeros((0, len(langs)), np.float32)]

        def word_scores(words: set[str]) -> np.ndarray:
            words = [w for w in words if w not in memory]
            made = np.zeros((len(words), len(langs)), np.float32)
            sizes = np.zeros((len(words), 1), np.float32)
            for bucket, of in letter_groups(words) if words else ():
                # every word has a group of one to three letters, as its borders count; longer groups are not in all
                starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
                if len(starts):
                    made[of[starts]] += np.add.reduceat(table[bucket], starts, axis=0)
                    sizes[of[starts], 0] += np.diff(np.append(starts, len(of)))
            made /= np.maximum(sizes, 1)
            allowed = met[[script(w) for w in words]] if words else np.zeros((0, len(langs)), bool)
            made = np.where(allowed | ~allowed.any(axis=1, keepdims=True), made, np.float32(-30))
            for i, w in enumerate(words):
                memory[w] = len(known[0]) + i
            known[0] = np.concatenate([known[0], made])

        def work(texts, part):
            found = [WORDS.findall(t.lower()) for t in texts] if langs else [[] for _ in texts]
            unmet = {w for ws in found for w in ws}
            if len(memory) + len(unmet) > REMEMBERED:
                memory.clear()
                known[0] = known[0][:0]
            word_scores(unmet)
            sizes = np.array([len(x) for x in found], np.int64)
            offsets = np.append(0, np.cumsum(sizes))
            at = np.fromiter((i for ws in found for i in map(memory.__getitem__, ws)), np.int64, int(offsets[-1]))
            label = viterbi(known[0][at], offsets, switch)
            letters = np.fromiter((n for ws in found for n in map(len, ws)), np.int64, int(offsets[-1]))
            text_of = np.repeat(np.arange(len(texts)), sizes)
            mass = np.bincount(text_of * len(langs) + label, letters, len(texts) * len(langs)).reshape(len(texts), -1) if langs else np.zeros((len(texts), 1))
            first = np.append(True, (label[1:] != label[:-1]) | (text_of[1:] != text_of[:-1]))[: len(label)]
            pred, total = mass.argmax(axis=1), mass.sum(axis=1)
            out = {c: part.column(part.schema.get_field_index(c)) for c in keep}
            out["lang_pred"] = pa.array([langs[p] if n else UND for p, n in zip(pred, total, strict=True)], pa.string())
            out["score"] = mass.max(axis=1) / np.maximum(total, 1)
            out["n_spans"] = np.bincount(text_of[first], minlength=len(texts)).astype(np.int32)
            if spans:
                out["spans"] = pa.array([labelled_spans(t, label[a:b]) for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)], pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32(), "lang": pa.string()})))
            return out

        def labelled_spans(t, labels):
            made: list[dict] = []
            # lower-casing can change lengths, so places are taken from the text itself
            places = [m.span() for m in WORDS.finditer(t)]
            if len(places) != len(labels):
                places = [m.span() for m in WORDS.finditer(t.lower())]
            for (a, b), k in zip(places, labels, strict=True):
                if made and made[-1]["lang"] == langs[k]:
                    made[-1]["end"] = b
                else:
                    made.append({"start": a, "end": b, "lang": langs[k]})
            return made

        yield from by_step(text, work)(batches)

    return docs.select(*keep, text).mapInArrow(run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 5, 0))
    model = learn(docs.where(~F.col("held_out")), "text", "lang")
    return identify(docs.drop("lang"), model)
