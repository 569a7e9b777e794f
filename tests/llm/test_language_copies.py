"""Languages that copies swell are learned all the same, and predictions are those of a plain predictor."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import language
from tallyforge.llm.common import ship

from .test_operators import prose


def test_copies_do_not_push_a_language_out(spark):
    ship(spark)
    own = ["zzqua zzovo zzmik zzlat", "zzqua zztor zzovo zzvem", "zzlat zzmik zzsab zzqua"]
    copies = spark.range(100_000).select(F.element_at(F.array(*map(F.lit, own)), (F.col("id") % 3 + 1).cast("int")).alias("text"), F.lit("xx").alias("lang"))
    rng = random.Random(2)
    others = spark.createDataFrame([(prose(rng, 40), "en") for _ in range(500)], "text string, lang string")
    model = language.learn(copies.unionByName(others), "text", "lang")
    assert model[0] == ["en", "xx"]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*own, prose(rng, 30)])], "doc_id long, text string")
    assert [r.lang_pred for r in language.identify(asked, model).orderBy("doc_id").collect()] == ["xx", "xx", "xx", "en"]


def test_predictions_are_those_of_a_plain_predictor(spark):
    """Scores and Viterbi word by word, without arrays, on the learned table."""
    ship(spark)
    rng = random.Random(4)
    alien = lambda n: " ".join("".join(rng.choice("zqxvk") for _ in range(rng.randint(3, 7))) for _ in range(n))
    rows = [(prose(rng, 30), "en") for _ in range(60)] + [(alien(30), "xx") for _ in range(60)]
    langs, table, met = model = language.learn(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    texts = [prose(rng, rng.randint(1, 20)) + " " + alien(rng.randint(0, 20)) for _ in range(40)] + ["12 34", ""]

    def scores(word):
        rows = [table[b] for groups, _ in language.letter_groups([word]) for b in groups.tolist()]
        mean = np.mean(rows, axis=0)
        allowed = met[language.script(word)]
        return [m if ok or not allowed.any() else -math.inf for m, ok in zip(mean, allowed, strict=True)]

    def plain(text):
        words = language.WORDS.findall(text.lower())
        if not words:
            return "und"
        best, back = [0.0] * len(langs), []
        for w in words:
            s = scores(w)
            came = [max(range(len(langs)), key=lambda j: best[j] - (language.SWITCH if j != k else 0)) for k in range(len(langs))]
            back.append(came)
            best = [best[came[k]] - (language.SWITCH if came[k] != k else 0) + s[k] for k in range(len(langs))]
        label, weight = max(range(len(langs)), key=best.__getitem__), dict.fromkeys(range(len(langs)), 0)
        for w, came in zip(reversed(words), reversed(back), strict=True):
            weight[label] += len(w)
            label = came[label]
        return langs[max(weight, key=weight.get)]

    asked = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = [r.lang_pred for r in language.identify(asked, model).orderBy("doc_id").collect()]
    want = [plain(t) for t in texts]
    # words of equal length on both sides may tie
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= len(texts) - 1 and got[-2:] == ["und", "und"]
