"""Operator 2: naive Bayes against one in plain Python."""

import math
import random
from collections import Counter

import pytest
from logweave.llm import language_id
from pyspark.sql import functions as F

BUCKETS, LONGEST, SMOOTHING = 64, 3, 0.5


def brute_grams(text):
    own = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not own.strip():
        return []
    own = f" {' '.join(own.split(' '))} "
    while "  " in own:
        own = own.replace("  ", " ")
    out, keep = [], (1 << 64) - 1
    for n in range(1, LONGEST + 1):
        for i in range(len(own) - n + 1):
            h = 0
            for k, c in enumerate(own[i : i + n], 1):
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + k) & keep
            out.append((((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & keep) >> 33) % BUCKETS)
    return out


def brute(texts, training):
    counts, docs = {}, Counter()
    for text, lang in training:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(brute_grams(text))
            docs[lang] += 1
    weights = {x: [math.log((c[b] + SMOOTHING) / (sum(c.values()) + SMOOTHING * BUCKETS)) for b in range(BUCKETS)] for x, c in counts.items()}
    prior = {x: math.log(n / sum(docs.values())) for x, n in docs.items()}
    for text in texts:
        own = brute_grams(text)
        if not own or not counts:
            yield "und", 0.0
            continue
        total = {x: sum(w[b] for b in own) for x, w in weights.items()}
        best = min(total, key=lambda x: (-total[x] - prior[x], x))
        mean = {x: v * LONGEST / len(own) + prior[x] for x, v in total.items()}
        yield best, 1 / sum(math.exp(v - mean[best]) for v in mean.values())


def test_predictions_equal_plain_naive_bayes(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PART", 50)
    monkeypatch.setattr(language_id, "TOGETHER", 120)
    r = random.Random(4)
    words = {"x": "der die und straße äh".split(), "y": "the of and house".split(), "z": "el la y ñandú".split()}
    say = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    training = [(say(x, r.randrange(1, 40)), x) for x in "xxxxyyz" for _ in range(4)] + [(None, "x"), ("und", None), ("", "y"), ("12 !", "z")]
    texts = [say(x, n) for x in "xyz" for n in (1, 2, 7, 60)] + [None, "", "!!", "a", "ß", "the der el", "A-B  c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    learn = spark.createDataFrame(training, "text string, lang string").repartition(3)
    got = [(x["lang_pred"], x["score"]) for x in language_id.identify(docs, learn, BUCKETS, LONGEST, SMOOTHING).orderBy("doc_id").collect()]
    expected = list(brute(texts, training))
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert [g[1] for g in got] == pytest.approx([e[1] for e in expected], rel=1e-4)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "words"), (2, None)], "doc_id long, text string")
    got = language_id.identify(docs, docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [(x["lang_pred"], x["score"]) for x in got] == [("und", 0.0)] * 2
