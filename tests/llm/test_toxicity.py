"""Operator 9: scores of the highest window against a plain recurrent network, word by word and window by window; the sample's ids."""

import re
from zlib import crc32

import numpy as np
import pytest
from logweave.llm import toxicity
from pyspark.sql import functions as F


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_network(p, inputs, hidden):
    """One sequence: two gated recurrent networks, then attention. inputs: [steps, 6 * hidden]."""
    k = 2 * hidden
    directions = []
    for own, order in ((slice(0, hidden), 1), (slice(hidden, k), -1)):
        state, states = np.zeros(hidden), []
        weights = [p["recurrent"][own, part * k : (part + 1) * k][:, own] for part in range(3)]
        for x in inputs[::order]:
            parts = [x[part * k : (part + 1) * k][own] for part in range(3)]
            update, reset = (sigmoid(parts[i] + state @ weights[i]) for i in (0, 1))
            candidate = np.tanh(parts[2] + reset * (state @ weights[2]))
            state = update * state + (1 - update) * candidate
            states.append(state)
        directions.append(states[::order])
    states = np.concatenate(directions, 1)
    weight = np.exp(states @ p["attention"])
    pooled = (weight[:, None] * states).sum(0) / weight.sum()
    return pooled @ p["out"] + p["bias"][0], pooled


def plain_logit(model, text, hidden):
    words = re.findall(r"[a-z\x80-\U0010ffff]+", text.lower())
    if not words:
        return -np.inf
    rows = []
    for w in words:
        classes = [ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (toxicity.CLASSES - 27) for c in w]
        last = max(len(w) - toxicity.LONGEST, 0)
        starts = sorted({*range(0, last, toxicity.LONGEST // 2), last})
        logit, pooled = max((plain_network(model.chars.p, model.letters[classes[s : s + toxicity.LONGEST]], hidden) for s in starts), key=lambda x: x[0])
        vector = np.concatenate([pooled, [logit], model.embedding[crc32(w.encode()) % toxicity.BUCKETS]])
        rows.append(vector @ model.project + model.shift)
    rows += [np.zeros(6 * hidden)] * (model.window - len(rows))
    last = len(rows) - model.window
    starts = sorted({*range(0, last, model.window // 2), last})
    return max(plain_network(model.words.p, np.array(rows[s : s + model.window]), hidden)[0] for s in starts)


def test_scores_equal_a_plain_network():
    hidden = 3
    model = toxicity.Model(hidden, 4, 1)
    rng = np.random.default_rng(2)
    model.embedding = rng.normal(0, 1, model.embedding.shape).astype(np.float32)
    model.shift = rng.normal(0, 0.5, model.shift.shape).astype(np.float32)
    model.slope, model.level = 1.7, -0.3
    texts = ["one", "a few Words, here", "straße über naïve 日本語 words", "x" * 100 + " y", "", None, "12 !", " ".join(f"{a}{b}" for a in "abcdef" for b in "uvwxyz"), "four words in all", "five words there are now"]
    expected = [plain_logit(model, t or "", hidden) for t in texts]
    assert model.logits(texts) == pytest.approx(expected, rel=1e-3, abs=1e-4)
    assert model.scores(texts, batch_chars=20) == pytest.approx([sigmoid(1.7 * e - 0.3) if np.isfinite(e) else 0.0 for e in expected], rel=1e-3, abs=1e-4)


def test_the_sample_is_bounded_and_takes_one_text_of_an_id(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(150)] + [(1, "other"), (None, "none"), (3, None), (7, "x" * 50)], "doc_id long, text string")
    found = toxicity.labelled_sample(docs, labels, 30, 40, 20)
    assert 15 <= sum(r["toxic"] for r in found) <= 30 and 15 <= sum(not r["toxic"] for r in found) <= 40
    assert len({r["text"] for r in found}) == len(found) and all(len(r["text"]) <= 20 for r in found)
    whole = toxicity.labelled_sample(docs, labels, 1000, 1000, 20)
    assert len(whole) == 150 and sum(r["toxic"] for r in whole) == 76  # 0 is toxic by its second label
    assert toxicity.labelled_sample(docs.limit(0), labels, 5, 5, 20) == []
    assert [r["score"] for r in toxicity.score_toxicity(docs.limit(3), docs, labels.withColumn("toxic", F.lit(0))).collect()] == [0.0] * 3


def test_training_and_scoring_split_bounded_parts(monkeypatch):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(400)]
    texts = [" ".join(words[(7 * i + j) % 400] for j in range(900)) + (" vile" if i % 3 == 0 else "") for i in range(700)] + [None, ""]
    toxic = np.array([float(i % 3 == 0) for i in range(len(texts))])
    split, sizes, whole = toxicity.split_words, [], []
    monkeypatch.setattr(toxicity, "split_words", lambda part: sizes.append(sum(len(t or "") for t in part)) or split(part))
    monkeypatch.setattr(toxicity.Model, "_fit_chars", lambda self, words, docs, toxic, steps: whole.extend((words, docs)))
    model = toxicity.Model(4, 32, 5)
    model.fit(texts, toxic, 1, 1)
    model.scores(texts)
    longest, total = max(len(t or "") for t in texts), sum(len(t or "") for t in texts)
    assert total > 2_000_000 and max(sizes) < 1_000_000 + longest
    distinct, at, bounds = split(texts)
    assert whole[0] == distinct and len(whole[1]) == len(texts)
    assert all(np.array_equal(own, at[a:b]) for own, a, b in zip(whole[1], bounds, bounds[1:]))


def test_local_rows_take_no_python_worker(spark):
    from logweave.llm.common import local_rows

    rows = [(1, True), (2, None), (None, False)]
    found = local_rows(spark, rows, "doc_id long, toxic boolean")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Python" not in plan
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str) and dict(found.dtypes) == {"doc_id": "bigint", "toxic": "boolean"}
    none = local_rows(spark, [], "doc_id long, toxic boolean")
    assert none.dtypes == found.dtypes and none.count() == 0
