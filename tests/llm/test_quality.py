"""Operator 10: counts, path lengths, threshold and verdict against brute force; labels of rows that took no part."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from logweave.llm import quality
from pyspark.sql import functions as F


def brute_repeat_words(words, size):
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(size)})


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8])
def test_repeated_words_equal_brute_force(size, monkeypatch):
    r = random.Random(size)
    for few in (0, 10**9):  # both ways of counting
        monkeypatch.setattr(quality, "MEMO_WORDS", few)
        for n in (0, 1, 7, 8, 9, 60, 200):
            words = [bytes([97 + r.randrange(2)]) for _ in range(n)]
            if n > 20:
                words[-12:] = words[3:15]
            assert quality.repeat_words(words, size) == brute_repeat_words(words, size)


def brute_path(tree, row):
    feature, value, left, path = (x.tolist() for x in tree)
    node = 0
    while left[node] != node:
        node = left[node] + (row[feature[node]] >= value[node])
    return path[node]


def test_path_lengths_equal_walking_each_tree():
    rng = np.random.default_rng(0)
    rows = rng.uniform(0, 0.3, (500, 8))
    forest = quality.IsolationForest(rows, 20, 64, 1)
    asked = np.concatenate([rows[:40], rng.uniform(0, 1, (20, 8)), np.ones((1, 8)), np.zeros((1, 8))])
    expected = [np.mean([brute_path(t, x) for t in forest.trees]) for x in asked.tolist()]
    assert forest.path_lengths(asked) == pytest.approx(expected)
    normal = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    assert forest.score(asked) == pytest.approx(2 ** (-np.array(expected) / normal(64)))
    assert forest.score(np.ones((1, 8)))[0] > forest.score(rows).max()


def test_trees_hold_what_their_boxes_hold():
    """Every leaf's path is its depth and the normal path of the sample's rows in it."""
    rows = np.random.default_rng(2).uniform(0, 1, (64, 3))
    feature, value, left, path = quality.IsolationForest(rows, 1, 64, 3, deepest=5).trees[0]

    def check(node, own, depth):
        if left[node] == node:
            assert path[node] == pytest.approx(depth + float(quality.normal_path(len(own)))) and (depth == 5 or len(own) < 2)
            return len(own)
        above = own[:, feature[node]] >= value[node]
        return check(left[node], own[~above], depth + 1) + check(left[node] + 1, own[above], depth + 1)

    assert check(0, rows, 0) == 64


def test_verdict_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    loss = 0.01
    got = quality.quality_rules(docs, labels, trees=30, keep_loss=loss).collect()
    quality_of = {}
    for r in labels.filter("quality is not null").collect():
        quality_of[r["doc_id"]] = min(quality_of.get(r["doc_id"], 1), r["quality"])
    bins = 10_000
    known = [(min(int(np.floor(r["anomaly"] * bins)), bins - 1), quality_of[r["doc_id"]]) for r in got if r["doc_id"] in quality_of and not r["base_failed"]]
    good = [b for b, q in known if q > 0]
    bad = [b for b, q in known if q <= 0]
    best = 2.0
    for limit in sorted(set(good + bad), reverse=True):
        lost, caught = sum(b >= limit for b in good), sum(b >= limit for b in bad)
        if lost > loss * len(good):
            break
        if caught * max(len(good), 1) > lost * max(len(bad), 1):
            best = limit / bins
    assert all(r["kept"] == (not r["base_failed"] and min(np.floor(r["anomaly"] * bins), bins - 1) / bins < best) for r in got)
    assert best < 2
    stays = {r["doc_id"] for r in quality.good_rows(docs, labels, trees=30, keep_loss=loss).collect()}
    assert stays == {r["doc_id"] for r in got if r["kept"]}


def test_rows_that_took_no_part(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    used = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    asked = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    got = [r for r in quality.quality_rules(asked, used).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 2 and not r["base_failed"]]
    table = pq.read_table(f"{folder}/labels.parquet").to_pydict()
    label = dict(zip(table["doc_id"], table["quality"]))
    good, bad = [r["kept"] for r in got if label[r["doc_id"]] == 1], [r["kept"] for r in got if label[r["doc_id"]] == 0]
    print(f"held out: kept {sum(good)} of {len(good)} good, {sum(bad)} of {len(bad)} bad")
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_without_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(30))), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs, none).collect()} == {1: True, 2: False}
    assert [r["doc_id"] for r in quality.good_rows(docs, none).collect()] == [1]
    assert quality.quality_rules(docs.limit(0), none).count() == quality.good_rows(docs.limit(0), none).count() == 0
