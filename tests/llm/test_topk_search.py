"""Operator 4: bounds, reads and rounds of the aggregation against brute force."""

import numpy as np
import pytest
from logweave.llm import topk_search
from pyspark.sql import functions as F


def brute(ids, values, own_id, query, k, least=-np.inf):
    scored = sorted((-int(v.astype(object) @ query.astype(object)), int(i)) for i, v in zip(ids, values) if i != own_id)
    return [(i, -s) for s, i in scored[:k] if -s >= least]


def clustered(rng, n, width, kinds=10, spread=6):
    return (rng.integers(-40, 40, (kinds, width))[rng.integers(kinds, size=n)] + rng.integers(-spread, spread + 1, (n, width))).astype(np.int64)


@pytest.mark.parametrize("n, width, k, make", [
    (700, 16, 20, lambda r, n, w: clustered(r, n, w)), (300, 5, 7, lambda r, n, w: r.integers(-3, 4, (n, w))), (40, 3, 50, lambda r, n, w: r.integers(-9, 9, (n, w))), (1, 4, 2, lambda r, n, w: r.integers(-9, 9, (n, w))),
    (200, 6, 5, lambda r, n, w: np.ones((n, w), np.int64)), (60, 4, 5, lambda r, n, w: r.integers(-(2**29), 2**29, (n, w))), (400, 8, 10, lambda r, n, w: np.repeat(clustered(r, 4, w), n // 4, 0)),
])
def test_a_shard_gives_the_k_best(n, width, k, make):
    rng = np.random.default_rng(n)
    values = make(rng, n, width).astype(np.int64)
    ids = rng.permutation(n).astype(np.int64)
    ids[: n // 10] = ids[n // 10 : 2 * (n // 10)]  # repeated ids
    shard = topk_search.Shard(ids, values)
    asked = rng.choice(n, min(n, 15), replace=False)
    whole = {int(i): brute(ids, values, ids[i], values[i], k) for i in asked}
    for least in (None, 0, -1):  # no threshold, the k-th score, one that too few reach
        limits = np.array([-np.inf if least is None or not whole[i] else whole[i][least][1] for i in asked.tolist()])
        found = list(shard.search(asked.astype(np.int64), ids[asked], values[asked], limits, k))
        for i, limit in zip(asked.tolist(), limits):
            assert [(v, s) for a, _, v, s in found if a == i] == [(v, s) for v, s in whole[i] if s >= limit]


def test_reading_stops_early_and_ends_where_lists_do():
    rng = np.random.default_rng(5)
    values, ids = clustered(rng, 4000, 64), np.arange(4000)
    shard = topk_search.Shard(ids, values)
    found = list(shard.search(ids[:50], ids[:50], values[:50], np.full(50, -np.inf), 20))
    everything = 50 * 64 * 4000
    assert len(found) == 1000 and shard.read + shard.resolved < 0.95 * everything
    alone, shard.read, shard.resolved = shard.read, 0, 0
    limits = np.array([min(s for a, _, _, s in found if a == i) for i in range(50)], float)
    assert list(shard.search(ids[:50], ids[:50], values[:50], limits, 20)) == found
    assert shard.read < 0.6 * everything and shard.read < alone and shard.resolved < 0.07 * everything
    random = topk_search.Shard(ids, rng.integers(-40, 40, (4000, 64)))
    found = list(random.search(ids[:20], ids[:20], random.values[:20], np.full(20, -np.inf), 20))
    limits = np.array([min(s for a, _, _, s in found if a == i) for i in range(20)], float)
    random.read = 0
    assert list(random.search(ids[:20], ids[:20], random.values[:20], limits, 20)) == found
    assert random.read < 0.8 * 20 * 64 * 4000  # fewer than all, even where nothing is close to anything


def test_rounds_and_repeated_queries(spark, monkeypatch):
    assert topk_search.rounds_of(1) == [(0, 1)] and topk_search.rounds_of(64) == [(0, 1), (1, 8), (8, 64)]
    monkeypatch.setattr(topk_search, "shards_for", lambda rows: 11)
    rng = np.random.default_rng(7)
    v = clustered(rng, 300, 6)
    rows = [(int(i), [float(x) / 64 for x in e]) for i, e in enumerate(v)]
    df = spark.createDataFrame(rows + rows[:40], "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("ask", "shard", "block", "least", "rank", "v")})
    got = topk_search.search(df, df.filter("vec_id % 20 = 0"), k=5).collect()
    ids = np.array([*range(300), *range(40)])
    values = np.concatenate([v, v[:40]])
    expected = [(q, r, i, s) for q in [*range(0, 300, 20), 0, 20] for r, (i, s) in enumerate(brute(ids, values, q, v[q], 5), 1)]
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_odd_and_empty_tables(spark):
    kind = "vec_id long, embedding array<float>"
    odd = spark.createDataFrame([(None, [1.0]), (0, None), (20, []), (40, [None]), (60, [float("inf")]), (80, [float("nan")]), (100, [1.0]), (120, [1.0, 2.0])], kind)
    assert topk_search.search(odd, odd).count() == 0  # no two usable rows of one length
    assert topk_search.search(odd.limit(0), odd).count() == topk_search.search(odd, odd.limit(0)).count() == 0
