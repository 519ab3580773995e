import random

import corpus_pipeline
from logweave.llm import quality
from logweave.llm.common import table
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_pipeline_applies_its_stages_to_all_that_came_before(spark):
    docs = table(spark, SMALL, "documents")
    good = corpus_pipeline.quality_rules(spark, docs, SMALL)
    kept = {r["doc_id"] for r in quality.quality_rules(docs, table(spark, SMALL, "labels")).collect() if r["kept"]}
    assert {r["doc_id"] for r in good.collect()} == kept and good.columns == docs.columns
    single = corpus_pipeline.near_duplicates(spark, good, SMALL)
    rows = sorted(good.select("doc_id", "text").collect())
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({rows[t]["doc_id"] for t in brute_groups([r["text"] for r in rows])})
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in single.collect()}
    room = {}
    for r in rows:
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert max(room.values()) <= 4096


def brute_groups(texts):
    """Components of all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    top = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                x, y = sorted((top[i], top[j]))
                top = [x if t == y else t for t in top]
    return top


def test_near_copies_equal_all_pairs_of_shingle_sets(spark):
    r = random.Random(3)
    texts = [None, "", "a b", "A  b", "a b c"]
    for k in range(12):
        words = [f"w{r.randrange(40 if k % 2 else 4000)}" for _ in range(60 + 10 * k)]
        for _ in range(8):
            texts.append(" ".join(words))
            for at in r.sample(range(len(words)), 1 + k % 3):  # a chain of copies, each of the one before it
                words[at] = f"x{r.randrange(10**6)}"
    passage = " ".join(f"p{i}" for i in range(50))
    texts += [f"{passage} {' '.join(f'q{r.randrange(10**6)}' for _ in range(n))}" for n in range(4, 30)]
    top = brute_groups(texts)
    assert 30 < len(set(top)) < len(texts) - 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(top))


def test_a_large_group_of_near_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    from logweave.llm import near_copies

    r, compare, asked = random.Random(5), near_copies.verified, []
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *a: (asked.append(pairs.count()), compare(pairs, *a))[1])
    texts = [" ".join(f"w{i}" for i in range(146))]
    for k in range(220):  # copies of it, each with one to five words of its own at places of its own
        words = [f"w{i}" for i in range(146)]
        for at in r.sample(range(146), 1 + k % 5):
            words[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"y{r.randrange(10**6)}" for _ in range(50)) for _ in range(30)]
    top = brute_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(top)) and 60 < len(kept) < 160
    assert 100 < sum(asked) < 2 * len(texts)


def test_stages_decide_by_row_not_by_id(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    good = [r["text"] for r in docs.join(table(spark, SMALL, "labels").filter("quality = 1 and toxic = 0"), "doc_id").orderBy("doc_id").limit(3).collect()]
    rows = [(None, good[0]), (None, "too short"), (None, good[0]), (-1, good[1]), (-1, "short too"), (-2, good[2]), (-2, good[2])]
    mixed = docs.union(spark.createDataFrame(rows, "doc_id long, text string"))
    added = "doc_id is null or doc_id < 0"
    kept = corpus_pipeline.quality_rules(spark, mixed, SMALL).filter(added)
    assert sorted(r["text"] for r in kept.collect()) == sorted([good[0]] * 2 + [good[1]] + [good[2]] * 2)
    copies = spark.createDataFrame(rows, "doc_id long, text string")
    single = corpus_pipeline.near_duplicates(spark, copies, SMALL)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in single.collect()) == sorted({(i or 0, t) for i, t in rows})
    assert single.columns == copies.columns


def test_toxicity_decides_by_row_not_by_id(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline.toxicity, "train", lambda *a, **k: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "scores_of", lambda model, texts: [float("bad" in t) for t in texts])
    rows = [(None, "fine"), (None, "bad"), (1, "bad"), (1, "fine too"), (2, "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["text"] for r in corpus_pipeline.toxicity_filter(spark, docs, SMALL).collect()) == ["fine", "fine too"]


def test_stages_pass_clashing_columns_and_empty_tables(spark):
    names = ("h1", "h2", "row", "set", "top", "id", "x1", "stays", "suspect", "features", "kept", "kept_id", "score", "predicted", "row_key", "salt", "n", "fp")
    docs = table(spark, SMALL, "documents").withColumns({n: F.lit(f"own {n}") for n in names})
    rows = docs.union(docs.filter("doc_id % 10 = 0")).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, rows, SMALL)
        assert found.columns == docs.columns and found.filter(" or ".join(f"{n} <> 'own {n}'" for n in names)).count() == 0
        assert found.count() > 0 and stage(spark, docs.limit(0), SMALL).count() == 0
        assert len({(r["doc_id"], r["text"]) for r in found.collect()}) == (found.count() if stage is corpus_pipeline.near_duplicates else found.select("doc_id", "text").distinct().count())
    assert corpus_pipeline.best_fit_packing(spark, rows, SMALL).filter("piece = 0").count() == rows.count()


class Frame:
    """Takes a task's function as map_batches makes it."""

    columns = ["doc_id", "text"]

    def __init__(self, session):
        self.sparkSession, self.schema = session, None

    def mapInArrow(self, run, schema):
        return run


def test_tasks_let_go_of_their_function_before_they_give_memory_back(spark, monkeypatch):
    import weakref

    import numpy as np
    import pyarrow as pa
    from logweave.llm import common

    class Keeps:
        def __call__(self, rows):
            return np.ones(len(rows), bool) if isinstance(rows, pa.Array) else rows

    made, held = [], []

    def make():
        made.append(weakref.ref(f := Keeps()))
        return f

    monkeypatch.setattr(common, "give_back", lambda: held.append(made[-1]() is not None))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a", "b"]})
    for run in (common.map_batches(Frame(spark), make, "doc_id long, text string"), common.filter_rows(Frame(spark), "text", make)):
        assert sum(b.num_rows for b in run([batch])) == 2
    assert held == [False, False]


def test_marking_held_keys_takes_no_python_worker(spark):
    from logweave.llm.common import may_be_in

    rows = spark.createDataFrame([(i, i * 7919 - 4000) for i in range(5000)], "i long, h1 long")
    marked = may_be_in(rows, "h1", rows.filter("i % 3 = 0").select(F.col("h1").alias("x1")), "held")
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and marked.columns == ["i", "h1", "held"]
    found = {r["i"]: r["held"] for r in marked.collect()}
    assert len(found) == 5000 and all(found[i] for i in range(0, 5000, 3)) and sum(found.values()) < 1700
