"""Near copies for the pipeline: of each group of texts whose sets of word shingles have a Jaccard similarity of at least `similarity`, one row.

SimHash distances only estimate that similarity: at 0.8, fingerprints differ in about ten of 64 bits and often in more, and BK-trees
of so wide a radius visit nearly all they hold. So operator 6's fingerprints and BK-trees bring together what is within their radius, and an
exact prefix filter finds all other pairs, so that none is lost:

1. Tasks hash each text's shingles. Equal sets become one row, with a fingerprint, and a prefix: its first n - ceil(similarity * n) + 1
   shingles in one order for all texts. Similar sets share a shingle of their prefixes. Shingles that a sample shows to be common
   come last; this saves work and changes no result.
   A place in it counts where what lies behind it is enough for the overlap with the shortest set that holds the shingle too.
2. Links of the BK-trees, and links from each member of a group of more than STAR sets that share a prefix shingle to the group's
   centre, are compared. The centre is the set with the fewest shingles before the shared one: copies of a text that were each changed
   elsewhere have own, rare shingles there, and are nearer to the least changed one than to each other. So a large group of copies gives
   pairs in proportion to its rows.
3. Of a group, only sets that step 2 didn't bring to the centre meet the others. Sets of different components that share prefix
   shingles become pairs with the number of those that they share. A pair is left out if its lengths are too different, if what lies
   behind its first shared shingle, or the number and what lies behind the last one, can't add up to the overlap that the similarity asks for.
4. Every pair is compared exactly, on its whole texts, before it becomes a link; groups are the components of the links.

Of each group the text stays whose (doc_id, hashes of the text) is smallest, null ids last. Rows that agree in doc_id and text are one document:
one of them stays, with whatever its other columns are. Texts of fewer words than a shingle have one shingle, their words; null and
empty texts have none and are copies of each other. Columns of any names pass through. An empty table stays empty.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, give_back, hot_keys, join_hot, map_batches, may_be_in
from .simhash import components, links, majority, shingle_hashes

#: The sample that ranks common shingles: SAMPLE texts, but at most every eighth; COMMON shingles are broadcast.
SAMPLE, COMMON = 400_000, 500_000
STAR, PAIRS = 64, 1000


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size).view(np.int64))


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles that several texts of a sample hold, from rare to frequent."""
    share = min(1 / 8, SAMPLE / max(docs.count(), 1))
    texts = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)).distinct()

    def make():
        return lambda rows: {"shingle": [shingle_set(t, size).tolist() for t in rows["text"]]}

    counts = map_batches(texts, make, "shingle array<long>").select(F.explode("shingle").alias("shingle")).groupBy("shingle").count()
    rows = counts.filter("count > 3").orderBy(F.desc("count"), "shingle").limit(COMMON).select("shingle").toPandas()  # COMMON rows at most
    return rows["shingle"].to_numpy(np.int64)[::-1].copy()


def signatures(keyed: DataFrame, size: int, similarity: float) -> DataFrame:
    """keyed: doc_id, h1, h2, text. For each row its set's hash and size, the fingerprint, and the prefix."""
    ranks = keyed.sparkSession.sparkContext.broadcast(common_shingles(keyed, size))

    def make():
        import xxhash

        order = np.argsort(ranks.value)
        known = ranks.value[order]

        def apply(rows):
            out = {k: rows[k] for k in ("doc_id", "h1", "h2")} | {"set_hash": [], "n": [], "fp": [], "prefix": []}
            for text in rows["text"]:
                hashes = shingle_hashes(text, size)
                own = np.unique(hashes.view(np.int64))
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                rank = np.where(known[at] == own, order[at], -1) if len(known) else np.full(len(own), -1)
                fp = majority(hashes)
                out["set_hash"].append(xxhash.xxh64_intdigest(own.tobytes()) - 2**63)
                out["n"].append(len(own))
                out["fp"].append(fp - (1 << 64) if fp >> 63 else fp)
                out["prefix"].append(own[np.argsort(rank, kind="stable")[: prefix_length(len(own), similarity)]].tolist())
            return out

        return apply

    return map_batches(keyed.select("doc_id", "h1", "h2", "text"), make, "doc_id long, h1 long, h2 long, set_hash long, n long, fp long, prefix array<long>")


def verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Of pairs (a, b), those whose texts are similar enough. texts: a, text. A set in many pairs has its text once for each PAIRS of them, so that no task gets all."""
    pairs = cut_lineage(pairs)
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    parts = counts.select("a", F.ceil(F.col("n") / PAIRS).alias("parts"))
    dealt = join_hot(pairs, parts, "a", hot_keys(counts)).select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    of_a = texts.toDF("a", "text_a").join(parts, "a").select("a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = dealt.join(texts.toDF("b", "text_b"), "b").join(of_a, ["a", "part"])

    def make():
        def apply(rows):
            out = {"a": [], "b": []}
            for a, b, text_a, text_b in zip(rows["a"], rows["b"], rows["text_a"], rows["text_b"]):
                x, y = shingle_set(text_a, size), shingle_set(text_b, size)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared >= similarity * (len(x) + len(y) - shared) - 1e-9:
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return apply

    return cut_lineage(map_batches(both.select("a", "b", "text_a", "text_b"), make, "a long, b long"))


def _texts_of(sets: DataFrame, asked: DataFrame, keyed: DataFrame) -> DataFrame:
    """set and text of the sets that pairs ask for, each once."""
    wanted = cut_lineage(sets.join(asked.toDF("set").distinct(), "set", "left_semi").select("set", "top.doc_id", "top.h1", "top.h2").toDF("set", "id", "x1", "x2"))
    rows = _once_a_batch(may_be_in(keyed, "h1", wanted.select("x1"), "asked").filter("asked").drop("asked"))
    same = rows["doc_id"].eqNullSafe(wanted["id"]) & (rows["h1"] == wanted["x1"]) & (rows["h2"] == wanted["x2"])
    return cut_lineage(rows.join(wanted, same).groupBy("set").agg(F.first("text").alias("text")))


def _once_a_batch(rows: DataFrame) -> DataFrame:
    """rows (with doc_id, h1, h2) without most of the repeated ones: a batch keeps one of each, so a row that a third of all are like reaches no task in such numbers."""
    at = [rows.columns.index(c) for c in ("doc_id", "h1", "h2")]

    def run(batches):
        for batch in batches:
            first: dict = {}
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in at))):
                first.setdefault(key, i)
            yield batch.take(pa.array(list(first.values()), pa.int64())) if len(first) < batch.num_rows else batch
        batch = None
        give_back()

    return rows.mapInArrow(run, rows.schema)


def groups_of(sets: DataFrame, keyed: DataFrame, size: int, similarity: float) -> DataFrame:
    """set and group of the sets that have near copies. sets: set, n, fp, prefix, top."""
    by_shingle = Window.partitionBy("shingle")
    need = lambda n, m: similarity / (1 + similarity) * (n + m) - 1e-9  # noqa: E731  shingles that sets of n and m have to share
    dealt = sets.select("n", "set", F.posexplode("prefix").alias("i", "shingle")).select("shingle", "set", F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("n")).alias("at"))
    i, n = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit((1 << 32) - 1))
    shortest = F.greatest(F.min(n).over(by_shingle), similarity * n)
    dealt = dealt.withColumn("open", n - i >= need(n, shortest)).filter("open").drop("open")
    meeting = dealt.withColumns({"times": F.count("*").over(by_shingle), "first": F.min(F.struct("at", "set")).over(by_shingle)}).filter("times > 1")
    meeting = cut_lineage(meeting.select("shingle", F.col("set").alias("a"), n.alias("n"), i.alias("i"), "times", F.col("first.set").alias("first"), F.col("first.at").bitwiseAND(F.lit((1 << 32) - 1)).alias("first_n")))
    long_enough = F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9

    stars = meeting.filter(F.col("times") > STAR).select(F.col("first").alias("a"), F.col("first_n").alias("n"), F.col("a").alias("b"), F.col("n").alias("m")).filter("a <> b")
    by_print = cut_lineage(sets.groupBy("fp").agg(F.min(F.struct("set", "n")).alias("one")))
    of = lambda x, y, z: by_print.select(F.col("fp").alias(x), F.col("one.set").alias(y), F.col("one.n").alias(z))
    alike = links(by_print.select("fp"), 2).toDF("x", "y").join(of("x", "a", "n"), "x").join(of("y", "b", "m"), "y").select("a", "n", "b", "m")
    near = stars.unionByName(alike).filter(long_enough).select("a", "b").distinct()
    near = cut_lineage(near)
    texts = _texts_of(sets, near.select("a").union(near.select("b")), keyed)
    found = verified(near, texts, size, similarity)

    named = meeting.join(components(found).toDF("a", "comp"), "a", "left").select("shingle", "a", "n", "i", (F.col("a") == F.col("first")).alias("is_first"), F.coalesce("comp", "a").alias("comp"))
    around = F.max(F.when(F.col("is_first"), F.col("comp"))).over(by_shingle)
    apart = named.withColumns({"low": F.min("comp").over(by_shingle), "high": F.max("comp").over(by_shingle), "outside": F.col("comp") != around})
    apart = cut_lineage(apart.filter("low <> high").drop("low", "high", "is_first"))
    met = apart.filter("outside").drop("outside").join(apart.toDF("shingle", "b", "m", "j", "other", "beside"), "shingle").filter("comp <> other and (a < b or not beside)").filter(long_enough)
    met = met.filter(F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= need(F.col("n"), F.col("m")))
    x, y = F.struct("a", "n", "i"), F.struct(F.col("b").alias("a"), F.col("m").alias("n"), F.col("j").alias("i"))
    met = met.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).select(F.col("x.a").alias("a"), F.col("x.n").alias("n"), F.col("x.i").alias("i"), F.col("y.a").alias("b"), F.col("y.n").alias("m"), F.col("y.i").alias("j"))
    shared = met.groupBy("a", "b", "n", "m").agg(F.count("*").alias("c"), F.max("i").alias("i"), F.max("j").alias("j"))
    most = F.col("c") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - 1
    rest = cut_lineage(shared.filter(most >= need(F.col("n"), F.col("m"))).select("a", "b"))
    texts = _texts_of(sets, rest.select("a").union(rest.select("b")), keyed)
    return components(found.union(verified(rest, texts, size, similarity))).toDF("set", "group")


def without_near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies among docs (doc_id, text), with all columns."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    signed = signatures(keyed, size, similarity).withColumn("top", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2"))
    signed = signed.withColumn("set", F.xxhash64("set_hash", "n"))
    sets = cut_lineage(signed.groupBy("set", "n").agg(F.min("top").alias("top"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix")))
    groups = groups_of(sets, keyed, size, similarity)
    tops = sets.join(groups, "set", "left").groupBy(F.coalesce("group", "set")).agg(F.min("top").alias("top"))
    tops = cut_lineage(tops.select("top.doc_id", "top.h1", "top.h2"))

    # What isn't a top goes; a top that stands several times stays once. All other rows stay where they are.
    seen = keyed.select("doc_id", "h1", "h2").groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("times"))
    top = tops.toDF("id", "x1", "x2").withColumn("stays", F.lit(True))
    judged = seen.join(top, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2")), "left")
    acted = cut_lineage(judged.filter("stays is null or times > 1").select(F.col("doc_id").alias("id"), F.col("h1").alias("x1"), F.col("h2").alias("x2"), F.col("stays").isNotNull().alias("stays")))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    whole = may_be_in(whole, "h1", acted.select("x1"), "suspect")
    suspects = _once_a_batch(whole.filter("suspect"))
    met = suspects.join(acted, suspects["doc_id"].eqNullSafe(acted["id"]) & (suspects["h1"] == acted["x1"]) & (suspects["h2"] == acted["x2"]), "left")
    alone = met.filter("stays is null").select("row.*")
    once = met.filter("stays").groupBy(F.col("id"), F.col("x1"), F.col("x2")).agg(F.first("row").alias("row")).select("row.*")
    return whole.filter("not suspect").select("row.*").union(alone).union(once)
