"""Operator 4: exact top-k search by inner product, with no-random-access aggregation.

Vectors become integers. A shard sorts its rows by each component, once for all queries. For a query each of these lists, read from the
one end or the other by the sign of the query's component, has the contributions to the score in falling order. All lists are read in
sequence, to the same depth at a time. A row has an upper bound: its contributions read so far, and what the other lists
have reached; and a lower bound: these contributions, and the least of the other lists. The threshold is the k-th lower bound so
far, or what is known from other shards. Where nothing is known, lists are read from their worst ends too, which raises lower bounds.

Reading stops when outsiders can't qualify: when the rows whose upper bound reaches the threshold, unseen ones included, are few (4 * k, or
every 16th row), or the lists end. Only then are these rows' final scores resolved, from their vectors; no such access decides
what is read or when reading stops. Rows that tie with the threshold are never dropped, so ties go to the smaller vec_id.

Candidates are dealt to shards by hash; the query set is a stated part of the table and meets every row once, in blocks. Shards
are searched in rounds, each of ROUND times as many shards as the one before; the k-th best score of the rounds so far is the threshold that a query brings to
the next. So shards give few rows beyond the k best, however many shards there are.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids. Vectors of different
lengths don't meet. Rows with the query's own vec_id aren't candidates; other repeated rows each are. Each row of queries is a query, repeated
ones too. Other columns aren't read. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

ROUND = 8
#: Shares of the lists that are read before bounds are compared. A shard's queries begin where the one before them stopped.
DEPTHS = tuple(i / 16 for i in range(1, 17))
_FOUND = pa.schema([("ask", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component as double, without unusable rows."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(finite).select("vec_id", whole.alias("v"))


def _exact_type(values: np.ndarray):
    """The fastest type in which sums of products are exact; None if 64-bit integers could overflow."""
    largest = float(np.abs(values.astype(float)).max(initial=0)) ** 2 * values.shape[1]
    return np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else object


class Shard:
    """The rows of a shard, and for each dimension a list of them sorted by their component; made once, for all queries."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")  # so that a stable order by score goes to the smaller vec_id
        self.ids, self.values = ids[order], values[order]
        self.kind = None
        self.start = [0, 0]  # of DEPTHS, the one at which bounds are first compared, where a threshold is known and where not
        self.read = self.resolved = 0  # entries of lists, and what was resolved at the end

    def search(self, asks: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, thresholds: np.ndarray, k: int):
        """(ask, query_id, vec_id, score) of the k best of each query, and of no others that a threshold rules out."""
        kind = _exact_type(np.concatenate([self.values, queries]))
        if self.kind is not kind:
            self.kind, self.exact = kind, self.values.astype(kind)
            self.rows = np.argsort(self.values.T, 1, kind="stable")
            self.sorted = np.take_along_axis(self.values.T.astype(float), self.rows, 1)
        for ask, own_id, query, least in zip(asks.tolist(), query_ids.tolist(), queries, thresholds.tolist()):
            for row, score in self._best(query, own_id, least, k):
                yield ask, own_id, int(self.ids[row]), int(score)

    def _entries(self, query: np.ndarray, up: np.ndarray, down: np.ndarray, a: int, b: int):
        """What lies from the a-th to the b-th place of the lists up, read from their greatest component on, and of the lists down, from their least: rows and contributions, list by list."""
        n = len(self.ids)
        self.read += (len(up) + len(down)) * (b - a)
        rows = np.concatenate([self.rows[up, n - b : n - a].ravel(), self.rows[down, a:b].ravel()])
        return rows, np.concatenate([(self.sorted[up, n - b : n - a] * query[up, None]).ravel(), (self.sorted[down, a:b] * query[down, None]).ravel()])

    def _best(self, query: np.ndarray, own_id: int, threshold: float, k: int):
        n, rough = len(self.ids), query.astype(float)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        both = threshold == -np.inf  # the worst ends, which give lower bounds, are read where no threshold is known
        alive = self.ids != own_id
        sums, done = np.zeros(n), 0
        seen: list[tuple[np.ndarray, np.ndarray, int]] = []  # rows list by list, the lists, and how many rows each
        for i in range(self.start[both], len(DEPTHS)):
            depth = int(np.ceil(DEPTHS[i] * n / (1 + both)))
            for best in (True, False)[: 1 + both]:
                end = depth if best else min(depth, n - depth)  # the ends don't overlap
                if end > done:
                    rows, parts = self._entries(rough, *((up, down) if best else (down, up)), done, end)
                    sums += np.bincount(rows, parts, n)
                    seen.append((rows, np.concatenate([up, down] if best else [down, up]), end - done))
            done = depth
            last = depth >= n or both and 2 * depth >= n
            greatest, least = self.sorted[:, n - 1 - min(depth, n - 1)], self.sorted[:, min(depth, n - 1)]
            high = np.where(query > 0, greatest, least) * rough
            low = (np.where(query > 0, least, greatest) if both else np.where(query > 0, self.sorted[:, 0], self.sorted[:, -1])) * rough
            seen_of = lambda bound: sum(np.bincount(rows, np.repeat(bound[lists], size), n) for rows, lists, size in seen)
            if not (both or last) and high.sum() >= threshold:
                continue  # rows that no list has shown may still qualify
            room = 1e-9 * (np.abs(high).sum() + np.abs(low).sum() + np.abs(sums)) + 1e-3
            upper = sums + room + high.sum() - seen_of(high)
            if both or last:
                lower = (sums - room + low.sum() - seen_of(low))[alive]
                if len(lower) >= k:
                    threshold = max(threshold, np.partition(lower, len(lower) - k)[len(lower) - k])
            alive &= upper >= threshold
            left, few = alive.sum(), max(4 * k, n // 16)
            if last or left <= few:
                # The next query first compares bounds where this one stopped, or a step before if this one went further than it had to.
                self.start[both] = max(i - 1, 0) if i == self.start[both] and 4 * left <= few else i
                break
        rows = np.flatnonzero(alive)  # none but these can qualify
        self.resolved += len(rows) * (len(up) + len(down))
        final = self.exact[rows] @ query.astype(self.kind)
        enough = final >= threshold - 1e-3 - 1e-9 * abs(threshold) if np.isfinite(threshold) else np.ones(len(rows), bool)
        rows, final = rows[enough], final[enough]
        best = np.argsort(-final, kind="stable")[:k]
        return zip(rows[best].tolist(), final[best].tolist())


def _blocks(rows: pa.Table):
    values = rows["v"].combine_chunks()
    width = len(values.values) // max(len(rows), 1)
    return rows["vec_id"].to_numpy(), values.values.to_numpy().reshape(-1, width)


def shards_for(rows: int) -> int:
    """Shards of about 4,096 rows up to 64 shards; beyond, of up to 65,536 rows, as queries are sent to each."""
    return max(1, min(rows // 4096, 64), -(-rows // 65_536))


def rounds_of(shards: int) -> list[tuple[int, int]]:
    """Ranges of shards, each ROUND - 1 times as long as all before."""
    out, done = [], 0
    while done < shards:
        upto = min(shards, max(1, done * ROUND))
        out.append((done, upto))
        done = upto
    return out


def _search_round(candidates: DataFrame, asked: DataFrame, first: int, last: int, k: int, block: int, n_asked: int) -> DataFrame:
    """ask, query_id, vec_id and score of what the shards first to last - 1 give. asked: ask, vec_id, v, least."""
    workers = candidates.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(-(-2 * workers // (last - first)), -(-n_asked // block)))
    every = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
    width = F.size("v").alias("width")
    held = candidates.filter((F.col("shard") >= first) & (F.col("shard") < last)).withColumn("block", every(0, blocks))
    held = held.select(width, "shard", "block", F.lit(False).alias("asks"), "vec_id", "v", F.lit(0).cast("long").alias("ask"), F.lit(0.0).alias("least"))
    asking = asked.withColumn("block", F.pmod("ask", F.lit(blocks)).cast("int")).withColumn("shard", every(first, last))
    both = held.unionByName(asking.select(width, "shard", "block", F.lit(True).alias("asks"), "vec_id", "v", "ask", "least"))
    dealt = both.repartition(min(max(2 * (last - first) * blocks, workers), 8192), "width", "shard", "block").sortWithinPartitions("width", "shard", "block", "asks", "vec_id")

    def run(batches):
        shard, key, waiting = None, None, []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            keys = np.stack([rows[c].to_numpy() for c in ("width", "shard", "block", "asks")], 1).astype(int)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part, (*tile, asks) = rows.slice(a, b - a), keys[a].tolist()
                if tile != key:
                    shard, key, waiting = None, tile, []
                if not asks:
                    waiting.append(_blocks(part))
                    continue
                if shard is None:
                    if not waiting:
                        continue
                    shard = Shard(*map(np.concatenate, zip(*waiting)))
                ids, values = _blocks(part)
                numbers, least = part["ask"].to_numpy(), part["least"].to_numpy()
                for i in range(0, len(ids), block):
                    found = list(shard.search(numbers[i : i + block], ids[i : i + block], values[i : i + block], least[i : i + block], k))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=_FOUND)

    return dealt.mapInArrow(run, "ask long, query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, block: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score: for each row of queries the k best rows of vectors (both: vec_id, embedding)."""
    candidates = cut_lineage(integers(vectors, scale))
    shards = shards_for(candidates.count())
    candidates = candidates.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    asked = cut_lineage(integers(queries, scale).withColumn("ask", F.monotonically_increasing_id()))
    n_asked, best = asked.count(), None
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    for first, last in rounds_of(shards):
        known = asked.withColumn("least", F.lit(float("-inf")))
        if best is not None:
            kth = best.filter(F.col("rank") == k).select("ask", F.col("score").cast("double").alias("kth"))
            known = asked.join(kth, "ask", "left").select("ask", "vec_id", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("least"))
        found = _search_round(candidates, known, first, last, k, block, n_asked)
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = cut_lineage(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    return best.select("query_id", "rank", "vec_id", "score")
