"""Operator 6: SimHash near-duplicates through BK-trees.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 values of a text's word shingles. Fingerprints at
a Hamming distance of at most radius are linked, and the classes are the connected components.

1. Tasks compute fingerprints; equal ones become one row, which keeps the smallest doc_id.
2. Shards: the 64 bits fall into radius + 2 blocks. Two fingerprints within the radius agree on two whole blocks at
   least, so each fingerprint goes to the shard of every pair of blocks (6 shards of 32 agreeing bits for radius 2). A shard
   of more than SHARD_ROWS fingerprints is dealt out once more, by pairs of smaller blocks of its other bits, by the same
   argument: what comes of it agrees on 48 bits, and so holds at most 65,536 of the distinct fingerprints, whatever the corpus.
3. A task builds a shard's BK-tree in memory (children keyed by their distance to the parent), follows only the edges
   within the radius, and joins what it finds in a union-find. It emits a link from each fingerprint to the smallest
   one of its component in the shard, so a shard of n fingerprints gives less than n links. Shards too large for one tree
   are split further inside the task. Trees live in the task that owns the shard; nothing of the size of the corpus is broadcast.
4. Connected components of the links: each round hooks every node to its smallest neighbour, jumps along the hooks to
   their roots, and contracts the edges; checkpointed.
5. Documents get the class of their fingerprint. Fingerprints, components and nodes that many rows share are joined by
   broadcast; since they are those above a share of all rows, there are at most HOT of them.

A null or empty text has fingerprint zero, which is linked like any other. A null doc_id is kept and sorts behind all
others. Repeated rows come back once each. Other columns aren't read. An empty table gives an empty result.
"""

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, hot_keys, join_hot, map_batches

TREE_SIZE = 3000
SHARD_ROWS = 65_536


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included. ASCII letters lowered; words are cut at ASCII white space; fewer words are one shingle."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(words) - shingle + 1)
    hash64 = xxhash.xxh64_intdigest
    return np.array([hash64(line[a:b], 42) for a, b in zip(starts[:last].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprint(text: str | None, shingle: int = 3) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    def make():
        def apply(rows):
            return {"doc_id": rows["doc_id"], "fingerprint": [f"{fingerprint(t, shingle):016x}" for t in rows["text"]]}

        return apply

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, fingerprint string")


class BKTree:
    """Nodes are fingerprints; the child of a node at distance d holds all that are at distance d from it."""

    def __init__(self, root: int):
        self.root = (root, {})

    def add_and_find(self, x: int, radius: int) -> list[int]:
        """Those in the tree within the radius of x; then x is in it too."""
        found, todo = [], [self.root]
        while todo:
            value, children = todo.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append(value)
            if children:
                for edge in range(max(d - radius, 1), d + radius + 1):
                    child = children.get(edge)
                    if child is not None:
                        todo.append(child)
        value, children = self.root
        while d := (value ^ x).bit_count():
            if d not in children:
                children[d] = (x, {})
                break
            value, children = children[d]
        return found


class Classes:
    """Union-find whose root is the smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = x
        while (up := self.parent.get(top, top)) != top:
            top = up
        while x != top:
            self.parent[x], x = top, self.parent.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _blocks(bits: list[int], radius: int) -> list[int]:
    """Masks of every pair of the radius + 2 blocks that the bits fall into: within the radius, at least one pair agrees."""
    parts = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), radius + 2)]
    return [a | b for a, b in combinations(parts, 2)]


def link_shard(values: list[int], free: list[int], radius: int, classes: Classes, tree_size: int = TREE_SIZE) -> None:
    """Joins all of values that are within the radius; they agree on all bits but the free ones."""
    if len(values) > tree_size and len(free) >= 2 * (radius + 2):
        for mask in _blocks(free, radius):
            shards: dict[int, list[int]] = {}
            for x in values:
                shards.setdefault(x & mask, []).append(x)
            for own in shards.values():
                if len(own) > 1:
                    link_shard(own, [b for b in free if not mask >> b & 1], radius, classes, tree_size)
        return
    tree = BKTree(values[0])
    for x in values[1:]:
        for near in tree.add_and_find(x, radius):
            classes.join(x, near)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Each row once for each mask: mask (the bits that a shard agrees on), shard (their values), fp."""
    keys = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("shard")) for m in masks])
    return rows.select("fp", F.explode(keys).alias("k")).select("k.mask", "k.shard", "fp")


def links(distinct: DataFrame, radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b), a > b as unsigned numbers, whose components are those of all pairs within the radius. distinct: fp long, without repeats."""
    import pyarrow as pa

    masks = _blocks(list(range(64)), radius)
    shards = _dealt(distinct, masks)
    sizes = shards.groupBy("mask", "shard").agg(F.count("*").alias("n"))
    most = max(shard_rows, distinct.count() * len(masks) // 10_000)
    large = cut_lineage(sizes.filter(F.col("n") > most).select("mask", "shard"))  # 10,000 rows at most
    if not large.isEmpty():
        whole = shards.join(F.broadcast(large), ["mask", "shard"], "left_anti")
        parts = [whole.select("mask", "shard", "fp")]
        for m in masks:
            own = shards.filter(F.col("mask") == _signed(m)).join(F.broadcast(large), ["mask", "shard"], "left_semi")
            parts.append(_dealt(own.select("fp"), [m | x for x in _blocks([b for b in range(64) if not m >> b & 1], radius)]))
        shards = parts[0]
        for p in parts[1:]:
            shards = shards.union(p)
    dealt = shards.repartition("mask", "shard").sortWithinPartitions("mask", "shard", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links_of(mask: int, values: np.ndarray) -> list[tuple[int, int]]:
        classes = Classes()
        link_shard(values.view(np.uint64).tolist(), [b for b in range(64) if not mask >> b & 1], radius, classes)
        return [(x, top) for x in list(classes.parent) if (top := classes.find(x)) != x]

    def run(batches):
        held, own = None, []  # the shard that is being read, which batches may cut
        for batch in batches:
            mask, shard, fp = (batch.column(i).to_numpy() for i in range(3))
            cuts = [0, *(np.flatnonzero((mask[1:] != mask[:-1]) | (shard[1:] != shard[:-1])) + 1).tolist(), len(fp)]
            for x, y in zip(cuts, cuts[1:]):
                if x < y and (mask[x], shard[x]) != held:
                    if sum(map(len, own)) > 1:
                        yield _record(links_of(int(held[0]), np.concatenate(own)), schema)
                    held, own = (mask[x], shard[x]), []
                own.append(fp[x:y].copy())
        if sum(map(len, own)) > 1:
            yield _record(links_of(int(held[0]), np.concatenate(own)), schema)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _record(found: list[tuple[int, int]], schema):
    import pyarrow as pa

    values = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(values[:, 0]), pa.array(values[:, 1])], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """node, comp for every node of edges (a, b); comp is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, if that is smaller, and jumps along hooks until all lead to roots: as each
    jump doubles the way, a path of n nodes takes about log2(n) jumps. Contracting leaves edges between roots alone, so every round
    at least halves the nodes that still have edges. A node that many edges share is joined by broadcast.
    """
    edges = cut_lineage(edges.select("a", "b").filter("a <> b").distinct())
    labels = edges.select("a").union(edges.select("b")).distinct().toDF("node").withColumn("comp", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        near = cut_lineage(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("top"), F.count("*").alias("n")))
        hot = hot_keys(near.select("node", "n"))
        hooks = near.select("node", "top")
        while True:
            held = hot_keys(hooks.groupBy("top").agg(F.count("*").alias("n")))
            ways = hooks.toDF("top", "further")
            jumped = join_hot(hooks, ways, "top", held).select("node", F.col("further").alias("top"), (F.col("further") != F.col("top")).alias("moved"))
            jumped = cut_lineage(jumped)
            hooks = jumped.select("node", "top")
            if jumped.filter("moved").isEmpty():
                break
        held = hot_keys(labels.groupBy("comp").agg(F.count("*").alias("n")))
        labels = cut_lineage(join_hot(labels, hooks.toDF("comp", "top"), "comp", held, "left").select("node", F.coalesce("top", "comp").alias("comp")))
        contracted = join_hot(join_hot(edges, hooks.toDF("a", "x"), "a", hot), hooks.toDF("b", "y"), "b", hot).filter("x <> y")
        edges = cut_lineage(contracted.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    return labels


def _as_long(fingerprint) -> "F.Column":
    """The number that 16 hexadecimal digits write, as a signed long."""
    high = lambda x, y: F.conv(F.substring(fingerprint, x, y), 16, 10).cast("long")
    return F.shiftleft(high(1, 8), 32).bitwiseOR(high(9, 8))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint and component_id, the smallest doc_id of the component, for each row of docs (doc_id, text)."""
    prints = cut_lineage(fingerprints(docs, shingle))
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).withColumn("fp", _as_long("fingerprint")))
    comps = components(links(distinct.select("fp"), radius))
    linked = cut_lineage(distinct.join(comps.toDF("fp", "comp"), "fp").select("fingerprint", "comp", "first"))
    tops = linked.groupBy("comp").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    linked = join_hot(linked, tops.select("comp", "component_id"), "comp", hot_keys(tops.select("comp", "n"))).select("fingerprint", "component_id")
    classes = distinct.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "first").alias("component_id"))
    return join_hot(prints, classes, "fingerprint", hot_keys(distinct.select("fingerprint", "n"))).select("doc_id", "fingerprint", "component_id")
