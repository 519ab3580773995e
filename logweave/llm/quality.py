"""Operator 10: quality rules and an isolation forest on their statistics.

1. Tasks compute each whole text's rule statistics. Two base rules reject on them alone.
2. The forest sees the statistics as rates (FEATURES), points of the unit cube. Every tree takes a random sample and splits the
   cube: each node cuts its own box at a random value of a random rate, until a box holds one row or none. Documents that
   few splits isolate have short paths and a high anomaly score, 2 ** (-mean path / normal path). Boxes start from the whole
   cube, not from the sample's range, so that rows far outside of what the sample holds are cut off by the first splits.
   The sample is of rows labelled good: at most fit_rows of them that pass the base rules, those of smallest hash; each tree
   sees tree_rows of them.
3. The threshold: over all labelled rows, the smallest score above which at most keep_loss of the good rows lie; with no
   rows labelled good the forest rejects nothing. A threshold that wouldn't catch more bad than good rows isn't used.
4. Tasks score all rows.

A null or empty text has no words and fails the base rule on words. Repeated rows come back once each; a doc_id with several
labels counts as bad if one of them is 0. Null labels and labels without a document don't count. Other columns aren't read. An
empty table gives an empty result.
"""

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, filter_rows, map_batches, smallest_by_hash

_SYMBOL = b"#*$%&|<>"
_MARKS = b"!\"'()+,-./:;=?@[\\]^_`{}~"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
STATS = BASE + ", features array<double>"
NAMES = [x.split()[0] for x in STATS.split(", ")]
#: What the forest sees of each document, each from 0 to 1.
FEATURES = (
    "n_symbols by word_chars", "n_repeat_words by n_words", "n_dup_lines by lines with a word", "word_chars by n_words, of 30 at most",
    "ASCII capitals by word_chars", "other ASCII marks by word_chars", "share of the commonest word", "log of distinct words by log of words",
)
MEMO_WORDS = 2000


def repeat_words(words: list[bytes], size: int = 8) -> int:
    """Words that lie in a window of size words that the text holds twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    if len(words) <= MEMO_WORDS:
        windows = list(zip(*[words[i:] for i in range(size)]))
        if len(set(windows)) == n:
            return 0
        times = Counter(windows)
        repeated = np.fromiter((times[w] > 1 for w in windows), bool, n)
    else:
        repeated = _repeated(words, size)
    inside = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + size, -1)
    return int((np.cumsum(inside)[:-1] > 0).sum())


def _repeated(words: list[bytes], size: int) -> np.ndarray:
    """For each window, whether it occurs twice or more. Windows are numbered exactly, by the numbers of two shorter ones that cover them, so memory is in proportion to the words."""
    numbers: dict[bytes, int] = {}
    code = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    length = 1
    while length < size:
        longer = min(2 * length, size)
        n = len(words) - longer + 1
        _, code = np.unique(code[:n] * len(words) + code[longer - length : longer - length + n], return_inverse=True)
        length = longer
    return np.bincount(code)[code] > 1


def statistics(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, features."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACE))
    of = lambda kind: len(raw) - len(raw.translate(None, kind))
    symbols = of(_SYMBOL)
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    repeated = repeat_words(words)
    duplicates = len(lines) - len(set(lines))
    failed = n < 20 or 100 * repeated > 30 * n
    m, c = max(n, 1), max(chars, 1)
    times = Counter(words)
    rates = (symbols / c, repeated / m, duplicates / max(len(lines), 1), chars / m / 30, of(_CAPITALS) / c, of(_MARKS) / c, max(times.values(), default=0) / m, float(np.log1p(len(times)) / np.log1p(m)))
    return n, chars, symbols, duplicates, repeated, failed, [min(1.0, x) for x in rates]


def document_statistics(docs: DataFrame) -> DataFrame:
    def make():
        def apply(rows):
            got = [statistics(t) for t in rows["text"]]
            columns = list(zip(*got)) if got else [()] * 7
            return dict(zip(NAMES, [rows["doc_id"], *map(list, columns)]))

        return apply

    return map_batches(docs.select("doc_id", "text"), make, STATS)


def normal_path(n) -> np.ndarray:
    """The mean path length of an unsuccessful search in a random binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as arrays of nodes: feature, value, left child (the right one follows) and path length. A leaf leads to itself."""

    def __init__(self, rows: np.ndarray, trees: int, tree_rows: int, seed: int, deepest: int = 16):
        rng = np.random.default_rng(seed)
        self.size, self.deepest = min(tree_rows, len(rows)), deepest
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, rng) -> tuple:
        feature, value, left, path = [0], [np.inf], [0], [0.0]
        todo = [(rows, 0, 0, np.zeros(rows.shape[1]), np.ones(rows.shape[1]))]
        while todo:
            own, node, depth, low, high = todo.pop()
            if depth >= self.deepest or len(own) < 2:
                path[node] = depth + float(normal_path(len(own)))
                continue
            f = int(rng.integers(rows.shape[1]))
            v = rng.uniform(low[f], high[f])
            feature[node], value[node], left[node] = f, v, len(feature)
            above = own[:, f] >= v
            for k, part in enumerate((own[~above], own[above])):
                child = len(feature)
                feature.append(0), value.append(np.inf), left.append(child), path.append(0.0)
                bounds = low.copy(), high.copy()
                bounds[1 - k][f] = v
                todo.append((part, child, depth + 1, *bounds))
        return tuple(map(np.array, (feature, value, left, path)))

    def path_lengths(self, rows: np.ndarray) -> np.ndarray:
        """The mean over all trees."""
        total, flat, base = np.zeros(len(rows)), np.ascontiguousarray(rows).ravel(), np.arange(len(rows)) * rows.shape[1]
        for feature, value, left, path in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.deepest):
                node = left[node] + (flat[base + feature[node]] >= value[node])
            total += path[node]
        return total / len(self.trees)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; higher is more anomalous."""
        return 2 ** (-self.path_lengths(rows) / max(float(normal_path(self.size)), 1e-9))


def threshold(by_bin: list[tuple[int, int, int]], bins: int, keep_loss: float) -> float:
    """by_bin: (score bin, good rows, bad rows), over all labelled rows."""
    n_good, n_bad = sum(x[1] for x in by_bin), sum(x[2] for x in by_bin)
    good = bad = 0
    found = 2.0
    for b, g, x in sorted(by_bin, reverse=True):
        good, bad = good + g, bad + x
        if good > keep_loss * n_good:
            break
        if bad * max(n_good, 1) > good * max(n_bad, 1):
            found = b / bins
    return found


@dataclass
class Judge:
    """Base rules, forest and threshold. Without a forest nothing but the base rules rejects."""

    forest: IsolationForest | None
    limit: float
    bins: int

    def anomaly(self, features: np.ndarray) -> np.ndarray:
        return self.forest.score(features) if self.forest else np.zeros(len(features))

    def kept(self, failed: np.ndarray, anomaly: np.ndarray) -> np.ndarray:
        return ~failed & (bin_of(anomaly, self.bins) / self.bins < self.limit)


def bin_of(anomaly: np.ndarray, bins: int) -> np.ndarray:
    return np.minimum(np.floor(anomaly * bins), bins - 1)


def features_of(lists) -> np.ndarray:
    return np.array(lists, float).reshape(-1, len(FEATURES))


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int, trees: int, tree_rows: int, keep_loss: float, bins: int, seed: int) -> Judge:
    """stats: STATS, read more than once. labels: doc_id, quality."""
    marked = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality is not null")
    known = cut_lineage(stats.filter("not base_failed").join(marked, "doc_id").select("doc_id", "features", (F.col("quality") > 0).alias("good")))
    good = known.filter("good").select("doc_id", "features")
    sample = smallest_by_hash(good, ["doc_id", "features"], fit_rows, good.count())
    if not sample:
        return Judge(None, 2.0, bins)
    forest = IsolationForest(features_of([r["features"] for r in sample]), trees, tree_rows, seed)
    held = stats.sparkSession.sparkContext.broadcast(forest)

    def make():
        return lambda rows: {"good": rows["good"], "bin": bin_of(held.value.score(features_of(rows["features"])), bins).astype(int).tolist()}

    judged = map_batches(known.select("good", "features"), make, "good boolean, bin int").groupBy("bin")
    by_bin = [tuple(r) for r in judged.agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad")).collect()]  # bins rows at most
    return Judge(forest, threshold(by_bin, bins, keep_loss), bins)


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = 4096, trees: int = 100, tree_rows: int = 256, keep_loss: float = 0.001, bins: int = 10_000, seed: int = 7) -> DataFrame:
    """For each row of docs (doc_id, text): the statistics, base_failed, anomaly and kept. labels: doc_id, quality."""
    stats = cut_lineage(document_statistics(docs))
    judge = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, fit_rows, trees, tree_rows, keep_loss, bins, seed))

    def make():
        def apply(rows):
            anomaly = judge.value.anomaly(features_of(rows.pop("features")))
            kept = judge.value.kept(np.array(rows["base_failed"], bool), anomaly)
            return rows | {"anomaly": anomaly.tolist(), "kept": kept.tolist()}

        return apply

    return map_batches(stats, make, BASE + ", anomaly double, kept boolean")


def good_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = 4096, trees: int = 100, tree_rows: int = 256, keep_loss: float = 0.001, bins: int = 10_000, seed: int = 7) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns. Each row is judged where it lies: none is shuffled."""
    judge = docs.sparkSession.sparkContext.broadcast(fit(cut_lineage(document_statistics(docs)), labels, fit_rows, trees, tree_rows, keep_loss, bins, seed))

    def make() -> Callable[[pa.Array], np.ndarray]:
        def keep(texts):
            got = [statistics(t) for t in texts.to_pylist()]
            return judge.value.kept(np.array([g[5] for g in got], bool), judge.value.anomaly(features_of([g[6] for g in got])))

        return keep

    return filter_rows(docs, "text", make)
