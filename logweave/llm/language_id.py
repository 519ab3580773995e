"""Operator 2: language identification by multinomial naive Bayes over hashed character n-grams.

1. Training tasks lower-case whole texts, turn all that isn't a letter into single spaces, hash the n-grams of 1 to 4
   characters into buckets with integer arithmetic in numpy, and add up counts by language and bucket, and texts by language. One map-side row
   for each language and bucket is shuffled; the driver gets languages x (buckets + 1) numbers.
2. The matrix of log-probabilities (smoothed counts) and the log-priors (shares of the texts) are broadcast; their size doesn't depend on the corpus.
3. Scoring tasks hash the n-grams of many texts at once. Each text's n-grams are a sparse row of counts; rows meet the matrix by
   gathering the matrix' rows and adding them up by text. Long texts are cut into parts of PART characters that lose no n-gram.

The prediction is the language of the greatest posterior. The score is the posterior with log-likelihoods taken per character (so that
long texts don't all reach 1) and the prior. Texts that are null or have no letter are `und`, with score 0; so are all texts if nothing could be
learned. Ties go to the first language by name. Repeated rows come back once each and count as often in training; other columns
aren't read. An empty table gives an empty result.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

_SPACE = np.uint32(32)


def letters(text: str) -> np.ndarray:
    """Code points of the lowered letters, with one space for each gap and at both ends; empty if there is no letter."""
    text = text.lower()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = (points >= 97) & (points <= 122)
    if high := np.flatnonzero(points >= 128).tolist():
        kept[high] = [text[i].isalpha() for i in high]
    if not kept.any():
        return points[:0]
    padded = np.concatenate([[_SPACE], np.where(kept, points, _SPACE), [_SPACE]])
    gap = padded == _SPACE
    return padded[~(gap & np.concatenate([[False], gap[:-1]]))]


def hashed(points: np.ndarray, buckets: int, longest: int):
    """For n from 1 to longest, the bucket of the n-gram that starts at each place."""
    value = np.zeros(len(points), np.uint64)
    for n in range(1, longest + 1):
        if len(points) < n:
            return
        value = value[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        mixed = value ^ (value >> np.uint64(29))
        yield n, (((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


PART, TOGETHER = 1 << 16, 1 << 18


def parts_of(texts: list[str | None], longest: int):
    """Batches of about TOGETHER characters: code points end to end, and for each part of a text (text number, start, end, end of the n-grams that may start in it)."""
    points, parts, size = [], [], 0
    for i, text in enumerate(texts):
        own = letters(text or "").astype(np.uint64)
        for a in range(0, len(own), PART):
            piece = own[a : a + PART + longest - 1]
            points.append(piece)
            parts.append((i, size, size + len(piece), size + min(PART, len(piece))))
            size += len(piece)
            if size >= TOGETHER:
                yield np.concatenate(points), np.array(parts)
                points, parts, size = [], [], 0
    if parts:
        yield np.concatenate(points), np.array(parts)


def grams(texts: list[str | None], buckets: int, longest: int):
    """(text numbers, how many n-grams each has, buckets of all of them, text by text), over and over; a text may come back."""
    for points, parts in parts_of(texts, longest):
        owner, start, end, stop = parts.T
        for n, bucket in hashed(points, buckets, longest):
            count = np.maximum(np.minimum(stop, end - n + 1) - start, 0)
            at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
            yield owner, count, bucket[at]


def count_grams(docs: DataFrame, buckets: int, longest: int) -> DataFrame:
    """lang, bucket, n over docs (text, lang); bucket -1 counts the texts."""

    def run(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            names = sorted(set(langs))
            number = np.searchsorted(names, langs)
            sums = np.zeros(len(names) * buckets, np.int64)
            for owner, count, bucket in grams(batch["text"].to_pylist(), buckets, longest):
                sums += np.bincount(np.repeat(number[owner], count) * buckets + bucket, minlength=len(sums))
            for k, lang in enumerate(names):
                own = np.append(sums[k * buckets : (k + 1) * buckets], np.sum(number == k))
                total[lang] = total[lang] + own if lang in total else own
        for lang, n in total.items():
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(np.where(full == buckets, -1, full), pa.int64()), pa.array(n[full], pa.int64())], names=["lang", "bucket", "n"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, buckets: int, longest: int, smoothing: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages by name, log-probabilities [bucket, language] and log-priors; docs: text and lang without nulls."""
    rows = count_grams(docs, buckets, longest).toPandas()  # languages x (buckets + 1) rows at most
    langs = sorted(rows["lang"].unique())
    counts = np.full((buckets, len(langs)), smoothing)
    texts = rows[rows["bucket"] < 0].set_index("lang")["n"]
    rows = rows[rows["bucket"] >= 0]
    counts[rows["bucket"].to_numpy(int), np.searchsorted(langs, rows["lang"])] += rows["n"]
    prior = np.array([texts[x] for x in langs], float)
    return langs, np.log(counts / counts.sum(0)).astype(np.float32), np.log(prior / max(prior.sum(), 1))


def log_likelihoods(texts: list[str | None], weights: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weights [text, language], and each text's number of n-grams."""
    total, size = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), np.int64)
    for owner, count, bucket in grams(texts, len(weights), longest):
        owner, count = owner[count > 0], count[count > 0]
        if len(count):
            np.add.at(total, owner, np.add.reduceat(weights[bucket], np.cumsum(count) - count, axis=0, dtype=float))
            np.add.at(size, owner, count)
    return total, size


def identify(docs: DataFrame, training: DataFrame, buckets: int = 1 << 14, longest: int = 4, smoothing: float = 0.5) -> DataFrame:
    """doc_id, lang_pred and score for each row of docs (doc_id, text), learned from training (text, lang)."""
    langs, matrix, prior = train(training.filter("text is not null and lang is not null"), buckets, longest, smoothing)
    model = docs.sparkSession.sparkContext.broadcast(matrix)

    def make():
        def apply(rows):
            total, size = log_likelihoods(rows["text"], model.value, longest)
            if not langs:
                return {"doc_id": rows["doc_id"], "lang_pred": ["und"] * len(size), "score": [0.0] * len(size)}
            best = (total + prior).argmax(1)
            mean = total * (longest / np.maximum(size, 1))[:, None] + prior
            score = 1 / np.exp(mean - mean[np.arange(len(best)), best][:, None]).sum(1)
            return {"doc_id": rows["doc_id"], "lang_pred": [langs[b] if n else "und" for b, n in zip(best.tolist(), size.tolist())], "score": np.where(size > 0, score, 0.0).tolist()}

        return apply

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double")
