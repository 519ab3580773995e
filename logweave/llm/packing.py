"""Operator 5: best-fit packing of documents into sequences, planned on the histogram of lengths.

1. Tasks encode whole texts and cut each document into pieces of at most max_tokens.
2. The histogram of piece lengths (max_tokens rows at most) goes to the driver, which runs best-fit decreasing over
   counts: all pieces of a length are placed at once into the fullest groups of equal sequences that still take them.
   The plan has a row for each length and group, never one for each piece.
3. Pieces get a rank within their length. It is the rank within (length, salt) plus the number of pieces of that length
   in smaller salts. The salts grow with the number of pieces, at about SALT_ROWS pieces each, so that however many pieces
   share a length, a task ranks at most about SALT_ROWS of them at once.
4. Pieces take the planned slots by joining on rank within length.

Null texts are empty: they have the end id alone. Repeated rows are packed as rows of their own; among equal ones it doesn't
matter which takes which slot. Other columns aren't read. An empty table gives an empty result.
"""

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, local_rows, map_batches
from .word_encoder import WordEncoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long"
PLAN = "length long, lo long, hi long, per_sequence long, first_sequence long, first_offset long"
SALT_ROWS = 20_000


def best_fit_plan(counts: dict[int, int], max_tokens: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for counts[length] pieces of each length. Ranks lo to hi - 1 of a length fill sequences from first_sequence on,
    per_sequence of them each, from first_offset on."""
    plan, groups, rooms, n_sequences = [], defaultdict(list), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, size = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                per = max_tokens // length
                room, first, size = max_tokens, n_sequences, -(-left // per)
                n_sequences += size
            per = room // length
            whole = min(size, left // per)
            for first, size, per in ((first, whole, per), (first + whole, min(size - whole, 1), left - whole * per if whole < size else 0), (first + whole + 1, size - whole - 1, 0)):
                if size <= 0:
                    continue
                placed = size * per
                if placed:
                    plan.append((length, rank, rank + placed, per, first, max_tokens - room))
                    rank, left = rank + placed, left - placed
                if rest := room - per * length:
                    if rest not in groups:
                        insort(rooms, rest)
                    groups[rest].append((first, size))
    return plan


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int, end_id: int) -> DataFrame:
    def make():
        encoder = WordEncoder(tokenizer)
        end = np.array([end_id], "<u4")

        def apply(rows):
            out = {x.split()[0]: [] for x in PIECES.split(", ")}
            for doc_id, ids in zip(rows["doc_id"], encoder.ids(rows["text"])):
                ids = np.concatenate([ids, end])
                for k, start in enumerate(range(0, len(ids), max_tokens)):
                    part = ids[start : start + max_tokens]
                    crc = zlib.crc32(part.tobytes())
                    for column, value in zip(out.values(), (doc_id, k, start, len(part), crc, zlib.crc32(f"{doc_id}:{k}:{crc}".encode()))):
                        column.append(value)
            return out

        return apply

    return map_batches(docs.select("doc_id", "text"), make, PIECES)


def pack(docs: DataFrame, max_tokens: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    made = cut_lineage(pieces(docs, tokenizer, max_tokens, end_id))
    made = made.withColumn("salt", F.pmod("spread", F.lit(-(-made.count() // SALT_ROWS) or 1)))
    by_salt = made.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_tokens rows at most
    plan = local_rows(spark, best_fit_plan(counts, max_tokens), PLAN)
    smaller = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # a row for each salt
    before = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("smaller"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = made.withColumn("own_rank", F.row_number().over(own) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("smaller") + F.col("own_rank"))
    slots = ranked.join(F.broadcast(plan), [ranked["length"] == plan["length"], F.col("rank") >= F.col("lo"), F.col("rank") < F.col("hi")]).drop(plan["length"])
    place = F.col("rank") - F.col("lo")
    return slots.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.expr("(rank - lo) div per_sequence")).alias("sequence_id"),
        (F.col("first_offset") + place % F.col("per_sequence") * F.col("length")).alias("offset"),
    )
