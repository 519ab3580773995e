"""Hash chains: sealing (a fold, in order) and verifying (each row by itself, then its neighbour)."""

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import event_hash
from ..functions.scalars import GENESIS
from .folding import in_order


def seal(events: DataFrame) -> DataFrame:
    """events (branch_id, seq, epoch, at_ms, body: canonical) with prev_hash and hash. Each hash depends on the one before it,
    so a branch is folded in order; branches are independent, and rows stream through a task sorted by (branch, seq)."""
    columns = ["branch_id", "seq", "epoch", "at_ms", "body"]
    dealt = in_order(events.select(*columns), "branch_id", ["seq"])
    fields = {f.name: f.dataType.simpleString() for f in dealt.schema}
    schema = ", ".join(f"{c} {fields[c]}" for c in columns) + ", prev_hash string, hash string"

    def run(batches):
        branch, last = None, GENESIS
        for b in batches:
            prev, own = [], []
            for branch_id, seq, epoch, at_ms, body in zip(*(b[c] for c in columns)):
                if branch_id != branch:
                    branch, last = branch_id, GENESIS
                prev.append(last)
                last = hashlib.sha256(f'{{"at_ms":{at_ms},"body":{body},"branch_id":"{branch_id}","epoch":{epoch},"prev_hash":"{last}","seq":{seq}}}'.encode()).hexdigest()
                own.append(last)
            yield b.assign(prev_hash=pd.Series(prev, b.index, object), hash=pd.Series(own, b.index, object))

    return dealt.mapInPandas(run, schema)


def findings(sealed: DataFrame) -> DataFrame:
    """Rows that break the chain, with the first error that holds: tampered, gap (of the first seq or the next), broken link."""
    own = Window.partitionBy("branch_id").orderBy("seq")
    before, link = F.lag("seq").over(own), F.lag("hash").over(own)
    checked = sealed.withColumns({"computed": event_hash(), "before": before, "link": link})
    error = (
        F.when(F.col("computed") != F.col("hash"), "tampered")
        .when(F.col("before").isNull() & (F.col("seq") != 0), "gap")
        .when(F.col("before").isNull() & (F.col("prev_hash") != GENESIS), "broken link")
        .when(F.col("seq") != F.col("before") + 1, "gap")
        .when(F.col("prev_hash") != F.col("link"), "broken link")
    )
    return checked.withColumn("error", error).filter("error is not null").drop("computed", "before", "link")


def verdicts(sealed: DataFrame) -> DataFrame:
    """branch_id, at_seq, error: the first finding of each branch, null for a sound chain."""
    first = findings(sealed).groupBy("branch_id").agg(F.min("seq").alias("at_seq"), F.min_by("error", "seq").alias("error"))
    return sealed.select("branch_id").distinct().join(first, "branch_id", "left")


def epoch_regressions(events: DataFrame) -> DataFrame:
    """Events whose epoch is below one seen before in their branch: a writer that had lost its lease."""
    earlier = Window.partitionBy("branch_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("highest", F.max("epoch").over(earlier)).filter(F.col("epoch") < F.col("highest"))
