"""Structured Streaming forms: the lease machine over a command stream, first-write-wins, and segments by event time."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lease_machine import VERDICTS, State, fold

STATE = "epoch long, owned boolean, expires_ms long, visible_ms long, attempts int, progress long, head long, finished boolean"


def verdict_stream(commands: DataFrame, lease_ms: int) -> DataFrame:
    """Verdicts as commands arrive; one small state for each branch. Commands of a micro-batch are applied in the order of n."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = State(*state.get) if state.exists else State()
        rows = pd.concat(list(batches))
        out, now = fold(rows, now, lease_ms)
        state.update(tuple(now))
        yield out

    return commands.groupBy("branch_id").applyInPandasWithState(step, VERDICTS, STATE, "append", GroupStateTimeout.NoTimeout)


def append_accepted(verdicts: DataFrame, path: str):
    """A writer that adds accepted appends to a table of Parquet folders, one for each micro-batch. A batch that runs again after a lost executor or a restart
    writes its own folder anew, so each append is there once."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.filter("command = 'append' and verdict = 'accepted'").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return verdicts.writeStream.outputMode("append").foreachBatch(sink)


def answered_once(requests: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """The first request of a key passes, repeats within the watermark are dropped; state is bounded by the watermark."""
    return requests.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def spend_by_window(events: DataFrame, at: str, window: str, late: str) -> DataFrame:
    """Cost and events of each type in tumbling windows; late rows beyond the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), "type").agg(F.count("*").alias("events"), F.sum("cost_micros").alias("cost_micros"))
