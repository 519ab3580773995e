"""Folds in order: for rules in which each verdict depends on all verdicts before it. The state of a key has a constant size and its rows stream through a task."""

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


#: About how many rows a task sorts. Tasks grow in number with the input, and not in size, whatever spark.sql.shuffle.partitions is.
TASK_ROWS = 250_000


def tasks_for(*tables: DataFrame) -> int:
    """How many tasks the rows of all tables are dealt to: of TASK_ROWS, and of fewer where that leaves cores idle. A key's rows stay together, however many."""
    n, cores = sum(t.count() for t in tables), tables[0].sparkSession.sparkContext.defaultParallelism
    return max(math.ceil(n / TASK_ROWS), min(cores, math.ceil(n / 10_000)), 1)


def in_order(rows: DataFrame, key: str, order: list[str], tasks: int | None = None) -> DataFrame:
    """rows dealt to tasks by key, each key's in order. Rows that were dealt to as many tasks by the key before aren't dealt again."""
    return rows.repartition(tasks or tasks_for(rows), key).sortWithinPartitions(key, *order)


def fold(rows: DataFrame, key: str, order: list[str], start: tuple, step: Callable, made: str, tasks: int | None = None) -> DataFrame:
    """rows with the columns made ("name type, ..."): step(state, row as a dict) gives the next state and their values. Rows of a key are taken in order."""
    names, kinds = rows.columns, dict(rows.dtypes)
    dealt = in_order(rows, key, order, tasks)
    new = [x.split()[0] for x in made.split(", ")]

    def run(batches):
        own, state = None, start
        for batch in batches:
            out = []
            for values in zip(*(batch[c].tolist() for c in names)):
                row = dict(zip(names, values))
                if row[key] != own:
                    own, state = row[key], start
                state, result = step(state, row)
                out.append(result)
            columns = list(zip(*out)) if out else [()] * len(new)
            yield batch.assign(**{c: pd.Series(v, batch.index, object) for c, v in zip(new, columns)})

    return dealt.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", " + made)
