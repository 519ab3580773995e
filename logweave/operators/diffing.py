"""Comparing two branches: trajectory, content, outcome, economics."""

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scalars import percent_change


def _common_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each start of b, the length of its longest common subsequence with a."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def _common(a: np.ndarray, b: np.ndarray, at_a: int = 0, at_b: int = 0) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by halving a: memory in proportion to the steps."""
    if not len(a) or not len(b):
        return []
    if len(a) == 1:
        found = np.flatnonzero(b == a[0])
        return [(at_a, at_b + int(found[0]))] if len(found) else []
    half = len(a) // 2
    cut = int((_common_lengths(a[:half], b) + _common_lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
    return _common(a[:half], b[:cut], at_a, at_b) + _common(a[half:], b[cut:], at_a + half, at_b + cut)


def edit_script(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """A shortest script (equal / delete / insert, place in a, place in b); between two equal runs all deletes come before all inserts."""
    numbers: dict[str, int] = {}
    x, y = (np.array([numbers.setdefault(s, len(numbers)) for s in side], np.int64) for side in (a, b))
    own_x, own_y = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))  # what only one side has is in no common subsequence
    out, i, j = [], 0, 0
    for p, q in [*((int(own_x[p]), int(own_y[q])) for p, q in _common(x[own_x], y[own_y])), (len(a), len(b))]:
        out += [("delete", k, -1) for k in range(i, p)] + [("insert", -1, k) for k in range(j, q)]
        if p < len(a):
            out.append(("equal", p, q))
        i, j = p + 1, q + 1
    return out


def trajectory(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Alignment of two step lists (key, seq, step_id) for each key: key, position, op, step_id. Keys of one side alone stay."""
    steps = lambda side, name: side.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "step_id"))), lambda s: s["step_id"]).alias(name))
    none = F.array().cast("array<string>")
    both = steps(a, "old").join(steps(b, "new"), key, "full_outer").select(key, F.coalesce("old", none).alias("old"), F.coalesce("new", none).alias("new"))
    kind = both.schema[key].dataType

    def align(batches):
        import pyarrow as pa

        for batch in batches:
            for own, old, new in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                script = edit_script(old, new)
                text = [old[x] if op != "insert" else new[y] for op, x, y in script]
                yield pa.RecordBatch.from_arrays([pa.array([own.as_py()] * len(script), own.type), pa.array(range(len(script)), pa.int32()), pa.array([s[0] for s in script], pa.string()), pa.array(text, pa.string())], names=[key, "position", "op", "step_id"])

    return both.mapInArrow(align, f"`{key}` {kind.simpleString()}, position int, op string, step_id string")


@F.pandas_udf(StringType())
def text_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """A unified diff with two lines of context; empty if equal."""
    return pd.Series(["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="", n=2)) for a, b in zip(old, new)])


def content_changes(a: DataFrame, b: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """For steps that both have: whether their contents differ."""
    left, right = a.select(*keys, F.col(content).alias("old")), b.select(*keys, F.col(content).alias("new"))
    return left.join(right, keys).withColumn("changed", ~F.col("old").eqNullSafe(F.col("new")))


def changed_fields(a, b) -> Column:
    """Sorted keys of two flat JSON objects whose values differ; a missing key differs from null. Empty unless both are objects."""
    fields = "map<string,string>"
    left, right = F.from_json(a, fields), F.from_json(b, fields)
    keys = F.array_sort(F.array_union(F.map_keys(left), F.map_keys(right)))
    has = lambda m, k: F.array_contains(F.map_keys(m), k)
    differ = F.filter(keys, lambda k: (has(left, k) != has(right, k)) | ~F.try_element_at(left, k).eqNullSafe(F.try_element_at(right, k)))
    return F.when(left.isNotNull() & right.isNotNull(), differ).otherwise(F.array().cast("array<string>"))


def same_outcome(a, b, paths: list[str]) -> Column:
    """Judged on some paths of two JSON texts, missing as null; on the whole text if there are no paths."""
    if not paths:
        return F.col(a).eqNullSafe(F.col(b))
    out = F.lit(True)
    for p in paths:
        out = out & F.get_json_object(a, f"$.{p}").eqNullSafe(F.get_json_object(b, f"$.{p}"))
    return out


def economics_delta(pairs: DataFrame, economics: DataFrame, key: str = "branch_id") -> DataFrame:
    """pairs: a, b (branches). Both sides' cost and tokens, and the changes in per cent."""
    e = economics.select(key, "cost_micros", "tokens")
    left, right = e.toDF("a", "cost_a", "tokens_a"), e.toDF("b", "cost_b", "tokens_b")
    return pairs.join(left, "a").join(right, "b").withColumns({"cost_pct": percent_change("cost_a", "cost_b"), "tokens_pct": percent_change("tokens_a", "tokens_b")})
