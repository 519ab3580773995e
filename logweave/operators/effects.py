"""Effects: open intents, latest states, duplicates, deduplication by key, the protocol, and simulation from the parent."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def open_effects(intents: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Intents without a commit, abort or in-doubt record of the same step."""
    return intents.join(results.select(*keys), keys, "left_anti")


def latest_state(changes: DataFrame, key, order: list[str]) -> DataFrame:
    """Upserts folded: the last state, the last external reference that isn't null, and the number of attempts."""
    keys = [key] if isinstance(key, str) else key
    at = F.struct(*order)
    return changes.groupBy(*keys).agg(F.max_by("state", at).alias("state"), F.max_by("external_ref", F.when(F.col("external_ref").isNotNull(), at)).alias("external_ref"), F.count("*").alias("attempts"))


def duplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that were executed more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("executions")).filter("executions > 1")


def first_write_wins(rows: DataFrame, keys: list[str], answer: list[str], order: list[str]) -> DataFrame:
    """The first answer for a key is the answer to every repeat. An aggregate with map-side combine rather than a window."""
    first = F.min_by(F.struct(*answer), F.struct(*order)).alias("first")
    return rows.groupBy(*keys).agg(first, F.count("*").alias("requests")).select(*keys, *[F.col(f"first.{c}").alias(c) for c in answer], "requests")


def protocol_breaches(events: DataFrame, allowed: list[tuple[str | None, str]], keys: list[str]) -> DataFrame:
    """Transitions of a step (its type before, null at first, and its type) that aren't allowed."""
    before = F.lag("type").over(Window.partitionBy(*keys).orderBy("seq"))
    legal = events.sparkSession.createDataFrame(allowed, "before string, type string")
    moved = events.withColumn("before", before)
    return moved.join(F.broadcast(legal.toDF("legal_before", "legal_type")), F.col("before").eqNullSafe(F.col("legal_before")) & (F.col("type") == F.col("legal_type")), "left_anti")


def runs_live(mode, effect_class, adapter, allow_live) -> Column:
    """Live mode runs all; simulation runs pure and idempotent effects, and adapters that are allowed by name."""
    return (F.col(mode) == "live") | F.col(effect_class).isin("pure", "idempotent") | F.coalesce(F.array_contains(allow_live, F.col(adapter)), F.lit(False))


def simulated_from_parent(child_steps: DataFrame, parent_commits: DataFrame) -> DataFrame:
    """The parent's own first committed output of the same step from the fork on; null where the parent never got there.

    child_steps: branch_id, parent_branch, fork_seq, step_id. parent_commits: branch_id, seq, step_id, output.
    """
    p = parent_commits.select(F.col("branch_id").alias("parent_branch"), "step_id", F.col("seq").alias("parent_seq"), "output")
    joined = child_steps.join(p, ["parent_branch", "step_id"], "left")
    usable = F.col("parent_seq") >= F.col("fork_seq")
    return joined.groupBy("branch_id", "step_id").agg(F.min_by("output", F.when(usable, F.col("parent_seq"))).alias("output"))
