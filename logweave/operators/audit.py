"""Audits across runs: refunds against payments, caps, fleet totals."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chain import epoch_regressions
from .folding import fold, tasks_for


def refund_audit(payments: DataFrame, refunds: DataFrame) -> DataFrame:
    """For each payment: how many refunds, their sum, and whether there is more than one; payments without refunds stay."""
    sums = refunds.groupBy("payment").agg(F.count("*").alias("refunds"), F.sum("cents").alias("refunded"))
    joined = payments.join(sums, "payment", "left").withColumns({"refunds": F.coalesce("refunds", F.lit(0)), "refunded": F.coalesce("refunded", F.lit(0))})
    return joined.withColumn("duplicate", F.col("refunds") > 1)


def over_cap(payments: DataFrame, refunds: DataFrame, order: list[str]) -> DataFrame:
    """Refunds in order, with the sum that each would come to, and whether that exceeds the payment. A refund over the cap is refused and adds nothing to the sum
    of later ones."""
    caps = payments.select("payment", F.col("cents").alias("cap"))

    def step(refunded, row):
        so_far = refunded + row["cents"]
        over = so_far > row["cap"]
        return (refunded if over else so_far), (so_far, over)

    # Join and fold share one dealing out, so neither sorts more than a task's rows.
    tasks = tasks_for(refunds, caps)
    capped = refunds.repartition(tasks, "payment").join(caps.repartition(tasks, "payment"), "payment")
    return fold(capped, "payment", order, 0, step, "so_far bigint, over boolean", tasks)


def fleet_summary(runs: DataFrame, killed: Column, amount: Column, clean: Column) -> DataFrame:
    return runs.agg(F.count("*").alias("total_runs"), F.count_if(killed).alias("total_killed"), F.coalesce(F.sum(amount), F.lit(0)).alias("total_refunds"), F.coalesce(F.bool_and(clean), F.lit(True)).alias("all_clean"))


def within_run(annotations: DataFrame, run_keys: DataFrame, bounds: DataFrame, run: str) -> DataFrame:
    """Annotations of a run: those without a key or with one of the run's, and without a time or within the run's first and last event."""
    keyed = annotations.join(run_keys.select(run, "idem_key").distinct(), [run, "idem_key"], "left_semi").unionByName(annotations.filter("idem_key is null"))
    inside = F.col("at_ms").isNull() | F.col("at_ms").between(F.col("first_ms"), F.col("last_ms"))
    return keyed.join(bounds.select(run, "first_ms", "last_ms"), run).filter(inside).drop("first_ms", "last_ms")


def invariants(events: DataFrame, intent: Column, commit: Column, key: str, step: str) -> DataFrame:
    """branch_id and four counts: events behind a higher epoch, keys with several commits, steps with an intent but no commit, and with a commit but no intent."""
    behind = epoch_regressions(events).groupBy("branch_id").agg(F.count("*").alias("regressions"))
    twice = events.filter(commit).groupBy("branch_id", key).count().filter("count > 1").groupBy("branch_id").agg(F.count("*").alias("twice"))
    steps = events.filter(intent | commit).groupBy("branch_id", step).agg(F.bool_or(intent).alias("asked"), F.bool_or(commit).alias("answered"))
    sides = steps.groupBy("branch_id").agg(F.count_if(~F.col("answered")).alias("unanswered"), F.count_if(~F.col("asked")).alias("unasked"))
    out = events.select("branch_id").distinct()
    for found in (behind, twice, sides):
        out = out.join(found, "branch_id", "left")
    return out.na.fill(0)
