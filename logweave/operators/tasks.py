"""The task queue as data: claims, appends, attempts, signals, timers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folding import fold


def claimable(tasks: DataFrame, now_ms: Column) -> DataFrame:
    """Visible, and unowned or with an expired lease. tasks: queue, branch_id, visible_at_ms, lease_owner, lease_expires_at_ms."""
    return tasks.filter((F.col("visible_at_ms") <= now_ms) & (F.col("lease_owner").isNull() | (F.col("lease_expires_at_ms") <= now_ms)))


def next_claim(tasks: DataFrame, now_ms: Column) -> DataFrame:
    """One task a queue: the one visible for longest, ties to the smaller branch. Aggregated, so no queue has to fit in a task."""
    best = F.min(F.struct("visible_at_ms", "branch_id")).alias("best")
    return claimable(tasks, now_ms).groupBy("queue").agg(best, F.count("*").alias("claimable")).select("queue", F.col("best.branch_id").alias("branch_id"), F.col("best.visible_at_ms").alias("visible_at_ms"), "claimable")


def append_verdicts(log: DataFrame) -> DataFrame:
    """Verdicts over claims and appends in order (branch_id, seq: as arrived, claims, epoch: as held, first_seq: as sent).

    A claim raises the task's epoch. An append is stale if it doesn't hold the task's epoch, a conflict if it doesn't begin right behind the
    accepted head, and else moves the head. Refused appends change nothing."""

    def step(state, row):
        epoch, head = state
        if row["claims"]:
            return (epoch + 1, head), ("claimed", epoch + 1, head)
        if not epoch or row["epoch"] != epoch:  # without a claim there is no task
            return state, ("stale epoch", epoch, head)
        if row["first_seq"] != head + 1:
            return state, ("conflict", epoch, head)
        return (epoch, head + 1), ("accepted", epoch, head + 1)

    return fold(log, "branch_id", ["seq"], (0, -1), step, "verdict string, task_epoch bigint, head bigint")


def fence_counters(verdicts: DataFrame, key: str = "branch_id") -> DataFrame:
    n = lambda v: F.count_if(F.col("verdict") == v)
    return verdicts.groupBy(key).agg(n("accepted").alias("appends_accepted"), n("stale epoch").alias("rejected_stale_epoch"), n("conflict").alias("rejected_conflict"))


def consumed_signals(events: DataFrame, branches: DataFrame) -> DataFrame:
    """How many signals of each name a branch took from its inbox itself: received from its own fork on. events: branch_id, seq, name, source."""
    own = branches.select("branch_id", F.coalesce("fork_seq", F.lit(0)).alias("from_seq"))
    taken = events.filter("source = 'inbox'").join(own, "branch_id").filter("seq >= from_seq")
    return taken.groupBy("branch_id", "name").agg(F.count("*").alias("consumed"))


def without_cancelled(tasks: DataFrame, branches: DataFrame) -> DataFrame:
    """Tasks of cancelled branches leave the queue. branches: branch_id, status."""
    return tasks.join(branches.filter("status = 'cancelled'").select("branch_id"), "branch_id", "left_anti")


def attempts(claims: DataFrame, most: int) -> DataFrame:
    """Attempts since the last progress: 1 when the head has grown since the claim before, else one more; over most, quarantined. claims: branch_id, seq, head."""
    own = Window.partitionBy("branch_id").orderBy("seq")
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lag("head").over(own)
    grown = claims.withColumn("grew", F.when(before.isNull() | (F.col("head") > before), 1).otherwise(0)).withColumn("island", F.sum("grew").over(so_far))
    n = F.row_number().over(Window.partitionBy("branch_id", "island").orderBy("seq"))
    return grown.withColumn("attempt", n).withColumn("quarantined", F.col("attempt") > most).drop("grew", "island")


def match_signals(waits: DataFrame, signals: DataFrame) -> DataFrame:
    """The nth wait of a name takes the nth signal of that name; waits without one stay, with a null payload. Both: branch_id, name, seq."""
    nth = F.row_number().over(Window.partitionBy("branch_id", "name").orderBy("seq")) - 1
    inbox = signals.withColumn("idx", nth).select("branch_id", "name", "idx", "payload")
    return waits.withColumn("idx", nth).join(inbox, ["branch_id", "name", "idx"], "left")


def signal_outcome(recorded, override, inbox, deadline_ms, now_ms) -> Column:
    """Where a wait's answer comes from: what was recorded, else the override, else the inbox, else the timeout, else it parks."""
    return (
        F.when(F.col(recorded).isNotNull(), "recorded").when(F.col(override).isNotNull(), "override").when(F.col(inbox).isNotNull(), "inbox").when(F.col(deadline_ms) <= F.col(now_ms), "timed out").otherwise("parked")
    )


def wake_at(suspensions: DataFrame, key: str) -> DataFrame:
    """The earliest of several suspensions; one that can't be waited for (tip, diverged) takes precedence."""
    sticky = F.col("kind").isin("tip", "diverged")
    return suspensions.groupBy(key).agg(F.min(F.when(F.col("kind") == "until", F.col("at_ms"))).alias("visible_at_ms"), F.bool_or(sticky).alias("stuck"))


def terminal(events: DataFrame, kinds: list[str]) -> DataFrame:
    """The last terminal event of each branch decides what recovery does; null for branches without one."""
    ends = F.when(F.col("type").isin(kinds), F.col("seq"))
    return events.groupBy("branch_id").agg(F.max_by("type", ends).alias("terminal"), F.max(ends).alias("at_seq"), F.max("seq").alias("head"))


def slice_outcome(status, terminal, attempts, most: int, result, now_ms, until_ms) -> Column:
    """What becomes of a task after a worker's slice: outcome, the branch's next status, and when it may be claimed again (null: never, or unchanged).

    In this order: a cancelled branch is left alone; a terminal event that stands already is finished; too many claims without progress
    quarantine; then the result decides: done, until (a time), diverged, tip, fenced, transient, in doubt, nondeterminism, or another error.
    A transient error waits 1 s, doubled with each attempt up to the eighth."""
    text = lambda x: F.lit(x).cast("string")
    made = lambda outcome, to=None, at=None: F.struct(text(outcome).alias("outcome"), text(to).alias("next_status"), (F.lit(None).cast("bigint") if at is None else at).alias("visible_at_ms"))
    wait = (F.pow(F.lit(2), F.least(F.col(attempts), F.lit(8))) * 1000).cast("bigint")
    return (
        F.when(F.col(status) == "cancelled", made("noop"))
        .when(F.col(terminal) == "RunCompleted", made("finished", "completed")).when(F.col(terminal) == "RunFailed", made("finished", "failed")).when(F.col(terminal) == "RunCancelled", made("finished", "cancelled"))
        .when(F.col(attempts) > most, made("parked", "quarantined"))
        .when(F.col(result) == "done", made("completed", "completed")).when(F.col(result) == "until", made("suspended", "suspended", F.col(until_ms)))
        .when(F.col(result).isin("diverged", "tip", "nondeterminism"), made("parked", "quarantined")).when(F.col(result) == "in doubt", made("parked", "in_doubt"))
        .when(F.col(result).isin("fenced", "none"), made("abandoned")).when(F.col(result) == "transient", made("retrying", None, F.col(now_ms) + wait))
        .otherwise(made("failed", "failed"))
    )


def recorded_values(asked: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """For steps that ask for a time, a random number or an id: the first value recorded for the step, or null beyond the tip. recorded: keys, seq, value."""
    first = recorded.groupBy(*keys).agg(F.min_by("value", "seq").alias("value"))
    return asked.join(first, keys, "left")
