"""The task queue: claims, appends, attempts, signals, timers, the lease machine."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import backoff_ms, epoch_ms
from ..operators import lease_machine, tasks, views
from .bindings import BRANCHES, EVLOG, branches, evlog, table, with_views
from .registry import query

DAY_MS = 86_400_000
NOW = "(SELECT max(epoch_ms(o_orderdate)) FROM orders)"


@query(
    f"""WITH tasks AS (SELECT o_orderpriority AS queue, o_orderkey AS branch_id, epoch_ms(o_orderdate) + {DAY_MS} AS visible_at_ms, CASE WHEN o_orderstatus <> 'O' THEN 'w' || o_custkey % 9 END AS lease_owner,
  epoch_ms(o_orderdate) + {300 * DAY_MS} AS lease_expires_at_ms FROM orders),
free AS (SELECT * FROM tasks WHERE visible_at_ms <= {NOW} AND (lease_owner IS NULL OR lease_expires_at_ms <= {NOW})),
placed AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY visible_at_ms, branch_id) AS place, count(*) OVER (PARTITION BY queue) AS claimable FROM free)
SELECT queue, branch_id, visible_at_ms, claimable FROM placed WHERE place = 1"""
)
def claimable_tasks(spark, d):
    o = table(spark, d, "orders")
    at = epoch_ms("o_orderdate")
    waiting = o.select(
        F.col("o_orderpriority").alias("queue"), F.col("o_orderkey").alias("branch_id"), (at + DAY_MS).alias("visible_at_ms"),
        F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("w"), (F.col("o_custkey") % 9).cast("string"))).alias("lease_owner"), (at + 300 * DAY_MS).alias("lease_expires_at_ms"),
    )
    now = o.agg(F.max(at).alias("now_ms"))
    return tasks.next_claim(waiting.crossJoin(F.broadcast(now)), F.col("now_ms"))  # now is one row


#: Signups claim the task; every 13th event holds the epoch before, every 17th begins one too far.
APPENDS = """appends AS (SELECT branch_id, seq, type = 'signup' AS claims, epoch - 1 - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS epoch,
  count(*) FILTER (epoch > 1 AND type <> 'signup' AND event_id % 13 <> 0 AND event_id % 17 <> 0) OVER (PARTITION BY branch_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS first_seq FROM evlog),
judged AS (SELECT branch_id, CAST(-1 AS BIGINT) AS seq, '' AS verdict, CAST(0 AS BIGINT) AS task_epoch, CAST(-1 AS BIGINT) AS head FROM evlog GROUP BY branch_id
  UNION ALL SELECT branch_id, seq, verdict, task_epoch + CASE WHEN verdict = 'claimed' THEN 1 ELSE 0 END, head + CASE WHEN verdict = 'accepted' THEN 1 ELSE 0 END FROM
  (SELECT a.branch_id, a.seq, j.task_epoch, j.head, CASE WHEN a.claims THEN 'claimed' WHEN j.task_epoch = 0 OR a.epoch <> j.task_epoch THEN 'stale epoch' WHEN a.first_seq <> j.head + 1 THEN 'conflict' ELSE 'accepted' END AS verdict
   FROM judged j JOIN appends a ON a.branch_id = j.branch_id AND a.seq = j.seq + 1))"""


def judged_appends(spark, d):
    e, mark = evlog(spark, d), lambda n: (F.col("event_id") % n == 0).cast("int")
    good = (F.col("epoch") > 1) & (F.col("type") != "signup") & (mark(13) == 0) & (mark(17) == 0)
    sent = F.count(F.when(good, 1)).over(views.ordered().rowsBetween(Window.unboundedPreceding, -1))
    log = e.select("branch_id", "seq", (F.col("type") == "signup").alias("claims"), (F.col("epoch") - 1 - mark(13)).alias("epoch"), (sent + mark(17)).alias("first_seq"))
    return tasks.append_verdicts(log)


@query(with_views(EVLOG, APPENDS) + "SELECT branch_id, seq, verdict, task_epoch, head FROM judged WHERE seq >= 0")
def append_verdicts(spark, d):
    return judged_appends(spark, d).select("branch_id", "seq", "verdict", "task_epoch", "head")


@query(with_views(EVLOG, APPENDS) + "SELECT branch_id, count(*) FILTER (verdict = 'accepted') AS appends_accepted, count(*) FILTER (verdict = 'stale epoch') AS rejected_stale_epoch, count(*) FILTER (verdict = 'conflict') AS rejected_conflict FROM judged WHERE seq >= 0 GROUP BY branch_id")
def fence_counters(spark, d):
    return tasks.fence_counters(judged_appends(spark, d))


@query(with_views(EVLOG, BRANCHES) + "SELECT e.branch_id, e.event_id % 3 AS name, count(*) AS consumed FROM evlog e JOIN branches b USING (branch_id) WHERE e.type = 'click' AND e.event_id % 2 = 0 AND e.seq >= coalesce(b.fork_seq, 0) GROUP BY 1, 2")
def consumed_signals(spark, d):
    received = evlog(spark, d).filter("type = 'click'").select("branch_id", "seq", (F.col("event_id") % 3).alias("name"), F.when(F.col("event_id") % 2 == 0, "inbox").otherwise("override").alias("source"))
    return tasks.consumed_signals(received, branches(spark, d))


@query("SELECT o_orderpriority AS queue, count(*) AS tasks FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderkey % 2 = 0) GROUP BY 1")
def cancelled_tasks(spark, d):
    """What is left in each queue after every second suspended run was cancelled."""
    o = table(spark, d, "orders")
    waiting = o.select(F.col("o_orderkey").alias("branch_id"), F.col("o_orderpriority").alias("queue"))
    known = o.select(F.col("o_orderkey").alias("branch_id"), F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0), "cancelled").otherwise("running").alias("status"))
    return tasks.without_cancelled(waiting, known).groupBy("queue").agg(F.count("*").alias("tasks"))


@query(
    with_views(EVLOG, """claims AS (SELECT branch_id, seq, count(*) FILTER (type = 'purchase') OVER (PARTITION BY branch_id ORDER BY seq) AS head FROM evlog),
grown AS (SELECT *, CASE WHEN head > lag(head) OVER (PARTITION BY branch_id ORDER BY seq) OR lag(head) OVER (PARTITION BY branch_id ORDER BY seq) IS NULL THEN 1 ELSE 0 END AS grew FROM claims),
islands AS (SELECT *, sum(grew) OVER (PARTITION BY branch_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM grown),
counted AS (SELECT branch_id, seq, head, CAST(row_number() OVER (PARTITION BY branch_id, island ORDER BY seq) AS INTEGER) AS attempt FROM islands)""")
    + "SELECT branch_id, seq, head, attempt, attempt > 5 AS quarantined FROM counted"
)
def attempts_quarantine(spark, d):
    e = evlog(spark, d)
    claims = e.select("branch_id", "seq", F.count(F.when(F.col("type") == "purchase", 1)).over(views.ordered()).alias("head"))
    return tasks.attempts(claims, 5)


@query(
    with_views(EVLOG, """waits AS (SELECT branch_id, seq, event_id % 3 AS name, row_number() OVER (PARTITION BY branch_id, event_id % 3 ORDER BY seq) - 1 AS idx FROM evlog WHERE type = 'view'),
inbox AS (SELECT branch_id, event_id % 3 AS name, row_number() OVER (PARTITION BY branch_id, event_id % 3 ORDER BY seq) - 1 AS idx, step_id AS payload FROM evlog WHERE type = 'click')""")
    + "SELECT branch_id, name, CAST(w.idx AS INTEGER) AS idx, w.seq, i.payload FROM waits w LEFT JOIN inbox i USING (branch_id, name, idx)"
)
def signal_match(spark, d):
    e = evlog(spark, d).withColumn("name", F.col("event_id") % 3)
    waits = e.filter("type = 'view'").select("branch_id", "name", "seq")
    signals = e.filter("type = 'click'").select("branch_id", "name", "seq", F.col("step_id").alias("payload"))
    return tasks.match_signals(waits, signals)


@query(
    with_views(EVLOG, "now AS (SELECT max(at_ms) AS now_ms FROM evlog)", "timers AS (SELECT branch_id, at_ms + cost_micros // 10 AS fire_at FROM evlog WHERE type = 'view')")
    + "SELECT branch_id, count(*) FILTER (fire_at <= now_ms) AS due, count(*) FILTER (fire_at > now_ms) AS waiting, min(fire_at) FILTER (fire_at > now_ms) AS next_ms FROM timers, now GROUP BY branch_id"
)
def timers_due(spark, d):
    e = evlog(spark, d)
    timers = e.filter("type = 'view'").select("branch_id", F.expr("at_ms + cost_micros div 10").alias("fire_at")).crossJoin(F.broadcast(e.agg(F.max("at_ms").alias("now_ms"))))  # now is one row
    late = F.col("fire_at") > F.col("now_ms")
    return timers.groupBy("branch_id").agg(F.count_if(~late).alias("due"), F.count_if(late).alias("waiting"), F.min(F.when(late, F.col("fire_at"))).alias("next_ms"))


@query(
    with_views(EVLOG)
    + """SELECT branch_id, seq, CASE WHEN event_id % 2 = 0 THEN 'recorded' WHEN event_id % 3 = 0 THEN 'override' WHEN event_id % 5 = 0 THEN 'inbox' WHEN at_ms + 1000 <= at_ms + cost_micros // 100000 THEN 'timed out' ELSE 'parked' END AS outcome FROM evlog"""
)
def signal_precedence(spark, d):
    e = evlog(spark, d).withColumns({
        "recorded": F.when(F.col("event_id") % 2 == 0, F.lit("r")), "override": F.when(F.col("event_id") % 3 == 0, F.lit("o")), "inbox": F.when(F.col("event_id") % 5 == 0, F.lit("i")),
        "deadline_ms": F.col("at_ms") + 1000, "now_ms": F.expr("at_ms + cost_micros div 100000"),
    })
    return e.select("branch_id", "seq", tasks.signal_outcome("recorded", "override", "inbox", "deadline_ms", "now_ms").alias("outcome"))


@query(with_views(EVLOG) + "SELECT branch_id, seq, CAST(100 * power(2, least(seq, 6)) AS BIGINT) AS wait_ms FROM evlog")
def backoff_schedule(spark, d):
    return evlog(spark, d).select("branch_id", "seq", backoff_ms(F.lit(100), "seq", 6).alias("wait_ms"))


def commands(spark, d):
    """evlog as a command log: types are commands, and every 7th carries the epoch before."""
    e = evlog(spark, d)
    named = F.when(F.col("type") == "signup", "claim").when(F.col("type") == "view", "append").when(F.col("type") == "click", "heartbeat").when(F.col("type") == "error", "retry").otherwise("suspend")
    return e.select(
        "branch_id", F.col("seq").alias("n"), named.alias("command"), "at_ms", (F.col("epoch") - 1 - (F.col("event_id") % 7 == 0).cast("int")).alias("epoch"),
        F.coalesce(F.count(F.when(F.col("type") == "view", 1)).over(views.ordered().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_seq"), F.lit(1).alias("events"), (F.col("at_ms") + 60_000).alias("until_ms"),
    )


@query()
def lease_transitions(spark, d):
    """A fold whose state depends on every verdict before it: tests compare batch, stream and a plain loop."""
    return lease_machine.batch_verdicts(commands(spark, d), 30_000)


RESULTS = ['done', 'until', 'diverged', 'tip', 'fenced', 'transient', 'in doubt', 'nondeterminism', 'error', 'none']


@query(
    with_views(EVLOG, f"""slices AS (SELECT branch_id, seq, at_ms, CASE WHEN event_id % 29 = 0 THEN 'cancelled' ELSE 'running' END AS status, CASE WHEN event_id % 23 = 0 THEN 'RunCompleted' WHEN event_id % 19 = 0 THEN 'RunFailed' END AS terminal,
  event_id % 7 AS attempts, {RESULTS}[1 + event_id % 10] AS result FROM evlog)""")
    + """SELECT branch_id, seq,
  CASE WHEN status = 'cancelled' THEN 'noop' WHEN terminal IS NOT NULL THEN 'finished' WHEN attempts > 5 THEN 'parked' WHEN result = 'done' THEN 'completed' WHEN result = 'until' THEN 'suspended'
    WHEN result IN ('diverged', 'tip', 'nondeterminism', 'in doubt') THEN 'parked' WHEN result IN ('fenced', 'none') THEN 'abandoned' WHEN result = 'transient' THEN 'retrying' ELSE 'failed' END AS outcome,
  CASE WHEN status = 'cancelled' THEN NULL WHEN terminal = 'RunCompleted' THEN 'completed' WHEN terminal = 'RunFailed' THEN 'failed' WHEN attempts > 5 THEN 'quarantined' WHEN result = 'done' THEN 'completed' WHEN result = 'until' THEN 'suspended'
    WHEN result IN ('diverged', 'tip', 'nondeterminism') THEN 'quarantined' WHEN result = 'in doubt' THEN 'in_doubt' WHEN result IN ('fenced', 'none', 'transient') THEN NULL ELSE 'failed' END AS next_status,
  CASE WHEN status = 'cancelled' OR terminal IS NOT NULL OR attempts > 5 THEN NULL WHEN result = 'until' THEN at_ms + 9000 WHEN result = 'transient' THEN at_ms + CAST(1000 * power(2, attempts) AS BIGINT) END AS visible_at_ms FROM slices"""
)
def slice_outcomes(spark, d):
    e = evlog(spark, d).withColumns({
        "status": F.when(F.col("event_id") % 29 == 0, "cancelled").otherwise("running"), "terminal": F.when(F.col("event_id") % 23 == 0, "RunCompleted").when(F.col("event_id") % 19 == 0, "RunFailed"),
        "attempts": F.col("event_id") % 7, "result": F.element_at(F.array(*map(F.lit, RESULTS)), (1 + F.col("event_id") % 10).cast("int")), "until_ms": F.col("at_ms") + 9000,
    })
    return e.select("branch_id", "seq", tasks.slice_outcome("status", "terminal", "attempts", 5, "result", "at_ms", "until_ms").alias("o")).select("branch_id", "seq", "o.*")


@query(
    with_views(EVLOG, """asked AS (SELECT branch_id, unnest(range(1, 13)) AS n FROM evlog GROUP BY branch_id),
recorded AS (SELECT branch_id, row_number() OVER (PARTITION BY branch_id ORDER BY seq) AS n, at_ms AS value FROM evlog WHERE type = 'view')""")
    + "SELECT a.branch_id, CAST(a.n AS INTEGER) AS n, r.value FROM asked a LEFT JOIN recorded r ON r.branch_id = a.branch_id AND r.n = a.n"
)
def recorded_values(spark, d):
    """The nth time that a branch asks for is the nth that it recorded."""
    e = evlog(spark, d)
    asked = e.select("branch_id").distinct().select("branch_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("n"))
    recorded = e.filter("type = 'view'").select("branch_id", F.row_number().over(views.ordered()).alias("n"), "seq", F.col("at_ms").alias("value"))
    return tasks.recorded_values(asked, recorded, ["branch_id", "n"])
