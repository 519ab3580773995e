"""Effects and audits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import idempotency_key, one_of
from ..operators import audit, effects, tasks
from .bindings import BRANCHES, EVLOG, PAYMENTS, branches, evlog, payments, table, with_views
from .registry import query

NUMBERED = "numbered AS (SELECT *, CAST(split_part(step_id, '#', 2) AS INTEGER) AS n FROM evlog)"


def numbered(spark, d):
    from ..functions.scalars import step_number

    return evlog(spark, d).withColumn("n", step_number("step_id"))


@query(with_views(EVLOG, NUMBERED) + "SELECT branch_id, n, seq FROM numbered i WHERE type = 'view' AND NOT EXISTS (SELECT 1 FROM numbered r WHERE r.type = 'purchase' AND r.branch_id = i.branch_id AND r.n = i.n)")
def open_effects(spark, d):
    e = numbered(spark, d)
    return effects.open_effects(e.filter("type = 'view'"), e.filter("type = 'purchase'"), ["branch_id", "n"]).select("branch_id", "n", "seq")


@query(
    with_views(EVLOG, "changes AS (SELECT branch_id, event_id % 5 AS slot, seq, type AS state, CASE WHEN type = 'purchase' THEN step_id END AS external_ref FROM evlog)")
    + "SELECT branch_id, slot, arg_max(state, seq) AS state, arg_max(external_ref, seq) FILTER (external_ref IS NOT NULL) AS external_ref, count(*) AS attempts FROM changes GROUP BY branch_id, slot"
)
def latest_effect_state(spark, d):
    changes = evlog(spark, d).select("branch_id", (F.col("event_id") % 5).alias("slot"), "seq", F.col("type").alias("state"), F.when(F.col("type") == "purchase", F.col("step_id")).alias("external_ref"))
    return effects.latest_state(changes, ["branch_id", "slot"], ["seq"])


@query(with_views(PAYMENTS) + "SELECT payment, line, count(*) AS executions FROM refunds GROUP BY payment, line HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return effects.duplicated(payments(spark, d)[1], ["payment", "line"])


FIRST = "ORDER BY part, supplier, cents"


@query(
    with_views(PAYMENTS, f"placed AS (SELECT *, row_number() OVER (PARTITION BY payment, line {FIRST}) AS place, count(*) OVER (PARTITION BY payment, line) AS requests FROM refunds)")
    + "SELECT payment, line, part, supplier, cents, requests FROM placed WHERE place = 1"
)
def idempotent_dedupe(spark, d):
    answer = ["part", "supplier", "cents"]
    return effects.first_write_wins(payments(spark, d)[1], ["payment", "line"], answer, answer)


@query(with_views(PAYMENTS) + "SELECT part, min(payment) AS payment, count(*) AS requests FROM refunds GROUP BY part")
def distinct_first(spark, d):
    return effects.first_write_wins(payments(spark, d)[1], ["part"], ["payment"], ["payment"])


@query(
    with_views(PAYMENTS, "sums AS (SELECT payment, count(*) AS refunds, CAST(sum(cents) AS BIGINT) AS refunded FROM refunds GROUP BY payment)")
    + "SELECT p.payment, p.cents, p.status, coalesce(s.refunds, 0) AS refunds, coalesce(s.refunded, 0) AS refunded, coalesce(s.refunds, 0) > 1 AS duplicate FROM payments p LEFT JOIN sums s USING (payment)"
)
def refund_audit(spark, d):
    return audit.refund_audit(*payments(spark, d))


@query(
    with_views(PAYMENTS, """placed AS (SELECT r.*, p.cents AS cap, row_number() OVER (PARTITION BY payment ORDER BY line, part, supplier, r.cents) AS place FROM refunds r JOIN payments p USING (payment)),
running AS (SELECT *, cents AS so_far, CASE WHEN cents > cap THEN 0 ELSE cents END AS refunded FROM placed WHERE place = 1
  UNION ALL SELECT p.*, r.refunded + p.cents, CASE WHEN r.refunded + p.cents > p.cap THEN r.refunded ELSE r.refunded + p.cents END FROM running r JOIN placed p ON p.payment = r.payment AND p.place = r.place + 1)""")
    + "SELECT payment, line, part, supplier, cents, so_far, cap, so_far > cap AS over FROM running"
)
def refund_cap(spark, d):
    return audit.over_cap(*payments(spark, d), ["line", "part", "supplier", "cents"])


@query("SELECT count(*) AS total_runs, count(*) FILTER (o_orderstatus = 'F') AS total_killed, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS BIGINT) AS total_refunds, coalesce(bool_and(o_totalprice > 0), true) AS all_clean FROM orders")
def fleet_summary(spark, d):
    p = payments(spark, d)[0]
    return audit.fleet_summary(p, F.col("status") == "F", F.col("cents"), F.col("cents") > 0)


@query("SELECT o_orderpriority AS tier, o_orderstatus AS status, count(*) AS runs, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1, 2")
def tier_status_counts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("tier"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return o.groupBy("tier", "status").agg(F.count("*").alias("runs"), F.sum("cents").alias("cents"))


@query(with_views(EVLOG) + "SELECT branch_id, seq, 'run_' || left(sha256(branch_id % 2 || ':' || branch_id || ':' || step_id), 48) AS idem_key FROM evlog")
def idem_keys(spark, d):
    e = evlog(spark, d)
    return e.select("branch_id", "seq", idempotency_key(F.col("branch_id") % 2, "branch_id", "step_id").alias("idem_key"))


@query(
    with_views(EVLOG, BRANCHES, """children AS (SELECT e.branch_id, b.parent_branch, b.fork_seq, e.step_id FROM evlog e JOIN branches b USING (branch_id) WHERE b.parent_branch IS NOT NULL)""")
    + """SELECT c.branch_id, c.step_id, arg_min(p.body, p.seq) FILTER (p.seq >= c.fork_seq) AS output FROM children c
  LEFT JOIN evlog p ON p.branch_id = c.parent_branch AND p.step_id = c.step_id AND p.type = 'purchase' GROUP BY c.branch_id, c.step_id"""
)
def simulated_source(spark, d):
    e = evlog(spark, d)
    children = e.select("branch_id", "step_id").join(branches(spark, d).filter("parent_branch is not null").select("branch_id", "parent_branch", "fork_seq"), "branch_id")
    return effects.simulated_from_parent(children, e.filter("type = 'purchase'").select("branch_id", "seq", "step_id", F.col("body").alias("output")))


@query(
    with_views(EVLOG, NUMBERED, """dangerous AS (SELECT branch_id, n FROM numbered WHERE type = 'purchase' AND (branch_id % 2 = 0 OR branch_id % 5 = 0) AND branch_id % 2 = 1)""")
    + "SELECT d.branch_id, d.n, EXISTS (SELECT 1 FROM numbered a WHERE a.type = 'click' AND a.branch_id = d.branch_id AND a.n = d.n) AS audited FROM dangerous d"
)
def live_audit(spark, d):
    """Irreversible effects that ran live in a simulating (odd) branch, and whether an audit record of the same number stands beside."""
    e = numbered(spark, d).withColumns({
        "mode": F.when(F.col("branch_id") % 2 == 0, "live").otherwise("simulate"),
        "class": F.when(F.col("type") == "purchase", "irreversible").otherwise("pure"),
        "allowed": F.when(F.col("branch_id") % 5 == 0, F.array(F.lit("purchase"))).otherwise(F.array().cast("array<string>")),
    })
    live = e.filter(effects.runs_live("mode", "class", "type", "allowed") & (F.col("mode") == "simulate") & (F.col("class") == "irreversible"))
    audits = e.filter("type = 'click'").select("branch_id", "n", F.lit(True).alias("found"))
    return live.select("branch_id", "n").join(audits, ["branch_id", "n"], "left").select("branch_id", "n", F.coalesce("found", F.lit(False)).alias("audited"))


LEGAL = [(None, "signup"), (None, "view"), ("signup", "view"), ("view", "view"), ("view", "click"), ("click", "click"), ("click", "purchase"), ("purchase", "view"), ("view", "error"), ("error", "view")]


@query(
    with_views(EVLOG, "moved AS (SELECT branch_id, seq, type, lag(type) OVER (PARTITION BY branch_id ORDER BY seq) AS before FROM evlog)", "legal(b, t) AS (VALUES " + ", ".join(f"({'NULL' if b is None else repr(b)}, {t!r})" for b, t in LEGAL) + ")")
    + "SELECT branch_id, seq, before, type FROM moved m WHERE NOT EXISTS (SELECT 1 FROM legal l WHERE l.b IS NOT DISTINCT FROM m.before AND l.t = m.type)"
)
def effect_protocol(spark, d):
    return effects.protocol_breaches(evlog(spark, d), LEGAL, ["branch_id"]).select("branch_id", "seq", "before", "type")


@query(
    with_views(EVLOG, """notes AS (SELECT branch_id, event_id, CASE WHEN event_id % 3 <> 0 THEN branch_id || ':' || event_id % 40 END AS idem_key, CASE WHEN event_id % 4 <> 0 THEN at_ms END AS at_ms FROM evlog WHERE type = 'error'),
keys AS (SELECT DISTINCT branch_id, branch_id || ':' || event_id % 40 AS idem_key FROM evlog WHERE type = 'purchase'),
bounds AS (SELECT branch_id, min(at_ms) AS first_ms, max(at_ms) AS last_ms FROM evlog WHERE type = 'view' GROUP BY branch_id)""")
    + """SELECT n.branch_id, n.event_id, n.idem_key, n.at_ms FROM notes n JOIN bounds b USING (branch_id)
  WHERE (n.idem_key IS NULL OR EXISTS (SELECT 1 FROM keys k WHERE k.branch_id = n.branch_id AND k.idem_key = n.idem_key)) AND (n.at_ms IS NULL OR n.at_ms BETWEEN b.first_ms AND b.last_ms)"""
)
def annotation_filter(spark, d):
    e = evlog(spark, d)
    key = F.concat_ws(":", F.col("branch_id").cast("string"), (F.col("event_id") % 40).cast("string"))
    notes = e.filter("type = 'error'").select("branch_id", "event_id", F.when(F.col("event_id") % 3 != 0, key).alias("idem_key"), F.when(F.col("event_id") % 4 != 0, F.col("at_ms")).alias("at_ms"))
    keys = e.filter("type = 'purchase'").select("branch_id", key.alias("idem_key"))
    bounds = e.filter("type = 'view'").groupBy("branch_id").agg(F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"))
    return audit.within_run(notes, keys, bounds, "branch_id").select("branch_id", "event_id", "idem_key", "at_ms")


@query("SELECT e.event_id, e.event_id * 3 AS payment, CAST(round(o.o_totalprice * 100) AS BIGINT) AS cents, CASE WHEN o.o_orderkey IS NULL THEN 'no such order' END AS error FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id * 3")
def order_lookup(spark, d):
    asked = table(spark, d, "events").select("event_id", (F.col("event_id") * 3).alias("payment"))
    known = payments(spark, d)[0].select("payment", "cents", F.lit(True).alias("known"))
    return asked.join(known, "payment", "left").select("event_id", "payment", "cents", F.when(F.col("known").isNull(), "no such order").alias("error"))


@query(with_views(EVLOG) + "SELECT branch_id, step_id, CAST(row_number() OVER (PARTITION BY branch_id ORDER BY step_id) AS INTEGER) AS place FROM evlog WHERE type = 'purchase'")
def effect_listing(spark, d):
    """Effects in the order of their step ids as strings, in which a#10 stands before a#2."""
    e = evlog(spark, d).filter("type = 'purchase'")
    return e.select("branch_id", "step_id", F.row_number().over(Window.partitionBy("branch_id").orderBy("step_id")).alias("place"))


@query(with_views(EVLOG) + "SELECT branch_id, count(*) FILTER (type = 'view') AS model_calls, count(*) FILTER (type = 'purchase') AS provider_calls, count(*) FILTER (type = 'error') AS failures, count(*) AS events FROM evlog GROUP BY branch_id")
def replay_counters(spark, d):
    n = lambda t: F.count_if(F.col("type") == t)
    return evlog(spark, d).groupBy("branch_id").agg(n("view").alias("model_calls"), n("purchase").alias("provider_calls"), n("error").alias("failures"), F.count("*").alias("events"))


@query(with_views(EVLOG, "waits AS (SELECT branch_id, CASE type WHEN 'error' THEN 'diverged' WHEN 'view' THEN 'until' ELSE 'other' END AS kind, at_ms + 1000 AS at_ms FROM evlog)") + "SELECT branch_id, min(at_ms) FILTER (kind = 'until') AS visible_at_ms, bool_or(kind IN ('tip', 'diverged')) AS stuck FROM waits GROUP BY branch_id")
def earliest_wake(spark, d):
    waits = evlog(spark, d).select("branch_id", F.when(F.col("type") == "error", "diverged").when(F.col("type") == "view", "until").otherwise("other").alias("kind"), (F.col("at_ms") + 1000).alias("at_ms"))
    return tasks.wake_at(waits, "branch_id")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'duplicate' WHEN 3 THEN NULL ELSE 'requested_by_customer' END AS reason FROM events")
def refund_reasons(spark, d):
    """Reasons that the provider doesn't know become the customer's request; no reason stays none."""
    said = F.element_at(F.array(F.lit("duplicate"), F.lit("angry"), F.lit("requested_by_customer"), F.lit(None).cast("string")), (1 + F.col("event_id") % 4).cast("int"))
    known = ["duplicate", "fraudulent", "requested_by_customer"]
    return table(spark, d, "events").select("event_id", F.when(said.isNotNull(), one_of(said, known, "requested_by_customer")).alias("reason"))


@query(
    with_views(EVLOG, NUMBERED, """zombies AS (SELECT branch_id, seq, type, n, event_id % 7 AS slot, CASE WHEN event_id % 13 = 0 THEN epoch - 1 ELSE epoch END AS epoch FROM numbered),
epochs AS (SELECT branch_id, count(*) FILTER (epoch < highest) AS regressions FROM (SELECT *, max(epoch) OVER (PARTITION BY branch_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM zombies) GROUP BY branch_id),
twice AS (SELECT branch_id, count(*) AS twice FROM (SELECT branch_id, slot FROM zombies WHERE type = 'purchase' GROUP BY branch_id, slot HAVING count(*) > 1) GROUP BY branch_id),
sides AS (SELECT coalesce(i.branch_id, c.branch_id) AS branch_id, count(*) FILTER (c.n IS NULL) AS unanswered, count(*) FILTER (i.n IS NULL) AS unasked
  FROM (SELECT branch_id, n FROM numbered WHERE type = 'view') i FULL JOIN (SELECT branch_id, n FROM numbered WHERE type = 'purchase') c ON c.branch_id = i.branch_id AND c.n = i.n GROUP BY 1)""")
    + "SELECT e.branch_id, e.regressions, coalesce(t.twice, 0) AS twice, coalesce(s.unanswered, 0) AS unanswered, coalesce(s.unasked, 0) AS unasked FROM epochs e LEFT JOIN twice t USING (branch_id) LEFT JOIN sides s USING (branch_id)"
)
def log_invariants(spark, d):
    """What a recorded log must not hold, counted by branch: writers behind their epoch, keys committed twice, intents without and commits before an answer."""
    e = numbered(spark, d).withColumns({"slot": F.col("event_id") % 7, "epoch": F.col("epoch") - (F.col("event_id") % 13 == 0).cast("int")})
    return audit.invariants(e, F.col("type") == "view", F.col("type") == "purchase", "slot", "n")
