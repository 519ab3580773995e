"""Comparing branches, and replays."""

from pyspark.sql import functions as F

from ..operators import diffing, replaying, views
from .bindings import EVLOG, TURNS, evlog, turns, with_views
from .history_queries import ECONOMICS, steps_of
from .registry import query


@query(
    with_views(EVLOG, ECONOMICS)
    + """SELECT x.branch_id AS a, y.branch_id AS b, x.cost_micros AS cost_a, x.tokens AS tokens_a, y.cost_micros AS cost_b, y.tokens AS tokens_b,
  CASE WHEN x.cost_micros = 0 THEN 0.0::DOUBLE ELSE round((y.cost_micros::DOUBLE - x.cost_micros::DOUBLE) / x.cost_micros::DOUBLE * 1000) / 10 END AS cost_pct,
  CASE WHEN x.tokens = 0 THEN 0.0::DOUBLE ELSE round((y.tokens::DOUBLE - x.tokens::DOUBLE) / x.tokens::DOUBLE * 1000) / 10 END AS tokens_pct
  FROM economics x JOIN economics y ON x.branch_id % 2 = 0 AND y.branch_id = x.branch_id + 1"""
)
def economics_delta(spark, d):
    e = views.economics(steps_of(spark, d))
    pairs = e.filter("branch_id % 2 = 0").select(F.col("branch_id").alias("a"), (F.col("branch_id") + 1).alias("b"))
    return diffing.economics_delta(pairs, e)


def pairs_of_turns(spark, d):
    """Conversations 2k as main branches and 2k + 1 as their forks, by pair, with step ids."""
    t = views.numbered_steps(turns(spark, d), "role").withColumn("pair", F.expr("branch_id div 2"))
    return t.filter("branch_id % 2 = 0"), t.filter("branch_id % 2 = 1")


@query()
def trajectory(spark, d):
    """Many shortest scripts exist; tests check that a script is shortest and turns one side into the other."""
    a, b = pairs_of_turns(spark, d)
    return diffing.trajectory(a, b, "pair")


#: Chains of matching steps, later in both lists than the one before; the longest is the common subsequence.
CHAINS = """turned AS (SELECT pair, branch_id % 2 AS side, step_id, seq FROM steps),
matches AS (SELECT a.pair, a.seq AS x, b.seq AS y FROM turned a JOIN turned b ON a.pair = b.pair AND a.step_id = b.step_id AND a.side = 0 AND b.side = 1),
chains AS (SELECT pair, x, y, 1 AS n FROM matches UNION SELECT m.pair, m.x, m.y, c.n + 1 FROM chains c JOIN matches m ON m.pair = c.pair AND m.x > c.x AND m.y > c.y),
longest AS (SELECT pair, max(n) AS n FROM chains GROUP BY pair), sizes AS (SELECT pair, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM turned GROUP BY pair)"""
STEPS = "steps AS (SELECT *, branch_id // 2 AS pair, role || '#' || row_number() OVER (PARTITION BY branch_id, role ORDER BY seq) AS step_id FROM turns)"


@query(
    with_views(TURNS, STEPS)
    + "SELECT a.pair, a.step_id, a.text AS old, b.text AS new, a.text IS DISTINCT FROM b.text AS changed FROM steps a JOIN steps b ON a.pair = b.pair AND a.step_id = b.step_id AND a.branch_id % 2 = 0 AND b.branch_id % 2 = 1"
)
def content_changes(spark, d):
    a, b = pairs_of_turns(spark, d)
    return diffing.content_changes(a, b, ["pair", "step_id"], "text")


@query(
    with_views(EVLOG, "before AS (SELECT branch_id, seq, type, body, lag(type) OVER (PARTITION BY branch_id ORDER BY seq) AS old_type, lag(body) OVER (PARTITION BY branch_id ORDER BY seq) AS old_body FROM evlog)")
    + "SELECT branch_id, seq, CASE WHEN old_type IS NULL THEN '' ELSE concat_ws(',', CASE WHEN body <> old_body THEN 'k' END, CASE WHEN (type = 'error') <> (old_type = 'error') THEN 'note' END, CASE WHEN type <> old_type THEN 'type' END) END AS changed FROM before"
)
def outcome_fields(spark, d):
    """Outcomes of neighbouring events: fields that differ, where a missing note differs from one that is null."""
    k = F.get_json_object("body", "$.k").cast("int").alias("k")
    shown = F.when(F.col("type") == "error", F.to_json(F.struct(k, "type", F.lit(None).cast("string").alias("note")), {"ignoreNullFields": "false"})).otherwise(F.to_json(F.struct(k, "type")))
    e = evlog(spark, d).withColumn("output", shown)
    e = e.withColumn("before", F.lag("output").over(views.ordered()))
    return e.select("branch_id", "seq", F.array_join(diffing.changed_fields("before", "output"), ",").alias("changed"))


FINGERPRINTS = """recorded AS (SELECT branch_id // 2 AS pair, step_id, sha256(type || event_id % 3) AS old FROM evlog WHERE branch_id % 2 = 0),
recomputed AS (SELECT branch_id // 2 AS pair, step_id, sha256(type || event_id % 3) AS new FROM evlog WHERE branch_id % 2 = 1),
verdicts AS (SELECT pair, step_id, CASE WHEN old IS NULL THEN 'beyond the tip' WHEN new IS NULL THEN 'unreached' WHEN old = new THEN 'replayed' ELSE 'mismatch' END AS verdict
  FROM recorded FULL JOIN recomputed USING (pair, step_id))"""


def verdicts_of(spark, d):
    e = evlog(spark, d).select(F.expr("branch_id div 2").alias("pair"), "branch_id", "step_id", F.sha2(F.concat("type", (F.col("event_id") % 3).cast("string")), 256).alias("fingerprint"))
    return replaying.step_verdicts(e.filter("branch_id % 2 = 0"), e.filter("branch_id % 2 = 1"), ["pair", "step_id"])


@query(with_views(EVLOG, FINGERPRINTS) + "SELECT pair, step_id, verdict FROM verdicts")
def replay_verdicts(spark, d):
    return verdicts_of(spark, d)


@query(
    with_views(EVLOG, FINGERPRINTS)
    + """, outputs AS (SELECT branch_id // 2 AS pair, arg_max(body, seq) FILTER (branch_id % 2 = 0) AS recorded, arg_max(body, seq) FILTER (branch_id % 2 = 1) AS output FROM evlog WHERE type = 'purchase' GROUP BY 1),
counted AS (SELECT pair, count(*) FILTER (verdict = 'replayed') AS replayed, count(*) FILTER (verdict = 'mismatch') AS mismatches, count(*) FILTER (verdict = 'beyond the tip') AS external_calls,
  min(step_id) FILTER (verdict = 'mismatch') AS first_mismatch, count(*) FILTER (verdict IN ('mismatch', 'beyond the tip')) = 0 AND pair % 9 <> 0 AS sound FROM verdicts GROUP BY pair)
SELECT c.pair, replayed, mismatches, external_calls, first_mismatch, recorded = output AS output_matches, sound AND coalesce(recorded = output, true) AS clean FROM counted c LEFT JOIN outputs o ON o.pair = c.pair"""
)
def replay_report(spark, d):
    """Every ninth pair's chain counts as broken."""
    verdicts = verdicts_of(spark, d)
    chains = verdicts.select("pair").distinct().withColumn("error", F.when(F.col("pair") % 9 == 0, "tampered"))
    side = lambda rest: F.when(F.col("branch_id") % 2 == rest, F.col("seq"))
    bought = evlog(spark, d).filter("type = 'purchase'").groupBy(F.expr("branch_id div 2").alias("pair"))
    outputs = bought.agg(F.max_by("body", side(0)).alias("recorded"), F.max_by("body", side(1)).alias("output"))
    return replaying.report(verdicts, chains, outputs, "pair", "step_id")


@query(
    with_views(EVLOG, """sides AS (SELECT branch_id, CAST(sum(cost_micros) FILTER (event_id % 2 = 0) AS BIGINT) AS expected, CAST(sum(cost_micros) FILTER (event_id % 2 = 1) AS BIGINT) AS actual FROM evlog WHERE type = 'signup' GROUP BY branch_id)""")
    + "SELECT branch_id, expected, actual, expected IS NOT DISTINCT FROM actual AS same FROM sides"
)
def reference_compare(spark, d):
    cost = lambda rest: F.sum(F.when(F.col("event_id") % 2 == rest, F.col("cost_micros")))
    sides = evlog(spark, d).filter("type = 'signup'").groupBy("branch_id").agg(cost(0).alias("expected"), cost(1).alias("actual"))
    return sides.withColumn("same", F.col("expected").eqNullSafe(F.col("actual")))


@query(with_views(TURNS, "marked AS (SELECT *, max(CASE WHEN role <> 'user' THEN seq END) OVER (PARTITION BY branch_id) AS other FROM turns)") + "SELECT branch_id, seq, role, text, tokens FROM marked WHERE other IS NULL OR seq > other")
def trailing_turns(spark, d):
    return views.trailing(turns(spark, d), "user")


@query(with_views(TURNS, STEPS, CHAINS) + "SELECT s.pair, CAST(coalesce(l.n, 0) AS BIGINT) AS equal, a - coalesce(l.n, 0) AS deleted, b - coalesce(l.n, 0) AS inserted FROM sizes s LEFT JOIN longest l ON l.pair = s.pair")
def trajectory_counts(spark, d):
    """How much of both sides a shortest script keeps, deletes and inserts: the same for every shortest script."""
    n = lambda op: F.count_if(F.col("op") == op)
    return trajectory(spark, d).groupBy("pair").agg(n("equal").alias("equal"), n("delete").alias("deleted"), n("insert").alias("inserted"))
