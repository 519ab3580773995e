"""Histories: reading, lineage, views, segments, chains."""

from pyspark.sql import functions as F

from ..functions.canonical import canonical_json_jvm
from ..operators import chain, lineage, views
from ..sources import export, ingest
from .bindings import BRANCHES, EVLOG, branches, evlog, table, with_views
from .registry import query

CLOSURE = """reach AS (SELECT branch_id, branch_id AS ancestor, 0 AS distance, CAST(NULL AS BIGINT) AS upto FROM branches
  UNION ALL SELECT r.branch_id, b.parent_branch, r.distance + 1, CASE WHEN r.upto IS NULL OR b.fork_seq < r.upto THEN b.fork_seq ELSE r.upto END
  FROM reach r JOIN branches b ON b.branch_id = r.ancestor WHERE b.parent_branch IS NOT NULL),
closure AS (SELECT r.branch_id, r.ancestor, r.distance, coalesce(b.fork_seq, 0) AS from_seq, r.upto FROM reach r JOIN branches b ON b.branch_id = r.ancestor)"""
SEEN = "seen AS (SELECT c.branch_id, e.branch_id AS origin, e.seq, e.type, e.cost_micros FROM closure c JOIN evlog e ON e.branch_id = c.ancestor AND e.seq >= c.from_seq AND (c.upto IS NULL OR e.seq < c.upto))"


def is_result():
    return F.col("type").isin("purchase", "click")


@query(with_views(EVLOG) + "SELECT branch_id, seq, type, step_id, at_ms - first_value(at_ms) OVER (PARTITION BY branch_id ORDER BY seq) AS offset_ms, type || ' for ' || cost_micros AS detail FROM evlog")
def history(spark, d):
    return views.history(evlog(spark, d), F.concat("type", F.lit(" for "), F.col("cost_micros").cast("string")))


@query(with_views(EVLOG) + "SELECT branch_id, seq, type, step_id FROM evlog WHERE branch_id = 7 AND seq >= 3")
def read_from_seq(spark, d):
    return ingest.own_events(evlog(spark, d), 7, 3).select("branch_id", "seq", "type", "step_id")


@query(with_views(BRANCHES) + "SELECT branch_id, created_at_ms FROM branches ORDER BY created_at_ms DESC, branch_id LIMIT 10")
def newest_runs(spark, d):
    return branches(spark, d).select("branch_id", "created_at_ms").orderBy(F.desc("created_at_ms"), "branch_id").limit(10)


@query(with_views(BRANCHES) + "SELECT branch_id, parent_branch, fork_seq, created_at_ms FROM branches WHERE branch_id = 5")
def branch_lookup(spark, d):
    return branches(spark, d).filter("branch_id = 5")


@query(with_views(BRANCHES, CLOSURE) + "SELECT c.ancestor AS run_id, count(*) AS branches, CAST(max(c.distance) AS INTEGER) AS deepest FROM closure c JOIN branches b ON b.branch_id = c.ancestor WHERE b.parent_branch IS NULL GROUP BY c.ancestor")
def runs_branches(spark, d):
    b = branches(spark, d)
    roots = b.filter("parent_branch is null").select(F.col("branch_id").alias("ancestor"))
    return lineage.closure(b).join(roots, "ancestor").groupBy(F.col("ancestor").alias("run_id")).agg(F.count("*").alias("branches"), F.max("distance").alias("deepest"))


@query(with_views(BRANCHES, CLOSURE) + "SELECT branch_id, ancestor, CAST(distance AS INTEGER) AS distance, from_seq, upto FROM closure")
def lineage_closure(spark, d):
    return lineage.closure(branches(spark, d))


@query(with_views(EVLOG, BRANCHES, CLOSURE, SEEN) + "SELECT branch_id, count(*) AS events, count(*) FILTER (origin <> branch_id) AS shared, CAST(sum(cost_micros) AS BIGINT) AS cost_micros FROM seen GROUP BY branch_id")
def lineage_events(spark, d):
    seen = lineage.visible_events(lineage.closure(branches(spark, d)), evlog(spark, d).select("branch_id", "seq", "cost_micros"))
    return seen.groupBy("branch_id").agg(F.count("*").alias("events"), F.count_if(F.col("origin") != F.col("branch_id")).alias("shared"), F.sum("cost_micros").alias("cost_micros"))


@query(
    with_views(BRANCHES, CLOSURE, """own AS (SELECT branch_id, parent_branch, CASE WHEN branch_id % 3 = 0 THEN 'm' || branch_id % 5 END AS model, ['t' || branch_id % 4, 't' || branch_id % 3] AS tools FROM branches),
steps AS (SELECT c.branch_id, c.distance, o.model, o.tools FROM closure c JOIN own o ON o.branch_id = c.ancestor WHERE o.parent_branch IS NOT NULL),
items AS (SELECT branch_id, unnest(tools) AS tool, generate_subscripts(tools, 1) - 10 * distance AS place FROM steps),
firsts AS (SELECT branch_id, tool, min(place) AS place FROM items GROUP BY branch_id, tool),
models AS (SELECT branch_id, arg_max(model, -distance) FILTER (model IS NOT NULL) AS model FROM steps GROUP BY branch_id)""")
    + "SELECT f.branch_id, m.model, string_agg(f.tool, ',' ORDER BY f.place) AS allow_live FROM firsts f JOIN models m ON m.branch_id = f.branch_id GROUP BY f.branch_id, m.model"
)
def override_schedule(spark, d):
    b = branches(spark, d)
    tool = lambda n: F.concat(F.lit("t"), (F.col("branch_id") % n).cast("string"))
    own = b.withColumns({"model": F.when(F.col("branch_id") % 3 == 0, F.concat(F.lit("m"), (F.col("branch_id") % 5).cast("string"))), "allow_live": F.array(tool(4), tool(3))})
    return lineage.override_schedule(lineage.closure(b), own).withColumn("allow_live", F.array_join("allow_live", ","))


def steps_of(spark, d):
    """evlog as steps: views are model calls, clicks and purchases are effects."""
    e = evlog(spark, d)
    before = F.lag("at_ms").over(views.ordered())
    return e.withColumns({
        "kind": F.when(F.col("type") == "view", "llm").when(is_result(), "effect").otherwise("signal"),
        "source": F.when(F.col("event_id") % 10 == 0, "simulated:parent").otherwise("live"),
        "tokens": F.ceil(F.octet_length("body") / 4),
        "duration_ms": F.coalesce(F.col("at_ms") - before, F.lit(0)),
    })


ECONOMICS = """steps AS (SELECT branch_id, CASE WHEN type = 'view' THEN 'llm' WHEN type IN ('purchase', 'click') THEN 'effect' ELSE 'signal' END AS kind, event_id % 10 = 0 AS simulated,
  CAST(ceil(octet_length(encode(body)) / 4) AS BIGINT) AS tokens, cost_micros, coalesce(at_ms - lag(at_ms) OVER (PARTITION BY branch_id ORDER BY seq), 0) AS duration_ms FROM evlog),
economics AS (SELECT branch_id, count(*) AS steps, count(*) FILTER (kind = 'llm') AS llm_calls, count(*) FILTER (kind = 'effect') AS effects,
  count(*) FILTER (kind = 'effect' AND simulated) AS simulated_effects, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_micros) AS BIGINT) AS cost_micros, CAST(sum(duration_ms) AS BIGINT) AS active_ms
  FROM steps GROUP BY branch_id)"""


@query(with_views(EVLOG, ECONOMICS) + "SELECT * FROM economics")
def economics(spark, d):
    return views.economics(steps_of(spark, d))


LATEST = "ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    with_views(EVLOG, f"""slots AS (SELECT *, event_id % 5 AS slot FROM evlog),
intents AS (SELECT *, last_value(CASE WHEN type = 'view' THEN at_ms END IGNORE NULLS) OVER (PARTITION BY branch_id, slot {LATEST} AS started_ms,
  last_value(CASE WHEN type = 'view' THEN step_id END IGNORE NULLS) OVER (PARTITION BY branch_id, slot {LATEST} AS intent_step FROM slots)""")
    + "SELECT branch_id, seq, step_id, intent_step, greatest(at_ms - coalesce(started_ms, at_ms), 0) AS duration_ms FROM intents WHERE type = 'purchase'"
)
def step_views(spark, d):
    """A commit takes the latest intent of its own step (here: of its slot), not of its branch."""
    e = evlog(spark, d).withColumn("slot", F.col("event_id") % 5)
    found = views.with_latest_intent(e, F.col("type") == "view", F.col("type") == "purchase", ("branch_id", "slot"))
    return found.select("branch_id", "seq", "step_id", "intent_step", "duration_ms")


@query(with_views(EVLOG) + "SELECT branch_id, max(seq) AS head FROM evlog GROUP BY branch_id")
def branch_head(spark, d):
    """Seqs are dense, so the head is the number of events, and no order is needed."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("branch_id")).agg((F.count("*") - 1).alias("head"))


#: Every 11th event belongs to no worker, as genesis events do.
SEGMENTS = """own AS (SELECT branch_id, seq, at_ms, CASE WHEN event_id % 11 = 0 THEN 0 ELSE epoch END AS epoch,
  count(*) FILTER (type IN ('purchase', 'click')) OVER (PARTITION BY branch_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS results_before FROM evlog),
worked AS (SELECT *, CASE WHEN lag(epoch) OVER (PARTITION BY branch_id ORDER BY seq) IS NOT DISTINCT FROM epoch THEN 0 ELSE 1 END AS begins FROM own WHERE epoch > 0),
numbered AS (SELECT *, CAST(sum(begins) OVER (PARTITION BY branch_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM worked),
segments AS (SELECT branch_id, segment, min(epoch) AS epoch, min(seq) AS first_seq, max(seq) AS last_seq, min(at_ms) AS start_ms, max(at_ms) AS end_ms, min(results_before) AS prior_results FROM numbered GROUP BY branch_id, segment)"""


@query(with_views(EVLOG, SEGMENTS) + "SELECT * FROM segments")
def segments(spark, d):
    e = evlog(spark, d).withColumn("epoch", F.when(F.col("event_id") % 11 == 0, 0).otherwise(F.col("epoch")))
    return views.segments(e, is_result())


@query(
    with_views(EVLOG, """zombies AS (SELECT branch_id, seq, CASE WHEN event_id % 13 = 0 THEN epoch - 1 ELSE epoch END AS epoch FROM evlog),
marked AS (SELECT *, max(epoch) OVER (PARTITION BY branch_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM zombies)""")
    + "SELECT branch_id, seq, epoch, highest FROM marked WHERE epoch < highest"
)
def epoch_regressions(spark, d):
    zombies = evlog(spark, d).withColumn("epoch", F.col("epoch") - (F.col("event_id") % 13 == 0).cast("int"))
    return chain.epoch_regressions(zombies).select("branch_id", "seq", "epoch", "highest")


@query(with_views(EVLOG) + "SELECT branch_id, seq, coalesce(least(at_ms - lag(at_ms) OVER (PARTITION BY branch_id ORDER BY seq), 1600) // 2, 0) AS delay_ms FROM evlog")
def inter_event_gap(spark, d):
    return views.gaps(evlog(spark, d), 1600, 2)


def sealed_log(spark, d):
    return chain.seal(evlog(spark, d).withColumn("body", canonical_json_jvm("body")))


def _material(prev: str) -> str:
    return f"""'{{"at_ms":' || e.at_ms || ',"body":' || replace(e.body, ' ', '') || ',"branch_id":"' || e.branch_id || '","epoch":' || e.epoch || ',"prev_hash":"' || {prev} || '","seq":' || e.seq || '}}'"""


SEALED = f"""sealed AS (SELECT e.branch_id, e.seq, repeat('0', 64) AS prev_hash, sha256({_material("repeat('0', 64)")}) AS hash FROM evlog e WHERE e.seq = 0
  UNION ALL SELECT e.branch_id, e.seq, s.hash, sha256({_material("s.hash")}) FROM sealed s JOIN evlog e ON e.branch_id = s.branch_id AND e.seq = s.seq + 1)"""


@query(with_views(EVLOG, SEALED) + "SELECT branch_id, seq, prev_hash, hash FROM sealed")
def seal_chain(spark, d):
    return sealed_log(spark, d).select("branch_id", "seq", "prev_hash", "hash")


@query(with_views(EVLOG) + "SELECT DISTINCT branch_id, CAST(NULL AS BIGINT) AS at_seq, CAST(NULL AS VARCHAR) AS error FROM evlog")
def chain_links(spark, d):
    return chain.verdicts(sealed_log(spark, d))


@query(with_views(EVLOG) + "SELECT branch_id, min(seq) FILTER ((31 * branch_id + seq) % 97 = 0) AS at_seq, max(CASE WHEN (31 * branch_id + seq) % 97 = 0 THEN 'tampered' END) AS error FROM evlog GROUP BY branch_id")
def chain_tamper(spark, d):
    touched = (31 * F.col("branch_id") + F.col("seq")) % 97 == 0
    return chain.verdicts(sealed_log(spark, d).withColumn("body", F.when(touched, F.lit('{"k":-1}')).otherwise(F.col("body"))))


@query(
    with_views(EVLOG, BRANCHES, """hashed AS (SELECT branch_id, seq, step_id, lag(sha256(body || seq)) OVER (PARTITION BY branch_id ORDER BY seq) AS prev_hash FROM evlog)""")
    + "SELECT b.branch_id, b.parent_branch, b.fork_seq, h.step_id, h.prev_hash FROM branches b LEFT JOIN hashed h ON h.branch_id = b.parent_branch AND h.seq = b.fork_seq WHERE b.parent_branch IS NOT NULL"
)
def fork_points(spark, d):
    hashed = evlog(spark, d).withColumn("hash", F.sha2(F.concat("body", F.col("seq").cast("string")), 256))
    return lineage.fork_points(branches(spark, d), hashed)


@query(
    with_views(BRANCHES)
    + """SELECT branch_id, CASE WHEN parent_branch IS NULL THEN 0 ELSE fork_seq END AS seq, CAST(0 AS BIGINT) AS epoch, CASE WHEN parent_branch IS NULL THEN 'RunStarted' ELSE 'Forked' END AS type,
  CASE WHEN parent_branch IS NULL THEN '{"history_format":1,"type":"RunStarted","version":"1","workflow":"shop"}' ELSE '{"from_branch":"' || parent_branch || '","type":"Forked"}' END AS body FROM branches"""
)
def genesis_rows(spark, d):
    return lineage.genesis_rows(branches(spark, d), "shop", "1")


@query(with_views(EVLOG, BRANCHES, CLOSURE, SEEN) + "SELECT branch_id, count(*) FILTER (origin = branch_id) AS own_events, count(*) AS events FROM seen GROUP BY branch_id")
def own_events(spark, d):
    seen = lineage.visible_events(lineage.closure(branches(spark, d)), evlog(spark, d).select("branch_id", "seq"))
    return seen.groupBy("branch_id").agg(F.count_if(F.col("origin") == F.col("branch_id")).alias("own_events"), F.count("*").alias("events"))


@query(with_views(EVLOG) + "SELECT branch_id, step_id, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS seqs FROM (SELECT branch_id, type AS step_id, seq FROM evlog) GROUP BY branch_id, step_id")
def step_index(spark, d):
    by_name = evlog(spark, d).select("branch_id", F.col("type").alias("step_id"), "seq")
    return views.step_index(by_name).withColumn("seqs", F.array_join("seqs", ","))


@query(with_views(EVLOG, "heads AS (SELECT *, max(seq) OVER (PARTITION BY branch_id) AS head FROM evlog)") + "SELECT branch_id, seq, step_id, at_ms FROM heads WHERE seq = head")
def head_subquery(spark, d):
    last = F.max_by(F.struct("seq", "step_id", "at_ms"), "seq").alias("last")
    return evlog(spark, d).groupBy("branch_id").agg(last).select("branch_id", "last.*")


@query(with_views(EVLOG) + "SELECT branch_id, min(at_ms) AS first_ms, max(at_ms) AS last_ms FROM evlog GROUP BY branch_id")
def time_bounds(spark, d):
    return evlog(spark, d).groupBy("branch_id").agg(F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"))


@query(with_views(EVLOG) + "SELECT branch_id, arg_max(type, seq) FILTER (type IN ('signup', 'error')) AS terminal, max(seq) FILTER (type IN ('signup', 'error')) AS at_seq, max(seq) AS head FROM evlog GROUP BY branch_id")
def terminal_recovery(spark, d):
    from ..operators.tasks import terminal

    return terminal(evlog(spark, d), ["signup", "error"])


@query(with_views(EVLOG) + "SELECT branch_id, min(seq) AS seq, arg_min(step_id, seq) AS step_id FROM evlog WHERE type = 'purchase' GROUP BY branch_id")
def first_match(spark, d):
    bought = evlog(spark, d).filter("type = 'purchase'")
    return bought.groupBy("branch_id").agg(F.min("seq").alias("seq"), F.min_by("step_id", "seq").alias("step_id"))


@query()
def recording_export(spark, d):
    """One document a branch, with its run's id; SQL can't write the nested text alike, a test reads it back. A run is assembled from its branches when it is asked for."""
    b = branches(spark, d)
    roots = b.filter("parent_branch is null").select("branch_id").withColumnRenamed("branch_id", "ancestor")
    of_run = lineage.closure(b).join(roots, "ancestor").select(F.col("ancestor").cast("string").alias("run_id"), "branch_id", F.col("distance").alias("depth"))
    text = lambda c: F.col(c).cast("string").alias(c)
    own = b.join(of_run, "branch_id").select("run_id", text("branch_id"), text("parent_branch"), "fork_seq", "depth", "created_at_ms")
    return export.branch_documents(own, evlog(spark, d).withColumn("branch_id", F.col("branch_id").cast("string")), 0)


@query(
    with_views(EVLOG, SEGMENTS) + "SELECT o.branch_id, o.seq, s.segment FROM own o JOIN segments s ON s.branch_id = o.branch_id AND s.epoch = o.epoch AND o.seq BETWEEN s.first_seq AND s.last_seq WHERE o.epoch > 0"
)
def event_segments(spark, d):
    e = evlog(spark, d).withColumn("epoch", F.when(F.col("event_id") % 11 == 0, 0).otherwise(F.col("epoch")))
    return views.event_segments(e, views.segments(e, is_result())).select("branch_id", "seq", "segment")


COMPLETED = "completed AS (SELECT s.branch_id, s.seq, s.type, e.step_id FROM seen s JOIN evlog e ON e.branch_id = s.origin AND e.seq = s.seq)"


@query(with_views(EVLOG, BRANCHES, CLOSURE, SEEN, COMPLETED) + "SELECT branch_id, arg_max(step_id, seq) FILTER (type = 'purchase') AS output, max(seq) FILTER (type = 'purchase') AS at_seq FROM completed GROUP BY branch_id")
def last_output(spark, d):
    seen = lineage.visible_events(lineage.closure(branches(spark, d)), evlog(spark, d).select("branch_id", "seq", "type", "step_id"))
    return lineage.last_output(seen, F.col("type") == "purchase", F.col("step_id"))


OVERRIDES = """own AS (SELECT branch_id, parent_branch, CASE WHEN branch_id % 3 = 0 THEN 'm' || branch_id % 5 END AS model, CASE WHEN branch_id % 4 = 0 THEN 'simulate' WHEN branch_id % 4 = 1 THEN 'live' END AS effects,
  CASE WHEN branch_id % 2 = 0 THEN 'p' || branch_id % 5 END AS triage, CASE WHEN branch_id % 3 = 1 THEN 'r' || branch_id % 7 END AS reply, CASE WHEN branch_id % 5 = 0 THEN 'g' || branch_id % 2 END AS go, 't' || branch_id % 4 AS tool FROM branches),
steps AS (SELECT c.branch_id, c.distance, c.from_seq, o.* EXCLUDE (branch_id, parent_branch) FROM closure c JOIN own o ON o.branch_id = c.ancestor WHERE o.parent_branch IS NOT NULL),
asked AS (SELECT branch_id, unnest([NULL, 0, 2, 4, 6]) AS seq FROM branches),
active AS (SELECT a.branch_id, a.seq, s.* EXCLUDE (branch_id) FROM asked a LEFT JOIN steps s ON s.branch_id = a.branch_id AND (a.seq IS NULL OR s.from_seq <= a.seq)),
tools AS (SELECT branch_id, seq, string_agg(tool, ',' ORDER BY place) AS allow_live FROM (SELECT branch_id, seq, tool, min(-distance) AS place FROM active WHERE tool IS NOT NULL GROUP BY branch_id, seq, tool) GROUP BY branch_id, seq),
nearest AS (SELECT branch_id, seq, arg_min(model, distance) FILTER (model IS NOT NULL) AS model, coalesce(arg_min(effects, distance) FILTER (effects IS NOT NULL), 'live') AS effects,
  concat_ws(',', 'reply=' || arg_min(reply, distance) FILTER (reply IS NOT NULL), 'triage=' || arg_min(triage, distance) FILTER (triage IS NOT NULL)) AS patches, coalesce('go=' || arg_min(go, distance) FILTER (go IS NOT NULL), '') AS signals FROM active GROUP BY branch_id, seq)"""


@query(
    with_views(BRANCHES, CLOSURE, OVERRIDES)
    + "SELECT n.branch_id, CAST(n.seq AS BIGINT) AS seq, n.model, n.effects, n.patches, n.signals, coalesce(t.allow_live, '') AS allow_live FROM nearest n LEFT JOIN tools t ON t.branch_id = n.branch_id AND t.seq IS NOT DISTINCT FROM n.seq"
)
def overrides_at(spark, d):
    """Overrides in force at some seqs and at the tip (null)."""
    b, at = branches(spark, d), F.col("branch_id")
    name = lambda letter, n: F.concat(F.lit(letter), (at % n).cast("string"))
    some = lambda *pairs: F.map_filter(F.create_map(*[F.lit(x) if isinstance(x, str) else x for p in pairs for x in p]), lambda k, v: v.isNotNull())
    own = b.withColumns({
        "model": F.when(at % 3 == 0, name("m", 5)), "effects": F.when(at % 4 == 0, "simulate").when(at % 4 == 1, "live"), "allow_live": F.array(name("t", 4)),
        "prompt_patches": some(("triage", F.when(at % 2 == 0, name("p", 5))), ("reply", F.when(at % 3 == 1, name("r", 7)))), "signals": some(("go", F.when(at % 5 == 0, name("g", 2)))),
    })
    asked = b.select("branch_id", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (None, 0, 2, 4, 6)])).alias("seq"))
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    found = lineage.overrides_at(lineage.closure(b), own, asked)
    return found.select("branch_id", "seq", "model", "effects", shown("prompt_patches").alias("patches"), shown("signals").alias("signals"), F.array_join("allow_live", ",").alias("allow_live"))


CLIPPED = "CASE WHEN length(t) > 90 THEN left(t, 89) || '…' ELSE t END"


@query(
    with_views(EVLOG, """typed AS (SELECT branch_id, seq, type, step_id, replace(body, ' ', '') AS body, sha256(body) AS fp FROM evlog)""")
    + f"""SELECT branch_id, seq, CASE type WHEN 'signup' THEN 'shop@' || step_id WHEN 'view' THEN 'model=large fp=' || left(fp, 12) WHEN 'click' THEN '[inbox] ' || body
  WHEN 'purchase' THEN (SELECT {CLIPPED} FROM (SELECT '[live] ' || body AS t)) ELSE (SELECT {CLIPPED} FROM (SELECT repeat(step_id || ' ', 20) AS t)) END AS detail FROM typed"""
)
def history_details(spark, d):
    """A line about each event by its type."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    json = lambda *pairs: F.concat(F.lit("{"), *[x for i, (k, v) in enumerate(pairs) for x in (F.lit(("," if i else "") + f'"{k}":'), v)], F.lit("}"))
    e = evlog(spark, d)
    named = F.when(F.col("type") == "signup", "RunStarted").when(F.col("type") == "view", "LlmRequested").when(F.col("type") == "click", "SignalReceived").when(F.col("type") == "purchase", "EffectCommitted").otherwise("RunFailed")
    body = (
        F.when(F.col("type") == "signup", json(("workflow", F.lit('"shop"')), ("workflow_version", quoted(F.col("step_id")))))
        .when(F.col("type") == "view", json(("request", F.lit('{"model":"large"}')), ("fingerprint", quoted(F.sha2("body", 256)))))
        .when(F.col("type") == "click", json(("source", F.lit('"inbox"')), ("payload", F.col("body"))))
        .when(F.col("type") == "purchase", json(("source", F.lit('"live"')), ("output", F.col("body"))))
        .otherwise(json(("error", quoted(F.repeat(F.concat("step_id", F.lit(" ")), F.lit(20))))))
    )
    return e.select("branch_id", "seq", views.detail(named, body).alias("detail"))


TARGETS = """root_of AS (SELECT r.branch_id, r.ancestor AS root FROM reach r JOIN branches b ON b.branch_id = r.ancestor WHERE b.parent_branch IS NULL),
own AS (SELECT branch_id AS n, root, left(sha256('b' || branch_id), 16) AS branch_id, left(sha256('r' || root), 16) AS run_id, CASE WHEN branch_id = root THEN 'main' ELSE 'f' || branch_id % 20 END AS label FROM root_of),
runs AS (SELECT run_id, branch_id AS root_branch FROM own WHERE n = root),
targets AS (SELECT left(branch_id, 1 + n % 6) AS target FROM own UNION SELECT left(run_id, 4) || ':' || label FROM own UNION SELECT run_id FROM own UNION SELECT upper(left(run_id, 3)) FROM own UNION SELECT 'nothing'),
asked AS (SELECT target, lower(split_part(target, ':', 1)) AS needle, CASE WHEN contains(target, ':') THEN split_part(target, ':', 2) END AS wanted FROM targets),
met AS (SELECT a.*, r.run_id, r.root_branch FROM asked a JOIN runs r ON starts_with(r.run_id, a.needle)),
found AS (SELECT target, root_branch AS branch_id FROM met WHERE wanted IS NULL OR wanted = 'main'
  UNION ALL SELECT target, min(o.branch_id) FROM met JOIN own o ON o.run_id = met.run_id AND (o.label = wanted OR starts_with(o.branch_id, wanted)) WHERE wanted <> 'main' GROUP BY target, met.run_id
  UNION ALL SELECT a.target, o.branch_id FROM asked a JOIN own o ON starts_with(o.branch_id, a.needle) WHERE wanted IS NULL AND NOT EXISTS (SELECT 1 FROM met WHERE met.target = a.target AND met.run_id = o.run_id))"""


@query(
    with_views(BRANCHES, CLOSURE, TARGETS)
    + "SELECT a.target, CASE WHEN count(f.target) = 1 THEN min(f.branch_id) END AS branch_id, CASE WHEN count(f.target) = 0 THEN 'nothing matches' WHEN count(f.target) > 1 THEN 'ambiguous (' || count(f.target) || ' matches)' END AS error FROM asked a LEFT JOIN found f ON f.target = a.target GROUP BY a.target"
)
def target_resolution(spark, d):
    """Branches that starts of ids, and runs with labels, name."""
    b = branches(spark, d)
    roots = b.filter("parent_branch is null").select(F.col("branch_id").alias("ancestor"))
    code = lambda letter, c: F.left(F.sha2(F.concat(F.lit(letter), F.col(c).cast("string")), 256), F.lit(16))
    label = F.when(F.col("branch_id") == F.col("ancestor"), "main").otherwise(F.concat(F.lit("f"), (F.col("branch_id") % 20).cast("string")))
    own = lineage.closure(b).join(roots, "ancestor").select(F.col("branch_id").alias("n"), (F.col("branch_id") == F.col("ancestor")).alias("root"), code("b", "branch_id").alias("branch_id"), code("r", "ancestor").alias("run_id"), label.alias("label"))
    runs = own.filter("root").select("run_id", F.col("branch_id").alias("root_branch"))
    named = [F.expr("left(branch_id, cast(1 + n % 6 as int))"), F.concat(F.expr("left(run_id, 4)"), F.lit(":"), "label"), F.col("run_id"), F.upper(F.expr("left(run_id, 3)")), F.lit("nothing")]
    targets = own.select(F.explode(F.array(*named)).alias("target")).distinct()
    return lineage.resolve(targets, runs, own.select("branch_id", "run_id", "label"))
