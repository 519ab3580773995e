"""Scalar functions, projections, sets and small sorts over whole tables."""

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.canonical import canonical_json
from ..operators import views
from ..sources import ingest, schema
from .bindings import EVLOG, TURNS, evlog, table, turns, with_views
from .registry import query


@query("SELECT event_id, replace(props, ' ', '') AS canonical, sha256(replace(props, ' ', '')) AS fingerprint FROM events")
def canonical_props(spark, d):
    return table(spark, d, "events").select("event_id", canonical_json("props").alias("canonical"), F.sha2(canonical_json("props"), 256).alias("fingerprint"))


@query("SELECT sha256(text) AS fingerprint, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def fingerprint_docs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    return docs.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")


@query(
    with_views(TURNS)
    + """SELECT branch_id, CAST(sum(CASE WHEN role <> 'assistant' THEN tokens ELSE 0 END) AS BIGINT) AS tokens_in, CAST(sum(CASE WHEN role = 'assistant' THEN tokens ELSE 0 END) AS BIGINT) AS tokens_out,
  CAST((sum(CASE WHEN role <> 'assistant' THEN tokens ELSE 0 END) * 2000000 + sum(CASE WHEN role = 'assistant' THEN tokens ELSE 0 END) * 8000000) // 1000000 AS BIGINT) AS cost_micros FROM turns GROUP BY branch_id"""
)
def llm_rollup(spark, d):
    spoken = F.col("role") == "assistant"
    sums = turns(spark, d).groupBy("branch_id").agg(F.sum(F.when(~spoken, F.col("tokens")).otherwise(0)).alias("tokens_in"), F.sum(F.when(spoken, F.col("tokens")).otherwise(0)).alias("tokens_out"))
    return sums.withColumn("cost_micros", scalars.cost_micros("tokens_in", "tokens_out", F.lit(2_000_000), F.lit(8_000_000)))


PRICES = [("small", "small-1", 150_000), ("large", "large-1", 2_500_000)]


@query(
    with_views(TURNS, "prices(alias, model, price) AS (VALUES " + ", ".join(f"({a!r}, {m!r}, {p}::BIGINT)" for a, m, p in PRICES) + ")", "asked AS (SELECT branch_id, seq, tokens, CASE branch_id % 3 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'Large' ELSE 'Own' END AS alias FROM turns)")
    + "SELECT branch_id, seq, coalesce(p.model, a.alias) AS model, tokens * coalesce(p.price, 0) // 1000000 AS cost_micros FROM asked a LEFT JOIN prices p ON p.alias = lower(a.alias)"
)
def alias_prices(spark, d):
    asked = turns(spark, d).withColumn("alias", F.when(F.col("branch_id") % 3 == 0, "SMALL").when(F.col("branch_id") % 3 == 1, "Large").otherwise("Own"))
    prices = spark.createDataFrame(PRICES, "name string, model string, price bigint")
    joined = asked.join(F.broadcast(prices), F.lower("alias") == F.col("name"), "left")
    return joined.select("branch_id", "seq", F.coalesce("model", "alias").alias("model"), F.expr("tokens * coalesce(price, 0) div 1000000").alias("cost_micros"))


@query(
    with_views(EVLOG)
    + """SELECT branch_id, seq, type AS name, CAST(split_part(step_id, '#', 2) AS INTEGER) AS n, 'ORD-' || event_id AS order_ref, CAST(event_id * 100 + 50 AS BIGINT) AS cents FROM evlog"""
)
def text_parse(spark, d):
    e = evlog(spark, d)
    said = F.concat(F.lit("about order ORD-"), F.col("event_id").cast("string"), F.lit(": please refund $"), F.format_number(F.col("event_id"), 0), F.lit(".50."))
    e = e.withColumn("said", said)
    return e.select("branch_id", "seq", scalars.step_name("step_id").alias("name"), scalars.step_number("step_id").alias("n"), scalars.order_reference("said").alias("order_ref"), scalars.dollars_to_cents("said").alias("cents"))


@query("SELECT event_id, CASE WHEN s = 429 THEN 'retryable' WHEN s BETWEEN 500 AND 599 THEN 'ambiguous' WHEN s BETWEEN 400 AND 499 THEN 'definitive' WHEN s BETWEEN 200 AND 299 THEN 'ok' ELSE 'transport' END AS class FROM (SELECT event_id, 200 + event_id % 450 AS s FROM events)")
def error_classes(spark, d):
    e = table(spark, d, "events").withColumn("status", 200 + F.col("event_id") % 450)
    return e.select("event_id", scalars.http_class("status").alias("class"))


@query("SELECT user_id AS branch_id, count(DISTINCT event_type) AS kinds, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY user_id")
def distinct_sets(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("branch_id")).agg(F.count_distinct("event_type").alias("kinds"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


STATUS = {"F": "completed", "O": "running", "P": "suspended"}


@query(
    """SELECT o_orderkey AS branch_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'suspended' END AS status, o_orderstatus = 'F' AS finished, o_orderstatus = 'P' AS parked,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'exactly once by key' WHEN '2' THEN 'exactly once by two phases' WHEN '3' THEN 'exactly once by reconciliation' WHEN '4' THEN 'at most once, then in doubt' END AS guarantee FROM orders"""
)
def status_projection(spark, d):
    names = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    tier = F.element_at(F.array(*map(F.lit, "ABCDE")), F.substring("o_orderpriority", 1, 1).cast("int"))
    o = ingest.decoded_branches(table(spark, d, "orders").select(F.col("o_orderkey").alias("branch_id"), names[F.col("o_orderstatus")].alias("status"), tier.alias("tier")))
    return o.select("branch_id", "status", F.col("status").isin(schema.FINISHED).alias("finished"), (F.col("status") == "suspended").alias("parked"), scalars.guarantee("tier").alias("guarantee"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS missing, 'k-' || json_extract_string(props, '$.k') AS external_ref FROM events")
def outcome_projection(spark, d):
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.try_variant_get(v, "$.id", "string").alias("missing"), F.concat(F.lit("k-"), F.try_variant_get(v, "$.k", "string")).alias("external_ref"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 20")
def failing_topn(spark, d):
    return table(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id", "value").orderBy(F.desc("value"), "event_id").limit(20)


@query("SELECT event_id, array_to_string(list_sort(list_distinct(['k', event_type, 'type'])), ',') AS keys FROM events")
def sorted_keys(spark, d):
    keys = F.array_union(F.json_object_keys("props"), F.array(F.col("event_type"), F.lit("type")))
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.array_distinct(keys)), ",").alias("keys"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 50 OFFSET 100")
def page_offset(spark, d):
    return table(spark, d, "events").select("event_id", "event_type").orderBy("event_id").offset(100).limit(50)


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 79) || '…' ELSE text END AS shown, left(text, 500) AS excerpt FROM documents")
def clip_text(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.clipped("text", 80).alias("shown"), F.left("text", F.lit(500)).alias("excerpt"))


PROMPT = "Answer briefly."


@query(
    with_views(TURNS, "firsts AS (SELECT branch_id, min(seq) FILTER (role = 'system') AS at FROM turns GROUP BY branch_id)")
    + f"""SELECT t.branch_id, CASE WHEN bool_or(t.role = 'system') THEN '' ELSE 'system: {PROMPT}' || chr(10) END || string_agg(t.role || ': ' || CASE WHEN t.seq = f.at THEN '{PROMPT}' ELSE t.text END, chr(10) ORDER BY t.seq) AS body, bool_or(t.role = 'system') AS had_prompt,
  CASE WHEN bool_or(t.role = 'system') THEN count(*) ELSE count(*) + 1 END AS messages FROM turns t JOIN firsts f USING (branch_id) GROUP BY t.branch_id"""
)
def context_patch(spark, d):
    """A prompt patch: the first system message is replaced; without one, one is put first."""
    gathered = turns(spark, d).groupBy("branch_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))).alias("m"))
    at = F.array_position(F.transform("m", lambda x: x["role"]), "system") - 1
    shown = F.transform("m", lambda x, i: F.concat(x["role"], F.lit(": "), F.when(i == at, F.lit(PROMPT)).otherwise(x["text"])))
    had = at >= 0
    first = F.when(had, F.array().cast("array<string>")).otherwise(F.array(F.lit(f"system: {PROMPT}")))
    return gathered.select("branch_id", F.array_join(F.concat(first, shown), "\n").alias("body"), had.alias("had_prompt"), (F.size("m") + F.when(had, 0).otherwise(1)).cast("bigint").alias("messages"))


@query("SELECT event_id, 'order=' || event_id || ',user=' || user_id AS metadata FROM events")
def metadata_map(spark, d):
    """Form keys metadata[x] become a map; other keys are left out."""
    form = F.create_map(F.lit("metadata[order]"), F.col("event_id").cast("string"), F.lit("metadata[user]"), F.col("user_id").cast("string"), F.lit("amount"), F.col("value").cast("string"))
    own = F.transform_keys(F.map_filter(form, lambda k, v: k.rlike(r"^metadata\[.*\]$")), lambda k, v: F.regexp_extract(k, r"^metadata\[(.*)\]$", 1))
    shown = F.transform(F.array_sort(F.map_entries(own)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, d, "events").select("event_id", F.array_join(shown, ",").alias("metadata"))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN '{"_raw":"' || event_type || '"}' ELSE replace(props, ' ', '') END AS arguments, event_type = 'error' AS fatal FROM events""")
def response_parse(spark, d):
    """Arguments that aren't JSON are wrapped as _raw."""
    e = table(spark, d, "events").withColumn("said", F.when(F.col("event_id") % 6 == 0, F.col("event_type")).otherwise(F.col("props")))
    parsed = F.to_json(F.try_parse_json("said"))
    return e.select("event_id", F.coalesce(parsed, F.to_json(F.struct(F.col("said").alias("_raw")))).alias("arguments"), (F.col("event_type") == "error").alias("fatal"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'pure' ELSE 'irreversible' END AS class, CASE WHEN event_type = 'purchase' THEN 'committed' ELSE 'in_doubt' END AS state FROM events")
def row_defaults(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "pure").otherwise(F.col("event_type")).alias("class"), F.when(F.col("event_type") == "purchase", "committed").otherwise(F.col("event_type")).alias("state"))
    return ingest.decoded_effects(e)


@query(
    """SELECT p_partkey AS part, trim(p_name) AS model, CAST(floor(p_retailprice * 1000000) AS BIGINT) AS price_in, CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 2500000 ELSE 0 END::BIGINT AS price_out FROM part"""
)
def price_parse(spark, d):
    """Prices as "model, dollars in, dollars out" a million tokens; what is missing or no number costs nothing."""
    said = F.concat(F.col("p_name"), F.lit(" , "), F.col("p_retailprice").cast("string"), F.when(F.col("p_size") % 3 == 0, ", free").when(F.col("p_size") % 3 == 1, ",2.5 ").otherwise(""))
    model, price_in, price_out = scalars.prices(said)
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), model.alias("model"), price_in.alias("price_in"), price_out.alias("price_out"))


@query(
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END || CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN chr(10) ELSE '' END || CASE WHEN event_id % 3 <> 0 THEN '→ ' || event_type || '(' || replace(props, ' ', '') || ')' ELSE '' END AS content FROM events"""
)
def model_content(spark, d):
    """A model's answer as text: what it says, and a line for each call of a tool."""
    call = F.concat(F.lit('{"name":"'), F.col("event_type"), F.lit('","arguments":'), F.col("props"), F.lit("}"))
    calls = F.when(F.col("event_id") % 3 == 0, F.lit("[]")).otherwise(F.concat(F.lit("["), call, F.lit("]")))
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise(F.lit("null"))
    response = F.concat(F.lit('{"content":'), said, F.lit(',"tool_calls":'), calls, F.lit("}"))
    return table(spark, d, "events").select("event_id", views.model_content(response).alias("content"))


@query(
    with_views(TURNS)
    + """SELECT branch_id, to_json({'model': 'large-1', 'messages': list({'role': role, 'content': text} ORDER BY seq), 'max_completion_tokens': 256}) ->> '$.model' AS model, CAST(len(list(role)) AS INTEGER) AS messages,
  sha256(string_agg(role || chr(1) || text, chr(2) ORDER BY seq)) AS digest FROM turns GROUP BY branch_id"""
)
def wire_bodies(spark, d):
    """Requests as the model's service takes them, read back from their JSON."""
    gathered = turns(spark, d).groupBy("branch_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct("role", F.col("text").alias("content")).alias("m")))).alias("all"))
    body = views.wire_body(F.lit("large-1"), F.transform("all", lambda x: x["m"]), F.lit(256))
    parsed = F.from_json(body, "struct<model:string,messages:array<struct<role:string,content:string>>,max_completion_tokens:int>")
    said = F.array_join(F.transform(parsed["messages"], lambda m: F.concat(m["role"], F.lit("\x01"), m["content"])), "\x02")
    return gathered.select("branch_id", parsed["model"].alias("model"), F.size(parsed["messages"]).alias("messages"), F.sha2(said, 256).alias("digest"))
