"""Projections of a history: step views, economics, worker segments, offsets."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clipped, col


def ordered(*keys) -> Window:
    return Window.partitionBy(*(keys or ("branch_id",))).orderBy("seq")


def history(events: DataFrame, detail: Column) -> DataFrame:
    """Each event with its offset from the branch's first and a line of detail."""
    first = F.first("at_ms").over(ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.select("branch_id", "seq", "type", "step_id", (F.col("at_ms") - first).alias("offset_ms"), detail.alias("detail"))


def with_latest_intent(events: DataFrame, intent: Column, commit: Column, keys=("branch_id",)) -> DataFrame:
    """As-of join of commits to the latest intent before them, as one window. Without an intent the duration is 0; it is never negative."""
    so_far = ordered(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    started = F.last(F.when(intent, F.col("at_ms")), ignorenulls=True).over(so_far)
    by = F.last(F.when(intent, F.col("step_id")), ignorenulls=True).over(so_far)
    out = events.withColumns({"started_ms": started, "intent_step": by}).filter(commit)
    return out.withColumn("duration_ms", F.greatest(F.col("at_ms") - F.coalesce("started_ms", "at_ms"), F.lit(0)))


def economics(steps: DataFrame, key: str = "branch_id") -> DataFrame:
    """steps: kind (llm, effect, ...), source, tokens, cost_micros, duration_ms."""
    return steps.groupBy(key).agg(
        F.count("*").alias("steps"),
        F.count_if(F.col("kind") == "llm").alias("llm_calls"),
        F.count_if(F.col("kind") == "effect").alias("effects"),
        F.count_if((F.col("kind") == "effect") & F.col("source").startswith("simulated")).alias("simulated_effects"),
        F.sum("tokens").alias("tokens"), F.sum("cost_micros").alias("cost_micros"), F.sum("duration_ms").alias("active_ms"),
    )


def segments(events: DataFrame, result: Column) -> DataFrame:
    """Runs of consecutive events of one worker epoch (above 0), with how many results came before. Rows of epoch 0 break no segment."""
    before = ordered().rowsBetween(Window.unboundedPreceding, -1)
    counted = events.withColumn("results_before", F.coalesce(F.count(F.when(result, 1)).over(before), F.lit(0))).filter("epoch > 0")
    begins = F.when(F.lag("epoch").over(ordered()).eqNullSafe(F.col("epoch")), 0).otherwise(1)
    numbered = counted.withColumn("begins", begins).withColumn("segment", F.sum("begins").over(ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("branch_id", "segment").agg(
        F.first("epoch").alias("epoch"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("at_ms").alias("start_ms"), F.max("at_ms").alias("end_ms"),
        F.min("results_before").alias("prior_results"),
    )


def gaps(events: DataFrame, most_ms: int, speed: int) -> DataFrame:
    """Playback delays: the time since the event before, capped, divided by the speed."""
    gap = F.least(F.col("at_ms") - F.lag("at_ms").over(ordered()), F.lit(most_ms))
    return events.select("branch_id", "seq", F.coalesce(F.floor(gap / speed), F.lit(0)).cast("bigint").alias("delay_ms"))


def numbered_steps(calls: DataFrame, name) -> DataFrame:
    """Step ids name#n, n from 1 for each name of a branch."""
    n = F.row_number().over(Window.partitionBy("branch_id", col(name)).orderBy("seq"))
    return calls.withColumn("step_id", F.concat(col(name), F.lit("#"), n.cast("string")))


def step_index(events: DataFrame) -> DataFrame:
    """branch_id, step_id, and the step's seqs in order: what replay looks up."""
    return events.groupBy("branch_id", "step_id").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))


def trailing(turns: DataFrame, role: str) -> DataFrame:
    """The last turns of each branch that all have one role."""
    other = F.max(F.when(F.col("role") != role, F.col("seq"))).over(Window.partitionBy("branch_id"))
    return turns.withColumn("other", other).filter(F.col("other").isNull() | (F.col("seq") > F.col("other"))).drop("other")


def event_segments(events: DataFrame, found: DataFrame) -> DataFrame:
    """Each event with the worker segment that it lies in; events of no worker have none. found: as segments gives it."""
    s = found.select("branch_id", F.col("epoch").alias("own_epoch"), "segment", "first_seq", "last_seq")
    inside = (F.col("epoch") == F.col("own_epoch")) & F.col("seq").between(F.col("first_seq"), F.col("last_seq"))
    return events.filter("epoch > 0").join(s, "branch_id").filter(inside).drop("own_epoch", "first_seq", "last_seq")


def model_content(response) -> Column:
    """Of a model's answer (JSON): its content, and a line "→ name(arguments)" for each call."""
    said = F.nullif(F.coalesce(F.get_json_object(response, "$.content"), F.lit("")), F.lit(""))
    calls = F.coalesce(F.from_json(F.get_json_object(response, "$.tool_calls"), "array<struct<name:string,arguments:string>>"), F.array().cast("array<struct<name:string,arguments:string>>"))
    lines = F.transform(calls, lambda c: F.concat(F.lit("→ "), c["name"], F.lit("("), c["arguments"], F.lit(")")))
    return F.array_join(F.array_compact(F.concat(F.array(said), lines)), "\n")


def detail(kind, body, size: int = 90) -> Column:
    """A line about an event, by its type. body: JSON; other types show it, cut to size."""
    get = lambda path: F.coalesce(F.get_json_object(body, f"$.{path}"), F.lit(""))
    cut = lambda c: clipped(c, size)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    names = F.from_json(F.get_json_object(body, "$.response.tool_calls"), "array<struct<name:string>>")
    calls = F.coalesce(F.array_join(F.transform(names, lambda c: F.concat(F.lit("→"), F.coalesce(c["name"], F.lit("")))), " "), F.lit(""))
    said = F.when(get("response.content") != "", text(" “", get("response.content"), "”")).otherwise("")
    lines = {
        "RunStarted": text(get("workflow"), "@", get("workflow_version")), "RunCompleted": cut(get("output")), "RunFailed": cut(get("error")),
        "Forked": text("from ", get("from_step"), " ", get("overrides")), "LlmRequested": text("model=", get("request.model"), " fp=", F.left(get("fingerprint"), F.lit(12))),
        "LlmCompleted": cut(text(get("response.model"), " ", calls, said)),
        "EffectIntent": text(get("adapter"), " tier ", get("tier"), " key ", F.left(get("idem_key"), F.lit(13)), "…", F.when(get("simulated") == "true", " (simulated)").otherwise("")),
        "EffectCommitted": cut(text("[", get("source"), "] ", get("output"))), "EffectAborted": cut(get("error")), "EffectInDoubt": cut(get("reason")),
        "SignalReceived": text("[", get("source"), "] ", get("payload")), "TimerSet": text("fires at ", get("fire_at_ms")),
    }
    out = F
    for name, line in lines.items():
        out = out.when(kind == name, line)
    return out.otherwise(cut(body))


def wire_body(model, messages, max_tokens=None) -> Column:
    """A request as JSON text. messages: an array of structs (role, content, and where there are any tool_calls and tool_call_id); what is null is left out."""
    fields = [model.alias("model"), messages.alias("messages")] + ([] if max_tokens is None else [max_tokens.alias("max_completion_tokens")])
    return F.to_json(F.struct(*fields))
