"""Scalar functions over log columns, as Column expressions (JVM side)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS = "0" * 64


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_ms(ts) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(ts))


def sha256_hex(c) -> Column:
    return F.sha2(col(c), 256)


def idempotency_key(run, branch, step, prefix: str = "run_") -> Column:
    """One key for each (run, branch, step), whoever executes the step."""
    material = F.concat_ws(":", col(run).cast("string"), col(branch).cast("string"), col(step))
    return F.concat(F.lit(prefix), F.substring(F.sha2(material, 256), 1, 48))


def step_name(step) -> Column:
    return F.regexp_extract(col(step), r"^(.*)#([0-9]+)$", 1)


def step_number(step) -> Column:
    """The instance number of `name#n`, cut at the last #; null if it isn't one."""
    return F.nullif(F.regexp_extract(col(step), r"^(.*)#([0-9]+)$", 2), F.lit("")).try_cast("int")


def tokens(text) -> Column:
    """Bytes, not characters, by four, rounded up."""
    return F.ceil(F.octet_length(col(text)) / 4)


def cost_micros(tokens_in, tokens_out, price_in, price_out) -> Column:
    """Prices are micro-units for a million tokens; one integer division at the end."""
    return F.try_divide((col(tokens_in) * col(price_in) + col(tokens_out) * col(price_out)).cast("decimal(38,0)"), F.lit(1_000_000)).cast("bigint")


def percent_change(a, b) -> Column:
    """0 where a is 0; one decimal, halves away from zero."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(a == 0, F.lit(0.0)).otherwise(F.round((b - a) / F.nullif(a, F.lit(0.0)) * 1000) / 10)


def backoff_ms(base, attempt, most: int) -> Column:
    """base * 2 ** min(attempt, most)"""
    return (col(base) * F.pow(F.lit(2), F.least(col(attempt), F.lit(most)))).cast("bigint")


def clipped(text, size: int) -> Column:
    """At most size characters; a longer text ends in an ellipsis."""
    return F.when(F.char_length(col(text)) > size, F.concat(F.substring(col(text), 1, size - 1), F.lit("…"))).otherwise(col(text))


def dollars_to_cents(text) -> Column:
    """The first $ amount; thousands separators are dropped; null without one."""
    found = F.regexp_replace(F.regexp_extract(col(text), r"\$([0-9][0-9,]*(?:\.[0-9]{1,2})?)", 1), ",", "")
    return F.round(F.nullif(found, F.lit("")).try_cast("decimal(18,2)") * 100).cast("bigint")


def order_reference(text) -> Column:
    """The word after `about order `, up to a colon; null without one."""
    return F.nullif(F.regexp_extract(col(text), r"about order ([^:\s]+)", 1), F.lit(""))


def http_class(status) -> Column:
    """What may follow an answer: retry it, treat it as unknown, or give up."""
    s = col(status)
    return F.when(s == 429, "retryable").when(s.between(500, 599), "ambiguous").when(s.between(400, 499), "definitive").when(s.between(200, 299), "ok").otherwise("transport")


def guarantee(tier) -> Column:
    t = col(tier)
    return F.when(t == "A", "exactly once by key").when(t == "B", "exactly once by two phases").when(t == "C", "exactly once by reconciliation").when(t == "D", "at most once, then in doubt")


def one_of(c, allowed: list[str], default: str) -> Column:
    """Decoders never fail on an unknown enumeration value; they fall back."""
    return F.when(col(c).isin(allowed), col(c)).otherwise(F.lit(default))


def prices(text) -> tuple[Column, Column, Column]:
    """Of "model, dollars in, dollars out": the model, and both prices in millionths; 0 where there is no number."""
    part = lambda n: F.trim(F.split_part(col(text), F.lit(","), F.lit(n)))
    micros = lambda n: F.coalesce(F.floor(F.nullif(part(n), F.lit("")).try_cast("double") * 1_000_000).cast("bigint"), F.lit(0).cast("bigint"))
    return part(1), micros(2), micros(3)
