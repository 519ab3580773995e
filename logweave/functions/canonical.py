"""Canonical JSON, fingerprints and event hashes.

Canonical JSON has sorted keys and no white space. Most bodies go through the VARIANT type inside the JVM. Numbers with a
fraction or an exponent, keys beyond the basic plane and repeated keys go through an Arrow function, since VARIANT prints or refuses them
otherwise.
"""

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scalars import GENESIS, col

_OUTSIDE_STRINGS = r'"(?:[^"\\]|\\.)*"'


def _number(x: float) -> str:
    """Shortest digits; exponents without a plus sign or leading zeros; whole numbers keep one decimal."""
    text = repr(x)
    if "e" in text:
        mantissa, _, exponent = text.partition("e")
        return f"{mantissa}e{int(exponent)}"
    return text


def canonical_text(text: str | None) -> str | None:
    """Of one JSON text; the last of repeated keys wins; null if it isn't JSON."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        return None

    def show(v) -> str:
        if isinstance(v, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{show(v[k])}" for k in sorted(v, key=lambda k: k.encode("utf-8", "surrogatepass"))) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(show, v)) + "]"
        return _number(v) if isinstance(v, float) else json.dumps(v, ensure_ascii=False)

    return show(value)


@F.pandas_udf(StringType())
def _canonical_arrow(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_text)


def canonical_json(body) -> Column:
    """Rows that need it, and only those, take the Arrow path."""
    c = col(body)
    bare = F.regexp_replace(c, _OUTSIDE_STRINGS, '""')
    simple = ~bare.rlike(r"[0-9][.eE]") & ~c.rlike(r"[\x{10000}-\x{10FFFF}]|\\u[dD][89abAB]")
    in_jvm = F.to_json(F.try_parse_json(F.when(simple, c)))
    return F.coalesce(in_jvm, _canonical_arrow(F.when(in_jvm.isNull(), c)))


def canonical_json_jvm(body) -> Column:
    """For bodies that are known to hold neither fractions nor repeated keys: no Python at all."""
    return F.to_json(F.try_parse_json(col(body)))


def fingerprint(body) -> Column:
    return F.sha2(canonical_json(body), 256)


def event_material(branch="branch_id", seq="seq", epoch="epoch", at_ms="at_ms", prev_hash="prev_hash", body="body") -> Column:
    """What an event's hash covers, as canonical JSON; body is canonical already."""
    text = lambda c: col(c).cast("string")
    return F.concat(F.lit('{"at_ms":'), text(at_ms), F.lit(',"body":'), col(body), F.lit(',"branch_id":"'), text(branch), F.lit('","epoch":'), text(epoch), F.lit(',"prev_hash":"'), text(prev_hash), F.lit('","seq":'), text(seq), F.lit("}"))


def event_hash(**columns) -> Column:
    return F.sha2(event_material(**columns), 256)


__all__ = ["GENESIS", "canonical_json", "canonical_json_jvm", "canonical_text", "event_hash", "event_material", "fingerprint"]
