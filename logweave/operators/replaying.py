"""Replay as data: recorded fingerprints against recomputed ones."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def step_verdicts(recorded: DataFrame, recomputed: DataFrame, keys: list[str]) -> DataFrame:
    """replayed, mismatch, unreached (recorded, but not asked for again) or beyond the tip (asked for, but never recorded)."""
    r = recorded.select(*keys, F.col("fingerprint").alias("old"))
    c = recomputed.select(*keys, F.col("fingerprint").alias("new"))
    verdict = F.when(F.col("old").isNull(), "beyond the tip").when(F.col("new").isNull(), "unreached").when(F.col("old") == F.col("new"), "replayed").otherwise("mismatch")
    return r.join(c, keys, "full_outer").withColumn("verdict", verdict).drop("old", "new")


def report(verdicts: DataFrame, chains: DataFrame, outputs: DataFrame, key: str, first: str) -> DataFrame:
    """A replay is clean if nothing mismatched, nothing would have gone out, the chain is sound, and the outputs don't differ. chains: key, error. outputs: key, recorded, output; where
    one is null there is nothing to compare."""
    counted = verdicts.groupBy(key).agg(
        F.count_if(F.col("verdict") == "replayed").alias("replayed"), F.count_if(F.col("verdict") == "mismatch").alias("mismatches"),
        F.count_if(F.col("verdict") == "beyond the tip").alias("external_calls"), F.min(F.when(F.col("verdict") == "mismatch", F.col(first))).alias("first_mismatch"),
    )
    joined = counted.join(chains.select(key, "error"), key, "left").join(outputs.select(key, (F.col("recorded") == F.col("output")).alias("output_matches")), key, "left")
    clean = (F.col("mismatches") == 0) & (F.col("external_calls") == 0) & F.col("error").isNull() & F.coalesce("output_matches", F.lit(True))
    return joined.withColumn("clean", clean).drop("error")
