"""Readers: JSON documents, JSON arrays, JSON lines (strict or lenient), Parquet logs, JDBC; decoders that fall back."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import one_of
from . import schema


def json_documents(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """One object, or one array of objects, in each file."""
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, ddl: str, strict: bool = True) -> DataFrame:
    """Strict: a malformed line fails the job. Lenient: a missing path is empty and bad lines are dropped. Blank lines never count."""
    if strict:
        return spark.read.schema(ddl).option("mode", "FAILFAST").json(path)
    try:
        return spark.read.schema(ddl).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the last one."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def events_from_bodies(lines: DataFrame) -> DataFrame:
    """Envelope rows (branch_id, seq, epoch, at_ms, prev_hash, hash, body) with type and step_id, taken from the exact body text."""
    body = F.try_parse_json("body")
    return lines.withColumns({"type": F.try_variant_get(body, "$.type", "string"), "step_id": F.try_variant_get(body, "$.step_id", "string")})


def decoded_branches(rows: DataFrame) -> DataFrame:
    """Unknown statuses read as running."""
    return rows.withColumn("status", one_of("status", ["running", "suspended", "quarantined", *schema.FINISHED], "running"))


def decoded_effects(rows: DataFrame) -> DataFrame:
    """Unknown classes read as irreversible, unknown states as in doubt: the careful choice."""
    return rows.withColumns({
        "class": one_of("class", ["pure", "idempotent", "compensatable", "irreversible"], "irreversible"),
        "state": one_of("state", ["pending", "prepared", "committed", "aborted", "in_doubt", "compensated"], "in_doubt"),
    })


def jdbc(spark: SparkSession, url: str, name: str, partition_column: str, lower: int, upper: int, partitions: int) -> DataFrame:
    return spark.read.jdbc(url, name, column=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions)


def own_events(events: DataFrame, branch: str, from_seq: int = 0) -> DataFrame:
    """Both predicates reach the Parquet scan."""
    return events.filter((F.col("branch_id") == branch) & (F.col("seq") >= from_seq)).orderBy("seq")
