"""Recordings: nested documents of runs or of single branches, and JSON sinks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "recording/v1"


def recordings(runs: DataFrame, branches: DataFrame, events: DataFrame, exported_at_ms: int, schema: str = SCHEMA) -> DataFrame:
    """run_id and document: runs with their branches and those branches' own events, in order.

    Events gather by branch first, then branches by run: a document has to hold its run, and nothing holds more than one.
    """
    e = events.groupBy("branch_id").agg(F.array_sort(F.collect_list(F.struct("seq", "type", "step_id", "epoch", "at_ms", "body"))).alias("events"))
    b = branches.join(e, "branch_id", "left").withColumn("events", F.coalesce("events", F.expr("filter(array(cast(null as struct<seq:bigint,type:string,step_id:string,epoch:bigint,at_ms:bigint,body:string>)), x -> false)")))
    nested = b.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("created_at_ms", "depth", "branch_id", "parent_branch", "fork_seq", "events"))).alias("branches"))
    document = F.to_json(F.struct(F.lit(schema).alias("schema"), F.lit(exported_at_ms).alias("exported_at_ms"), F.struct(*runs.columns).alias("run"), "branches"))
    return runs.join(nested, "run_id").select("run_id", document.alias("document"))


def branch_documents(branches: DataFrame, events: DataFrame, exported_at_ms: int, schema: str = SCHEMA) -> DataFrame:
    """run_id, branch_id and document: each branch with its own events in order, as a recording of one branch. So no task holds more than a branch."""
    e = events.groupBy("branch_id").agg(F.array_sort(F.collect_list(F.struct("seq", "type", "step_id", "epoch", "at_ms", "body"))).alias("events"))
    branch = F.struct("created_at_ms", "depth", "branch_id", "parent_branch", "fork_seq", "events")
    document = F.to_json(F.struct(F.lit(schema).alias("schema"), F.lit(exported_at_ms).alias("exported_at_ms"), F.struct("run_id").alias("run"), F.array(branch).alias("branches")))
    return branches.join(e, "branch_id", "left").select("run_id", "branch_id", document.alias("document"))


def write_recordings(documents: DataFrame, path: str) -> None:
    """One folder of JSON text a run."""
    documents.withColumnRenamed("document", "value").write.partitionBy("run_id").mode("overwrite").text(path)


def read_recordings(spark, path: str, schema: str = SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Branches and events of recordings; a document of another schema fails the job."""
    lines = spark.read.text(path)
    found = F.get_json_object("value", "$.schema")
    checked = lines.select(F.when(found == schema, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("unexpected schema "), F.coalesce(found, F.lit("none"))))).alias("value"))
    event = "struct<seq:bigint,type:string,step_id:string,epoch:bigint,at_ms:bigint,body:string>"
    branch = f"struct<created_at_ms:bigint,depth:int,branch_id:string,parent_branch:string,fork_seq:bigint,events:array<{event}>>"
    parsed = checked.select(F.from_json("value", f"struct<run:struct<run_id:string>,branches:array<{branch}>>").alias("r")).select("r.run.run_id", F.explode("r.branches").alias("b"))
    return parsed.select("run_id", "b.*").drop("events"), parsed.select("b.branch_id", F.explode("b.events").alias("e")).select("branch_id", "e.*")


def append_json_lines(rows: DataFrame, path: str) -> None:
    """Annotations and reports: one JSON object a row, added to what the folder holds; null fields are left out. ingest.json_lines reads them back."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)
