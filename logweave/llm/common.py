"""Small helpers that several operators share."""

import ctypes
import gc
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready_to_checkpoint(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir. Only a local session (tests) may do without, with a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: it survives lost executors, and what follows doesn't compute df again."""
    ready_to_checkpoint(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(key: str, modulus: int, rest: int):
    """crc32 of the key as text, in one residue class. A null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """createDataFrame from an Arrow table. From a list, Spark sends the rows through Python workers of executors, which are others than those of mapInArrow
    (another environment) and stay in memory beside them."""
    wanted = _arrow(schema)
    columns = list(zip(*rows)) or [()] * len(wanted)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, wanted)], schema=wanted))


def smallest_by_hash(rows: DataFrame, keys: list[str], n: int, total: int) -> list:
    """The n distinct rows whose keys have the smallest hash, collected: a sample of bounded size. total: about how many rows there are.

    Rows beyond a bound that holds about 4 * n of them aren't compared, and repeated ones become one in their tasks, so what tasks
    send doesn't grow with their number. Where too few lie below the bound, it is raised.
    """
    hashed, share = F.xxhash64(*keys), 4 * n / max(total, 1)
    while True:
        part = rows.filter(hashed < F.lit(int(-(2**63) + share * 2**64))) if share < 1 else rows
        found = part.distinct().orderBy(hashed, *keys).limit(n).collect()
        if len(found) == n or share >= 1:
            return found
        share *= 8


SLICE_BYTES, BATCH_ROWS = 4 << 20, 1000


def slices(batch: pa.RecordBatch):
    """Parts of a batch of about SLICE_BYTES, so that what Python makes of one doesn't grow with the length of the rows; a longer row is a part alone."""
    rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
    for i in range(0, max(batch.num_rows, 1), rows):
        yield batch.slice(i, rows)


#: Of Python workers: numpy's matrix products start no threads beside Spark's tasks, and freed memory goes back to the system.
WORKERS = {"OPENBLAS_NUM_THREADS": "1", "OMP_NUM_THREADS": "1", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows in this session: of long texts, the default of 10,000 can be more than an executor holds. A smaller setting stays. And WORKERS, where they aren't set."""
    for name, value in WORKERS.items():
        spark.sparkContext.environment.setdefault(name, value)
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", 2 * SLICE_BYTES)):
        now = (spark.conf.get(name, None) or "").rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:  # sizes with units are read as unset
            spark.conf.set(name, str(most))


def give_back() -> None:
    """At the end of a task: what Python, Arrow and the C library hold but don't use goes back to the system, as workers live on for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def filter_rows(df: DataFrame, column: str, make) -> DataFrame:
    """The rows of df that stay, with all their columns. make() is called once a task and returns a function from an Arrow array of the column to a mask."""
    at = df.columns.index(column)
    small_batches(df.sparkSession)

    def run(batches):
        keep = make()
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(keep(part.column(at)), pa.bool_()))
        keep = batch = part = None
        give_back()

    return df.mapInArrow(run, df.schema)


def may_be_in(rows: DataFrame, key: str, keys: DataFrame, name: str, bits: int = 23) -> DataFrame:
    """rows with a boolean column name: false only where no row of keys (one column) has that key. A bit map of fixed size is broadcast, 64 bits a row, and saves
    dealing out rows that a join wouldn't find; what passes still has to be joined. It takes no Python workers beside those of the stage that it stands in."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    words = keys.select(place(keys.columns[0]).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("ones"))
    met = rows.withColumn("p", place(key)).join(F.broadcast(words), F.shiftright("p", 6) == F.col("word"), "left")  # 2 ** 17 words at most
    return met.select(*rows.columns, F.coalesce(F.expr("shiftright(ones, cast(p % 64 as int)) & 1 = 1"), F.lit(False)).alias(name))


HOT = 1000


def hot_keys(counted: DataFrame) -> DataFrame | None:
    """Of counted (key, n), the keys of more than 1 / HOT of all rows, so at most HOT of them; checkpointed. None if there is none, or too few rows to care."""
    key, n = counted.columns
    total = counted.agg(F.sum(n)).first()[0] or 0
    if total < 10 * HOT:
        return None
    found = cut_lineage(counted.filter(F.col(n) > total / HOT).select(key))
    return None if found.isEmpty() else found


def join_hot(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with table (one row a key), inner or left. Rows of hot keys meet their rows of table by broadcast, so that no task gets all rows of a key."""
    if hot is None:
        return rows.join(table, key, how)
    hot = hot.toDF(key)
    few = F.broadcast(table.join(F.broadcast(hot), key, "left_semi"))  # HOT rows at most
    there = rows.join(F.broadcast(hot), key, "left_semi").join(few, key, how)
    return there.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, how))


def map_batches(df: DataFrame, make, schema: str) -> DataFrame:
    """mapInArrow with lists: make() is called once a task and returns a function from a dict of lists to a dict of lists."""

    small_batches(df.sparkSession)

    def run(batches):
        apply, wanted = make(), None
        for batch in batches:
            for part in slices(batch):
                out = apply(part.to_pydict())
                wanted = wanted or _arrow(schema)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in wanted], schema=wanted)
        apply = batch = part = out = None
        give_back()

    return df.mapInArrow(run, schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow(schema: str) -> pa.Schema:
    fields = [x.split() for x in schema.split(",")]
    return pa.schema([(name, pa.list_(_TYPES[kind[6:-1]]) if kind.startswith("array<") else _TYPES[kind]) for name, kind in fields])


def one_thread() -> None:
    """Libraries in a task must not start threads beside Spark's own tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
