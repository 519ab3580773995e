import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": f"file://{base}/checkpoints", "spark.local.dir": f"{base}/local", "spark.sql.warehouse.dir": f"{base}/warehouse",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """A connection with the smallest driver tables as views, and a comparison of a DataFrame with a query."""
    import duckdb

    folder = Path("/root/testdata/sf0.001")
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def shown(v):
        return repr(round(v, 6)) if isinstance(v, float) else str(v)

    def same(df, sql):
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        expected = sorted(tuple(map(shown, r)) for r in cursor.fetchall())
        assert sorted(tuple(shown(r[n]) for n in names) for r in df.collect()) == expected

    return str(folder), same
