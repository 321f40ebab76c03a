import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from support import SF, TABLES, plain  # noqa: E402



@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")

    def rows(sql, tables=None):
        for name, frame in (tables or {}).items():
            con.register(name, frame)
        rel = con.sql(sql)
        cols = sorted(rel.columns)
        out = cols, sorted((tuple(plain(v) for v in r) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=repr)
        for name in tables or {}:
            con.unregister(name)
        return out

    return rows
