import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    """DuckDB over the tables of a scale."""
    import duckdb

    def at(sf: str):
        c = duckdb.connect()
        c.execute("SET TimeZone = 'UTC'")
        for f in (DATA / sf).glob("*.parquet"):
            c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        return c

    return at


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same_rows(df, duck, sql):
    """Compare a DataFrame with a query of DuckDB, by name of column and without order."""
    cur = duck.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    a = sorted(str(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    b = sorted(str(tuple(plain(dict(zip(names, r))[c]) for c in cols)) for r in cur.fetchall())
    assert a == b
