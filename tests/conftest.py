import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF_DIR


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or v != v if not hasattr(v, "__len__") else False:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows_of(frame) -> list[tuple]:
    """Rows with columns by name, nulls alike, sorted."""
    import pandas as pd

    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(pd.notna(frame), None)
    return sorted((tuple(_plain(x) for x in r) for r in frame.itertuples(index=False)), key=lambda r: tuple(str(x) for x in r))


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    def check(query, sql):
        got, want = query(spark, sf_dir).toPandas(), duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert len(got) == len(want)
        assert rows_of(got) == rows_of(want)

    return check
