import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TESTDATA = os.environ.get("TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return TESTDATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def plain(frame):
    """Rows as sorted tuples by column name; floats rounded, NaN as null."""

    def value(v):
        if v is None or (isinstance(v, float) and v != v):
            return ""
        if hasattr(v, "tolist") and getattr(v, "ndim", 0):
            v = v.tolist()
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v):.6f}"
        return str(v)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(value(v) for v in row) for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False))
