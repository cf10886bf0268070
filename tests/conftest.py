import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows_of(df):
    """Rows of a pandas frame with columns in order of name, values as comparable texts, sorted."""
    import math

    def text(v):
        if v is None or type(v).__name__ in ("NAType", "NaTType") or isinstance(v, float) and math.isnan(v):
            return "~"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        try:
            return f"{float(v):.6g}"
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
