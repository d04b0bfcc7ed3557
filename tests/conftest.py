import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYTHONPATH", str(ROOT))
DATA = Path(os.environ.get("SEINE_TEST_DATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = DATA / "sf0.001"
    if not path.exists():
        pytest.skip("no test data here")
    return str(path)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def canonical(rows, columns):
    """Rows as sorted tuples of comparable text, columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(x):
        if isinstance(x, float):
            return repr(round(x, 6))
        return x.replace(tzinfo=None).isoformat() if hasattr(x, "isoformat") else repr(x)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)
