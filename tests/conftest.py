import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    top = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{top}/shared").config("spark.sql.warehouse.dir", f"{top}/warehouse").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = "/root/testdata"


def same_rows(got, want):
    """Whether two pandas frames have the same rows, whatever their order."""
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = (sorted(map(str, zip(*(x[c].tolist() for c in columns), strict=True))) for x in (got, want))
    assert a == b


def duck(sql, sf="sf0.001"):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(f"{DATA}/{sf}"):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{sf}/{f}'")
    return c.sql(sql).df()
