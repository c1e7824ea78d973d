import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "2g").config("spark.ui.showConsoleProgress", "false")
        # tables are tiny here: compiling costs more than it gains
        .config("spark.sql.codegen.wholeStage", "false").config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return con


def rows_of(df):
    """Rows as sorted tuples of text, columns by name, floats rounded."""
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v != v:
            return ""
        return repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        if str(df[c].dtype).startswith(("int", "Int", "float")):
            df[c] = df[c].astype("float64")
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))
