"""Tables in the folder that driver and executors share, which cut lineage and survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one is set in local mode, as in tests; on a cluster that is an error, as executors would each write to their own disk."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skeinframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def prepare_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in (known := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


#: Folders handed out by this driver.
_made: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    _made.append(f"{shared_dir(spark)}/skeinframe/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, operators may write what tables they need; at its end all of them are removed from the shared folder, finished or not. Results are lazy, so they are to be written elsewhere, or collected, within it."""
    before = len(_made)
    try:
        yield
    finally:
        while len(_made) > before:
            _remove(spark, _made.pop())


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again."""
    out = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(out)
    found = df.sparkSession.read.schema(df.schema).parquet(out)
    found._skeinframe_folder = out
    return found


def release(*tables: DataFrame) -> None:
    """Remove tables that ``durable`` made; others are left alone. What reads them must have been written before."""
    for df in tables:
        folder = getattr(df, "_skeinframe_folder", None)
        if folder:
            _remove(df.sparkSession, folder)
