"""Cutting lineage through the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: dict[str, SparkSession] = {}
_TABLES: dict[str, str] = {}
ROWS = 500_000  #: rows of a bucket of `dealt`, about
SENT = 1_000_000  #: rows of a table that `sent` sends, some 100 MB at most


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder in local mode, else an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="partflow-ckpt-"))
        at = sc.getCheckpointDir()
    return at


def _place(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/partflow-{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_clean)
    _MADE[path] = spark
    return path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a table into the shared folder and read it back: iterations stay short plans and survive lost executors. It goes with
    `release`, or when the driver's Python ends."""
    spark = df.sparkSession
    path = _place(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def once(df: DataFrame, name: str = "step") -> DataFrame:
    """A table that `cut` or `dealt` wrote as it is, any other one cut."""
    return df if getattr(df, "cut_path", None) else cut(df, name)


def dealt(df: DataFrame, by: str, rows: int, name: str = "step") -> DataFrame:
    """Like `cut`, with all rows of a key in one of about rows / ROWS buckets: grouping by the key later needs no shuffle, and what a task
    holds doesn't grow with the table."""
    spark, n = df.sparkSession, max(1, -(-rows // ROWS))
    path, table = _place(spark, name), f"partflow_{name}_{uuid.uuid4().hex}"
    df.repartition(n, by).write.format("parquet").bucketBy(n, by).option("path", path).saveAsTable(table)
    _TABLES[path] = table
    out = spark.table(table)
    out.cut_path = path
    return out


def sent(df: DataFrame, rows: int) -> DataFrame:
    """A table of a few numbers a row that goes to every task, whatever Spark's size limit, if it has SENT rows at most: what it is joined with, a
    graph's arcs, is a thousand times larger and isn't shuffled. A longer one is left to Spark."""
    return F.broadcast(df) if rows <= SENT else df


def release(*tables: DataFrame | None) -> None:
    """Delete tables that `cut` wrote and nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "cut_path", None)
        spark = _MADE.pop(path, None) if path else None
        if spark is not None:
            if path in _TABLES:
                spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for path, spark in list(_MADE.items()):
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is over: the files stay where the cluster's own clean-up finds them
            return
