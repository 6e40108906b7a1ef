"""What shapes a plan: intermediate tables in the folder that the cluster shares, rows dealt anew, columns kept whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session within one process may leave it out, for a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="lodestrata-"))
    return _own[0]


def cut(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/lodestrata-{what}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestrata_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut` wrote, once nothing reads them any more: those of a round when the next is written."""
    for df in tables:
        path = getattr(df, "_lodestrata_path", None)
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all cores: for few rows from which many are made, which a plan that goes by
    bytes would leave to one task."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def dealt(df: DataFrame) -> DataFrame:
    """``df``, whose joins go by shuffles.  Files of :func:`cut` are a small part of their rows in memory, and rows out of a generator
    count as one: a plan that goes by bytes would take millions of rows to the driver to broadcast them."""
    return df.hint("merge")


def let(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with expressions as columns that are computed once.

    They come out of a generator of one row: filters on columns of a projection are pushed below it with their
    expressions put in, and determinants of determinants grow beyond what is compiled.
    """
    return df.select("*", F.inline(F.array(F.struct(*(F.expr(e).alias(k) for k, e in columns.items())))))
