"""Shared storage: intermediate tables and files that every executor can read.

The folder is the one that the cluster names in ``spark.checkpoint.dir``.  Only a session within one process
(tests, a laptop) may leave it out: a temporary folder of this process is used instead.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_own: list[str] = []
#: Rows of texts that a Python worker receives at once.
TEXT_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="lodestrata-"))
    return _own[0]


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder; nothing is created."""
    return f"{shared_dir(spark)}/lodestrata-{what}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestrata_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote, once nothing reads it any more."""
    path = getattr(df, "_lodestrata_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def filesystem(uri: str):
    """``(pyarrow filesystem, path)`` of a URI: local disks and whatever store pyarrow knows."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), local_path(uri)
    return fs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    """The POSIX path of a URI, or None if it is not a mounted one."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def publish(uri: str, write) -> None:
    """Write a file so that it appears whole or not at all.

    ``write(stream)`` fills a name of this attempt, which then replaces the final name: a task that
    is retried or runs twice leaves the same bytes.
    """
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    mine = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with fs.open_output_stream(mine) as stream:
        write(stream)
    fs.move(mine, path)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within the block, Python receives at most ``rows`` rows at once; for tables that are written inside it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """From now on Python receives at most ``rows`` rows at once: texts may be long, and a batch is held whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: list[str], stem: str) -> str:
    """``stem``, or the first ``stem_1``, ``stem_2``, ... that no column has (case aside)."""
    low = {c.lower() for c in taken}
    name, k = stem, 0
    while name.lower() in low:
        k += 1
        name = f"{stem}_{k}"
    return name


def filter_texts(docs: DataFrame, make_judge) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text a judge keeps.

    ``make_judge()`` runs once a task and gives a function from a list of texts (or None) to booleans.
    """

    small_batches(docs.sparkSession)

    def run(batches):
        judge = make_judge()
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column("text").to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _frame(columns: dict[str, pa.Array]) -> pd.DataFrame:
    """Arrow columns as a frame in which every integer stays one: beside nulls it is ``Int64``, not a double."""

    def series(column):
        if pa.types.is_integer(column.type) and column.null_count:
            return column.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or (pa.types.is_boolean(column.type) and column.null_count):
            return pd.Series(column.to_pylist(), dtype=object)
        return column.to_pandas()

    return pd.DataFrame({k: series(c) for k, c in columns.items()})


def _table(frame: pd.DataFrame, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pandas(frame, schema=schema, preserve_index=False)


def map_frames(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInPandas(run, schema)`` in which ids keep all their digits.

    There a batch of longs with one null becomes doubles, which hold 53 bits: hashed ids would change.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def over(batches):
        for frame in run(_frame(dict(zip(b.schema.names, b.columns, strict=True))) for b in batches):
            yield from _table(frame, arrow).to_batches()

    return df.mapInArrow(over, schema)


def map_groups(df: DataFrame, group: str, run, schema: str) -> DataFrame:
    """``df.groupBy(group).applyInPandas(run, schema)`` with a ``run(key, frame)``, likewise."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def over(key, table):
        frame = _frame(dict(zip(table.column_names, (c.combine_chunks() for c in table.columns), strict=True)))
        return _table(run(tuple(k.as_py() for k in key), frame), arrow)

    return df.groupBy(group).applyInArrow(over, schema)
