"""Array, point and scan files written and read by tasks, framed chunks, and a store of runs that are committed whole."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, rows long"


def filesystem(uri: str):
    """``(pyarrow filesystem, path)`` of a URI."""
    from pyarrow import fs

    parts = urlparse(uri)
    return (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


def publish(uri: str, data: bytes) -> None:
    """Write a file so that it appears whole or not at all: a task that runs twice leaves the same bytes."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    mine = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with fs.open_output_stream(mine) as out:
        out.write(data)
    fs.move(mine, path)


def write_files(rows: DataFrame, group: str, base: str, suffix: str, encode: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """A file ``base/<group><suffix>`` per value of ``group``: ``path, rows``.  A group is a file and bounds a task's memory."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        path = f"{base}/{key[0]}{suffix}"
        publish(path, encode(frame.drop(columns=group)))
        return pd.DataFrame({"path": [path], "rows": [len(frame)]})

    return rows.groupBy(group).applyInPandas(run, FILES)


def read_files(spark: SparkSession, path: str, pattern: str, decode: Callable[[bytes], pd.DataFrame], schema: str) -> DataFrame:
    """``file`` (the name before the suffix) and the rows that ``decode`` finds in each file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                found = decode(raw)
                yield found.assign(file=name.rpartition("/")[2].partition(".")[0])[["file", *found.columns]]

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInPandas(run, f"file string, {schema}")


def to_npy(frame: pd.DataFrame) -> bytes:
    """A two-dimensional array file of the frame's columns in order."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(frame.to_numpy()), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(columns: list[str]) -> Callable[[bytes], pd.DataFrame]:
    def decode(raw: bytes) -> pd.DataFrame:
        values = np.lib.format.read_array(io.BytesIO(raw), allow_pickle=False)
        if values.ndim != 2 or values.shape[1] != len(columns):
            raise ValueError(f"an array of shape {values.shape} hasn't the columns {columns}")
        return pd.DataFrame(values, columns=columns).assign(row=np.arange(len(values)))[["row", *columns]]

    return decode


#: Scalar types of the format and their array types.
_PLY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def to_ply(frame: pd.DataFrame, text: bool = False) -> bytes:
    """Vertices x, y, z (doubles) as ASCII or binary."""
    head = f"ply\nformat {'ascii' if text else 'binary_little_endian'} 1.0\nelement vertex {len(frame)}\n" + "".join(f"property double {c}\n" for c in "xyz") + "end_header\n"
    body = "".join(f"{x!r} {y!r} {z!r}\n" for x, y, z in frame[["x", "y", "z"]].astype(float).itertuples(index=False)).encode() if text else np.ascontiguousarray(frame[["x", "y", "z"]].to_numpy(), "<f8").tobytes()
    return head.encode() + body


def from_ply(raw: bytes) -> pd.DataFrame:
    """The vertices of a file (ASCII, or binary of either byte order): ``row, x, y, z``; other elements are left alone."""
    head, mark, body = raw.partition(b"end_header\n")
    if not mark or not head.startswith(b"ply"):
        raise ValueError("not a ply file")
    form, elements = "", []
    for line in head.decode("ascii").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            form = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append(words[1:])
    if not elements or elements[0][0] != "vertex" or any(p[0] == "list" for p in elements[0][2]):
        raise ValueError("vertices of plain properties must come first")
    _, n, properties = elements[0]
    names = [p[1] for p in properties]
    if form == "ascii":
        rows = [line.split() for line in body.decode("ascii").splitlines()[:n]]
        got = {c: np.asarray([float(r[names.index(c)]) for r in rows]) for c in "xyz"}
    else:
        order = "<" if form == "binary_little_endian" else ">"
        values = np.frombuffer(body, np.dtype([(p[1], order + _PLY[p[0]]) for p in properties]), n)
        got = {c: values[c].astype("f8") for c in "xyz"}
    return pd.DataFrame({"row": np.arange(n), **got})


MAGIC, VERSION = b"LDCK", 1
_HEAD = struct.Struct("<4sHHIII")  # magic, version, columns, rows, bytes, checksum


def encode_chunk(frame: pd.DataFrame) -> bytes:
    """Integer columns as a framed chunk: a header with a checksum, then the compressed columns."""
    body = zlib.compress(np.ascontiguousarray(frame.to_numpy().T, "<i8").tobytes(), 6)
    return _HEAD.pack(MAGIC, VERSION, frame.shape[1], len(frame), len(body), zlib.crc32(body)) + body


def decode_chunk(raw: bytes, most_bytes: int = 64 << 20) -> np.ndarray:
    """Rows of a chunk; anything but a whole, sound chunk of this version within the bound is an error."""
    if len(raw) < _HEAD.size:
        raise ValueError("a chunk is cut")
    magic, version, columns, rows, size, check = _HEAD.unpack_from(raw)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a chunk of this version")
    body = raw[_HEAD.size :]
    if 8 * columns * rows > most_bytes or len(body) != size or zlib.crc32(body) != check:
        raise ValueError("a chunk is damaged or too large")
    return np.frombuffer(zlib.decompress(body), "<i8").reshape(columns, rows).T


def encode_chunks(rows: DataFrame, chunk_rows: int = 4096) -> DataFrame:
    """The integer columns of ``rows`` as chunks: ``chunk`` (binary), ``chunk_rows`` rows each at most."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"chunk": [encode_chunk(frame.iloc[k : k + chunk_rows]) for k in range(0, len(frame), chunk_rows)]})

    return rows.mapInPandas(run, "chunk binary")


def decode_chunks(chunks: DataFrame, columns: list[str]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["chunk"]:
                yield pd.DataFrame(decode_chunk(raw), columns=columns)

    return chunks.mapInPandas(run, ", ".join(f"{c} long" for c in columns))


class RunStore:
    """Runs of one table below ``base``, each committed whole, in a line: every entry of the log names its run and holds a
    digest of the entry before it.

    A run is written under a name of its own and counts only once its entry is published, so a job that dies leaves
    nothing that a reader sees, and committing a run that is there already changes nothing.  ``recertify`` (a function of
    the run's table) must return True before a run is committed.
    """

    def __init__(self, spark: SparkSession, base: str, recertify: Callable[[DataFrame], bool] | None = None):
        self.spark, self.base, self.recertify = spark, base.rstrip("/"), recertify

    def log(self) -> list[dict]:
        """The committed entries in order, checked."""
        fs, path = filesystem(f"{self.base}/log")
        from pyarrow.fs import FileSelector

        files = sorted(f.path for f in fs.get_file_info(FileSelector(path, allow_not_found=True)) if f.path.endswith(".json"))
        found, before = [], ""
        for name in files:
            with fs.open_input_stream(name) as f:
                entry = json.loads(f.read())
            if entry["before"] != before:
                raise ValueError(f"{name} doesn't follow the entry before it")
            before = self._digest(entry)
            found.append(entry)
        return found

    @staticmethod
    def _digest(entry: dict) -> str:
        return hashlib.sha256(json.dumps(entry, sort_keys=True).encode()).hexdigest()

    def commit(self, name: str, run: DataFrame) -> bool:
        """Write and commit a run; False if one of that name is committed already."""
        entries = self.log()
        if any(e["name"] == name for e in entries):
            return False
        path = f"{self.base}/runs/{name}-{uuid.uuid4().hex[:12]}"
        run.write.parquet(path)
        written = self.spark.read.schema(run.schema).parquet(path)
        if self.recertify is not None and not self.recertify(written):
            raise ValueError(f"run {name} is refused")
        entry = {"name": name, "path": path, "rows": written.count(), "before": self._digest(entries[-1]) if entries else ""}
        publish(f"{self.base}/log/{len(entries):08d}.json", json.dumps(entry, sort_keys=True).encode())
        return True

    def read(self, schema) -> DataFrame:
        """All committed runs."""
        paths = [e["path"] for e in self.log()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
