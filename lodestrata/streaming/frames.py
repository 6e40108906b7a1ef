"""Structured Streaming: exactly-once chunk sinks, sliding accumulation, and frame-by-frame tracking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lineage import shared_dir

#: A confirmed track survives this many frames unseen; an unconfirmed one none.  Hits that confirm; gate; gain.
MOST_UNSEEN, HITS_TO_CONFIRM, GATE, GAIN, MOST_SPEED = 5, 3, 3.0, 0.5, 35.0


def accumulate(stream: DataFrame, width: str, slide: str) -> DataFrame:
    """Sliding windows over ``ts`` per ``key``: count and sum of ``value``."""
    w = stream.groupBy("key", F.window("ts", width, slide).alias("w"))
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("key", F.col("w.start").alias("start"), "n", "total")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and give its result as a table of the shared folder.

    Append: each micro-batch becomes one folder named by its batch id, written by overwrite, so a batch that
    runs again after a failure replaces itself.  Complete: the last batch is the result.
    """
    import uuid

    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/lodestrata-stream-{name}-{uuid.uuid4().hex[:12]}"

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number if mode == 'append' else 0}")

    q = stream.writeStream.outputMode(mode).foreachBatch(commit).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", f"{base}/out").parquet(f"{base}/out").select(*stream.columns)


def read_stream(spark: SparkSession, sf_dir: str, table: str, files_per_batch: int = 1) -> DataFrame:
    """A table's Parquet file or folder as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{table}.parquet*")


class Track:
    """Constant-velocity position on a line, with a clamped speed."""

    __slots__ = ("number", "x", "v", "hits", "unseen")

    def __init__(self, number: int, x: float, v: float = 0.0, hits: int = 1, unseen: int = 0):
        self.number, self.x, self.v, self.hits, self.unseen = number, x, v, hits, unseen

    def predict(self) -> None:
        self.x += self.v

    def update(self, x: float) -> None:
        gap = x - self.x
        self.x += GAIN * gap
        self.v = float(np.clip(self.v + GAIN * GAIN * gap, -MOST_SPEED, MOST_SPEED))
        self.hits, self.unseen = self.hits + 1, 0

    @property
    def alive(self) -> bool:
        return self.unseen < (MOST_UNSEEN if self.hits >= HITS_TO_CONFIRM else 1)


def step(tracks: list[Track], born: int, seen: list[float]) -> tuple[list[Track], int, list[int]]:
    """One frame: predict, assign greedily the nearest pairs inside the gate, update, expire, give birth.

    Gives the living tracks, the next number, and the track number of each detection.
    """
    for t in tracks:
        t.predict()
    pairs = sorted((abs(t.x - x), t.number, i) for t in tracks for i, x in enumerate(seen) if abs(t.x - x) <= GATE)
    of: dict[int, int] = {}
    taken: set[int] = set()
    by = {t.number: t for t in tracks}
    for _, number, i in pairs:
        if number not in taken and i not in of:
            of[i] = number
            taken.add(number)
    for t in tracks:
        if t.number not in taken:
            t.unseen += 1
    for i, number in of.items():
        by[number].update(seen[i])
    tracks = [t for t in tracks if t.alive]
    for i, x in enumerate(seen):
        if i not in of:
            tracks.append(Track(born, x))
            of[i] = born
            born += 1
    return tracks, born, [of[i] for i in range(len(seen))]


TRACKED, STATE = "key string, frame long, x double, track long", "frame long, born long, number array<long>, x array<double>, v array<double>, hits array<long>, unseen array<long>"


def _fold(key: str, tracks: list[Track], born: int, frames: pd.DataFrame) -> tuple[list[Track], int, pd.DataFrame]:
    rows = []
    for frame, part in frames.sort_values(["frame", "x"]).groupby("frame", sort=True):
        seen = part["x"].tolist()
        tracks, born, numbers = step(tracks, born, seen)
        rows += [(key, int(frame), x, n) for x, n in zip(seen, numbers, strict=True)]
    return tracks, born, pd.DataFrame(rows, columns=["key", "frame", "x", "track"])


def _stateful(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, born, tracks = -1, 0, []
    if state.exists:
        last, born, *parts = state.get
        tracks = [Track(int(a), b, c, int(d), int(e)) for a, b, c, d, e in zip(*parts, strict=True)]
    got = pd.concat(list(frames))
    tracks, born, out = _fold(key[0], tracks, born, got)
    state.update((max(last, int(got["frame"].max())), born, [t.number for t in tracks], [t.x for t in tracks], [t.v for t in tracks], [t.hits for t in tracks], [t.unseen for t in tracks]))
    yield out


def track_stream(detections: DataFrame) -> DataFrame:
    """Tracks of ``detections(key, frame, x)`` as a stream; a key's frames must arrive in order, whole."""
    return detections.groupBy("key").applyInPandasWithState(_stateful, TRACKED, STATE, "append", GroupStateTimeout.NoTimeout)


def track_batch(detections: DataFrame) -> DataFrame:
    """The same over a finished table: one ordered fold per key."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _fold(key[0], [], 0, frame)[2]

    return detections.groupBy("key").applyInPandas(run, TRACKED)


VERIFIED = "key string, number long, status string"


def _verify(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    poisoned = bool(state.get[0]) if state.exists else False
    got = pd.concat(list(frames)).sort_values("number", kind="stable")
    bad = got["bad"].fillna(True).to_numpy(bool)
    before = np.concatenate([[False], np.logical_or.accumulate(bad)[:-1]]) | poisoned
    state.update((bool(poisoned or bad.any()),))
    yield pd.DataFrame({"key": key[0], "number": got["number"].to_numpy(), "status": np.where(before, "poisoned", np.where(bad, "failed", "verified"))})


def verify_stream(rows: DataFrame) -> DataFrame:
    """``rows(key, number, bad)`` verified in order of number within a key: ``verified``, then ``failed`` at the first bad row
    (a null is bad), then ``poisoned`` for good, over all later batches.  A key's batches must arrive in order."""
    return rows.groupBy("key").applyInPandasWithState(_verify, VERIFIED, "poisoned boolean", "append", GroupStateTimeout.NoTimeout)
