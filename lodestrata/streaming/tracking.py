"""Tracks in space over frames: constant-velocity filters, a transport gate, the best assignment, births and expiry.

Every frame of a key moves its tracks ahead, sends mass from detections to tracks inside a gate by unbalanced transport,
gives each track the detection that carries most to it under the best one-to-one assignment, updates, and lets go of tracks
unseen for too long.  The state of a key is its living tracks, as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import arrays

# Fixed values of the filter: speed limit, process and measurement noise, first variances of place and velocity.
MOST_SPEED, PROCESS, MEASUREMENT, FIRST_PLACE, FIRST_VELOCITY = 35.0, 0.05, 0.5, 1.0, 10.0
# Fixed values of a track's life: hits that confirm it, frames that a confirmed one and another may go unseen.
CONFIRMED, MOST_UNSEEN, MOST_UNSEEN_NEW = 3, 5, 1
#: Transport: blur, reach, and the least mass that a match carries.
BLUR, REACH, LEAST_MASS = 0.2, 3.0, 1e-6

_SEES = np.eye(3, 6)


class Tracks:
    """The living tracks of a key: number, place and velocity (6), covariance (6 by 6), hits, frames unseen."""

    def __init__(self, number=(), place=(), spread=(), hits=(), unseen=(), born: int = 0, frame: int = -1):
        n = len(number)
        self.number, self.hits, self.unseen = (np.asarray(v, np.int64) for v in (number, hits, unseen))
        self.place, self.spread = np.asarray(place, float).reshape(n, 6), np.asarray(spread, float).reshape(n, 6, 6)
        self.born, self.frame = born, frame

    def state(self) -> tuple:
        return self.frame, self.born, self.number.tolist(), self.place.ravel().tolist(), self.spread.ravel().tolist(), self.hits.tolist(), self.unseen.tolist()

    @classmethod
    def of(cls, state: tuple) -> Tracks:
        frame, born, number, place, spread, hits, unseen = state
        return cls(number, place, spread, hits, unseen, born, frame)

    def predict(self, dt: float) -> None:
        """Everything one frame ahead; speeds are cut to the limit after the move."""
        move = np.eye(6)
        move[[0, 1, 2], [3, 4, 5]] = dt
        self.place = self.place @ move.T
        speed = np.linalg.norm(self.place[:, 3:], axis=1)
        fast = speed > MOST_SPEED
        self.place[fast, 3:] *= (MOST_SPEED / speed[fast])[:, None]
        self.spread = move @ self.spread @ move.T + PROCESS * np.eye(6)
        self.unseen = self.unseen + 1

    def update(self, k: np.ndarray, seen: np.ndarray) -> None:
        """Each of some tracks meets its detection."""
        at = self.spread[k]
        gain = at[:, :, :3] @ np.linalg.inv(at[:, :3, :3] + MEASUREMENT * np.eye(3))
        self.place[k] += (gain @ (seen - self.place[k, :3])[:, :, None])[:, :, 0]
        self.spread[k] = (np.eye(6) - gain @ _SEES) @ at
        self.hits[k] += 1
        self.unseen[k] = 0

    def match(self, seen: np.ndarray, gate: float) -> list[tuple[int, int]]:
        """``(track, detection)`` of the assignment that carries most mass inside the gate."""
        if not len(self.number) or not len(seen):
            return []
        n, m = len(seen), len(self.number)
        rows, columns, d2 = arrays.gated(seen, self.place[:, :3], gate)
        plan = arrays.sparse_transport(n, m, rows, columns, d2 / (gate * gate), BLUR, REACH)
        some = plan > 0
        carried = dict(zip(zip(rows.tolist(), columns.tolist(), strict=True), plan.tolist(), strict=True))
        return [(k, i) for i, k in arrays.sparse_assignment(n, m, rows[some], columns[some], plan[some]) if carried[i, k] > LEAST_MASS]

    def keep(self, kept: np.ndarray) -> None:
        self.number, self.place, self.spread, self.hits, self.unseen = self.number[kept], self.place[kept], self.spread[kept], self.hits[kept], self.unseen[kept]

    def give_birth(self, seen: np.ndarray) -> np.ndarray:
        """A new track for every detection; their numbers."""
        n = len(seen)
        new = np.arange(self.born, self.born + n)
        self.born += n
        self.number, self.hits, self.unseen = np.append(self.number, new), np.append(self.hits, np.ones(n, np.int64)), np.append(self.unseen, np.zeros(n, np.int64))
        self.place = np.concatenate([self.place, np.concatenate([seen, np.zeros((n, 3))], axis=1)])
        first = np.diag([FIRST_PLACE] * 3 + [FIRST_VELOCITY] * 3)
        self.spread = np.concatenate([self.spread, np.repeat(first[None], n, axis=0)])
        return new

    def step(self, seen: np.ndarray, gate: float, dt: float) -> np.ndarray:
        """One frame; the track number of each detection."""
        self.predict(dt)
        out = np.full(len(seen), -1, np.int64)
        if found := self.match(seen, gate):
            k, i = np.asarray(found).T
            self.update(k, seen[i])
            out[i] = self.number[k]
        self.keep(self.unseen < np.where(self.hits >= CONFIRMED, MOST_UNSEEN, MOST_UNSEEN_NEW))
        free = out < 0
        out[free] = self.give_birth(seen[free])
        return out


TRACKED = "key string, frame long, detection long, track long, x double, y double, z double"
STATE = "frame long, born long, number array<long>, place array<double>, spread array<double>, hits array<long>, unseen array<long>"


def fold(key: str, tracks: Tracks, frames: pd.DataFrame, gate: float, dt: float) -> pd.DataFrame:
    """Frames in order, detections of a frame by their number; frames up to the last one seen are late and left out.  A frame without
    detections still ages the tracks (a gap longer than any track's patience ends them all)."""
    rows = []
    for number, part in frames.sort_values(["frame", "detection"]).groupby("frame", sort=True):
        if int(number) <= tracks.frame:
            continue
        for _ in range(min(int(number) - tracks.frame - 1, MOST_UNSEEN + 1) if tracks.frame >= 0 else 0):
            tracks.step(np.empty((0, 3)), gate, dt)
        seen = part[["x", "y", "z"]].to_numpy(float)
        ids = tracks.step(seen, gate, dt)
        tracks.frame = int(number)
        at = dict(zip(tracks.number.tolist(), tracks.place[:, :3], strict=True))
        rows += [(key, int(number), int(d), int(t), *at[int(t)].tolist()) for d, t in zip(part["detection"], ids, strict=True)]
    return pd.DataFrame(rows, columns=["key", "frame", "detection", "track", "x", "y", "z"])


def track_stream(detections: DataFrame, gate: float, dt: float) -> DataFrame:
    """Tracks of the stream ``detections(key, frame, detection, x, y, z)``: a row per detection with its track and the filtered
    place.  Batches must hold whole frames, in order of frames within a key; later rows of a frame that is done are left out."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracks = Tracks.of(state.get) if state.exists else Tracks()
        out = fold(key[0], tracks, pd.concat(list(frames)), gate, dt)
        state.update(tracks.state())
        yield out

    return detections.groupBy("key").applyInPandasWithState(run, TRACKED, STATE, "append", GroupStateTimeout.NoTimeout)


def track_batch(detections: DataFrame, gate: float, dt: float) -> DataFrame:
    """The same over a finished table, one ordered fold per key."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return fold(key[0], Tracks(), frame, gate, dt)

    return detections.groupBy("key").applyInPandas(run, TRACKED)
