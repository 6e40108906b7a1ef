"""Packing token sequences into windows: best-fit decreasing over a segment tree.

Every document is first cut into full windows; what remains of it (shorter than a window) is placed
whole, longest first, into the open window with the least room that still holds it.  A segment tree
over the possible capacities finds that window in one descent.

The plan needs lengths only.  Rows are dealt evenly into groups of about ``group_docs`` documents by
a hash of their place in the input, whatever their key, and each group is packed on its own: a group
leaves one or two windows part empty out of thousands, and memory is bounded by the group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, vocab

WINDOW, GROUP_DOCS = 4096, 50_000


class CapacityTree:
    """Counts of open windows by remaining capacity, as a segment tree over 0..window."""

    def __init__(self, window: int):
        self.leaves = 1 << max(1, (window).bit_length())
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        k, count = capacity + self.leaves, self.count
        while k:
            count[k] += by
            k >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of an open window that is at least ``need``, or -1."""
        k, count = need + self.leaves, self.count
        if count[k]:
            return need
        while k > 1:  # up to the first right sibling that holds something, then down its left edge
            if not k & 1 and count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """``(window number, offset)`` of each item, and the windows used.  Items are 1..window long."""
    bins, offsets = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    tree, used = CapacityTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tree.tightest(need)
        if room < 0:
            number, room = used, window
            used += 1
        else:
            number = open_at[room].pop()
            tree.add(room, -1)
        bins[i], offsets[i] = number, window - room
        if room > need:
            open_at[room - need].append(number)
            tree.add(room - need, 1)
    return bins, offsets, used


def cut(n: int, window: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the full windows of ``n`` ids and of the rest."""
    return [(a, min(window, n - a)) for a in range(0, n, window)]


def pack_pieces(pieces: DataFrame, groups: int, window: int = WINDOW, group: str = "pack_group") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have ``length`` (1..window) and a group number.

    Every other column is carried along, and the column ``group`` is dropped.  Sequence numbers of group
    g of G are g, g + G, g + 2G, ..., so they are unique without a pass to count.  Equal lengths are
    placed in the order of doc_id and start.
    """
    kept = [f for f in pieces.schema.fields if f.name != group]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "length"], kind="stable", na_position="first").reset_index(drop=True)
        bins, offsets, _ = best_fit_decreasing(frame["length"].to_numpy().astype("i8"), window)
        return frame.drop(columns=group).assign(sequence_id=bins * groups + int(key[0]), offset=offsets)

    return store.map_groups(pieces, group, pack, schema)


def _pieces(tokenizer: str, end_id: int, window: int, groups: int, with_ids: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, at = vocab.encoder(tokenizer).encode_many, TaskContext.get().partitionId() << 32
        end = np.asarray([end_id], "<u4").tobytes()
        for frame in frames:
            rows = []
            for doc, ids in zip(frame["doc_id"], encode(frame["text"]), strict=True):
                ids += end
                n = len(ids) // 4
                at += 1
                lot = (at * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) * groups >> 64
                for a, k in cut(n, window):
                    own = ids[4 * a : 4 * (a + k)]
                    rows.append((doc, a, k, zlib.crc32(own), n, lot, *([own] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pack_group", *(["ids"] if with_ids else [])], dtype=object)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """Pack whole texts: per piece ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``with_ids`` adds the piece's ids as unsigned 32-bit bytes.  A null or empty text is the end id alone;
    null doc_ids stay null; repeated rows are packed as often as they come; an empty table gives no rows.
    """
    store.small_batches(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, pack_group long" + ", ids binary" * with_ids
    return pack_pieces(store.map_frames(rows, _pieces(tokenizer, end_id, window, groups, with_ids), schema), groups, window)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return pack_documents(store.spark_table(spark, sf_dir, "documents"), vocab.vocabulary("word_bpe_49k.json"))
