"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A shard ``part-00012`` is three flat little-endian files: ``.ids`` (16-bit ids if the vocabulary
allows, else 32-bit), ``.idx`` (64-bit offsets, one more than documents, counted in ids) and
``.doc`` (per document the 64-bit doc_id and a byte that is 1 where it was null).  Shards follow
each other in ascending doc_id; ``manifest.json`` holds for each the ids and documents before it,
which are prefix sums over the shards.  A reader maps the files into memory.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, vocab

#: Rows of documents and bytes of their texts a shard is made for, and the shards a small corpus gets at least.
SHARD_DOCS, SHARD_BYTES, LEAST_SHARDS = 20_000, 64 << 20, 1
#: Ids a shard's writer holds before it appends them to the file.
BLOCK_BYTES = 8 << 20

_SHARD = "shard int, docs long, ids long, digest long"


def _writer(base: str, path: str, end_id: int, width: int):
    kind = f"<u{width}"

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, shard = vocab.encoder(path).encode_many, TaskContext.get().partitionId()
        end = np.asarray([end_id], "<u4").tobytes()
        lengths: list[np.ndarray] = []
        names: list[np.ndarray] = []
        digest = 0

        def fill(out) -> None:
            nonlocal digest
            held: list[bytes] = []
            size = 0

            def flush() -> None:
                nonlocal digest
                raw = np.frombuffer(b"".join(held), "<u4").astype(kind).tobytes()
                digest = zlib.crc32(raw, digest)
                out.write(raw)
                held.clear()

            for frame in frames:
                ns = np.empty(len(frame), "<i8")
                for i, got in enumerate(encode(frame["text"])):
                    got += end
                    ns[i] = len(got) // 4
                    held.append(got)
                    size += len(got)
                    if size >= BLOCK_BYTES:
                        flush()
                        size = 0
                lengths.append(ns)
                doc = np.zeros(len(frame), [("id", "<i8"), ("null", "u1")])
                gone = frame["doc_id"].isna().to_numpy()
                doc["id"] = frame["doc_id"].fillna(0).to_numpy().astype("<i8")
                doc["null"] = gone
                names.append(doc)
            flush()

        stem = f"{base}/part-{shard:05d}"
        store.publish(f"{stem}.ids", fill)
        ns = np.concatenate(lengths) if lengths else np.empty(0, "<i8")
        offsets = np.concatenate([[0], np.cumsum(ns)]).astype("<u8")
        store.publish(f"{stem}.idx", lambda out: out.write(offsets.tobytes()))
        store.publish(f"{stem}.doc", lambda out: out.write(np.concatenate(names).tobytes() if names else b""))
        yield pd.DataFrame({"shard": [shard], "docs": [len(ns)], "ids": [int(offsets[-1])], "digest": [digest]})

    return write


def write_token_files(docs: DataFrame, base: str, tokenizer: str, end_id: int = 2, shard_docs: int = SHARD_DOCS, partitions: int | None = None) -> str:
    """Encode every whole text in ascending doc_id order into shards below ``base``.

    Null or empty texts give the end id alone.  Null doc_ids sort first; equal doc_ids are ordered by
    their text.  No rows: no shard, a manifest all the same.  Other columns are ignored.
    Returns the path of the manifest.
    """
    store.small_batches(docs.sparkSession)
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    width = 2 if max(size - 1, end_id) < 1 << 16 else 4
    docs_in, bytes_in = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    n = partitions or max(LEAST_SHARDS, -(-docs_in // shard_docs), -(-bytes_in // SHARD_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    shards = sorted(store.map_frames(ordered, _writer(base, tokenizer, end_id, width), _SHARD).collect())
    ids = np.concatenate([[0], np.cumsum([s.ids for s in shards])]).astype(int).tolist()
    rows_before = np.concatenate([[0], np.cumsum([s.docs for s in shards])]).astype(int).tolist()
    manifest = {"width": width, "end_id": end_id, "ids": ids[-1], "docs": rows_before[-1], "shards": [{"stem": f"part-{s.shard:05d}", "docs": s.docs, "ids": s.ids, "ids_before": a, "docs_before": b, "crc32": s.digest} for s, a, b in zip(shards, ids, rows_before, strict=False)]}
    target = f"{base}/manifest.json"
    store.publish(target, lambda out: out.write(json.dumps(manifest).encode()))
    return target


def map_flat(uri: str, kind) -> np.ndarray:
    """A flat file as an array: memory-mapped where it is mounted, else read."""
    fs, path = store.filesystem(uri)
    if fs.get_file_info(path).size == 0:
        return np.empty(0, kind)
    if store.local_path(uri):
        return np.memmap(path, kind, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def _reader(base: str, width: int):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for stem, before, digest in zip(frame["stem"], frame["ids_before"], frame["crc32"], strict=True):
                ids, idx = map_flat(f"{base}/{stem}.ids", f"<u{width}"), map_flat(f"{base}/{stem}.idx", "<u8").astype("i8")
                doc = map_flat(f"{base}/{stem}.doc", [("id", "<i8"), ("null", "u1")])
                if zlib.crc32(ids) != digest or len(idx) != len(doc) + 1 or idx[-1] != len(ids):
                    raise ValueError(f"{stem} is not what was written")
                for lo in range(0, len(doc), 4096):
                    some = doc[lo : lo + 4096]
                    cuts = idx[lo : lo + len(some) + 1]
                    yield pd.DataFrame({
                        "doc_id": pd.Series(some["id"].astype("i8")).astype("Int64").mask(some["null"].astype(bool)),
                        "start": cuts[:-1] + int(before),
                        "n_tokens": np.diff(cuts),
                        "ids": [ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                    })

    return read


def read_token_files(spark: SparkSession, manifest: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document; ids as unsigned 32-bit bytes.  Files that are cut or changed
    are an error."""
    base = manifest.rpartition("/")[0]
    fs, path = store.filesystem(manifest)
    with fs.open_input_stream(path) as f:
        head = json.loads(f.read())
    shards = spark.createDataFrame([(s["stem"], s["ids_before"], s["crc32"]) for s in head["shards"]], "stem string, ids_before long, crc32 long")
    return shards.repartition(max(1, len(head["shards"]))).mapInPandas(_reader(base, head["width"]), "doc_id long, start long, n_tokens long, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the token files and back."""
    base = store.new_dir(spark, "tokens")
    manifest = write_token_files(store.spark_table(spark, sf_dir, "documents"), base, vocab.vocabulary("byte_bpe_50k.json"))
    return read_token_files(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
