"""Operators on small tables: brute force, round trips, and the hard cases (nulls, empties, ties, repeats, long texts)."""

from __future__ import annotations

import hashlib
import io
import math
import random
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrata.llm import components, decontam, embeddings, html_text, langid, minhash, packing, quality, sharding, shingles, store, tokens, vocab, warc

DOCS = "doc_id long, text string, lang string"
BYTE, WORD = vocab.vocabulary("byte_bpe_50k.json"), vocab.vocabulary("word_bpe_49k.json")
LONG = "word " * 60_000
HARD = [(0, None, None), (1, "", "en"), (2, " \n\t ", "en"), (3, LONG, "en"), (3, LONG, "en"), (None, "no id here", None), (None, None, None), (4, "a b", "fr"), (4, "a c", "fr"), (5, "x" * 50_000, "de"), (6, "nul \x00 and ­ soft  𝒳 日本", "de")]


@pytest.fixture(scope="module")
def hard(spark):
    """Rows of all kinds, with columns whose names clash with results'."""
    rows = [(*r, "s", i, True) for i, r in enumerate(HARD)]
    return spark.createDataFrame(rows, DOCS + ", score string, component_id long, kept boolean")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS + ", score string")


def sentence(draw, words=30, letters="abcdefgh"):
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 6))) for _ in range(words))


# Tokens and packing


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'.,!?*&0123abcXYZéßİı½²­ ‍̈"), st.characters(codec="utf-8")), max_size=60), max_size=8))
def test_chunks_give_the_ids_of_the_whole_text(texts):
    for path in (BYTE, WORD):
        e = vocab.Encoder(path, cache_chunks=20)
        assert list(e.encode_many(texts)) == [e.whole(t) for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_added_tokens_in_a_text_are_the_librarys(path):
    library = Tokenizer.from_file(path)
    contents = [t.content for t in library.get_added_tokens_decoder().values()]
    assert "<|endoftext|>" in contents
    texts = [f"foo{a}{c}{b} bar" for c in contents for a in ("", " ", "x") for b in ("", "\n", "y")] + [c.upper() for c in contents] + ["foo < | endoftext | > bar", "<|endoftext", *contents]
    got = vocab.Encoder(path, cache_chunks=20).encode_many([*texts, *texts[::-1]])
    want = [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in [*texts, *texts[::-1]]]
    assert list(got) == want


def test_vocabularies_that_split_otherwise_get_whole_texts(tmp_path):
    import json

    with open(BYTE) as f:
        spec = json.load(f)
    spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    other = vocab.Encoder(str(path))
    texts = ["It's  a text, with 12 chunks.\n", "", None]
    assert vocab.Encoder(BYTE).by_chunks and vocab.Encoder(WORD).by_chunks and not other.by_chunks
    assert list(other.encode_many(texts)) == [other.whole(t or "") for t in texts]


def test_changed_token_files_are_an_error(spark):
    from pathlib import Path

    manifest = tokens.write_token_files(spark.createDataFrame([(1, "some text"), (2, "more")], "doc_id long, text string"), store.new_dir(spark, "test-tokens"), BYTE)
    assert tokens.read_token_files(spark, manifest).count() == 2
    ids = next(Path(store.local_path(manifest)).parent.glob("*.ids"))
    raw = bytearray(ids.read_bytes())
    raw[0] ^= 1
    ids.write_bytes(raw)
    with pytest.raises(Exception, match="is not what was written"):
        tokens.read_token_files(spark, manifest).count()


@pytest.mark.parametrize("table", ["hard", "empty"])
def test_token_files_round_trip(spark, request, table):
    docs = request.getfixturevalue(table)
    base = store.new_dir(spark, "test-tokens")
    manifest = tokens.write_token_files(docs, base, BYTE, partitions=3)
    got = tokens.read_token_files(spark, manifest).collect()
    rows = HARD if table == "hard" else []
    encode = vocab.encoder(BYTE).whole
    want = sorted(((-1 if i is None else i), encode(t or "") + np.asarray([2], "<u4").tobytes()) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_decreasing_is_what_a_scan_finds(lengths):
    n = np.asarray(lengths, np.int64)
    bins, offsets, used = packing.best_fit_decreasing(n, 64)
    rooms: list[int] = []
    for i in np.argsort(-n, kind="stable"):
        fits = sorted((r, k) for k, r in enumerate(rooms) if r >= n[i])
        if not fits:
            rooms.append(64 - n[i])
        else:
            best = fits[0][0]
            k = next(k for k, r in enumerate(rooms) if r == best)
            rooms[k] -= n[i]
    full = np.bincount(bins, n, used).tolist() if used else []
    assert used == len(rooms) and sorted(full) == sorted(64 - r for r in rooms)
    for b in range(used):
        own = sorted(zip(offsets[bins == b], n[bins == b]))
        assert [o for o, _ in own] == np.concatenate([[0], np.cumsum([k for _, k in own])[:-1]]).tolist()


@pytest.mark.parametrize("table", ["hard", "empty"])
def test_packing_places_every_id_once(request, table):
    docs = request.getfixturevalue(table)
    got = packing.pack_documents(docs, WORD, group_docs=4, with_ids=True).collect()
    rows = HARD if table == "hard" else []
    encode = vocab.encoder(WORD).whole
    whole = sorted(("~" if i is None else str(i), encode(t or "") + np.asarray([2], "<u4").tobytes()) for i, t, _ in rows)
    assert sum(r.length for r in got) == sum(len(w) // 4 for _, w in whole)
    by_sequence: dict[int, list] = {}
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    joined = sorted((("~" if r.doc_id is None else str(r.doc_id)), r.start, bytes(r.ids)) for r in got)
    assert sorted(b"".join(x for i, _, x in joined if i == k) for k in {"0", "1", "5", "6"} if rows) == sorted(b"".join(w for i, w in whole if i == k) for k in {"0", "1", "5", "6"} if rows)


# Sharding


def least_capacity(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, n, at = (lo + hi) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                n, at = n + 1, 0
            at += s
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("seed,docs,hot", [(1, 300, 0), (2, 200, 100), (3, 5, 0)])
def test_shards_are_the_minimax_partition(spark, seed, docs, hot):
    draw = random.Random(seed)
    rows = [(i, sentence(draw, draw.randint(1, 40))) for i in range(docs)] + [(docs + i, "the same text again") for i in range(hot)] + [(9000, None), (9001, ""), (None, None)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups: dict[str, int] = {}
    for _, t in rows:
        name = "" if t is None else hashlib.sha256(t.encode()).hexdigest()
        groups[name] = groups.get(name, 0) + len((t or "").encode()) + 8
    load: dict[int, int] = {}
    slots: dict[int, list] = {}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and max(load.values()) == least_capacity([groups[k] for k in sorted(groups)], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) <= set(range(24))
    texts = dict(r for r in rows if r[0] is not None)
    where: dict = {}
    for r in got:
        if r.doc_id is not None:
            t = texts[r.doc_id]
            assert r.text_crc32 == zlib.crc32((t or "").encode()) and r.size == len((t or "").encode()) + 8
            assert where.setdefault(t, r.shard) == r.shard


def test_intervals_refine_below_the_first_digits(spark):
    rows = [(f"{k // 40:x}" * 3 + f"{k:061x}", 10 + k % 7) for k in range(400)]
    capacity, firsts = sharding.smallest_capacity(spark.createDataFrame(rows, "name string, size long"), 24)
    assert capacity == least_capacity([s for _, s in sorted(rows)], 24) and len(firsts) <= 23


def test_sharding_nothing(empty, hard):
    assert sharding.shard_documents(empty).count() == 0
    assert sharding.shard_documents(hard).count() == len(HARD)


# Near duplicates


def jaccard_components(rows):
    sets = {i: set(shingles.shingle_set(t).tolist()) for i, t in rows}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and find(i) != find(j):
                up[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(draw, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(draw.randint(0, edits)):
            w[draw.randrange(len(w))] = "edit" + str(draw.randrange(10**6))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("hot", [1, 1000])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(minhash, "HOT_CLASSES", hot)
    draw = random.Random(11)
    texts = []
    common = sentence(draw, 60)
    for _ in range(12):
        texts += copies(draw, sentence(draw, draw.randint(20, 120)), draw.randint(1, 9), 4)
    texts += [common + " " + sentence(draw, draw.randint(10, 80)) for _ in range(25)]
    texts += ["", "  ", "one two", "One  TWO", "one two three", "one two"]
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    want = jaccard_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}
    assert len({c for _, c in want.values()}) < len(rows)


def test_links_that_a_star_misses_are_found_in_mixed_buckets():
    """In a bucket whose least class links with nothing, two others link with each other."""
    rng = np.random.default_rng(1)
    minima = shingles.MinWise(minhash.BANDS * minhash.ROWS)
    base = np.unique(rng.integers(0, 2**63, 400, np.uint64))
    other = np.unique(np.concatenate([base[:60], rng.integers(0, 2**63, 340, np.uint64)]))
    near = np.unique(np.concatenate([base[:380], rng.integers(0, 2**63, 20, np.uint64)]))
    frame = pd.DataFrame([{"bucket": 0, "block": 0, "probe_block": 0, "set_key": b"", "band": 0, "main": i == 0, "node": i, "component": i, "shingles": s.astype("<u8").tobytes(), "signature": minima(s).tobytes(), "probe": p} for p in (False, True) for i, s in enumerate((other, base, near)) if not p or i])
    first = int(np.argmax((minima(base) == minima(near)).reshape(minhash.BANDS, minhash.ROWS).all(axis=1)))
    for band in range(minhash.BANDS):  # a pair is seen in the first band that it shares
        near = minhash._agreeing(frame.assign(band=band))
        assert sorted(zip(near["node"], near["probe"])) == ([(1, True), (2, False)] if band == first else [])
        got = minhash._cross(frame.assign(band=band))
        assert sorted(map(tuple, minhash._cross(near).to_numpy().tolist())) == sorted(map(tuple, got.to_numpy().tolist()))
        assert ({tuple(sorted(x)) for x in got.to_numpy().tolist()} == {(1, 2)}) == (band == first)
    got = minhash._cross(frame.assign(band=first))
    assert {tuple(sorted(x)) for x in got.to_numpy().tolist()} == {(1, 2)}


def test_near_duplicates_of_hard_rows(hard, empty):
    got = minhash.near_duplicates(hard).collect()
    assert len(got) == len(HARD) and all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in got if r.doc_id in (0, 1, 2))
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_one_of_each(hard)
    left = [r.doc_id for r in kept.collect()]
    assert kept.columns == hard.columns and sorted(i for i in left if i is not None) == [0, 1, 2, 3, 4, 4, 5, 6] and left.count(None) == 2
    assert minhash.keep_one_of_each(empty).count() == 0


def test_rows_that_share_an_id_are_told_apart_by_their_texts(spark):
    draw = random.Random(3)
    a, b, c = (sentence(draw, 60) for _ in range(3))
    near = a.rsplit(" ", 1)[0]
    rows = [(1, a, 0), (1, b, 1), (1, a, 2), (1, near, 3), (2, a, 4), (2, c, 5), (2, c, 6), (None, a, 7), (None, a, 8), (3, "", 9), (3, "", 10), (3, None, 11), (0, c, 12), (4, near, 13)] + [(5, b.upper(), 14 + k) for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, key int").selectExpr("*", "map('a', key) AS h1", "key AS part", "struct(key) AS `order`")
    got = {r.key: r for r in minhash.keep_one_of_each(table).collect()}
    assert {7, 8, 9, 10, 11, 1, 12} <= set(got) and len(got) == 8 and len(set(got) & {0, 2, 3}) == 1
    assert all(r.doc_id == rows[k][0] and r.text == rows[k][1] and r.h1 == {"a": k} and r.part == k and r.order.key == k for k, r in got.items())
    marks = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(table).collect() if r.doc_id is not None)
    assert marks == sorted([(1, 1)] * 4 + [(2, 1), (2, 0), (2, 0), (3, 3), (3, 3), (3, 3), (0, 0), (4, 1)] + [(5, 1)] * 300)


def test_components_by_stars(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(draw.randrange(200, 260), draw.randrange(200, 260)) for _ in range(50)] + [(7, 7), (None, 3)]
    up = {i: i for e in edges if None not in e for i in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and find(a) != find(b):
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in up if any(i in e and e[0] != e[1] for e in edges if None not in e)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# Vectors


def vector_rows():
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.normal(size=8)
            for _ in range(rng.integers(1, 7)):
                rows.append((k, (centre + rng.normal(size=8) * 0.06).astype(np.float32).tolist(), label))
                k += 1
    rows += [(k, rows[0][1], 0), (k + 1, rows[0][1], 0), (k + 2, [0.0] * 8, 0), (k + 3, None, 0), (k + 4, [], 0), (k + 5, [1.0, None] + [0.0] * 6, 0), (k + 6, [float("nan")] + [1.0] * 7, 0), (k + 7, [float("inf")] + [1.0] * 7, 0), (k + 8, [1.0, 2.0], 0), (k + 9, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    return rows


@pytest.mark.parametrize("block", [4, 1024])
def test_vectors_equal_brute_force(spark, block):
    rows = vector_rows()
    up = {i: i for i, _, _ in rows if i is not None}
    links = dict.fromkeys(up, 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def sound(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    for a, (i, x, p) in enumerate(rows):
        for j, y, q in rows[a + 1 :]:
            if i is None or j is None or p is None or p != q or not sound(x) or not sound(y) or len(x) != len(y):
                continue
            u, v = np.asarray(x, np.float64), np.asarray(y, np.float64)
            if u @ v / (math.sqrt(u @ u) * math.sqrt(v @ v)) >= 0.98:
                links[i] += 1
                links[j] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicate_vectors(table, block=block).collect()}
    assert got == {i: (links[i], find(i), i == find(i)) for i in up} | {None: (0, None, True)}
    assert sum(links.values()) > 20


def test_doubles_are_compared_as_stored(spark):
    rows = [(1, [1e-60, 0.0], 0), (2, [1e-60, 1e-61], 0), (3, [1e-60, 1e-60], 0), (4, [1e-300, 1e-310], 0), (5, [0.0, 1e300], 0), (6, [1e290, 1e300], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS n", "2 AS dim", "3 AS block")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicate_vectors(table).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1), 5: (1, 5), 6: (1, 5)}


def test_vectors_that_share_an_id_are_told_apart(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (3, [0.0, 1.0], 1), (4, [0.0, 1.0], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 0, 3), (3, 2, 1), (4, 2, 1)]


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, n_links string")
    assert embeddings.near_duplicate_vectors(none).count() == 0


# WARC


def test_reader_finds_each_record_once_for_any_ranges():
    draw = random.Random(3)
    inner = b"".join(warc.member(warc.record(i, "u", b"nested", None)) for i in range(3))
    payloads = [b"", b"<p>x</p>", bytes(draw.randrange(256) for _ in range(5000)), inner, b"\x1f\x8b\x08" * 50, inner * 4]
    raw, starts = b"", []
    for i, p in enumerate(payloads):
        starts.append(len(raw))
        raw += warc.member(warc.record(i, f"http://a/{i}\r\nX: y", p, None))
    for width in (1, 37, 900, len(raw)):
        if width == 1 and len(raw) > 60_000:
            continue
        got = [(h["warc-record-id"], body) for lo in range(0, len(raw), width) for h, body in warc.records_in(io.BytesIO(raw), lo, min(lo + width, len(raw)), len(raw))]
        assert got == [(f"<urn:page:{i}>", p) for i, p in enumerate(payloads)]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records_in(io.BytesIO(raw[:-5]), 0, len(raw) - 5, len(raw) - 5))


def test_archives_round_trip(spark):
    rows = [(1, "http://a/1", "same"), (2, None, "same"), (7, "u", None), (8, "u", ""), (9, "u", "é" * 100_000), (None, "u", "same"), (5, "u", "own"), (5, "u", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_warc(pages, store.new_dir(spark, "test-warc"))
    got = sorted(((-1 if r.page_id is None else r.page_id), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_warc(archives, range_bytes=64).collect())
    digest = lambda t: warc.payload_digest((t or "").encode())
    want = [(-1, "response", None, 4, digest("same")), (1, "revisit", 2, 4, digest("same")), (2, "response", None, 4, digest("same")), (5, "response", None, 3, digest("own")), (5, "response", None, 3, digest("own")), (7, "revisit", 8, 0, digest("")), (8, "response", None, 0, digest("")), (9, "response", None, 200_000, digest("é" * 100_000))]
    assert got == want
    wide = pages.selectExpr("*", "'x' AS refers_to", "1 AS same", "2 AS last", "3 AS size", "4 AS lane", "5 AS n")
    planned = [sorted(map(str, warc.plan_revisits(t, broadcast_rows=b).collect())) for t in (pages, wide) for b in (0, 100)]
    assert planned[1:] == planned[:1] * 3 and len(planned[0]) == len(rows)
    small = warc.write_warc(wide, store.new_dir(spark, "test-warc"), archive_bytes=1)
    assert small.where("records > 0").count() == len(rows)
    for width in (1, 64):  # a task per range, however small
        some = store.materialize(small.where("records > 0").orderBy("bytes").limit(1), "test-small") if width == 1 else small
        back = warc.read_warc(some, range_bytes=width).coalesce(8).select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
        assert {((-1 if r.page_id is None else r.page_id), *tuple(r)[1:]) for r in back.collect()} <= set(want) and back.count() == some.agg({"records": "sum"}).first()[0]
    none = warc.write_warc(pages.where("false"), store.new_dir(spark, "test-warc"))
    assert warc.read_warc(none).count() == 0


def test_headers_of_any_length_are_read(spark):
    draw = random.Random(5)
    urls = ["http://a/" + "".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=k)) for k in (3_500_000, 10, 1_100_000)] + ["data:," + "x" * 3_000_000]
    raw = b"".join(warc.member(warc.record(i, u, b"body", None)) for i, u in enumerate(urls))
    for width in (700_000, len(raw)):
        got = [(h["warc-target-uri"], body) for lo in range(0, len(raw), width) for h, body in warc.records_in(io.BytesIO(raw), lo, min(lo + width, len(raw)), len(raw))]
        assert got == [(u, b"body") for u in urls]
    pages = spark.createDataFrame([(i, u, "same") for i, u in enumerate(urls)], "page_id long, url string, html string")
    archives = warc.write_warc(pages, store.new_dir(spark, "test-warc"))
    assert warc.all_of(warc.read_warc(archives).select("page_id", "refers_to"), archives).count() == len(urls)
    with pytest.raises(ValueError, match="3 records were read of archives of 4"):
        warc.all_of(warc.read_warc(archives).where("page_id > 0").select("page_id"), archives)


# Pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no";</script></head><body>
<nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>gone</p> --><div class=ad>Buy</div>
<main><article><h1>Title &amp; more</h1><p>One&nbsp;two
 three<br>four<p><b>Five &lt;x&gt;</b> <a href="a>b">six</a><aside>Related</aside><form>Name <input></form><p>Five &lt;x&gt; six</p></article>
<section id="comments"><p>First!</p></section></main><footer>(c)</footer></body></html>"""


def test_article_without_its_surroundings():
    lines = html_text.lines_of(PAGE)
    assert html_text.main_text(lines, set()) == "Title & more\nOne two three four\nFive <x> six\nFive <x> six"
    assert html_text.lines_of(None) == [] and html_text.main_text([], set()) == ""
    assert html_text.main_text(html_text.lines_of("plain &amp text"), set()) == "plain & text"
    text = lambda page, shared=None: html_text.main_text(html_text.lines_of(page), shared)
    assert text("<article><p>A <a title=it's>x</a> b</p>") == "A x b" and text('<p title="a>b</p><p>next</p> <b') == "b\nnext"
    assert text("<article><header class=page-header><h1>Headline</h1></header><p>body</p></article><header>no</header>") == "Headline\nbody"
    assert text('<main><div class="search-results">found</div></main>') == "found" and text("a < b </ c > d <!-- e > f") == "a < b d"
    # What is outside the article is decided by differencing, if there is a page to compare with.
    page = "<div>intro</div><article>story</article><div>shared</div>"
    assert text(page) == "story" and text(page, {2}) == "intro\nstory" and text(page, {1, 2}) == "intro\nstory"


@pytest.mark.parametrize("page", ["<b>" * 30_000 + "</i>" * 30_000, '<a "' * 30_000, '<a ="' * 30_000, "<p>x" + "<a title=it's>y</a>" * 30_000, "<div>" + "<b>" * 30_000 + "<p>x</p>" * 30_000, "<!--" * 30_000, "<script>" * 30_000])
def test_broken_pages_take_linear_time(page):
    began = time.time()
    html_text.lines_of(page)
    assert time.time() - began < 2


@pytest.mark.parametrize("a,b,n", [(["x"] * 100_000, ["x"] * 90_000, 90_000), (["a"] + ["x"] * 100_000, ["x"] * 100_000 + ["b"], 100_000), (list(map(str, range(100_000))), list(map(str, range(7, 100_007))), 99_993)])
def test_long_pages_are_aligned(a, b, n):
    began = time.time()
    assert len(html_text.shared_lines(a, b)) == n and time.time() - began < 5


@pytest.mark.parametrize(
    "kept",
    [
        '<p style="overflow:hidden">kept</p>',
        '<p><a href="/hidden-gems" title=\'the hidden cost\'>kept</a></p>',
        '<p data-id="search" data-class=ad data-role="navigation">kept</p>',
        '<div class="wrapper header-fixed no-sidebar with_nav"><p>kept</p></div>',
        '<article class="post has-comments share">kept</article>',
        '<main id=content-search>kept</main>',
        '<p><svg width="1"/><math />kept</p>',
    ],
)
def test_names_and_values_that_leave_nothing_out(kept):
    page = f'<html class="search"><body class="no-sidebar menu">{kept}</body></html>'
    assert html_text.main_text(html_text.lines_of(page), set()) == "kept"


@pytest.mark.parametrize("attribute", ["hidden", "HIDDEN=''", "aria-hidden='true'", "role=navigation", "id=comments", 'class="x cookie-notice"', "class='sidebar-left'", "class=ad_slot_2", 'title="a" class="side-bar"', "class=main-nav"])
def test_names_that_leave_out(attribute):
    assert html_text.main_text(html_text.lines_of(f"<p>kept</p><div {attribute}><p>gone</p></div>"), set()) == "kept"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14), st.sampled_from([1, 1 << 40]))
def test_shared_lines_are_a_longest_common_subsequence(a, b, held):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(html_text, "ALIGN_BYTES", held)
        check_alignment(a, b)


def check_alignment(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    got = html_text.shared_lines(a, b)
    assert len(got) == t[len(a)][len(b)]
    it = iter(b)
    assert all(a[i] in it for i in sorted(got))


def test_pages_without_an_article_lose_what_their_neighbour_shares(spark):
    page = lambda own: f"<div>Site name</div><p>{own}</p><div>All rights</div>"
    rows = [(1, "http://h/a/1", page("first own")), (2, "http://h/a/2", page("second own")), (3, "http://other/z", page("alone")), (4, None, None), (5, "http://copies/a/2", PAGE), (6, "http://copies/a/2", PAGE)]
    got = {r.page_id: r for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "first own" and got[2].text == "second own" and got[3].text == "Site name\nalone\nAll rights"
    assert got[4].text == "" and got[4].n_chars == 0 and got[5].text == got[6].text and got[5].text.startswith("Title & more") and got[5].n_shared > 0
    assert html_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string, text int")).count() == 0


def test_copies_do_not_delete_each_other(spark):
    page = lambda *own: "<div>Site name</div>" + "".join(f"<p>{x}</p>" for x in own) + "<div>All rights</div>"
    story = [f"paragraph {k} of a story that is told at some length" for k in range(8)]
    near = lambda k: page(*story[:k], f"another paragraph in place of number {k}", *story[k + 1 :])
    rows = [(k, f"http://only/{k}", page(*story)) for k in range(3)] + [(10 + k, f"http://near/{k}", near(k)) for k in range(8)]
    rows += [(20 + k, f"http://beside/a/{k}", page(*story)) for k in range(5)] + [(30, "http://beside/b", page("quite another story", *map(str, range(100, 130))))]
    got = {r.page_id: r.text for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = lambda lines: "\n".join(["Site name", *lines, "All rights"])
    assert all(got[k] == whole(story) for k in range(3))
    assert all(got[10 + k].split("\n")[1 + j] == story[j] for k in range(8) for j in range(8) if j != k)
    assert all(got[20 + k] == "\n".join(story) for k in range(5)) and got[30].startswith("quite another story\n100")


def test_pairing_equals_brute_force(spark):
    """Pages of three hosts: every unmarked line is kept unless an alignment with a near page that is no copy holds it."""
    draw = random.Random(12)
    pages = []
    for k in range(120):
        own = [f"line {draw.randrange(10**6)} of its own" for _ in range(draw.randint(1, 6))]
        lines = ["site", *(["promoted"] if draw.random() < 0.5 else []), *own, *(["tail"] if draw.random() < 0.7 else [])]
        if pages and draw.random() < 0.3:
            lines = [*draw.choice(pages)[2]]
            if draw.random() < 0.5:
                lines[-1] = "changed"
        pages.append((k, f"http://h{draw.randrange(3)}/{draw.randrange(9)}/{draw.randrange(30)}", lines))

    def copied(a, b):
        return sum(len(x) * min(a.count(x), b.count(x)) for x in set(a)) >= html_text.COPY_SHARE * sum(map(len, a)) > 0

    want = {}
    for host in range(3):
        own = sorted((u, k, lines) for k, u, lines in pages if u.startswith(f"http://h{host}/"))
        first = []
        for i, (_, _, lines) in enumerate(own):
            if not first or not copied(lines, own[first[-1]][2]):
                first.append(i)
        for i, (_, k, lines) in enumerate(own):
            run = max(j for j, at in enumerate(first) if at <= i)
            near = ([i - 1, i - 2, *(at - 1 for at in first[run::-1])], [i + 1, i + 2, *first[run + 1 :]])
            others = [x for side in near for x in [own[j][2] for j in dict.fromkeys(side) if 0 <= j < len(own) and not copied(lines, own[j][2])][: html_text.SIDES]]
            gone = {j for b in others for j in html_text.shared_lines(lines, b)}
            want[k] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    rows = [(k, u, "".join(f"<p>{x}</p>" for x in lines), "x") for k, u, lines in pages]
    got = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumn("path", F.lit(1))).collect()
    assert {r.page_id: r.text for r in got} == want and sum("site" in t for t in want.values()) < 10


# Decontamination


def test_search_equals_full_scoring():
    draw = random.Random(6)
    items = [(i, sentence(draw, draw.randint(5, 40), "abc")) for i in range(150)]
    bags = [decontam.words(t) for _, t in items]
    df: dict[str, int] = {}
    for b in bags:
        for w in set(b):
            df[w] = df.get(w, 0) + 1
    index = decontam.Index(items, df, len(items), sum(map(len, bags)) / len(bags))
    for least in (0.2, 0.5, 0.9):
        for _ in range(40):
            q = sorted({index.term[w] for w in decontam.words(draw.choice(items)[1] + " " + sentence(draw, 20, "abc")) if w in index.term})
            want = {}
            for t in q:
                for d, x in zip(index.items[t], index.impacts[t]):
                    want[d] = want.get(d, 0) + x
            got = dict(index.search(q, least))
            assert set(got) == {d for d, s in want.items() if s >= least - 1e-9} and all(abs(got[d] - want[d]) < 1e-9 for d in got)


def test_contained_items_are_found_and_nothing_else(spark):
    draw = random.Random(8)
    items = [(i, sentence(draw, draw.randint(8, 60)) + ". " + sentence(draw, draw.randint(1, 9)) + ".") for i in range(40)] + [(90, None), (91, ""), (None, "x y z"), (92, "two words")]
    docs, want = [], set()
    for d in range(60):
        text = sentence(draw, draw.randint(0, 300))
        if d % 3 == 0:
            i = draw.randrange(40)
            w = items[i][1].split()
            if d % 2:
                w[draw.randrange(len(w))] = "edited"
            text = f"{text} {' '.join(w).upper() if d % 4 == 0 else ' '.join(w)} {sentence(draw, draw.randint(0, 200))}"
        docs.append((d, text, None))
    docs += [(100, None, None), (101, "", None), (102, LONG + items[0][1], None), (None, items[1][1], None), (103, "has two words in it", None)]
    table = spark.createDataFrame(docs, DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for d, t, _ in docs:
        whole = decontam.shingles(decontam.words(t))
        text = f" {' '.join(decontam.words(t))} "
        for i, it in items:
            own = decontam.shingles(decontam.words(it))
            if i is not None and own and sum((g in whole) if len(g) == 5 else f" {' '.join(g)} " in text for g in own) >= 0.75 * len(own):
                want.add((d, i))
    got = decontam.find_contamination(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 10
    clean = decontam.without_contamination(table, bench)
    assert clean.columns == table.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _, _ in docs if d not in {x for x, _ in want})
    assert decontam.find_contamination(table, bench.where("false")).count() == 0


def test_indexes_in_blocks_find_the_same(spark):
    draw = random.Random(9)
    items = [(i, sentence(draw, 20)) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = " ".join(t for _, t in items[::3])
    table = spark.createDataFrame([(1, text, "x"), (2, "none of it", "y"), (3, None, "z"), (1, text, "w")], "doc_id long, text string, score string")
    some = [sorted(map(str, decontam.find_contamination(table, bench, n).collect())) for n in (100, 1 << 20)]
    assert some[0] == some[1] and len(some[0]) == 20
    assert [sorted(r.score for r in decontam.without_contamination(table, bench, n).collect()) for n in (100, 1 << 20)] == [["y", "z"]] * 2
    hits = lambda n: sorted(h[0] for index in decontam.build_indexes(bench, n) for h in index.hits(text))
    assert hits(500) == hits(1 << 20) == [i for i, _ in items[::3]]


# Language and quality


def code_length(text, texts, order):
    """By brute force: the whole text's bits under counts of ``texts``."""
    counts: dict[bytes, dict[int, int]] = {}
    for t in texts:
        s = b" " * order + langid.encoded(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts.setdefault(s[i - k : i], {}).setdefault(s[i], 0)
                counts[s[i - k : i]][s[i]] += 1
    s, total = b" " * order + langid.encoded(text), 0.0
    for i in range(order, len(s)):
        for k in range(order, -1, -1):
            c = counts.get(s[i - k : i], {})
            n, d = sum(c.values()), len(c)
            if s[i] in c:
                total += math.log2((n + d) / c[s[i]])
                break
            total += math.log2((n + d) / d) if c else 0
        else:
            total += 8
    return total


@pytest.mark.parametrize("order", [1, 2, 5, 7])
def test_code_lengths_are_those_of_the_trees(order):
    texts = {"a": ["the cat sat on the mat", "that hat", ""], "b": ["le chat est sur le tapis", "été\n été"], "c": ["x"]}
    trees = langid.Trees(texts, order)
    judge = langid.Scorer(trees)
    judge.shift, judge.keys, judge.rows = np.uint64(62), judge.keys[:4], judge.rows[:4]  # a table that nearly every window fights for
    asked = ["the", "le chat  sat\ton the\r\nmat", "qqq", "ÉTÉ \U0001d4b3", "", "x", " x", "the hat est sur that chat " * 20]
    for _ in range(2):
        for t, row in zip(asked, judge.lengths([langid.encoded(t) for t in asked]), strict=True):
            assert row == pytest.approx([code_length(t, texts[lang], order) for lang in "abc"], rel=1e-5)
    for t, got in zip(asked, judge.texts(asked), strict=True):
        want = [code_length(t, texts[lang], order) for lang in "abc"]
        assert got[0] == ("abc"[int(np.argmin(want))] if t else "und")
    of, bits, n, _ = judge.words([langid.encoded(t) for t in asked])
    for k, t in enumerate(asked):
        assert n[of == k].sum() == len(langid.encoded(t)) and bits[of == k].sum(axis=0) == pytest.approx([code_length(t, texts[lang], order) for lang in "abc"], rel=1e-5)
    assert [g[:2] for g in judge.texts(asked, bounded=True)] == [(a, pytest.approx(b)) for a, b, _ in judge.texts(asked)]


def test_words_that_say_something_of_a_language():
    judge = langid.Scorer(langid.Trees({"a": ["abc"]}))
    asked = ["  lead it's a1 a--b -a é 12 --- x", "", "\n", "end-", "a-b\n\nc"]
    of, _, n, telling = judge.words([langid.encoded(t) for t in asked])
    assert n.tolist() == [2, 5, 5, 3, 5, 3, 3, 3, 4, 1, 1, 4, 5, 1] and of.tolist() == [0] * 10 + [2, 3, 4, 4]
    assert telling.tolist() == [False, True, True, False, False, True, True, False, False, True, False, True, True, True]


def test_ties_go_to_the_first_language():
    judge = langid.Scorer(langid.Trees({"b": ["same words"], "a": ["same words"]}))
    got = list(judge.texts(["same words", "zzz", None, "12 34", "same"]))
    assert [g[0] for g in got] == ["a", "a", "und", "und", "a"] and [g[1] for g in got] == [0.5, 0.5, 0, 0, 0.5]


def test_languages_on_hard_rows(spark, hard, empty):
    trees = langid.train(hard)
    got = langid.identify(hard, trees).collect()
    assert len(got) == len(HARD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (0, 1, 2)) and all(r.held_out for r in got if r.doc_id is None)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    none = langid.train(empty)
    assert langid.identify(empty, none).count() == 0 and {r.lang_pred for r in langid.identify(hard, none).collect()} == {"und"}
    assert langid.keep_identified(hard, trees).columns == hard.columns


def test_held_out_languages_are_predicted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, good = got.count(), got.where("lang = lang_pred").count()
    assert n > 20 and good >= 0.95 * n


FOREIGN = {
    "ru": "Москва является столицей России и крупнейшим городом страны по численности населения",
    "ja": "東京は日本の首都であり世界最大の都市の一つです。人口は約千四百万人です。",
    "pl": "Warszawa jest stolicą Polski i największym miastem w kraju położonym nad Wisłą w środkowej części",
    "tr": "İstanbul Türkiye'nin en kalabalık şehridir ve ülkenin ekonomik ve kültürel merkezi olarak bilinir",
    "el": "Η Αθήνα είναι η πρωτεύουσα της Ελλάδας και η μεγαλύτερη πόλη της χώρας",
    "none": "xkq zrtv bdfg qwrtp mnbvc lkjhg zxcvb qwrty plkmn bhgvf trdcx zsqwx vbnmk plkjh",
}


@pytest.mark.parametrize("languages", [2, 4])
def test_texts_in_no_learned_language_are_rejected(spark, languages):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1"), "doc_id")
    docs = docs.select("doc_id", "text", "lang").where("lang in ('en', 'de')" if languages == 2 else "lang is not null")
    trees = langid.train(docs)
    own = {r.lang: r.text for r in docs.where("length(text) between 300 and 3000").collect()}
    assert len(own) == languages
    mixed = [f"{a} {b}" for a in own.values() for b in own.values()]
    clean = [r.text for r in docs.where(langid.held_out(docs.doc_id)).collect()]
    rows = [(k, t) for k, t in enumerate([*mixed, *clean, *FOREIGN.values(), *(" ".join(t.split()[:4]) for t in FOREIGN.values())])]
    kept = {r.doc_id for r in langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string"), trees).collect()}
    assert kept == set(range(len(mixed) + len(clean))) and len(clean) > 20


def test_quality_follows_the_labels_it_never_saw(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.features(docs)
    model = quality.train(rows)
    got = quality.score(rows, model).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    n, good = got.count(), got.where("kept = (quality = 1)").count()
    assert n > 300 and good >= 0.97 * n and min(model.labels.accuracies().values()) >= 0.5
    kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    assert kept == {r.doc_id for r in quality.score(rows, model).where("kept").collect()}


def naive_em(documents, rounds):
    """Expectation-maximisation document by document, with plain sums."""
    k = len(quality.LABELLERS)
    good = [1 / (1 + math.exp(-12 * (sum(v == quality.GOOD for v in d) - 2 * sum(v == quality.BAD for v in d)) / k)) for d in documents]
    for _ in range(rounds):
        prior = min(max(sum(good) / len(good), 1e-6), 1 - 1e-6)
        chance = []
        for weights in ([1 - g for g in good], good):
            own = []
            for j in range(k):
                n = [1 + sum(w for w, d in zip(weights, documents) if d[j] == v) for v in (quality.BAD, quality.NONE, quality.GOOD)]
                own.append([x / sum(n) for x in n])
            chance.append(own)
        for own in chance[1]:
            if own[0] > quality.MOST_FALSE_FAULTS:
                rest = (1 - quality.MOST_FALSE_FAULTS) / (own[1] + own[2])
                own[:] = [quality.MOST_FALSE_FAULTS, own[1] * rest, own[2] * rest]
        good = []
        for d in documents:
            yes, no = prior, 1 - prior
            for j, v in enumerate(d):
                if v != quality.UNSEEN:
                    yes, no = yes * chance[1][j][v], no * chance[0][j][v]
            good.append(yes / (yes + no))
    return good, chance


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_expectation_maximisation_equals_brute_force(seed):
    draw = random.Random(seed)
    documents = []
    for _ in range(400):
        bad = draw.random() < 0.3
        documents.append([draw.choices(range(4), (0.4, 0.4, 0.1, 0.1) if bad else (0.03, 0.6, 0.3, 0.07))[0] for _ in quality.LABELLERS])
    documents += [[quality.UNSEEN] * len(quality.LABELLERS)] * 5
    patterns, back, counts = np.unique([quality.pattern(d) for d in documents], return_inverse=True, return_counts=True)
    for rounds in (1, 7):
        got = quality.WeakLabels(patterns, counts, rounds)
        want, chance = naive_em(documents, rounds)
        assert [got.by_pattern[p] for p in patterns[back].tolist()] == pytest.approx(want, abs=1e-9)
        assert got.chance[:, :3].sum(axis=1) == pytest.approx(1) and got.chance[1, quality.BAD].max() <= quality.MOST_FALSE_FAULTS
        assert np.moveaxis(got.chance[:, :3], 1, 2) == pytest.approx(np.asarray(chance))
    assert sorted(quality.votes_of(patterns).tolist()) == sorted(set(map(tuple, documents)) and [list(d) for d in set(map(tuple, documents))])


def test_the_sample_is_that_of_least_hash(spark):
    rows = [(i % 5000 if i < 6000 else 3, i % 2 if i < 6000 else 1, [i % 2], [1.0]) for i in range(9000)] + [(None, 0, [0], [1.0])]
    table = spark.createDataFrame(rows, "doc_id long, pattern long, buckets array<int>, weights array<float>").where("doc_id is not null")
    ids = [r.doc_id for r in table.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(60).collect()]
    for n in (1, 50, 20_000):
        got = [(r.doc_id, r.pattern) for r in quality._sample(table, n)]
        assert len(got) == min(n, table.select("doc_id", "pattern").distinct().count()) and len(set(got)) == len(got)
        assert n > 50 or list(dict.fromkeys(i for i, _ in got)) == ids[: len({i for i, _ in got})]
    assert quality._sample(table.where("false"), 5) == []


def test_quality_of_hard_rows(hard, empty):
    rows = quality.features(hard)
    got = quality.score(rows, quality.train(rows)).collect()
    assert len(got) == len(HARD) and all(not r.kept for r in got if r.doc_id in (0, 1, 2))
    assert quality.keep_good(hard, quality.train(rows)).columns == hard.columns
    none = quality.features(empty)
    assert quality.score(none, quality.train(none)).count() == 0


# The pipeline and the SQL twins


def test_pipeline_on_a_small_table(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    step, columns = docs, docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        step = store.materialize(stage(spark, step, sf), "test-stage")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert step.columns == columns and 0 < step.count() <= docs.count()
            docs_left = {r.doc_id for r in step.select("doc_id").collect()}
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, step.collect())) and {r.doc_id for r in step.collect()} == docs_left


def test_pipeline_on_hard_rows(spark, hard, empty):
    import corpus_pipeline

    for table in (hard, empty):
        step = table
        for _, stage in corpus_pipeline.STAGES:
            step = store.materialize(stage(spark, step, "/root/testdata/sf0.001"), "test-stage")
        assert step.count() >= 0


@pytest.mark.parametrize("name", ["op5_warc", "op8_embedding_dedup", "op9_minhash", "op11_mixing", "op12_phrases", "op13_vector_codes"])
def test_queries_equal_their_sql(spark, name):
    from lodestrata.llm import entries

    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = entries.queries()[name](spark, sf)
    want = c.execute(entries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))
