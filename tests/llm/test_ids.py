"""Ids of 64 bits beside null ids, in one batch: no operator may change one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import decontam, html_text, langid, minhash, packing, quality, sharding, store, tokens, vocab, warc

A, B, C = 9007199254740993, 9007199254740995, -9223372036854775807
IDS = [A, None, B, C, None]


def words(k, n=60):
    draw = random.Random(k)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    one = words(1)
    texts = [one, words(2), one.rsplit(" ", 1)[0] + " other", words(3), one]
    return spark.createDataFrame([(i, t, "en") for i, t in zip(IDS, texts, strict=True)], "doc_id long, text string, lang string").coalesce(1)


@pytest.fixture(scope="module")
def pages(spark):
    html = ["<article><p>one</p></article>", "<p>x</p>", "<article><p>one</p></article>", "<p>y</p>", "<p>z</p>"]
    return spark.createDataFrame([(i, f"http://h/{k}", h) for k, (i, h) in enumerate(zip(IDS, html, strict=True))], "page_id long, url string, html string").coalesce(1)


def ids(df, column="doc_id"):
    return sorted(str(r[column]) for r in df.collect())


WANT = sorted(map(str, IDS))


def test_quality(docs):
    rows = quality.features(docs)
    assert ids(rows) == WANT and ids(quality.score(rows.coalesce(1), quality.train(rows))) == WANT


def test_packing(docs):
    assert ids(packing.pack_documents(docs, vocab.vocabulary("word_bpe_49k.json")).select("doc_id").distinct()) == sorted({*WANT})


def test_text(pages):
    assert ids(html_text.extract_main_text(pages), "page_id") == WANT


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, words(1)), (2, words(2))], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_contamination(docs, items).collect()}
    assert {(A, 1), (B, 1), (None, 1), (None, 2)} == found


def test_warc(spark, pages):
    archives = warc.write_warc(pages, store.new_dir(spark, "warc"))
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.read_warc(archives).collect()}
    assert got == {(A, "revisit", B), (B, "response", None), (C, "response", None), (None, "response", None)}


def test_token_files(spark, docs):
    manifest = tokens.write_token_files(docs, store.new_dir(spark, "tokens"), vocab.vocabulary("byte_bpe_50k.json"), partitions=1)
    assert ids(tokens.read_token_files(spark, manifest)) == WANT


def test_languages(docs):
    assert ids(langid.identify(docs, langid.train(docs))) == WANT


def test_near_duplicates_and_their_stage(spark, docs):
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(A, A, True), (B, A, False), (C, C, True), (None, None, True)}
    assert ids(corpus_pipeline.near_duplicate_stage(spark, docs, "")) == sorted(x for x in WANT if x != str(B))


def test_sharding(docs):
    assert ids(sharding.shard_documents(docs)) == WANT


def test_frames_keep_what_they_are_given(spark):
    rows = [(A, None, None, [1, 2], True, "x", 1.5, b"\x00"), (None, 2, 3.5, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a long, b int, c double, d array<int>, e boolean, f string, g float, h binary").coalesce(1)
    same = store.map_frames(df, lambda frames: frames, "a long, b int, c double, d array<int>, e boolean, f string, g float, h binary")
    assert [tuple(r) for r in same.collect()] == [tuple(r) for r in df.collect()]
    grouped = store.map_groups(df.withColumn("k", F.lit(1)), "k", lambda key, frame: frame.drop(columns="k"), "a long, b int, c double, e boolean, f string")
    assert sorted(map(str, (tuple(r) for r in grouped.collect()))) == sorted(map(str, (tuple(r) for r in df.select("a", "b", "c", "e", "f").collect())))
