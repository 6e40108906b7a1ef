"""Mixing, phrases and vector codes: brute force, and the hard cases (nulls, empties, ties, repeats, long texts, large ids)."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import keyed, mixing, ordered, phrases, vector_codes

BIG = 9007199254740993
DOCS = "doc_id long, text string, lang string, source string"
HARD = [(0, None, None, None), (1, "", "en", "a"), (2, " \n\t ", "en", "a"), (3, "word " * 60_000, "en", "b"), (3, "word " * 60_000, "en", "b"), (None, "no id here", None, None), (None, None, None, "z"), (BIG, "a b", "fr", "é"), (BIG + 2, "a c", "fr", "é"), (5, "x" * 50_000, "de", "")]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(*r, "s", i, True) for i, r in enumerate(HARD)]
    return spark.createDataFrame(rows, DOCS + ", score string, size long, slot boolean")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS + ", score string")


# Mixing


def naive_targets(words: dict, weights=(3, 1, 2), share=Fraction(3, 2), passes=2) -> dict:
    """Deal the share out by weight; who is above its limit gives that, the excess goes to the rest by weight; again."""
    names = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(words.values())
    while open_:
        per = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if per * weight[s] > passes * words[s]}
        if not above:
            target |= {s: per * weight[s] for s in open_}
            break
        for s in above:
            target[s] = Fraction(passes * words[s])
            left -= target[s]
        open_ -= above
    return target


def check_mix(spark, docs, block):
    rows, mixed = mixing.mix(docs, block=block)
    rows, mixed = [r.asDict() for r in rows.collect()], [r.asDict() for r in mixed.collect()]
    source_of = {r["row"]: r["source"] for r in rows}
    words = Counter()
    for r in rows:
        words[r["source"]] += r["size"]
    target = naive_targets(words)
    taken, held, slots = Counter(), defaultdict(list), defaultdict(int)
    for m in mixed:
        taken[source_of[m["row"]]] += m["words"]
        held[m["row"], m["pass"]].append((m["first"], m["words"]))
        slots[m["slot"]] += m["words"]
    for r in rows:
        assert r["source_size"] == words[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-12, abs_tol=1e-9)
        assert sum(n for p in range(2) for _, n in held[r["row"], p]) <= 2 * r["size"]
    for s, t in target.items():
        assert taken[s] == math.floor(t)
    for (row, _), spans in held.items():  # no word twice in a pass
        at = 0
        for first, n in sorted(spans):
            assert first == at and n > 0
            at += n
    assert all(n <= block for n in slots.values()) and len({source_of[m["row"]] for m in mixed}) == sum(t >= 1 for t in target.values())
    return rows, mixed, source_of


@pytest.mark.parametrize("block", [1, 7, 64])
def test_mixes_hold_their_targets_to_the_word(spark, block):
    draw = random.Random(block)
    rows = [(i, " ".join(["w"] * draw.choice([0, 1, 3, 40, 200])), "en", draw.choice(["a", "b", None, "long tail", "é", "a" * 40])) for i in range(120)]
    rows += [(i + 1000, " ".join(["w"] * 30), "en", "hot") for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS)
    check_mix(spark, docs.repartition(3), block)


def test_every_stretch_of_the_mix_is_near_the_weights(spark):
    plan = spark.createDataFrame([(0, 600, 0), (1, 0, 600), (2, 90, 600), (3, 310, 690)], "number long, blocks long, base long")
    got = [(r.number, r.block, r.slot) for r in mixing.schedule(plan, spark).collect()]
    assert sorted((n, b) for n, b, _ in got) == [(n, b) for n, k in ((0, 600), (2, 90), (3, 310)) for b in range(k)]
    assert len({s for _, _, s in got}) == 1000
    in_order = [n for n, _, s in sorted(got, key=lambda x: x[2])]
    for n, share in ((0, 0.6), (2, 0.09), (3, 0.31)):
        for end in range(50, 1000, 50):
            assert abs(in_order[:end].count(n) - share * end) < 6
        of = [(b, s) for m, b, s in got if m == n]
        assert [s for _, s in sorted(of)] == sorted(s for _, s in of)


def test_mixes_agree_whatever_the_partitions(spark):
    draw = random.Random(9)
    docs = spark.createDataFrame([(i % 50, " ".join(["w"] * (i % 17)), "en", draw.choice("abc")) for i in range(300)], DOCS)
    got = []
    for n in (1, 7):
        rows, mixed = mixing.mix(docs.repartition(n), block=8)
        taken = mixed.groupBy("row").agg(F.sum("words").alias("taken"))
        got.append(sorted((r.doc_id, r.size, r.source, r.taken or 0) for r in rows.join(taken, "row", "left").collect()))
    assert got[0] == got[1]


def test_mixes_of_hard_rows(spark, hard, empty):
    rows, _, _ = check_mix(spark, hard, 1024)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in HARD)
    assert mixing.mix(empty)[0].count() == 0 and mixing.mix(empty)[1].count() == 0
    none = spark.createDataFrame([(1, None, None, "a"), (2, " ", None, None)], DOCS)
    rows, mixed = mixing.mix(none)
    assert {(r.doc_id, r.size, r.target) for r in rows.collect()} == {(1, 0, 0.0), (2, 0, 0.0)} and mixed.count() == 0


def test_running_sums_and_lanes(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id"), (F.col("id") % 5).alias("v")).repartition(5)
    rows = sorted((r.k, r.id, r.v, r.before) for r in ordered.running(ordered.lay_out(df, [F.asc("k"), F.asc("id")], "test"), before="v").collect())
    at = 0
    for _, _, v, before in rows:
        assert before == at
        at += v
    left = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 50), ("b", 51)], "key string, x long")
    totals = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "key string, t long")
    want = sorted((r.x, r.t) for r in keyed.attach(left, totals, "key").collect())
    assert want == sorted((r.x, r.t) for r in keyed.attach(left, totals, "key", most=1).collect()) and len(want) == 52


# Phrases


def naive_phrases(rows, least, most_words, top, subsumed):
    counts = defaultdict(Counter)
    n = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, most_words + 1):
                for i in range(len(ws) - k + 1):
                    counts[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    around[p[i : i + m]] = max(around[p[i : i + m]], a)
        for p, a in candidates.items():
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if around[p] and 100 * around[p] >= subsumed * a:
                continue
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def mined(df, **how):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.mine(df, **how).collect())


@pytest.mark.parametrize(("words", "top"), [(2, 5), (3, 2000), (5, 2000)])
def test_phrases_are_those_of_brute_force(spark, words, top):
    draw = random.Random(words)
    vocabulary = ["of", "the", "New", "YORK", "É", "é", "city", "x" * 70, "日本", "a b"]
    rows = []
    for i in range(400):
        text = "".join(draw.choices(vocabulary, [9, 9, 5, 5, 1, 1, 3, 1, 1, 1])[0] + draw.choice([" ", " ", "\t", "  ", ", ", ".\n", "\x1c", "!"]) for _ in range(draw.randint(0, 40)))
        rows.append((i, text + draw.choice(["", "New York city"]), draw.choice(["en", "fr", None]), "s"))
    got = mined(spark.createDataFrame(rows, DOCS).repartition(4), least=4, most_words=words, top=top)
    assert got == naive_phrases([(t, lang) for _, t, lang, _ in rows], 4, words, top, 50) and got


def test_full_tables_of_bits_and_early_counts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LANES", (3, 2))
    monkeypatch.setattr(phrases, "COMMON", 20)
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice("abcdefghij") for _ in range(60)), "en", "s") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    want = naive_phrases([(t, lang) for _, t, lang, _ in rows], 3, 3, 50, 50)
    assert mined(docs, least=3, top=50) == want
    want = Counter(" ".join(t.split()[i : i + 3]).encode() for _, t, _, _ in rows for i in range(58))
    monkeypatch.setattr(phrases, "HELD_PHRASES", 10)
    for wide in (0, 30):  # phrases as numbers, or as rows
        tally = phrases._Tally("en", 3, lambda h: np.ones(len(h), bool))  # every bit set
        got = Counter()

        def take(counts, got=got):
            for names, n in counts:
                got.update(dict(zip(names.to_pylist(), n.tolist(), strict=True)))

        for _, text, _, _ in rows:
            if wide:
                tally.ids.update({b"%d x" % i: i for i in range(len(tally.ids), 1 << 22)} if not tally.ids else {})
                tally.word_hashes = np.zeros(len(tally.ids), np.uint64)
            take(tally.add(text.encode()))
            if wide:
                break
        take(tally.flush())
        assert got == want if not wide else sum(got.values()) == 58


def test_phrases_of_hard_rows(hard, empty):
    rows = [(t, lang) for _, t, lang, _ in HARD]
    assert mined(hard) == naive_phrases(rows, 10, 3, 2000, 50)
    assert mined(empty) == []


# Vector codes


def naive_codes(rows, rounds=2, entries=64):
    """Rows of (vec_id, vector, label), codebooks rebuilt from nothing each round."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1]) // 16
    cut = [[v[p * width : (p + 1) * width] for p in range(16)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(16)]

    def near(piece, book):
        return min((sum((a - b) ** 2 for a, b in zip(piece, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(16):
            mine = defaultdict(list)
            for c in cut:
                mine[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(mine[k]) for x in zip(*mine[k], strict=True)] if mine[k] else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, [near(c[p], books[p]) for p in range(16)], label) for (i, _, label), c in zip(kept, cut, strict=True)]
    total = Counter()
    for _, n, label in found:
        total[label] += sum(d for d, _ in n)
    return sorted((str(i), "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), total[label], digest) for i, n, label in found)


def coded(df, **how):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df, **how).collect())


@pytest.mark.parametrize(("n", "dim", "rounds"), [(300, 32, 2), (300, 16, 4), (40, 48, 2), (1, 16, 2), (100, 16, 0)])
def test_codes_are_those_of_brute_force(spark, n, dim, rounds):
    draw = np.random.default_rng(n + dim)
    vectors = np.round(draw.normal(0, 0.05, (n, dim)), 2).astype(np.float32)  # coarse: many ties
    rows = [(int(i) + BIG, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(vectors, draw.integers(0, 3, n), strict=True))]
    rows += [(None, [0.5] * dim, None), (5 + 2 * BIG, None, 1), (6, [math.nan] + [0.0] * (dim - 1), 1), (7, [math.inf] * dim, 1), (8, [None] * dim, 1), (2 * BIG + 1, [0.25] * dim, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    assert coded(df, rounds=rounds) == naive_codes(rows, rounds)


def test_only_changed_parts_are_shuffled(spark):
    q = np.arange(64).reshape(2, 32)
    import pyarrow as pa

    lists = pa.ListArray.from_arrays(pa.array([0, 32, 64], pa.int32()), pa.array(q.astype(np.int32).ravel()))
    old, new = bytes(16), bytes([0] * 15 + [1])
    batch = pa.RecordBatch.from_arrays([lists, pa.array([old, old]), pa.array([old, new])], ["q", "before", "code"])
    (out,) = vector_codes._changes(32, 2)(iter([batch]))
    assert sorted(zip(*(c.to_pylist() for c in out.columns), strict=True)) == [(15, 0, -1, -1), (15, 0, 0, -62), (15, 0, 1, -63), (15, 1, -1, 1), (15, 1, 0, 62), (15, 1, 1, 63)]


def test_codes_of_hard_rows(spark):
    schema = "vec_id long, embedding array<double>, label string, code int, error string, q int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [0.1] * 20, "a", 1, "e", 1), (1, [0.1] * 20, "a", 1, "e", 1), (2, [1e300] * 20, None, 1, "e", 1), (3, [0.5] * 16, "a", 1, "e", 1), (4, [], "b", 1, "e", 1), (5, None, "b", 1, "e", 1)]
    got = coded(spark.createDataFrame(rows, schema))
    assert [(i, c, e) for i, c, e, _, _ in got] == [("1", "00" * 16, 0), ("1", "00" * 16, 0), ("2", "02" * 10 + "00" * 6, 0), ("3", None, None), ("4", None, None)]
    only_empty = coded(spark.createDataFrame([(1, [], "a")], "vec_id long, embedding array<double>, label string"))
    assert [r[1:3] for r in only_empty] == [("00" * 16, 0)]
