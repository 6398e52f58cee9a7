"""Mixing, importance resampling and the filter audit against brute force, on odd rows too."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import audit, importance, mixing, queries

from .conftest import DOCS, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    """Several sources (null and empty among them), one with most rows, copies, nulls, repeated ids, a long text."""
    r = random.Random(5)
    texts = [sentence(r, r.randint(1, 300)) for _ in range(120)]
    texts += texts[:10] + [None, "", " \n", "A$ B% C", "Überall 你好 ÀÉ x-y_Z", "same words " * 150, sentence(r, 9000, 3000)]
    out = [(k, t, ("en", "de", None, "")[k % 4], ("big", "big", "b", "É", None, "")[k % 6], len(t or "")) for k, t in enumerate(texts)]
    return out + [out[3], (3, texts[9], "en", "big", 0), (None, texts[2], "en", "b", 0), (None, texts[2], "en", "b", 0), (None, None, None, None, None)]


@pytest.fixture()
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    for c in ("row", "s", "n", "score", "key", "part", "mask", "words", "print", "keep", "size"):
        df = df.withColumn(c, F.lit(1))
    return df


# mixing


def brute_targets(sizes, weights):
    """Step by step: what is over the limit is taken away and shared again."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    got = [Fraction(sum(sizes) * x, sum(w)) for x in w]
    while True:
        over = sum(max(g - 3 * n, 0) for g, n in zip(got, sizes))
        if not over:
            return [float(g) for g in got]
        got = [min(g, Fraction(3 * n)) for g, n in zip(got, sizes)]
        free = [k for k in range(len(sizes)) if got[k] < 3 * sizes[k]]
        for k in free:
            got[k] += over * w[k] / sum(w[j] for j in free)


def test_targets():
    r = random.Random(1)
    for _ in range(200):
        sizes = [r.choice((0, 1, 5, 100, 1000, 50_000)) for _ in range(r.randint(1, 9))]
        assert mixing.targets(sizes, (1, 2, 3)) == pytest.approx(brute_targets(sizes, (1, 2, 3)))
    assert mixing.targets([0, 0], (1, 2, 3)) == [0, 0]


def test_permutations_are_permutations():
    for m in (1, 2, 3, 17, 1000, 4097):
        for key in (0, 1, 99):
            out = mixing.permuted(np.arange(m), np.full(m, m), np.full(m, key, np.uint64))
            assert sorted(out.tolist()) == list(range(m))
    a, b = (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k, np.uint64)) for k in (1, 2))
    assert (a != b).mean() > 0.9


def test_shards_draw_what_is_expected():
    wanted = np.array([10.5, 1000.25, 0, 3000.25])
    counts = [mixing.shard_counts(wanted, k, 401, 1) for k in range(10)]
    assert all(c.sum() == 401 for c in counts)
    assert np.abs(sum(counts) - wanted * 4010 / wanted.sum()).max() < 10
    assert all((np.abs(c - wanted * 401 / wanted.sum()) <= 4).all() for c in counts)


def test_mix(spark, docs, rows):
    out = [tuple(r) for r in mixing.taken(mixing.mix(docs)).select("row.doc_id", "size", "source_size", "target", "taken").collect()]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([sizes[s] for s in order], (1, 2, 3))))
    assert Counter(x[:3] for x in out) == Counter((r[0], len(WORD.findall(r[1] or "")), sizes[r[3]]) for r in rows)
    assert {round(x[3], 6) for x in out} == {round(v, 6) for v in want.values()}
    assert all(0 <= x[4] <= 3 * x[1] for x in out)
    got = Counter()
    for x in out:
        got[x[2]] += x[4]
    assert len(set(sizes.values())) == len(sizes)
    for s in order:
        assert abs(got[sizes[s]] - want[s]) <= 2 * mixing.LENGTH, s
    again = mixing.taken(mixing.mix(clashing(docs).repartition(7))).select("row.doc_id", "size", "source_size", "target", "taken").collect()
    assert Counter(map(tuple, again)) == Counter(out)


def test_slots_hold_blocks_of_the_streams(spark):
    r = random.Random(2)
    some = [(k, " ".join(f"d{k}w{i}" for i in range(r.randint(0, 90))), "en", f"s{k % 3}", 0) for k in range(40)]
    docs = spark.createDataFrame(some, DOCS)
    m = mixing.mix(docs, length=16)
    laid = m.laid.select("s", "start", "size", "row.doc_id").collect()
    words = {r[0]: WORD.findall(r[1]) for r in some}
    stream = defaultdict(list)
    for x in sorted(laid, key=lambda x: (x["s"], x["start"], x["size"])):
        assert x["start"] == len(stream[x["s"]]) and x["size"] == len(words[x["doc_id"]])
        stream[x["s"]] += words[x["doc_id"]]
    spans = m.spans.select("shard", "slot", "s", "block").distinct().collect()
    assert len({x[:2] for x in map(tuple, spans)}) == len(spans)
    got = {(x["shard"], x["slot"]): x["text"].split() for x in mixing.texts(m, docs).collect()}
    assert got == {(x["shard"], x["slot"]): stream[x["s"]][x["block"] * 16 :][:16] for x in spans}
    times = Counter((x["s"], x["block"]) for x in spans)
    assert max(times.values()) <= 3


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.taken(mixing.mix(empty)).collect() == []
    no_words = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", None, 0)], DOCS)
    assert sorted(map(tuple, mixing.taken(mixing.mix(no_words)).select("row.doc_id", "size", "target", "taken").collect())) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


# resampling


def features(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute_draw(rows, target):
    crc = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(crc(f) for x in rows for f in features(x[1])[1]), Counter(crc(f) for x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for x in rows:
        w, f = features(x[1])
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in map(crc, f)) // max(1, len(f))
        h = int(sha256(f"7:{'' if x[0] is None else x[0]}".encode()).hexdigest()[:8], 16)
        out.append((x[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20))
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    drawn = 25 * len(fit) // 100
    ranked = [(*x[:4], k + 1) for k, x in enumerate(fit[:drawn])] + [(*x[:4], None) for x in fit[drawn:]] + [(*x[:4], None) for x in out if not x[4]]
    return Counter(ranked)


def test_features_of_texts_that_touch():
    import pyarrow as pa

    texts = ["One two", "two-THREE", None, "", "é你 X_9", "-", "two three "]
    f = importance.Features(pa.array(texts).slice(0))
    found = f.strings(np.arange(len(f.prints)), np.arange(len(f.prints))).to_pylist()
    assert [sorted(x for x, i in zip(found, f.text) if i == k) for k in range(len(texts))] == [sorted(features(t)[1]) for t in texts]
    assert f.buckets(np.arange(len(found))).tolist() == [zlib.crc32(x.encode()) % 10000 for x in found]


def test_resampling_matches_brute_force(spark, docs, rows, monkeypatch):
    target = [rows[k][1] for k in (4, 5, 6)] + [None, ""]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = Counter(map(tuple, importance.resample(docs, goal).collect()))
    assert got == brute_draw(rows, target)
    monkeypatch.setattr(importance, "_TOGETHER", 500)
    assert Counter(map(tuple, importance.resample(clashing(docs).repartition(5), goal).collect())) == got
    words = importance.dictionary(docs).collect()
    assert {r["feature"]: r["n"] for r in words} == Counter(f for x in rows for f in features(x[1])[1])


def test_resampling_of_a_whole_table(spark):
    from tests.conftest import DATA

    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert Counter(map(tuple, queries.op12_feature_dictionary(spark, str(DATA)).collect())) == brute_draw(rows, target)


def test_resampling_of_nothing(spark, docs, rows):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(spark.createDataFrame([], DOCS), none).collect() == []
    assert Counter(map(tuple, importance.resample(docs, none).collect())) == brute_draw(rows, [])


# audit


def brute_audit(rows, labels):
    first = {}
    for x in rows:
        key = (x[0] is None, x[0] or 0)
        first[x[1] or ""] = min(first.get(x[1] or "", key), key)
    parts = defaultdict(list)
    for x in rows:
        t = x[1] or ""
        w = WORD.findall(t)
        fails = {c for c, f in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search("[#$%&*|]", t), (x[0] is None, x[0] or 0) > first[t])) if f}
        parts[x[2] or ""].append((fails, any(y[0] == x[0] and y[1] == 1 for y in labels if y[0] is not None), any(y[0] == x[0] and y[2] == 1 for y in labels if y[0] is not None)))
    out, every = [], Counter()
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            left = members
            for k, c in enumerate(order):
                now = [m for m in left if c in m[0]]
                every[part, c] += len(now)
                left = [m for m in left if c not in m[0]]
                fails = [m for m in members if c in m[0]]
                out.append((part, "".join(order), k + 1, len(left), len(now), len(fails) - len(now), sum(m[0] == {c} for m in members), sum(m[1] for m in now), sum(m[2] for m in now)))
    return {(*x, every[x[0], x[1][x[2] - 1]]) for x in out}


def test_audit_matches_brute_force(spark, docs, rows):
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 100, 3)] + [(3, 1, 0), (None, 1, 1), (6, None, None)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(rows, labels)
    assert {tuple(r) for r in audit.audit(docs, marks).collect()} == want and len(want) % 600 == 0
    again = audit.audit(clashing(docs).repartition(5), marks.withColumn("part", F.lit(1)).withColumn("text", F.lit(2)))
    assert {tuple(r) for r in again.collect()} == want


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(spark.createDataFrame([], DOCS), none).collect() == []
    one = audit.audit(spark.createDataFrame([(None, None, None, None, None)], DOCS), none)
    assert {tuple(r) for r in one.collect()} == brute_audit([(None, None, None)], [])
