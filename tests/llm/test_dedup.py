"""Near duplicates and repeated passages against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkwell.llm import components, minhash, substring

from .conftest import DOCS, sentence


def shingle_counts(text):
    w = re.findall(r"[^\s!-/:-@\[-`{-~]+", (text or "").lower())
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def weighted_jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 0.0


def brute_classes(rows):
    parent = {i: i for i in range(len(rows))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [shingle_counts(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or weighted_jaccard(bags[i], bags[j]) >= 0.8:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    return {d: (min(g), len(g)) for g in groups.values() for d in g}


def test_classes_match_brute_force(docs, corpus):
    got = {r["doc_id"]: (r["class_id"], r["copies"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_classes(corpus)


def test_large_buckets_lose_no_link(docs, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 2)
    got = {r["doc_id"]: (r["class_id"], r["copies"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_classes(corpus)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        n = 400
        element = rng.integers(0, 1 << 63, n).astype(np.uint64)
        a = rng.uniform(0.2, 3.0, n)
        b = np.where(rng.random(n) < share, a, rng.uniform(0.2, 3.0, n))
        own = np.repeat([0, 1], n)
        sig = minhash.signatures(np.concatenate([element, element]), own, np.concatenate([a, b]), 2, 2000)
        exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sig[0] == sig[1]).mean() - exact) < 0.05


def test_signature_of_scaled_weights_is_shared():
    element = np.arange(1, 50, dtype=np.uint64)
    one = np.ones(49)
    sig = minhash.signatures(np.concatenate([element, element]), np.repeat([0, 1], 49), np.concatenate([one, one]), 2, 64)
    assert (sig[0] == sig[1]).all() and (sig != 0).all()


def test_first_of_each_keeps_columns_and_one_row_a_class(docs, corpus):
    classes = brute_classes(corpus)
    kept = minhash.first_of_each(docs.unionByName(docs))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in classes.values()})


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f", None, None, None), (5, "a b c d e f", None, None, None), (5, "x", None, None, None), (5, "x", None, None, None), (7, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("class_id", F.lit(9)).withColumn("sig", F.lit("s"))
    got = sorted(((r["doc_id"] or -1, r["class_id"], r["copies"]) for r in minhash.near_duplicates(df).collect()), key=repr)
    assert [x for x in got if x[0] != 5] == [(-1, got[0][1], 2), (7, 7, 1)]
    # the two classes with the least id 5 are told apart, and one of them has it as its class id
    ids = {c for d, c, _ in got if d == 5}
    assert len(ids) == 2 and 5 in ids and min(ids) < 0 and got[0][1] in ids
    assert sorted(n for d, _, n in got if d == 5) == [2, 2, 2]
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_unrelated_rows_with_null_and_repeated_ids_stay(spark):
    rows = [(None, "one two three", 1), (None, "four five six", 2), (7, "seven eight", 3), (7, "nine ten eleven", 4), (9, "twelve", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _o int").withColumn("_t1", F.lit(1)).withColumn("_k", F.lit("k")).withColumn("row", F.lit(0)).withColumn("rep", F.lit(None).cast("long"))
    kept = minhash.first_of_each(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, df.collect()))
    assert len({r["class_id"] for r in minhash.near_duplicates(df).collect()}) == 5
    # equal rows and near copies go, also among rows without an id
    more = df.unionByName(df).unionByName(df.where("_o = 1").withColumn("text", F.upper("text")))
    assert sorted(r["_o"] for r in minhash.first_of_each(more).collect()) == [1, 2, 3, 4, 5]
    assert minhash.first_of_each(df.where("false")).count() == 0


def test_one_text_in_a_third_of_the_rows(spark):
    rows = [(k, "a hot text of six words" if k % 3 == 0 else f"w{k} x{k} y{k}") for k in range(6000)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 6000
    assert {(r["class_id"], r["copies"]) for r in out if r["doc_id"] % 3 == 0} == {(0, 2000)}
    assert all(r["class_id"] == r["doc_id"] and r["copies"] == 1 for r in out if r["doc_id"] % 3)


def test_components(spark):
    edges = [(k + 1, k) for k in range(60)] + [(100, 200), (200, 300), (300, 100), (7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 300: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removal(rows):
    seen, out = set(), {}
    for d, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_substring_dedup_matches_brute_force_for_any_batches(docs, corpus):
    want = brute_removal(corpus)
    assert sum(x[1] for x in want.values()) > 200
    for n in (1, None, 6):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.substring_dedup(docs, batches=n).collect()}
        assert got == want, n


def test_a_lasting_log_dedups_later_documents(spark, docs, corpus, tmp_path_factory, monkeypatch):
    monkeypatch.setattr(substring, "HELD", 500)
    folder = f"file://{tmp_path_factory.mktemp('log')}"
    want, half = brute_removal(corpus), 3 * len(corpus) // 2
    early, late = docs.where(f"doc_id <= {half}"), docs.where(f"doc_id > {half}")
    one = substring.substring_dedup(early, batches=3, log=folder)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in one.collect()}
    for t in spark.catalog.listTables():
        spark.sql(f"DROP TABLE {t.name}")  # as in a new session
    two = substring.substring_dedup(late, batches=2, log=folder, history=early)
    got |= {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in two.collect()}
    assert got == want
    assert len(substring.FingerprintLog(spark, folder).runs) < 3 + 2  # compacted


def test_runs_merge_without_sorting(spark, docs):
    log = substring.FingerprintLog(spark)
    rows = docs.select(F.xxhash64("text").alias("h"), F.col("doc_id").alias("t1"), F.lit(False).alias("again"))
    one, two = log.run(rows), log.run(rows)
    with substring._in_order(spark):
        plan = one.join(two.select("h").hint("merge"), "h").groupBy("h").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort [" not in plan


def test_substring_dedup_odd_rows(spark, corpus):
    rows = [(None, "a " * 25, None, None, None), (1, "a " * 25, None, None, None), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash")).withColumn("starts", F.lit(1))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.substring_dedup(df).collect()}
    assert got == {1: (25, 24), None: (25, 25), 2: (0, 0)}  # all windows but the first repeat an earlier one
    assert substring.substring_dedup(df.where("false")).count() == 0
    out = substring.substring_dedup(df, keep=["lang", "text"])
    assert out.columns == ["doc_id", "lang", "n_words", "n_removed", "kept", "text"]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(((r[0], r[1]) for r in rows), key=repr)


def test_anchor_places_are_all_found():
    from inkwell.llm._words import words

    text = " ".join(f"x{(k * k) % 11}" for k in range(300))
    w = words(pa.array([text, "short", None, text]))
    at, own, anchor = substring._windows(w)
    place_own, place = substring._places(w)
    assert {(o, a) for o, a in zip(own.tolist(), anchor.tolist())} == {(o, a) for o, a in zip(place_own.tolist(), place.tolist())}


def test_substring_dedup_keeps_texts_of_many_slices(spark, corpus):
    """An Arrow batch of more than a slice: texts, and nulls, come back as they are."""
    r = random.Random(3)
    long = [(1000 + k, sentence(r, 60_000, 9000) if k % 3 else None, None, "s", 0) for k in range(9)]
    rows = corpus[:30] + long
    out = substring.substring_dedup(spark.createDataFrame(rows, DOCS).coalesce(1), keep=["text"]).collect()
    assert sorted((x["doc_id"], x["text"]) for x in out if x["text"]) == sorted((x[0], x[1]) for x in rows if x[1])
    assert sum(x["text"] is None for x in out) == sum(x[1] is None for x in rows)


def test_no_table_of_a_run_stays_in_the_catalog(spark, docs):
    from inkwell.llm import _shared

    mark = _shared.written_so_far()
    substring.substring_dedup(docs).count()
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("inkwell_run_")]
    _shared.release_since(mark)
    assert not [x for x in _shared._written[mark:]]
    own = {p.rsplit("/", 1)[-1] for _, p in _shared._written}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("inkwell_run_") and t.name not in own and not t.name in _lasting(spark)]


def _lasting(spark):
    """Tables of logs in folders of their own, which other tests made."""
    return {t.name for t in spark.catalog.listTables() if t.name.startswith("inkwell_run_") and "shared" not in spark.sql(f"DESCRIBE TABLE EXTENDED {t.name}").where("col_name = 'Location'").first()["data_type"]}
