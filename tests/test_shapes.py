"""Areas of many rectangles, and choices from large groups, against brute force."""

from __future__ import annotations

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import html as H
from inkwell.functions import style as Y
from inkwell.functions import text as T
from inkwell.operators import geometry, selection


def raster(rects, n=100):
    grid = np.zeros((n, n), bool)
    for x, y, w, h in rects:
        grid[round(x * n) : round((x + w) * n), round(y * n) : round((y + h) * n)] = True
    return grid.sum() / n / n


def some(r, n, n_cells=100, most=30):
    out = []
    for _ in range(n):
        x, y = r.randrange(n_cells), r.randrange(n_cells)
        out.append((x / n_cells, y / n_cells, min(n_cells - x, r.randint(0, most)) / n_cells, min(n_cells - y, r.randint(0, most)) / n_cells))
    return out


@pytest.mark.parametrize("piece", [50_000, 40])
def test_union_area_of_small_and_large_keys(spark, monkeypatch, piece):
    monkeypatch.setattr(geometry, "PIECE", piece)
    r = random.Random(1)
    keys = {"one": some(r, 1), "few": some(r, 30), "many": some(r, 300, most=6), "wide": some(r, 150, most=4) + [(0.0, k / 100, 1.0, 0.01) for k in range(0, 90, 7)], "none": [(0.1, 0.1, 0.0, 0.5)]}
    rows = [(k, *x) for k, v in keys.items() for x in v + v[:3]]
    got = {x["k"]: x["area"] for x in geometry.union_area(spark.createDataFrame(rows, "k string, x double, y double, width double, height double"), "k").collect()}
    assert got == pytest.approx({k: raster(v) for k, v in keys.items() if k != "none"})


@pytest.mark.parametrize("columns, rows", [(50, 32), (10, 7), (3, 130), (5, 64)])
def test_grid_coverage(spark, columns, rows):
    r = random.Random(7)
    rects = {"few": [(r.random(), r.random(), r.random() / 3, r.random() / 3) for _ in range(3)], "many": [(r.random(), r.random(), r.random() / 9, r.random() / 9) for _ in range(60)], "all": [(0.0, 0.0, 1.0, 1.0)], "sliver": [(0.2, 0.1, 1e-12, 0.5), (0.2, 0.1, 0.3, 0.5)]}

    def touched(x, y, w, h):
        span = lambda low, size, n: range(math.floor(low * n), min(n, math.ceil((low + size) * n - 1e-9)))
        return {(a, b) for a in span(x, w, columns) for b in span(y, h, rows)}

    data = [(k, *x) for k, v in rects.items() for x in v] + [("flat", 0.1, 0.1, 0.0, 0.5)]
    found = geometry.grid_coverage(spark.createDataFrame(data, "k string, x double, y double, width double, height double"), "k", columns, rows)
    want = {k: len(set().union(*[touched(*x) for x in v])) for k, v in rects.items()}
    assert {x["k"]: (x["cells"], x["coverage"]) for x in found.collect()} == {k: (n, round(n / (columns * rows), 6)) for k, n in want.items()}
    assert "Generate" not in found._jdf.queryExecution().toString()  # no row for each cell


def test_sweep_is_near_linear():
    r = np.random.default_rng(2)

    def run(n):
        x, y = r.random(n), r.random(n)
        w, h = r.random(n) / 50, r.random(n) / 50
        began = time.perf_counter()
        area = geometry.swept_area(x, x + w, y, y + h)
        return time.perf_counter() - began, area

    few, _ = run(5000)
    many, area = run(100_000)
    assert many < 20 * few * 4 and 0.9 < area < 1.1


def greedy(rows, k):
    left, used, out = sorted(rows), {}, []
    while left and len(out) < k:
        best = max(left, key=lambda x: (x[2] * (1, 0.65, 0.35, 0.1)[min(3, used.get(x[1], 0))], -x[0]))
        used[best[1]] = used.get(best[1], 0) + 1
        out.append(best[0])
        left.remove(best)
    return out


def test_choices_with_decay(spark):
    r = random.Random(3)
    decks = {f"d{k}": [(i, f"s{r.randrange(1 + k % 9)}", float(r.randrange(40))) for i in range(r.choice((1, 3, 50, 400)))] for k in range(30)}
    rows = spark.createDataFrame([(d, *x) for d, v in decks.items() for x in v], "deck string, index int, section string, score double")
    got = {}
    for x in selection.diverse(rows, "deck", 6).orderBy("deck", "place").collect():
        got.setdefault(x["deck"], []).append(x["index"])
    assert got == {d: greedy(v, 6) for d, v in decks.items()}


def test_places_in_groups_of_any_size(spark):
    from inkwell.operators import ranking

    r = random.Random(9)
    rows = [(r.choice(["big"] * 9 + ["small", None]), r.randrange(10**6), k) for k in range(5000)]
    got = {x["id"]: (x["place"], x["total"]) for x in ranking.placed(spark.createDataFrame(rows, "k string, at int, id int").repartition(9), "k", ["at", "id"]).collect()}
    want = {}
    for key in {x[0] for x in rows}:
        own = sorted((x[1:] for x in rows if x[0] == key))
        want |= {i: (n, len(own)) for n, (_, i) in enumerate(own)}
    assert got == want


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_need_no_pandas(spark):
    rows = spark.createDataFrame([("<p>A. b</p><P>c. d</P>e < f. g",), (None,), ("",)], "h string")
    out = rows.select(H.with_breaks(F.col("h")).alias("b"), H.interleaved(F.col("h"), F.array(F.lit("1"), F.lit("2"), F.lit("3"))).alias("i"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [("<p>A.<br>b</p><P>c.<br>d</P>e < f.<br>g", "<p>A. b</p>1<P>c. d</P>2e < f. g3"), (None, None), ("", "123")]
    assert "pandas" not in type(H.sanitized).__name__ and [r["x"] for r in rows.select(H.sanitized(F.col("h")).alias("x")).collect()][1:] == [None, ""]


def test_changes_too_far_apart_are_seen_at_once(monkeypatch):
    monkeypatch.setattr(H, "_alike", None)
    assert H.edits("the " * 600, "a " * 600) is None


def test_linters_go_through_a_text_once(spark):
    rows = spark.createDataFrame([("<p>x</p>", [("q", "a")])], "h string, f array<struct<question:string,answer:string>>")
    text = plan(rows.select(Y.publication_issues(F.col("h"), F.col("f"), F.array(F.lit("u")), F.lit(False)).alias("x")))
    assert text.count(Y.CLICHES[0]) == 1 and text.count("<(?:ol|ul)") == 1


def test_words_and_sentences_by_few_replacements(spark):
    rows = spark.createDataFrame([("A  b, \t　Ab 1c.  ﻿x y。z",), (None,)], "t string")
    assert "regexp_replace" not in plan(rows.select(T.token_set(F.col("t")).alias("x"))) and plan(rows.select(T.sentence_lengths(F.col("t")).alias("x"))).count("regexp_replace") == 4
    assert [r["w"] for r in rows.select(T.token_set(F.col("t")).alias("w")).collect()] == [["ab", "1c"], None]
    assert [(r["s"], r["n"]) for r in rows.select(T.squeeze(F.col("t")).alias("s"), T.sentence_lengths(F.col("t")).alias("n")).collect()] == [("A b, Ab 1c. x y。z", [7, 2, 1]), (None, None)]


def test_pairs_share_tokens_once(spark, tmp_path):
    from inkwell.queries import QUERIES

    spark.createDataFrame([(1, "ab cd ef"), (2, "cd ef gh"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert plan(QUERIES["FM06_novelty"](spark, str(tmp_path))).count("array_intersect") == 1
    assert sorted(tuple(r) for r in QUERIES["FM05_keywords"](spark, str(tmp_path)).collect()) == [(1, 47), (2, 0)]
    near = QUERIES["FM01_cosine"](spark, str(tmp_path))
    assert "Generate" not in plan(near) and sorted(tuple(r) for r in near.collect()) == [(1, 0.666667), (2, 0.0)]


def test_edits_leave_diagonals_that_lead_too_far(monkeypatch):
    """The way is the one that all diagonals give, and a text with 60 changes of seven edits each takes some steps for each edit, not some for each pair of edits."""
    r = random.Random(3)
    for _ in range(300):
        chars = r.choice(["ab", "abcdef", "a\U0001f600é"])
        a, b = ("".join(r.choice(chars) for _ in range(r.randrange(40))) for _ in range(2))
        flat = memoryview(np.zeros(41, np.int64))
        assert H.edits(a, b) == H._search(a, b, H.MOST_EDITS, flat, flat, flat, flat)
    words = ["".join(r.choice("abcdeghilnorstw") for _ in range(r.randint(2, 9))) for _ in range(600)]
    text = " ".join("that" if k % 10 == 5 else w for k, w in enumerate(words))
    steps, alike = [], H._alike
    monkeypatch.setattr(H, "_alike", lambda *x: steps.append(1) or alike(*x))
    way = H.edits(text, text.replace("that ", "which "))
    assert way.count("-") + way.count("+") == 420 and len(steps) < 8000


def test_union_area_takes_more_tasks_for_more_rectangles(spark, monkeypatch):
    """So that what a task sorts doesn't grow with the table; rectangles meet in the row of their key, without joins. Those without a place, key or width take no part."""
    monkeypatch.setattr(geometry, "ROWS", 20)
    r = random.Random(5)
    rects = {k: some(r, 1 + k % 5) for k in range(100)}
    rows = [(k, *x) for k, v in rects.items() for x in v + v[:1]] + [(200, None, 0.1, 0.5, 0.5), (None, 0.1, 0.1, 0.5, 0.5), (201, 1.0, 0.1, 0.5, 0.5)]
    found = geometry.union_area(spark.createDataFrame(rows, "k long, x double, y double, width double, height double"), "k")
    assert {x["k"]: x["area"] for x in found.collect()} == pytest.approx({k: raster(v) for k, v in rects.items() if any(w > 0 and h > 0 for *_, w, h in v)})
    plan = found._jdf.queryExecution().executedPlan().toString()
    n = sum(w > 0 and h > 0 for *_, w, h in rows) - 3
    assert "Join" not in plan and f"hashpartitioning(k, {-(-n // 20)})" in re.sub(r"#\d+L?", "", plan)


def test_heavy_decks_at_the_limit_in_any_order(spark, tmp_path):
    """The areas of deck 1 are exactly 0.2 together; one after the other, or from the last on, they come to a bit less or more. Deck 2 is short of it by 0.0001."""
    from inkwell.queries import QUERIES

    lines = [(46, 25.0, 0.06, 0.02), (33, 22.0, 0.0, 0.03), (97, 19.0, 0.05, 0.05), (47, 38.0, 0.08, 0.07), (33, 35.0, 0.02, 0.02), (30, 15.0, 0.06, 0.01), (33, 48.0, 0.01, 0.01), (36, 17.0, 0.03, 0.02)]
    found = []
    for k in range(8):
        rows = [(1, *x, "A", "F") for x in lines[k:] + lines[:k]] + [(2, *x, "A", "F") for x in [*lines[:-1], (36, 17.0, 0.03, 0.0194)]] + [(3, 1, None, None, 0.1, "A", "F"), (None, 1, 1.0, 0.1, 0.1, "A", "F")]
        spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        found.append({x["deck"]: x["heavy"] for x in QUERIES["FM21_heavy"](spark, f"{tmp_path}/{k}").collect()})
    assert all((x[1], x[2]) == (True, False) for x in found)
