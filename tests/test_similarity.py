"""Joins and searches by hashes and by tokens in time, against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

from inkwell.operators import setpairs, similarity


def distance(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def hashes(r, n, groups):
    """Clusters of near hashes, far ones, copies; signed longs, as they come from signs."""
    centres = [r.getrandbits(64) for _ in range(6)]
    out = []
    for k in range(n):
        h = r.choice(centres) if r.random() < 0.7 else r.getrandbits(64)
        for _ in range(r.choice((0, 0, 1, 3, 9))):
            h ^= 1 << r.randrange(64)
        out.append((k, groups[k % len(groups)], h - (1 << 64) if h >> 63 else h))
    return out + [(n + k, *out[k][1:]) for k in range(20)]


def test_nearest_hashes(spark):
    r = random.Random(4)
    rows = hashes(r, 500, ["big"] * 8 + ["small", "s2"]) + [(9000, "alone", 5), (9001, "pair", -1), (9002, "pair", 0)]
    got = {(x["g"], x["h"]): list(x["distances"]) for x in similarity.nearest_hashes(spark.createDataFrame(rows, "id long, g string, h long"), "g", "h", 4).collect()}
    members = defaultdict(list)
    for i, g, h in rows:
        members[g].append((i, h))
    want = {}
    for g, m in members.items():
        for i, h in m:
            want[g, h] = sorted(distance(h, x) for j, x in m if j != i)[:4]
    assert got == want


def test_nearest_hashes_in_blocks(spark, monkeypatch):
    """Groups that go to many blocks, to one, and less than k hashes in a block."""
    monkeypatch.setattr(similarity, "BLOCK", 7)
    r = random.Random(8)
    rows = hashes(r, 200, ["big"] * 8 + ["small"]) + [(9000, "alone", 5), *((9001 + k, "same", 5) for k in range(9))]
    got = {(x["g"], x["h"]): list(x["distances"]) for x in similarity.nearest_hashes(spark.createDataFrame(rows, "id long, g string, h long"), "g", "h", 3).collect()}
    assert got == {(g, h): sorted(distance(h, x) for j, f, x in rows if f == g and j != i)[:3] for i, g, h in rows} and got["alone", 5] == [] and got["same", 5] == [0, 0, 0]


def test_hamming_join(spark):
    r = random.Random(5)
    rows = [(i, h) for i, _, h in hashes(r, 300, ["g"])]
    left, right = spark.createDataFrame(rows, "a long, h long"), spark.createDataFrame(rows, "b long, h long")
    for most in (0, 1, 4, 7):
        got = sorted(map(tuple, similarity.hamming_join(left, right, "a", "b", "h", most).collect()))
        assert got == sorted((a, b, distance(x, y)) for a, x in rows for b, y in rows if distance(x, y) <= most)


def words(t):
    return set(t.split())


def test_worst_within_a_window(spark):
    r = random.Random(6)
    base = [" ".join(f"w{r.randrange(60)}" for _ in range(12)) for _ in range(8)]
    rows = []
    for k in range(150):
        w = r.choice(base).split()
        for _ in range(r.choice((0, 1, 3))):
            w[r.randrange(12)] = f"n{k}"
        rows.append((k, r.randrange(60), " ".join(w)))
    rows += [(200, 0, "edge one two three"), (201, 7, "edge one two three"), (202, 15, "edge one two three"), (203, 15, "edge one two three"), (204, 1, ""), (205, 2, "")]
    got = {x["id"]: x["worst"] for x in similarity.worst_within(spark.createDataFrame(rows, "id long, day long, text string"), "id", "day", 7, 40).collect()}
    want = {}
    for i, day, t in rows:
        scores = [int(100 * len(words(t) & words(u)) / max(1, len(words(t) | words(u))) + 0.5) for j, d, u in rows if words(t) and (day - 7 <= d < day or d == day and j < i)]
        want[i] = max([x for x in scores if x >= 40], default=0)
    assert got == want and (got[201], got[202], got[203]) == (100, 0, 100)


def test_daily_quota(spark):
    r = random.Random(7)
    titles = [" ".join(f"T{r.randrange(25)}" for _ in range(5)) for _ in range(40)] + ["", None]
    rows = [(r.randrange(50), k, r.choice(titles), r.randrange(9)) for k in range(250)]
    past = [(r.randrange(50), r.choice(titles)) for _ in range(60)] + [(0, "edge a b"), (20, "edge a b")]
    rows += [(14, 900, "edge a b", 99), (15, 901, "edge a b", 99), (20, 902, "edge a b", 99), (21, 903, "Edge b A", 99)]
    from inkwell.operators import selection

    got = {tuple(x) for x in selection.daily_quota(spark.createDataFrame(rows, "day long, doc_id long, title string, score int"), spark.createDataFrame(past, "day long, title string"), 3, 14, 0.5).collect()}
    like = lambda a, b: 2 * len(a & b) >= max(1, len(a | b))
    low = lambda t: words((t or "").lower())
    want = set()
    for day in {x[0] for x in rows}:
        chosen = []
        for _, i, t, _ in sorted((x for x in rows if x[0] == day), key=lambda x: (-x[3], x[1])):
            if len(chosen) < 3 and not any(day - 14 <= d < day and like(low(t), low(u)) for d, u in past) and not any(like(low(t), u) for u in chosen):
                chosen.append(low(t))
                want.add((day, i))
    assert got == want and (14, 900) not in got and (15, 901) in got and (20, 902) in got and (21, 903) not in got


def test_daily_quota_judges_only_as_many_as_fill_a_day(spark, monkeypatch):
    """Day 20 is filled by its best; day 21 only after 60 that resemble yesterday's title, three rounds later."""
    from inkwell.operators import selection

    monkeypatch.setattr(selection, "FIRST", 1)
    monkeypatch.setattr(selection, "MORE", 3)
    judged, stale = [], selection._stale
    monkeypatch.setattr(selection, "_stale", lambda rows, *a: judged.append(rows.count()) or stale(rows, *a))
    rows = [(20, k, f"a{k} b{k} c{k}", -k) for k in range(70)] + [(21, 100 + k, f"Old title here n{k}" if k < 60 else f"x{k} y{k}", -k) for k in range(62)] + [(21, 200, "old TITLE here", 1)]
    got = selection.daily_quota(spark.createDataFrame(rows, "day long, doc_id long, title string, score int"), spark.createDataFrame([(20, "old title here")], "day long, title string"), 2, 14, 0.5)
    assert {tuple(x) for x in got.collect()} == {(20, 0), (20, 1), (21, 160), (21, 161)} and judged == [4, 6, 18, 54, 62]


def test_half_hundredths_go_up(spark):
    """29 of 200 words are 14.5 hundredths, which 29 / 200 * 100 in doubles isn't."""
    left, right = [f"w{k}" for k in range(29)], [f"w{k}" for k in range(200)]
    frame = lambda name, t: spark.createDataFrame([(1, " ".join(t))], f"{name} long, text string")
    assert [x["score"] for x in similarity.jaccard_join(frame("a", left), frame("b", right), "a", "b", 10).collect()] == [15]


def test_shared_tokens_are_counted_in_blocks(spark, monkeypatch):
    """Several blocks of the right side and of counts, null, empty and repeated texts; the best of equal ones is the first, and no row is made for a token or a pair."""
    monkeypatch.setattr(similarity, "SENT", 40)
    monkeypatch.setattr(similarity, "COUNTS", 30)
    r = random.Random(9)
    some = lambda n: " ".join(f"w{min(r.randrange(40), r.randrange(40))}" for _ in range(n))
    left = [(k, some(r.randrange(30))) for k in range(80)] + [(90, None), (91, ""), (92, "W1 w1. w2"), (93, "unknown")]
    right = [(k, some(r.randrange(12))) for k in range(25)] + [(30, None), (31, "w1 w2"), (32, "w2 w1")]
    one, two = spark.createDataFrame(left, "a long, text string"), spark.createDataFrame(right, "b long, text string")
    of = lambda t: set(similarity.re.findall(similarity.TOKEN, (t or "").lower()))
    want = {(a, b): (len(of(t)), len(of(u)), len(of(t) & of(u))) for a, t in left for b, u in right if of(t) & of(u)}
    for n in (1, 4):
        got = similarity.shared_tokens(one, two, "a", "b", similarity.at_least(n)).collect()
        assert sorted((x["a"], x["b"], x["n_a"], x["n_b"], x["shared"]) for x in got) == sorted((*k, *v) for k, v in want.items() if v[2] >= n)
    got = {(x["a"], x["b"]): x["score"] for x in similarity.jaccard_join(one, two, "a", "b", 30).collect()}
    assert got == {k: s for k, (n, m, c) in want.items() if (s := int(100 * c / (n + m - c) + 0.5)) >= 30}
    monkeypatch.setattr(similarity, "SENT", 10_000)
    found = similarity.shared_tokens(one, two, "a", "b", similarity.at_least(1), best=True)
    best = {a: max((v[2], -b) for (x, b), v in want.items() if x == a) for a in {a for a, _ in want}}
    assert {x["a"]: (x["shared"], -x["b"]) for x in found.collect()} == best and best[92] == (2, -31)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Join", "Generate", "Exchange"))


def test_shared_tokens_without_a_right_side(spark):
    one, two = spark.createDataFrame([(1, "w1")], "a long, text string"), spark.createDataFrame([(2, None), (3, "")], "b long, text string")
    found = similarity.shared_tokens(one, two, "a", "b", similarity.at_least(1))
    assert found.columns == ["a", "b", "n_a", "n_b", "shared"] and found.count() == 0


def test_intersections_with_the_benchmark_are_counted_where_the_text_is(spark):
    from inkwell.queries import QUERIES

    from .conftest import DATA

    for name in ("U04_intersection_size", "J10_similarity_join"):
        plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Join", "Generate", "Exchange")), name


def test_worst_before_in_blocks(spark, monkeypatch):
    """Many blocks and windows, known and unknown tokens and many of one hash, copies, null and empty texts, keys of another kind; no row for a token or a pair leaves a task."""
    for name, value in (("KNOWN", 9), ("FIRST", 64), ("TOKENS", 150), ("SETS", 12), ("CELLS", 300)):
        monkeypatch.setattr(setpairs, name, value)
    r = random.Random(10)
    base = [[f"w{min(r.randrange(300), r.randrange(300))}" for _ in range(r.randrange(2, 60))] for _ in range(25)]
    texts = [None, "", "- a", *(" ".join(w if r.random() < 0.9 else f"n{r.randrange(99)}" for w in r.choice(base)) for _ in range(120))]
    texts += [r.choice(texts[3:]).upper() for _ in range(30)]
    r.shuffle(texts)
    of = [set(similarity.re.findall(similarity.TOKEN, (t or "").lower())) for t in texts]
    for least, key in ((48, lambda k: k), (58, lambda k: f"k{k:04d}"), (1, lambda k: -1000 + k)):
        df = spark.createDataFrame([(key(k), t) for k, t in enumerate(texts)], "id string, text string" if least == 58 else "id long, text string").repartition(3)
        got = {x["id"]: x["worst"] for x in similarity.worst_before(df, "id", least).collect()}
        scores = {k: [int(100 * len(a & b) / len(a | b) + 0.5) for b in of[:k] if a & b] for k, a in enumerate(of)}
        assert got == {key(k): max([s for s in v if s >= least], default=0) for k, v in scores.items()}, least
    plan = similarity.worst_before(df, "id", 48)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan


def test_worst_before_without_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id long, text string")
    assert sorted(map(tuple, similarity.worst_before(df, "id", 48).collect())) == [(1, 0), (2, 0)]
    assert similarity.worst_before(df.limit(0), "id", 48).collect() == []
