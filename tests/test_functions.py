"""Functions and operators that SQL can't check, on literal rows."""

from __future__ import annotations

import random
from collections import deque

from pyspark.sql import functions as F

from inkwell.functions import html as H
from inkwell.functions import jsons, privacy, text, web
from inkwell.operators import geometry, selection, similarity, upsert
from inkwell.queries import sorting, state, texts
from inkwell.streaming import limiter, windows


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("v")).first()["v"]


def redact(spark, texts, terms=()):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string")
    return [r["redaction"] for r in privacy.with_redaction(rows, "t", terms=terms).orderBy("k").collect()]


def test_redaction_order(spark):
    cases = {
        "mail a.b@c.co!": ("mail [EMAIL]!", {"email": 1}),
        "메일a@b.co": ("메일[EMAIL]", {"email": 1}),
        " .a@b.co": (" .[EMAIL]", {"email": 1}),
        "call 010-1234-5678": ("call [PHONE]", {"phone": 1}),
        "id 900101-1234567 and 110111-7654321": ("id [RESIDENT_ID] and [CORPORATE_ID]", {"registration": 2}),
        "biz 123-45-67890": ("biz [BUSINESS_ID]", {"registration": 1}),
        "card 4111 1111 1111 1111": ("card [CARD]", {"card": 1}),
        "card 4111 1111 1111 1112 no": ("card 4111 1111 1111 1112 no", {}),
        "계좌: 123456-78-901234": ("계좌: [ACCOUNT]", {"account": 1}),
        "담당자: 홍길동 님": ("담당자: [NAME] 님", {"name": 1}),
        "주소: 서울 어딘가 12\n다음": ("주소: [ADDRESS]\n다음", {"address": 1}),
        "Acme plan, ACME": ("[SENSITIVE] plan, [SENSITIVE]", {"custom": 2}),
        "배송지는 서울특별시 강남구 테헤란로 123이며 이전 주소는 부산광역시 해운대구 우동 456-7입니다.": ("배송지는 [ADDRESS]이며 이전 주소는 [ADDRESS]입니다.", {"address": 2}),
        "경기도 성남시 분당구 판교역로 166 101동, 강원도 홍천군 서면 산 12-3": ("[ADDRESS], [ADDRESS]", {"address": 2}),
        "한강로 12는 길 이름만": ("한강로 12는 길 이름만", {}),
        "기준일 2026-08-10, 환불계좌 110-123-456789, 결제카드 4111-1111-1111-1111": ("기준일 2026-08-10, 환불계좌: [ACCOUNT], 결제카드 [CARD]", {"account": 1, "card": 1}),
        None: ("", {}),
    }
    got = redact(spark, cases, ("acme", " a ", ""))
    want = {k: 0 for k in privacy.KINDS}
    assert [(r["text"], r["counts"].asDict(), r["total"]) for r in got] == [(t, want | n, sum(n.values())) for t, n in cases.values()]
    assert redact(spark, ["고객사 알파컴퍼니의 이전 전략", "알파컴퍼니 전략"], ("알파", "알파컴퍼니"))[0]["text"] == "고객사 [SENSITIVE]의 이전 전략"


def test_redaction_needs_no_python_workers(spark):
    rows = privacy.with_redaction(spark.createDataFrame([("card 4111 1111 1111 1111, 4111 1111 1111 1112",)], "t string"), "t")
    assert rows.first()["redaction"]["text"] == "card [CARD], 4111 1111 1111 1112"
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_risk_issues(spark):
    high, secret, named = privacy.HIGH_RISK[0], privacy.SECRET[0], privacy.NAMED[0]
    cases = {
        "외부 공유 금지 제안서": high, "INTERNAL use only": high, "the NDA holds": high, "calendar": None, "monday": None,
        "password: do-not-send": secret, "API key=1": secret, "비밀번호： x": secret, "password: [REDACTED]": None, "secret of the sea": None,
        "담당자명 홍길동": named, "고객명: [NAME]": None, "공개 블로그 원고": None,
    }
    rows = spark.createDataFrame([(x,) for x in cases], "t string")
    assert {r["t"]: r["i"] for r in rows.select("t", privacy.sensitive_issue(F.col("t")).alias("i")).collect()} == cases
    assert rows.where("t = '담당자명 홍길동'").select(privacy.high_risk_issue(F.col("t")).alias("i")).first()["i"] is None


def test_sanitizer_allows_and_drops():
    assert H.sanitize('<p onclick="x">a<script>b</script><a href="javascript:1" title="t">c</a><a href="/d">d</a>&amp;</p><iframe></iframe>') == '<p>a<a title="t">c</a><a href="/d">d</a>&amp;</p>'


def test_html_helpers(spark):
    assert one(spark, H.with_breaks(F.col("h")), h="<p a='1. 2'>One. Two! Three</p>") == "<p a='1. 2'>One.<br>Two!<br>Three</p>"
    assert one(spark, H.figures_to_marks(F.col("h")), h="a<figure>x</figure>b<figure>y</figure>") == "a[FIGURE 1]b[FIGURE 2]"
    hunks = one(spark, H.changes(F.col("a"), F.col("b")), a="one two three four five six seven eight", b="one 2 three four five six seven 8")
    assert [tuple(h) for h in hunks] == [("2", "one ", " three four f", 3), ("8", "ve six seven ", "", 5)]
    assert H.change_hunks("a\r\nb e\u0301\rc", "a\nb \u00e9\nc") == []
    merged = one(spark, H.merged_sections(F.col("h"), "h2", 5, 2), h="intro<h2>a</h2>bb<h2>c</h2>long enough<h2>d</h2>more text")
    assert "".join(merged) == "intro<h2>a</h2>bb<h2>c</h2>long enough<h2>d</h2>more text" and len(merged) == 2
    locked = spark.createDataFrame([("see http://x.y/1 and 20%",)], "t string").select(H.locked(F.col("t")).alias("l"))
    assert locked.select(H.restored(F.col("l"))).first()[0] == "see http://x.y/1 and 20%"


def test_bots_and_urls(spark):
    agents = {"GPTBot/1": "GPTBot", "Googlebot-News": "Googlebot-News", "x crawler": "Other bot", "Mozilla": None}
    rows = spark.createDataFrame([(a,) for a in agents], "a string").select("a", web.bot(F.col("a"))["name"].alias("n")).collect()
    assert {r["a"]: r["n"] for r in rows} == agents


def test_json_repair(spark):
    cases = {
        "none": None,
        '```json\n{"a": 2}\n```': '{"a":2}',
        ' {"a": "x"} ': '{"a":"x"}',
        'so: {"a": [1, 2]} and {"b": 1}': '{"a":[1,2]}',
        '{"a": "line\nbreak\tand {brace"} rest': '{"a":"line\\nbreak\\tand {brace"}',
        '[1, 2] tail': "[1,2]",
        '{"a": 1': None,
        '{"a": NaN}': None,
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", jsons.first_value(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == cases


def test_summary_cut(spark):
    assert one(spark, text.summary(F.col("t"), 20), t="word " * 10) == "word word word word…"


def test_union_area_against_raster(spark):
    r = random.Random(2)
    rects = [(k % 3, r.randrange(10) / 10, r.randrange(10) / 10, r.randrange(1, 5) / 10, r.randrange(1, 5) / 10) for k in range(40)]
    got = {x["deck"]: x["area"] for x in geometry.union_area(spark.createDataFrame(rects, "deck int, x double, y double, width double, height double"), "deck").collect()}
    for deck in range(3):
        cells = {(i, j) for d, x, y, w, h in rects if d == deck for i in range(round(x * 10), min(10, round((x + w) * 10))) for j in range(round(y * 10), min(10, round((y + h) * 10)))}
        assert abs(got[deck] - len(cells) / 100) < 1e-9


def test_hamming_join_finds_all(spark):
    r = random.Random(4)
    a = [(k, r.getrandbits(63)) for k in range(80)]
    b = [(k, h ^ sum(1 << i for i in r.sample(range(63), r.randint(0, 6)))) for k, h in a]
    got = {(x["a"], x["b"]) for x in similarity.hamming_join(spark.createDataFrame(a, "a long, h long"), spark.createDataFrame(b, "b long, h long"), "a", "b", "h", 4).collect()}
    assert got == {(i, j) for i, x in a for j, y in b if (x ^ y).bit_count() <= 4}


def test_greedy_selection_decays_sections(spark):
    rows = [(1, k, "s1", 100.0 - k) for k in range(4)] + [(1, 10, "s2", 70.0)]
    out = selection.diverse(spark.createDataFrame(rows, "deck long, index int, section string, score double"), "deck", 3)
    assert [r["index"] for r in out.orderBy("place").collect()] == [0, 10, 1]


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert sorted(map(tuple, upsert.last_wins(t, s, ["k"]).collect())) == [(1, "a"), (2, "x"), (3, "y")]
    assert sorted(map(tuple, upsert.first_wins(t, s, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "y")]
    twice = spark.createDataFrame([(3, "y"), (3, "w"), (2, "x"), (2, None)], "k int, v string")
    assert sorted(map(tuple, upsert.first_wins(t, twice, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "w")]
    assert sorted(map(tuple, upsert.first_wins(t, twice, ["k"], [F.desc("v")]).collect())) == [(1, "a"), (2, "b"), (3, "y")]
    assert sorted(map(tuple, upsert.last_wins(t, twice, ["k"]).collect())) == [(1, "a"), (2, "x"), (3, "y")]
    null = spark.createDataFrame([(2, None), (4, None)], "k int, v string")
    assert sorted(map(tuple, upsert.update_columns(t, null, ["k"], ["v"]).collect())) == [(1, "a"), (2, None), (4, None)]


def test_edits_are_shortest():
    r = random.Random(6)
    for _ in range(200):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 12))) for _ in range(2))
        way, i, j, out = H.edits(a, b), 0, 0, ""
        for step in way:
            if step == "=":
                assert a[i] == b[j]
            i, j, out = i + (step != "+"), j + (step != "-"), out + (b[j] if step != "-" else "")
        row = list(range(len(b) + 1))  # distance without substitutions
        for x in a:
            last, row[0] = row[:], row[0] + 1
            for k, y in enumerate(b, 1):
                row[k] = last[k - 1] if x == y else 1 + min(last[k], row[k - 1])
        assert (i, j, out) == (len(a), len(b), b) and len(way) - way.count("=") == row[-1]
    assert H.edits("a" * 300, "b" * 300) is None and H.change_hunks("a" * 300, "b" * 300) is None
    assert H.change_hunks("same", "same") == []


def test_regions_are_stripped(spark):
    assert one(spark, text.core_topic(F.col("t")), t="부산테크노파크 시제품 제작지원!") == one(spark, text.core_topic(F.col("t")), t="울산 창조경제혁신센터 시제품 제작지원") == "시제품 제작지원"
    assert one(spark, text.without_regions(F.col("t")), t="서울특별시  지원 사업") == "지원 사업"


def test_similarity_joins_against_brute_force(spark):
    r = random.Random(12)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(r.choices(words, weights=range(30, 0, -1), k=r.randint(0, 14))) for _ in range(80)] + ["w1 w2 w3 w4"] * 5
    sets = [set(t.split()) for t in texts]
    score = lambda x, y: int(100 * len(x & y) / len(x | y) + 0.5) if x and y else 0
    df = spark.createDataFrame(list(enumerate(texts)), "a long, text string")
    for least in (30, 58):
        got = {(x["a"], x["b"]): x["score"] for x in similarity.jaccard_join(df, df.withColumnRenamed("a", "b"), "a", "b", least).collect()}
        assert got == {(i, j): score(x, y) for i, x in enumerate(sets) for j, y in enumerate(sets) if score(x, y) >= least}
        worst = {x["a"]: x["worst"] for x in similarity.worst_before(df, "a", least).collect()}
        want = {i: max((score(x, sets[j]) for j in range(i)), default=0) for i, x in enumerate(sets)}
        assert worst == {i: w if w >= least else 0 for i, w in want.items()}
    got = {(x["a"], x["b"], x["shared"]) for x in similarity.shared_tokens(df, df.withColumnRenamed("a", "b"), "a", "b", similarity.at_least(4)).collect()}
    assert got == {(i, j, len(x & y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if len(x & y) >= 4}


def test_merged_intervals_with_ties(spark):
    rows = [(1, 0, 5, 1), (1, 0, 5, 2), (1, 0, 5, 3), (1, 6, 7, 4), (1, 5, 6, 5), (2, 1, 2, 6)]
    out = geometry.merge_intervals(spark.createDataFrame(rows, "k int, a int, b int, t int"), ["k"], "a", "b", ["t"])
    assert sorted(map(tuple, out.collect())) == [(1, 0, 7, 5), (2, 1, 2, 1)]


def test_rate_limiter_batch_and_stream_agree(spark, tmp_path):
    r = random.Random(1)
    hits = [(f"u{r.randrange(3)}", k, k * 400) for k in range(60)]
    df = spark.createDataFrame(hits, "key string, event_id long, at_ms long")
    batch = sorted(map(tuple, limiter.limited(df, "event_id", 5, 10_000).collect()))
    recent, want = {}, []
    for key, i, at in hits:
        want.append((key, i, *limiter._check(recent.setdefault(key, deque()), at, 5, 10_000)))
    assert batch == sorted(want)
    df.write.parquet(str(tmp_path / "in"))
    stream = limiter.limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "event_id", 5, 10_000)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == batch


def test_append_log_and_daily_windows(spark, tmp_path):
    rows = spark.range(50).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 7200).alias("ts"), F.lit("view").alias("event_type"))
    rows.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    windows.append_log(read(), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 50
    q = windows.daily(read()).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("daily").agg(F.sum("n")).first()[0] == 50


def test_distinct_titles_in_rounds(spark, monkeypatch):
    r = random.Random(9)
    rows = [(f"s{k % 2}" if k % 9 else None, k, " ".join(r.choices("abcdef", k=r.randint(0, 3))) or None, r.randint(0, 3)) for k in range(300)]
    rows += [("s0", 300 + k, "a b c", 9) for k in range(50)] + [("s1", 400, None, 9)] * 2
    want = []
    for key in ("s0", "s1", None):
        kept = []
        for _, doc, title, _ in sorted((x for x in rows if x[0] == key), key=lambda x: (-x[3], x[1])):
            words = set((title or "").split())
            if len(kept) < 12 and all(len(words & w) < 0.5 * max(1, len(words | w)) for w in kept):
                kept.append(words)
                want.append((key, doc))
    df = spark.createDataFrame(rows, "source string, doc_id long, title string, score int")
    for block in (7, 1000):
        monkeypatch.setattr(selection, "BLOCK", block)
        assert sorted(map(repr, map(tuple, selection.distinct_titles(df, "source", 12, 0.5).collect()))) == sorted(map(repr, want))


def test_queries_without_sql_cover_all_rows(spark):
    docs = [(k, f"{chr(97 + k % 26)}{k} only", "long" if k % 2 else "other") for k in (1, 2, 399, 400, 90_001)]

    class Rows:
        articles = spark.createDataFrame([(k, t, t, s) for k, t, s in docs], "doc_id long, title string, body string, source string")
        pages = spark.createDataFrame([(1, "x" * 5000 + "&amp;")], "page_id long, html string")
        labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")

    assert {r["doc_id"] for r in sorting.w11(Rows).collect()} == {r["doc_id"] for r in state.t11(Rows).collect()} == {d[0] for d in docs}
    assert texts.fs03(Rows).first()["html"] == "x" * 5000 + "&"


def test_rate_limiter_streams_through_a_key(spark):
    r = random.Random(4)
    rows = [(r.choice(("a", "a", "b", None)), k, r.randint(0, 3000)) for k in range(200)]
    want = {}
    for key in ("a", "b", None):
        recent = deque()
        for _, k, at in sorted((x for x in rows if x[0] == key), key=lambda x: (x[2], x[1])):
            want[k] = (key, *limiter._check(recent, at, 3, 500))
    out = limiter.limited(spark.createDataFrame(rows, "key string, id long, at_ms long"), "id", 3, 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {x["id"]: (x["key"], x["allowed"], x["retry_after"]) for x in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
