"""Linters, manifests, approvals, retention, staged jobs and SQL functions, on literal rows and against plain Python."""

from __future__ import annotations

import json
import re

import pytest
import regex
from pyspark.sql import functions as F

import inkwell.sql
from inkwell.functions import html as H
from inkwell.functions import style as Y
from inkwell.functions import text as T
from inkwell.operators import manifests as M
from inkwell.operators import queue as Q
from inkwell.plans import jobs as J
from inkwell.plans.stages import StagedJob, generation_id
from inkwell.queries import QUERIES
from inkwell.queries.texts import generated
from inkwell.sources.views import Tables

from .conftest import DATA

ENDS = regex.compile(r"(?:(?<![\p{L}\p{N}])\.|\.(?![\p{L}\p{N}])|[!?。？！])+(?:[\"'”’」』)\]]*)?\s*", regex.A)


def squeeze(t):
    return regex.sub(T.SPACE + "+", " ", t).strip(" ")


def visible(t):
    for p in (r"(?i)<br\s*/?>", "<[^>]+>", "(?i)&(?:nbsp|amp|lt|gt|quot|#39);"):
        t = re.sub(p, " ", t)
    return squeeze(t)


def lengths(t):
    n = [len(regex.sub(T.SPACE, "", s)) for s in ENDS.split(visible(t))]
    return [x for x in n if x]


def bare(t):
    t = (t or "").strip()
    if m := re.match(r"(?is)^<strong>\s*[QA]\s*[.．:：]\s*(.*?)</strong>$", t):
        return m[1].strip()
    return re.sub(r"(?i)^\s*(?:<strong>\s*)?[QA]\s*[.．:：]\s*(?:</strong>\s*)?", "", t).strip()


def friendly(body, faq, lively):
    plain = squeeze(re.sub("<[^>]+>", " ", body))
    n = lambda pattern, t=body: len(re.findall(pattern, t))
    worn = [m for p in Y.CLICHES for m in re.findall(p, plain)]
    thrice = [f"{e}({plain.count(e)}회)" for e in Y.ENDINGS if plain.count(e) > 2]
    samples = [*list(dict.fromkeys(worn))[:5], *thrice][:5]
    paragraphs, strong, shouts, asks = n(r"(?i)<p[\s>]"), n(r"(?i)<strong[\s>]"), n("[!！]", plain), n("[?？]", plain)
    long = sum(x > 100 for x in lengths(body))
    questions, answers = [lengths(visible(bare(q))) for q, _ in faq], [visible(bare(a)) for _, a in faq]
    rules = {
        "본문 핵심어 볼드가 부족합니다.": strong < sorted((3, paragraphs // 3, 5))[1],
        "본문 볼드가 너무 많습니다.": 0 < 2 * paragraphs < strong,
        "AI 상투 표현이 반복됩니다." + f" ({', '.join(samples)})" * bool(samples): worn or sum(map(plain.count, Y.ENDINGS)) > 2,
        "독자에게 말을 거는 질문이나 느낌표가 한 번도 없습니다. 규칙대로 자연스럽게 섞어 주세요.": lively and shouts + asks == 0,
        f"느낌표가 {shouts}회입니다. 4회 이하로 줄여 주세요.": shouts >= 5,
        f"질문이 {asks}회입니다. 3회 안팎으로 줄여 주세요.": asks >= 7,
        "숫자를 앞세운 목록 문단이 없습니다. '확인할 세 가지'처럼 소제목에 숫자를 쓰고 항목을 나눠 주세요.": lively and n(r"(?i)<[ou]l[\s>]") + n(Y.NUMBERED) == 0,
        f"100자를 넘는 긴 문장이 {long}개 있습니다. 한 문장에 한 가지 내용만 남겨 나누세요.": long,
        "FAQ 질문은 하나의 문장으로 작성하세요.": {len(x) for x in questions} - {1},
        "FAQ 답변은 결론부터 1~2문장, 최대 180자로 작성하세요.": [a for a in answers if len(lengths(a)) not in (1, 2) or len(regex.sub(T.SPACE, "", a)) > 180],
    }
    return [message for message, holds in rules.items() if holds]


def publication(body, faq, urls, portfolio):
    if not (body or "").strip():
        return ["검수할 본문이 없습니다."]
    found = friendly(body, faq, True)
    if not 3 <= len(faq) <= 4:
        found.append("FAQ는 3~4개로 구성하세요.")
    if not portfolio and len({re.sub("#.*$", "", u.strip()) for u in urls if re.match(r"(?i)https?://[^\s/?#]", u.strip())}) < 2:
        found.append("본문 하단에 표시할 공개 출처가 2개 미만입니다.")
    return list(dict.fromkeys(found))


def draft(title, summary, body, faq):
    plain = squeeze(re.sub("<[^>]+>", " ", re.sub("(?is)<style.*?</style>", " ", re.sub("(?is)<script.*?</script>", " ", body))))
    n, h, p = len(regex.sub(T.SPACE, "", plain)), len(re.findall(r"(?i)<h2[\s>]", body)), len(re.findall(r"(?i)<p[\s>]", body))
    pages = len(re.findall(r"(?i)(?:slide|슬라이드|page|페이지)\s*(?:no\.?\s*)?[0-9]+", plain))
    return [
        *[f"본문이 {n}자로 짧음"] * (n < 2500), *[f"본문이 {n}자로 김"] * (n > 3500), *[f"H2가 {h}개뿐임"] * (h < 5), *[f"설명 문단이 {p}개뿐임"] * (p < 12), *[f"FAQ가 {len(faq)}개뿐임"] * (len(faq) < 4),
        *publication(body, faq, [], True), *[f"내부 슬라이드·페이지 번호가 {pages}곳 노출됨"] * bool(pages), *["제목 누락"] * (not (title or "").strip()), *["요약 누락"] * (not (summary or "").strip()),
    ]


def test_linters_on_whole_pages(spark):
    rows = generated(Tables(spark, str(DATA))).collect()
    pairs = {r["page_id"]: [tuple(f) for f in r["faq"]] for r in rows}
    run = lambda name: {r["page_id"]: list(r["issues"]) for r in QUERIES[name](spark, str(DATA)).collect()}
    assert run("FS31_style_issues") == {r["page_id"]: friendly(r["body"], pairs[r["page_id"]], False) for r in rows}
    assert run("FS32_publication_issues") == {r["page_id"]: publication(r["body"], pairs[r["page_id"]], r["urls"], r["page_id"] % 7 == 0) for r in rows}
    breaks = lambda t: "".join(p if p.startswith("<") else re.sub(r"([.!?])\s+(?=\S)", r"\1<br>", p) for p in re.split("(<[^>]*>)", t))
    want = {r["page_id"]: draft(r["title"], r["summary"], breaks(H.sanitize(r["body"])), pairs[r["page_id"]]) for r in rows}
    assert run("FS50_draft_lint") == want


def test_linters_on_literals(spark):
    good = "<h2>확인할 세 가지</h2>" + "".join(f"<p>짧은 <strong>문장</strong>입니다. 어떤가요?</p>" for _ in range(3))
    cases = [
        (good, [("Q. 무엇인가요?", "A. 이것입니다.")] * 3, ["https://a.kr/1#x", "https://a.kr/1", " http://b.kr "]),
        (good, [("<strong>Q: 하나. 둘?</strong>", "가" * 181)] * 5, ["https://a.kr", "ftp://b.kr"]),
        ("<p>오늘날 단순한 도구를 넘어 " + "가" * 120 + ". 중요합니다! 중요합니다! 중요합니다!!!</p>" + "<p>?" * 8, [], []),
        ("  ", [], []),
        (None, [("", "")], []),
    ]
    rows = spark.createDataFrame([(k, b, [{"question": q, "answer": a} for q, a in f], u) for k, (b, f, u) in enumerate(cases)], "k int, body string, faq array<struct<question:string,answer:string>>, urls array<string>")
    got = {r["k"]: list(r["i"]) for r in rows.select("k", Y.publication_issues(F.col("body"), F.col("faq"), F.col("urls"), F.lit(False)).alias("i")).collect()}
    assert got == {k: publication(*c, False) for k, c in enumerate(cases)}
    assert got[0] == [] and len(got[1]) == 4 and len(got[2]) >= 6


def test_manifests(spark):
    region = lambda i, **x: {"slideIndex": i, "type": "logo", "label": "local_logo", "x": 0.1, "y": 0.2, "width": 0.3, "height": 0.4} | x
    slide = lambda i, **x: {"slideIndex": i, "sourceSlideNumber": i + 1, "inspectionStatus": "verified", "regions": [region(i)]} | x

    def manifest(n=5, slides=None, **x):
        return json.dumps({"version": 2, "method": M.METHOD, "sourceSlideCount": n, "slideCount": n, "slides": slides or [slide(i) for i in range(n)]} | x)

    put = lambda i, s: [s if k == i else slide(k) for k in range(5)]
    many = [slide(i, regions=[region(i)] * 1999) for i in range(11)]
    e = M.ERRORS
    cases = [
        (manifest(), 5, None), (manifest(4), 4, e["expected"]), ("{", 5, e["missing"]), (None, 5, e["missing"]), ("[1]", 5, e["missing"]), (manifest(version=1), 5, e["version"]), (manifest(version="2"), 5, e["version"]),
        (manifest(method="x"), 5, e["method"]), (manifest(sourceSlideCount=4), 5, e["source_count"]), (manifest(sourceSlideCount=5.5), 5, e["source_count"]), (manifest(sourceSlideCount=10_001), 5, e["source_count"]),
        (manifest(slideCount=6), 5, e["count"]), (manifest(slides={"a": 1}), 5, e["count"]), (manifest(slides=[slide(0)]), 5, e["cover"]),
        (manifest(slides=put(2, slide(2, sourceSlideNumber=2))), 5, e["slide"].format(2)), (manifest(slides=put(1, slide(1, sourceSlideNumber=9))), 5, e["slide"].format(1)), (manifest(slides=put(3, slide(3, inspectionStatus="x"))), 5, e["slide"].format(3)),
        (manifest(slides=put(0, slide(0, slideIndex=1))), 5, e["slide"].format(0)), (manifest(slides=put(4, slide(4, regions=[region(4)] * 2001))), 5, e["slide"].format(4)), (manifest(slides=put(4, slide(4, regions=None))), 5, e["slide"].format(4)), (manifest(slides=put(4, 7)), 5, e["slide"].format(4)),
        (manifest(slides=put(1, slide(1, regions=[region(1), region(1, label="local_table")]))), 5, e["region"].format(1)), (manifest(slides=put(1, slide(1, regions=[region(1, x=0.8)]))), 5, e["region"].format(1)), (manifest(slides=put(1, slide(1, regions=[region(1, width=0.001)]))), 5, e["region"].format(1)),
        (manifest(slides=put(1, slide(1, regions=[region(1, x="0.1")]))), 5, e["region"].format(1)), (manifest(slides=put(1, slide(1, regions=[region(2)]))), 5, e["region"].format(1)), (manifest(slides=put(1, slide(1, regions=[]))), 5, None),
        (manifest(11, slides=many), 11, e["regions"]), (manifest(10, slides=many[:10]), 10, None),
    ]
    rows = spark.createDataFrame([(k, b, n) for k, (b, n, _) in enumerate(cases)], "k int, body string, n int")
    got = {r["k"]: r["error"] for r in M.first_manifest_error(rows, "k", "body", "n").collect()}
    assert got == {k: c[2] for k, c in enumerate(cases)}
    issues = M.manifest_issues(rows.where("k = 21"), "k", "body", "n").collect()
    assert [(r["path"], r["code"]) for r in issues] == [("$.slides[1].regions[1]", "region")]


def test_approvals(spark):
    approvals = spark.createDataFrame([("a", 0, 10, {"x": "1", "y": "2"}), ("b", 0, 5, {}), ("b", 6, 16, {"x": "1"})], "operation string, created int, expires int, payload map<string,string>")
    asked = [(1, "a", 3, {"x": "2"}), (2, "a", 4, {"x": "1"}), (3, "a", 4, {"x": "1", "y": "2"}), (4, "a", 10, {"x": "1"}), (5, "b", 5, {"x": "1"}), (6, "b", 6, {"x": "1"}), (7, "none", 1, {}), (8, "a", 5, {"z": None})]
    got = {r["request"]: r["outcome"] for r in Q.consume_approvals(approvals, spark.createDataFrame(asked, "request int, operation string, at int, payload map<string,string>")).collect()}
    assert got == {1: "mismatch", 2: "consumed", 3: "used", 4: "expired", 5: "unknown", 6: "consumed", 7: "unknown", 8: "mismatch"}


def test_retention_goes_by_guard_age_and_batch(spark):
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    rows = spark.createDataFrame([(k, k % 2 == 0, f"2024-01-{k + 1:02d}") for k in range(20)] + [(99, True, None)], "id int, done boolean, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    rules = (J.RetentionRule("r", "t", "delete_rows", 20, "at", F.col("done"), 3), J.RetentionRule("all", "t", "clear_fields", 25, "at"))
    assert sorted(tuple(x) for x in J.retention({"t": rows}, rules, now).collect()) == sorted([("r", "delete_rows", k) for k in (0, 2, 4)] + [("all", "clear_fields", k) for k in range(6)])
    assert sorted(tuple(x) for x in J.retention_report({"t": rows}, rules, now).collect()) == [("all", 6, 6, 0), ("r", 6, 3, 3)]


def test_a_job_killed_after_any_stage_ends_the_same(spark, tmp_path):
    calls = []

    def stages(dies_in=None):
        def make(name, f):
            def run(spark, before):
                calls.append(name)
                out = f(spark, before)
                if dies_in == name:
                    out = out.select(F.raise_error(F.lit("killed")).cast("long").alias("id"))
                return out

            return name, run

        return [make("read", lambda s, _: s.range(100)), make("double", lambda s, d: d.select((F.col("id") * 2).alias("id"))), make("keep", lambda s, d: d.where("id % 3 = 0"))]

    for name in ("read", "double", "keep"):
        home = f"{tmp_path}/{name}"
        with pytest.raises(Exception, match="killed"):
            StagedJob(spark, home, "g", stages(name)).run()
        calls.clear()
        job = StagedJob(spark, home, "g", stages())
        assert sorted(r["id"] for r in job.run().collect()) == [k for k in range(0, 200, 2) if k % 3 == 0]
        assert calls == ["read", "double", "keep"][["read", "double", "keep"].index(name) :] and len(job.done()) == 3
    calls.clear()
    assert StagedJob(spark, home, "g", stages()).run().count() == 34 and calls == []
    assert StagedJob(spark, home, generation_id("other", 2), stages()).run(deadline=0) is None and calls == []
    assert generation_id("a", "b") != generation_id("ab", "") and len(generation_id(1)) == 16


def test_functions_in_sql(spark):
    inkwell.sql.register(spark)
    spark.createDataFrame([(1, '<a href="/x">One &amp; two</a><p>t</p><a title="T" href=y>z</a><a name=q>n</a><a href="/last">open'), (2, None)], "id int, html string").createOrReplaceTempView("some_pages")
    got = [tuple(r) for r in spark.sql("SELECT id, l.* FROM some_pages, LATERAL html_links(html) l ORDER BY id, place").collect()]
    assert got == [(1, 0, "/x", "One & two"), (1, 1, "y", "T"), (1, 2, "/last", "open")]
    hunks = spark.sql("SELECT h.* FROM LATERAL diff_hunks('one two three four five six seven eight', 'one 2 three four five six seven 8') h").collect()
    assert [(r["place"], r["changed"], r["removed"]) for r in hunks] == [(0, "2", 3), (1, "8", 5)]
    assert [r[0] for r in spark.sql("SELECT risk_issue(x) FROM VALUES ('the NDA'), ('고객명: 홍길동'), ('fine') v(x)").collect()][2] is None
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    pages.createOrReplaceTempView("all_pages")
    want = {(r["page_id"], h) for r in pages.collect() for h in re.findall(r'<a href="([^"]*)"', r["html"])}
    assert {tuple(r) for r in spark.sql("SELECT page_id, l.href FROM all_pages, LATERAL html_links(html) l").collect()} == want


def plain_metadata(m):
    """The rules over one parsed document, as a table of messages."""
    sha = lambda x: bool(re.fullmatch("(?i)[a-f0-9]{64}", x or ""))
    good = lambda xs: [x for x in xs or [] if x >= 0]
    html, mock, proof = (m.get("generated") or {}).get("bodyHtml") or "", m.get("portfolioMockup") or {}, m.get("redactionProof") or {}
    mode, n, raw = mock.get("mode"), mock.get("bodyBoardCount"), mock.get("selectedSlideIndexes") or []
    lists = {kind: [a.get("slideIndexes") or [] for a in m.get("portfolioAssets") or [] if a["kind"] == kind] for kind in ("thumbnail", "body_image")}
    every, boards = [*lists["thumbnail"], *lists["body_image"]], lists["body_image"]
    rendered, flat = {x for xs in every for x in good(xs)}, [x for xs in boards for x in good(xs)]
    bad = lambda xs: not xs or len(set(good(xs))) < len(xs)
    figures, images = len(re.findall(r"(?i)<figure[\s>]", html)), re.findall(r"(?i)<img\b[^>]*>", html)
    least = {"short_psd": 4, "six_grid": n if n in (3, 4, 5) else 3}.get(mode, 5)
    plain = lambda u: u.replace("&amp;", "&")
    shown = sorted(plain(x) for x in re.findall(r"""(?i)<img\b[^>]*\bsrc\s*=\s*["']([^"']+)["'][^>]*>""", html))
    urls = sorted(plain(a["url"]) for a in m.get("portfolioAssets") or [] if a["kind"] == "body_image" and a.get("url"))
    traces = [0 <= s["changedPixelRatio"] <= 1 and sha(s["sourceHash"]) and sha(s["redactedHash"]) and (s["regionCount"] > 0) == (s["changedPixelRatio"] > 0) == (s["sourceHash"] != s["redactedHash"]) for s in proof.get("slides") or []]
    source = m.get("portfolioSourceFingerprint") or ""
    bound = [proof.get("version"), proof.get("method"), proof.get("verified"), proof.get("sourceFingerprint")] == [2, M.METHOD, True, source] and sha(proof.get("manifestHash"))
    slides = sorted(s["slideIndex"] for s in proof.get("slides") or [])
    table = {
        "선정 장표 기록이 비어 있어 포트폴리오 자산을 검증할 수 없습니다.": not good(raw),
        "대표 썸네일과 본문 목업에 연결된 렌더링 장표 기록이 비어 있습니다.": not rendered,
        "대표 썸네일과 모든 본문 목업은 비어 있지 않은 고유 장표 인덱스를 가져야 합니다.": not every or any(map(bad, every)),
        "현재 원본과 일치하는 포트폴리오 목업 생성 기록이 없습니다.": not sha(source),
        "현재 포트폴리오 템플릿·기밀 규칙으로 다시 만든 기록이 없습니다.": m.get("portfolioRuleVersion") != "2026-08-05-public-visual-overrides-v9",
        "현재 포트폴리오 디자인 세대 기록이 없습니다.": not m.get("portfolioGenerationId"),
        "짧은 문서는 본문 목업 4장이 모두 확인되어야 합니다.": mode == "short_psd" and n != 4,
        "긴 문서는 중복 없는 6장 묶음의 본문 목업 3~5장이 확인되어야 합니다.": mode == "six_grid" and n not in (3, 4, 5),
        "포트폴리오 목업 제작 방식을 확인할 수 없습니다.": mode not in ("short_psd", "six_grid"),
        "기밀 블러 검수를 통과하지 않았습니다.": mock.get("redactionStatus") != "verified",
        "현재 원본에 연결된 선택적 가림 proof v2가 완전하지 않습니다.": not (bound and rendered and slides == sorted(rendered) and all(traces)),
        f"본문용 다중 페이지 목업이 {least}개 미만입니다.": figures < least,
        "본문 이미지는 모두 figure 안에 배치해야 합니다.": figures != len(images),
        "본문 이미지가 설명 없이 연속으로 배치되어 있습니다.": re.search(r"(?i)</figure>\s*<figure[\s>]", html),
        "이미지는 관련 설명 문단 다음에 배치해야 합니다.": figures and not re.search(r"(?is)<p[\s>].*?</p>\s*<figure[\s>]", html),
        f"본문 figure 수가 목업 기록 {n}장과 일치하지 않습니다.": n not in (None, figures),
        f"저장된 본문 목업 자산 수가 기록 {n}장과 일치하지 않습니다.": n not in (None, len(boards)),
        "본문 목업 장표는 자산별 고유 인덱스로 구성되어야 하며 긴 문서는 자산마다 정확히 6장이어야 합니다.": any(map(bad, boards)) or len(set(flat)) < len(flat) or mode == "six_grid" and ({len(good(xs)) for xs in boards} - {6} or n is not None and len(flat) != 6 * n),
        "선정 장표 기록과 실제 본문 목업 자산의 장표 구성이 일치하지 않습니다.": len(set(good(raw))) < len(raw) or set(raw) != set(flat),
        "본문 이미지 URL이 현재 기밀 블러 검수를 통과한 목업 자산과 일치하지 않습니다.": shown != urls,
    }
    return [message for message, holds in table.items() if holds]


def test_portfolio_metadata(spark):
    from inkwell.functions import portfolio as G
    from inkwell.queries.filters import portfolio_metadata

    texts = {r["l_orderkey"]: r["metadata"] for r in portfolio_metadata(Tables(spark, str(DATA))).collect()}
    got = {r["l_orderkey"]: list(r["issues"]) for r in QUERIES["P31_metadata_issues"](spark, str(DATA)).collect()}
    assert got == {k: plain_metadata(json.loads(v)) for k, v in texts.items()}
    assert [] in got.values() and len({x for v in got.values() for x in v}) >= 15
    odd = ["{}", '{"portfolioMockup": {"mode": "six_grid", "bodyBoardCount": 4, "selectedSlideIndexes": [1, -2]}, "portfolioAssets": [{"kind": "body_image", "url": null, "slideIndexes": null}, {"kind": "other"}]}']
    rows = spark.createDataFrame([(x,) for x in odd], "m string")
    assert {r["m"]: list(r["i"]) for r in rows.select("m", G.metadata_issues(F.from_json("m", G.METADATA)).alias("i")).collect()} == {x: plain_metadata(json.loads(x)) for x in odd}


def test_rules_read_their_json_once(spark):
    """A manifest is judged in its row, without joins; metadata stands in the plan once."""
    from inkwell.functions import portfolio as G

    rows = spark.createDataFrame([(1, "{}", 5)], "k long, body string, n int")
    assert "Exchange" not in M.first_manifest_error(rows, "k", "body", "n")._jdf.queryExecution().executedPlan().toString()
    found = rows.select(G.metadata_issues(F.from_json("body", G.METADATA)).alias("i"))
    assert found._jdf.queryExecution().analyzed().toString().count("from_json(") == 1
