"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import portfolio as G
from inkwell.functions import dates as D
from inkwell.functions import web as W
from inkwell.operators import rules, selection
from inkwell.queries import query

TS = lambda text: F.lit(text).cast("timestamp_ntz")
_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '')"


@query("P01_tests", "SELECT id FROM work_items WHERE channel = 'blog' AND status <> 'planned' AND format IN ('case', 'news') AND url IS NOT NULL")
def p01(t):
    return t.work_items.where((F.col("channel") == "blog") & (F.col("status") != "planned") & F.col("format").isin("case", "news") & F.col("url").isNotNull()).select("id")


@query("P02_closed_range", "SELECT id FROM traffic WHERE accessed_at >= TIMESTAMP '2024-01-10' AND accessed_at <= TIMESTAMP '2024-01-12'")
def p02(t):
    return t.traffic.where(F.col("accessed_at").between(TS("2024-01-10"), TS("2024-01-12"))).select("id")


@query("P03_half_open_range", "SELECT id FROM traffic WHERE accessed_at >= TIMESTAMP '2024-01-10' AND accessed_at < TIMESTAMP '2024-01-12'")
def p03(t):
    return t.traffic.where((F.col("accessed_at") >= TS("2024-01-10")) & (F.col("accessed_at") < TS("2024-01-12"))).select("id")


@query("P04_due", "SELECT id FROM jobs WHERE lease_expires_at IS NULL OR lease_expires_at <= TIMESTAMP '1998-01-01'")
def p04(t):
    return t.jobs.where(F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= TS("1998-01-01"))).select("id")


@query("P05_array_contains", "SELECT conv_id FROM conversations GROUP BY 1 HAVING list_contains(list(role), 'system')")
def p05(t):
    return t.conversations.groupBy("conv_id").agg(F.collect_set("role").alias("roles")).where(F.array_contains("roles", "system")).select("conv_id")


@query("P06_json_contains", "SELECT event_id FROM events WHERE props->>'$.k' = '42'")
def p06(t):
    return t.events.where(rules.json_contains(F.col("props"), {"k": 42})).select("event_id")


@query("P07_json_null", "SELECT count(*) FILTER (props->>'$.k' IS NULL) AS no_k, count(*) FILTER (props->>'$.m' IS NULL) AS no_m FROM events")
def p07(t):
    return t.events.agg(F.count_if(F.get_json_object("props", "$.k").isNull()).alias("no_k"), F.count_if(F.get_json_object("props", "$.m").isNull()).alias("no_m"))


@query("P08_json_path", "SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events")
def p08(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("P09_ilike", "SELECT doc_id FROM documents WHERE text ILIKE '%All rights%'")
def p09(t):
    return t.documents.where(F.col("text").ilike("%All rights%")).select("doc_id")


@query("P10_regex", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}')")
def p10(t):
    return t.documents.where(F.col("text").rlike("[0-9]{3}-[0-9]{4}")).select("doc_id")


@query("P11_optional_predicates", "SELECT id FROM work_items WHERE channel = 'column' AND created_at >= TIMESTAMP '1999-01-01'")
def p11(t):
    asked = {"channel": "column", "status": None, "since": "1999-01-01"}
    return rules.where_given(t.work_items, {"channel": asked["channel"], "status": asked["status"]}, {"created_at": TS(asked["since"]) if asked["since"] else None}).select("id")


@query("P12_patch_columns", "SELECT s_suppkey, 'new' AS s_name, s_acctbal FROM supplier")
def p12(t):
    return rules.patched(t.supplier, {"s_name": "new", "s_suppkey": 5}, allowed=("s_name", "s_acctbal")).select("s_suppkey", "s_name", "s_acctbal")


@query("P13_published", "SELECT id FROM work_items WHERE status = 'published' AND published_at <= TIMESTAMP '2000-01-01'")
def p13(t):
    return t.work_items.where((F.col("status") == "published") & (F.col("published_at") <= TS("2000-01-01"))).select("id")


_FORM = "SELECT doc_id, text, quality, toxic, source FROM documents LEFT JOIN labels USING (doc_id)"


def _form(t):
    return t.documents.join(t.labels, "doc_id", "left")


@query("P14_release_ready", f"SELECT doc_id, coalesce(quality = 1 AND toxic = 0, false) AND length(text) >= 200 AS ready FROM ({_FORM})")
def p14(t):
    return _form(t).select("doc_id", (F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)) & (F.length("text") >= 200)).alias("ready"))


@query("P15_blockers", f"SELECT doc_id, CASE WHEN quality IS NULL THEN 'not_reviewed' ELSE array_to_string(list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN length(text) < 200 THEN 'too_short' END], lambda x: x IS NOT NULL), ',') END AS blockers FROM ({_FORM})")
def p15(t):
    found = rules.issues({"toxic": F.col("toxic") == 1, "low_quality": F.col("quality") == 0, "too_short": F.length("text") < 200})
    return _form(t).select("doc_id", F.when(F.col("quality").isNull(), "not_reviewed").otherwise(F.array_join(found, ",")).alias("blockers"))


@query("P16_should_generate", "SELECT id, status IN ('planned', 'approved') AND channel <> 'portfolio' AND url IS NULL AS generate FROM work_items")
def p16(t):
    return t.work_items.select("id", (F.col("status").isin("planned", "approved") & (F.col("channel") != "portfolio") & F.col("url").isNull()).alias("generate"))


@query("P17_evidence", "SELECT id, coalesce(nullif(url, ''), published_at::VARCHAR) IS NOT NULL AS published FROM work_items")
def p17(t):
    return t.work_items.select("id", F.coalesce(F.nullif("url", F.lit("")), F.col("published_at").cast("string")).isNotNull().alias("published"))


@query("P18_needs_rewrite", f"SELECT doc_id, coalesce(quality, 0) <> 1 OR substr(sha256(text), 1, 1) < '4' AS rewrite FROM ({_FORM})")
def p18(t):
    return _form(t).select("doc_id", ((F.coalesce("quality", F.lit(0)) != 1) | (F.substring(F.sha2("text", 256), 1, 1) < "4")).alias("rewrite"))


@query("P19_first_issue", "SELECT doc_id, CASE WHEN length(trim(text)) < 50 THEN 'too_short' WHEN NOT regexp_matches(text, '[.!?]') THEN 'no_sentence' WHEN regexp_matches(text, '^[^a-z]*$') THEN 'shouting' END AS issue FROM documents")
def p19(t):
    text = F.col("text")
    return t.documents.select("doc_id", rules.first_issue({"too_short": F.length(F.trim(text)) < 50, "no_sentence": ~text.rlike("[.!?]"), "shouting": text.rlike("^[^a-z]*$")}).alias("issue"))


@query("P20_region_priority", "SELECT doc_id, CASE WHEN regexp_matches(title, '(?i)^the') THEN 'excluded' WHEN regexp_matches(title, '(?i)tion') THEN 'A' WHEN regexp_matches(title, '(?i)ing') THEN 'B' ELSE 'C' END AS priority FROM articles")
def p20(t):
    c = F.col("title")
    return t.articles.select("doc_id", F.when(c.rlike("(?i)^the"), "excluded").when(c.rlike("(?i)tion"), "A").when(c.rlike("(?i)ing"), "B").otherwise("C").alias("priority"))


@query("P21_not_expired", "SELECT id FROM jobs WHERE lease_expires_at IS NULL OR NOT lease_expires_at < TIMESTAMP '2000-01-01'")
def p21(t):
    return t.jobs.where(~F.coalesce(F.col("lease_expires_at") < TS("2000-01-01"), F.lit(False))).select("id")


@query("P22_file_eligible", "SELECT id, regexp_extract(file_name, '\\.([a-z]+)$', 1) IN ('pptx', 'pdf') AND NOT regexp_matches(file_name, '(?i)small|secret') AS eligible FROM candidates")
def p22(t):
    n = F.col("file_name")
    return t.candidates.select("id", (F.regexp_extract(n, r"\.([a-z]+)$", 1).isin("pptx", "pdf") & ~n.rlike("(?i)small|secret")).alias("eligible"))


@query("P23_candidate_eligible", "SELECT id FROM candidates WHERE regexp_extract(file_name, '\\.([a-z]+)$', 1) IN ('pptx', 'pdf') AND size_mb BETWEEN 2 AND 40 AND NOT regexp_matches(kind, 'PROMO')")
def p23(t):
    ok = F.regexp_extract("file_name", r"\.([a-z]+)$", 1).isin("pptx", "pdf")
    return t.candidates.where(ok & F.col("size_mb").between(2, 40) & ~F.col("kind").rlike("PROMO")).select("id")


@query("P24_routing", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'blog' WHEN 1 THEN 'column' WHEN 2 THEN 'portfolio' ELSE 'any' END AS route FROM nation")
def p24(t):
    routes = F.create_map(*[F.lit(x) for x in (0, "blog", 1, "column", 2, "portfolio")])
    return t.nation.select("n_nationkey", F.coalesce(F.try_element_at(routes, F.col("n_regionkey")), F.lit("any")).alias("route"))


_EDIT = "(dayofweek(d) IN (2, 4) OR (dayofweek(d) = 6 AND weekofyear(d) % 2 = 0))"


@query("P25_editorial_days", f"SELECT DISTINCT d FROM (SELECT o_orderdate::DATE AS d FROM orders) WHERE {_EDIT}")
def p25(t):
    return t.orders.select(F.to_date("o_orderdate").alias("d")).distinct().where(D.editorial_day(F.col("d")))


@query("P26_business_days", "SELECT DISTINCT d FROM (SELECT o_orderdate::DATE AS d FROM orders) WHERE dayofweek(d) NOT IN (0, 6) AND d NOT IN (DATE '1998-01-01', DATE '1998-03-02')")
def p26(t):
    holidays = t.spark.createDataFrame([("1998-01-01",), ("1998-03-02",)], "d string").select(F.col("d").cast("date").alias("d"))
    return D.business_days(t.orders.select(F.to_date("o_orderdate").alias("d")).distinct(), holidays, "d")


_VERSION = "CASE user_id % 4 WHEN 0 THEN '2.' || ((props->>'$.k')::INTEGER % 12) || '.' || (user_id % 10) WHEN 1 THEN '3.0.0-beta' WHEN 2 THEN ' 2.8.0 ' ELSE 'v2' END"


@query(
    "P27_minimum_version",
    f"WITH e AS (SELECT event_id, event_type, {_VERSION} AS version FROM events), p AS (SELECT *, regexp_extract(trim(version), '^([0-9]+)\\.([0-9]+)\\.([0-9]+)(?:[-+].*)?$', ['a', 'b', 'c']) AS m FROM e) "
    "SELECT event_id, version, m.a <> '' AND [m.a::INTEGER, m.b::INTEGER, m.c::INTEGER] >= [2, 8, 0] AS current, m.a <> '' AND [m.a::INTEGER, m.b::INTEGER, m.c::INTEGER] >= [2, 8, 0] AND event_type <> 'view' AS may_claim FROM p".replace("m.a::INTEGER", "try_cast(m.a AS INTEGER)").replace("m.b::INTEGER", "try_cast(m.b AS INTEGER)").replace("m.c::INTEGER", "try_cast(m.c AS INTEGER)"),
)
def p27(t):
    """Heartbeats of workers of many versions, some without the capability."""
    k = F.get_json_object("props", "$.k").cast("int")
    version = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("2."), k % 12, F.lit("."), F.col("user_id") % 10)).when(F.col("user_id") % 4 == 1, "3.0.0-beta").when(F.col("user_id") % 4 == 2, " 2.8.0 ").otherwise("v2")
    rows = t.events.select("event_id", version.alias("version"), F.array(F.lit("render"), F.when(F.col("event_type") != "view", "manifest")).alias("can"))
    return rows.select("event_id", "version", rules.at_least(F.col("version"), (2, 8, 0)).alias("current"), rules.may_claim(F.col("version"), F.col("can"), (2, 8, 0), "manifest").alias("may_claim"))


@query("P28_recovery_state", "SELECT id, CASE WHEN status = 'completed' THEN 'done' WHEN attempts >= max_attempts THEN 'exhausted' WHEN status = 'running' AND lease_expires_at < TIMESTAMP '1998-01-01' THEN 'stalled' ELSE 'open' END AS state FROM jobs")
def p28(t):
    state = F.when(F.col("status") == "completed", "done").when(F.col("attempts") >= F.col("max_attempts"), "exhausted").when((F.col("status") == "running") & (F.col("lease_expires_at") < TS("1998-01-01")), "stalled").otherwise("open")
    return t.jobs.select("id", state.alias("state"))


@query("P29_ownership", "SELECT id, claimed_by IS NULL OR claimed_by = 'w-' || (item_id % 10) AS own FROM jobs")
def p29(t):
    return t.jobs.select("id", (F.col("claimed_by").isNull() | (F.col("claimed_by") == F.concat(F.lit("w-"), F.col("item_id") % 10))).alias("own"))


@query("P30_restored_state", "SELECT id, CASE WHEN status = 'running' THEN 'waiting' ELSE status END AS status, coalesce(claimed_by, 'none') AS owner FROM jobs")
def p30(t):
    return t.jobs.select("id", F.when(F.col("status") == "running", "waiting").otherwise(F.col("status")).alias("status"), F.coalesce("claimed_by", F.lit("none")).alias("owner"))


def portfolio_metadata(t):
    """Each order as a portfolio article: its first line the thumbnail, the others boards; what is missing, or doesn't fit, goes by its number."""
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    grid = k % 3 == 0
    indexes = F.when(grid, F.sequence((line - 1) * 6, (line - 1) * 6 + F.when(k % 19 == 0, 4).otherwise(5))).otherwise(F.array(line - 1, F.when(k % 23 == 0, line - 1).otherwise(line + 90)))
    asset = F.struct(line.alias("place"), F.when(line == 1, "thumbnail").otherwise("body_image").alias("kind"), F.concat(F.lit("https://cdn/"), k, F.lit("/?a=1&b="), line).alias("url"), indexes.cast("array<int>").alias("slideIndexes"))
    # one board for each line number
    boards = t.lineitem.select("l_orderkey", "l_linenumber").distinct().groupBy("l_orderkey").agg(F.array_sort(F.collect_list(asset)).alias("assets"))
    body = F.filter("assets", lambda a: a["kind"] == "body_image")
    fingerprint = F.sha2(k.cast("string"), 256)
    figure = lambda a: F.concat(F.when(k % 7 == 0, "").otherwise("<p>Text</p>\n"), F.lit("<figure><img src=\""), F.replace(a["url"], F.lit("&"), F.lit("&amp;")), F.lit("\"></figure>"))
    slides = F.array_distinct(F.flatten(F.transform("assets", lambda a: a["slideIndexes"])))
    proof = lambda i: F.struct(i.alias("slideIndex"), F.sha2(i.cast("string"), 256).alias("sourceHash"), F.sha2(F.when(i % 2 == 0, i).otherwise(-i).cast("string"), 256).alias("redactedHash"), (i % 2).alias("regionCount"), F.when(k % 29 == 0, 1.5).when(i % 2 == 1, 0.25).otherwise(0.0).alias("changedPixelRatio"))
    chosen = F.flatten(F.transform(body, lambda a: a["slideIndexes"]))
    metadata = F.struct(
        F.struct(F.concat_ws("", F.transform(body, figure)).alias("bodyHtml")).alias("generated"),
        F.struct(F.when(grid, "six_grid").when(k % 3 == 1, "short_psd").otherwise("other").alias("mode"), F.when(k % 31 != 0, F.size(body)).alias("bodyBoardCount"), F.when(k % 37 != 0, chosen).alias("selectedSlideIndexes"), F.when(k % 11 == 0, "open").otherwise("verified").alias("redactionStatus")).alias("portfolioMockup"),
        F.transform("assets", lambda a: a.dropFields("place")).alias("portfolioAssets"), F.when(k % 13 == 0, "none").otherwise(fingerprint).alias("portfolioSourceFingerprint"),
        F.when(k % 17 == 0, "old").otherwise(G.RULES).alias("portfolioRuleVersion"), F.when(k % 5 != 0, F.concat(F.lit("g"), k)).alias("portfolioGenerationId"),
        F.struct(F.lit(2).alias("version"), F.lit(G.METHOD).alias("method"), F.lit(True).alias("verified"), fingerprint.alias("sourceFingerprint"), fingerprint.alias("manifestHash"), F.transform(slides, proof).alias("slides")).alias("redactionProof"),
    )
    return boards.select("l_orderkey", F.to_json(metadata).alias("metadata"))


@query("P31_metadata_issues")
def p31(t):
    return portfolio_metadata(t).select("l_orderkey", G.metadata_issues(F.from_json("metadata", G.METADATA)).alias("issues"))


@query("P32_source_state", "SELECT w.id, j.status IS NULL OR j.status = 'completed' AS ready FROM work_items w LEFT JOIN (SELECT item_id, arg_max(status, (created_at, id)) AS status FROM jobs GROUP BY 1) j ON j.item_id = w.owner")
def p32(t):
    last = t.jobs.groupBy(F.col("item_id").alias("owner")).agg(F.max_by("status", F.struct("created_at", "id")).alias("last"))
    return t.work_items.join(last, "owner", "left").select("id", (F.col("last").isNull() | (F.col("last") == "completed")).alias("ready"))


@query("P33_not_cancelled", "SELECT id FROM work_items WHERE NOT (status = 'planned' AND id % 3 = 0)")
def p33(t):
    """Work whose review note is not the mark of a cancelled generation; some notes hold that mark further on."""
    note = F.when((F.col("status") == "planned") & (F.col("id") % 3 == 0), F.concat(F.lit("generation-cancelled:"), "id")).when(F.col("id") % 3 == 1, F.concat(F.lit("was generation-cancelled:"), "id"))
    return t.work_items.where(~G.is_cancelled(note)).select("id")


@query("P34_facet", "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY'")
def p34(t):
    return t.part.where(F.col("p_type") == "ECONOMY").select("p_partkey")


@query(
    "P35_figure_rules",
    "WITH p AS (SELECT page_id, len(regexp_extract_all(html, '</p>')) AS n, regexp_matches(html, '(?is)<p[\\s>].*</p>') AS para FROM pages) SELECT page_id, array_to_string(list_filter([CASE WHEN (CASE page_id % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 * n ELSE n END) < 5 THEN '본문용 다중 페이지 목업이 5개 미만입니다.' END, "
    "CASE WHEN page_id % 4 = 1 AND n > 0 THEN '본문 이미지는 모두 figure 안에 배치해야 합니다.' END, CASE WHEN page_id % 4 = 3 AND n > 0 THEN '본문 이미지가 설명 없이 연속으로 배치되어 있습니다.' END, CASE WHEN page_id % 4 > 0 AND n > 0 AND NOT para THEN '이미지는 관련 설명 문단 다음에 배치해야 합니다.' END], lambda x: x IS NOT NULL), '|') AS issues FROM p",
)
def p35(t):
    """Pages with no figure, with one without an image after each paragraph, with one, and with two."""
    n, figure = F.col("page_id") % 4, "<figure><img src=\"a.png\"></figure>"
    after = F.when(n == 0, "</p>").when(n == 1, "</p> <figure><em></em></figure>").when(n == 2, "</p>\n" + figure).otherwise("</p>" + figure + " " + figure)
    rows = t.pages.select("page_id", F.regexp_replace("html", F.lit("</p>"), after).alias("html"))
    return rows.select("page_id", F.array_join(F.array_compact(F.array(*G.figure_issues(F.col("html"), F.lit(5)))), "|").alias("issues"))


@query("P36_loggable", "SELECT page_id, NOT regexp_matches(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1), '^/(admin|api|auth)') AS log FROM pages")
def p36(t):
    return t.pages.select("page_id", W.loggable(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))).alias("log"))


@query("FM14_candidate_score", "SELECT id, (CASE WHEN file_name LIKE '%.pptx' THEN 35 WHEN file_name LIKE '%.png' THEN -40 ELSE 0 END + CASE WHEN file_name LIKE '%red%' THEN 30 ELSE 0 END + least(35, 2 * size_mb))::BIGINT AS score, least(95, 45 + least(35, 2 * size_mb)) AS quality FROM candidates")
def fm14(t):
    return t.candidates.select("id", selection.candidate_score().alias("score"), F.least(F.lit(95), 45 + F.least(F.lit(35), 2 * F.col("size_mb"))).alias("quality"))
