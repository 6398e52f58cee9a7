"""String, HTML and URL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import html as H
from inkwell.functions import portfolio as G
from inkwell.functions import privacy as P
from inkwell.functions import style as Y
from inkwell.functions import text as T
from inkwell.functions import web as W
from inkwell.queries import query

_SQ = "trim(regexp_replace({}, '[\\s ]+', ' ', 'g'))"
_PLAIN = _SQ.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?i)&[a-z#0-9]+;', ' ', 'g')")
_DEC = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
for _n, _v in T.ENTITIES:
    _DEC = f"replace({_DEC}, '{_n}', chr({ord(_v)}))"
_DEC = _SQ.format(_DEC)
_VIS = _SQ.format("regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?i)&(?:nbsp|amp|lt|gt|quot|#39);', ' ', 'g')")
_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"
_STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@query("FS01_plain_text", f"SELECT page_id, {_PLAIN} AS text FROM pages")
def fs01(t):
    return t.pages.select("page_id", T.plain_text(F.col("html")).alias("text"))


@query("FS02_decoded_text", f"SELECT page_id, {_DEC} AS text FROM pages")
def fs02(t):
    return t.pages.select("page_id", T.decoded_text(F.col("html")).alias("text"))


@query("FS03_decode_entities")
def fs03(t):
    return t.pages.select("page_id", H.unescaped(F.col("html")).alias("html"))


@query("FS04_visible_length", f"SELECT page_id, length(regexp_replace({_VIS}, '[\\s ]', '', 'g')) AS n FROM pages")
def fs04(t):
    return t.pages.select("page_id", T.visible_length(F.col("html")).cast("long").alias("n"))


@query("FS05_headings", "SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), lambda h: " + _PLAIN.replace("html", "h") + "), '|') AS headings FROM pages")
def fs05(t):
    return t.pages.select("page_id", F.array_join(T.headings(F.col("html"), "1"), "|").alias("headings"))


@query("FS06_tokens", f"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[가-힣a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({_STOPS}, w))) AS n, md5(array_to_string(list_filter(regexp_extract_all(lower(text), '[가-힣a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({_STOPS}, w)), ' ')) AS tokens FROM documents")
def fs06(t):
    found = T.tokens(F.col("text"))
    return t.documents.select("doc_id", F.array_size(found).cast("long").alias("n"), F.md5(F.array_join(found, " ").cast("binary")).alias("tokens"))


@query("FS07_token_set", "SELECT doc_id, len(list_distinct(list_filter(string_split(" + _SQ.format("regexp_replace(lower(text), '[^0-9a-z가-힣\\s]', ' ', 'g')") + ", ' '), lambda w: length(w) >= 2))) AS n FROM documents")
def fs07(t):
    return t.documents.select("doc_id", F.array_size(T.token_set(F.col("text"))).cast("long").alias("n"))


@query("FS08_terms", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[0-9a-z가-힣]{2,}'))), ' ') AS terms FROM documents")
def fs08(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(T.terms(F.col("text"))), " ").alias("terms"))


@query("FS09_normalized_tokens")
def fs09(t):
    return t.documents.select("doc_id", H.compatible(F.col("text")).alias("t")).select("doc_id", F.array_size(F.array_distinct(F.filter(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) > 1))).alias("n"))


@query("FS10_title_key", "SELECT doc_id, regexp_replace(lower(regexp_replace(title, '^\\s*\\[[^\\]]*\\]\\s*', '')), '[^0-9a-z가-힣]', '', 'g') AS key FROM articles")
def fs10(t):
    return t.articles.select("doc_id", T.title_key(F.col("title")).alias("key"))


#: Titles get a region and a body in front, so that there is something to strip.
_PLACE = "['부산광역시 테크노파크 ', '서울 ', '경기도 창조경제혁신센터', ''][(doc_id % 4 + 1)::INTEGER] || title"


@query(
    "FS11_region_stripping",
    f"SELECT doc_id, trim(regexp_replace(lower(regexp_replace(regexp_replace({_PLACE}, '({'|'.join(T.REGIONS)})\\s*({'|'.join(T.REGION_LEVELS)})?\\s*({'|'.join(T.REGION_BODIES)})?', ' ', 'g'), '{'|'.join(T.REGION_BODIES)}', ' ', 'g')), '[^0-9a-z가-힣]+', ' ', 'g')) AS core FROM articles",
)
def fs11(t):
    places = F.array(F.lit("부산광역시 테크노파크 "), F.lit("서울 "), F.lit("경기도 창조경제혁신센터"), F.lit(""))
    return t.articles.select("doc_id", T.core_topic(F.concat(F.element_at(places, (F.col("doc_id") % 4 + 1).cast("int")), "title")).alias("core"))


_ENTITIES = ("tion", "rights reserved", "license", "thon", "e-mail")


@query("FS12_entities", "SELECT doc_id, array_to_string(list_filter(['" + "','".join(_ENTITIES) + "'], lambda e: contains(lower(text), e)), ',') AS entities FROM documents")
def fs12(t):
    return t.documents.select("doc_id", F.array_join(F.filter(F.array(*map(F.lit, _ENTITIES)), lambda e: F.contains(F.lower("text"), e)), ",").alias("entities"))


@query("FS13_slug", "SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS slug FROM articles")
def fs13(t):
    return t.articles.select("doc_id", T.slug(F.col("title")).alias("slug"))


_ONE = _SQ.format("text")
_HEAD = f"substr({_ONE}, 1, 120)"


@query(
    "FS14_summaries",
    f"SELECT doc_id, CASE WHEN length({_ONE}) > 110 THEN rtrim(substr({_ONE}, 1, 109)) || '…' ELSE {_ONE} END AS line, "
    f"CASE WHEN length({_ONE}) > 120 THEN CASE WHEN instr({_HEAD}, ' ') > 0 AND 120 - instr(reverse({_HEAD}), ' ') > 72 THEN substr({_HEAD}, 1, 120 - instr(reverse({_HEAD}), ' ')) ELSE {_HEAD} END || '…' ELSE {_ONE} END AS summary FROM documents",
)
def fs14(t):
    return t.documents.select("doc_id", T.tidy_line(F.col("text")).alias("line"), T.summary(F.col("text")).alias("summary"))


@query("FS15_first_email", "SELECT doc_id, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS email FROM documents")
def fs15(t):
    return t.documents.select("doc_id", T.first_email(F.col("text")).alias("email"))


@query("FS16_post", "SELECT source, 1 AS part, doc_id, '- ' || doc_id || ' ' || substr(title, 1, 20) AS line FROM articles UNION ALL SELECT DISTINCT source, 2, NULL::BIGINT, '--' FROM articles")
def fs16(t):
    """A list of each source with a footer, line by line: written sorted by source, part and id, it is the post. So a source of any size is
    never one row."""
    lines = t.articles.select("source", F.lit(1).alias("part"), "doc_id", F.concat(F.lit("- "), "doc_id", F.lit(" "), F.substring("title", 1, 20)).alias("line"))
    return lines.unionByName(t.articles.select("source").distinct().select("source", F.lit(2).alias("part"), F.lit(None).cast("long").alias("doc_id"), F.lit("--").alias("line")))


#: Agents, and what they are.
_AGENTS = (
    ("Mozilla/5.0 (compatible; GPTBot/1.0)", "GPTBot", "ai"),
    ("Googlebot-Image/1.0", "Googlebot-Image", "search"),
    ("Mozilla/5.0 AppleWebKit Safari", None, None),
    ("curl/8.1", "Automated tool", "tool"),
    ("SomeCrawler/2", "Other bot", "other"),
    ("Applebot-Extended/0.1", "Applebot-Extended", "ai"),
)
_PICK = "(props->>'$.k')::INTEGER % 6"


@query("FS17_bots", f"SELECT event_id, CASE {_PICK} " + " ".join(f"WHEN {k} THEN '{n}'" for k, (_, n, _) in enumerate(_AGENTS) if n) + f" END AS name, CASE {_PICK} " + " ".join(f"WHEN {k} THEN '{c}'" for k, (_, _, c) in enumerate(_AGENTS) if c) + " END AS category FROM events")
def fs17(t):
    """Each event with the agent of its key, in upper case for every other one."""
    k = F.get_json_object("props", "$.k").cast("int")
    agent = F.element_at(F.array(*[F.lit(a) for a, _, _ in _AGENTS]), k % 6 + 1)
    rows = t.events.select("event_id", W.bot(F.when(F.col("event_id") % 2 == 0, agent).otherwise(F.concat(F.lit("x "), agent))).alias("b"))
    return rows.select("event_id", "b.name", "b.category")


@query("FS18_path_attribution", "SELECT id, CASE split_part(requested_path, '/', 2) WHEN '' THEN 'home' WHEN 'columns' THEN 'column' WHEN 'portfolio' THEN 'portfolio' ELSE 'page' END AS kind, split_part(requested_path, '/', 3) AS slug FROM traffic")
def fs18(t):
    return t.traffic.withColumn("k", W.path_kind(F.col("requested_path"))).select("id", "k.kind", "k.slug")


@query("FS19_masked_ip", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '10.' || user_id % 256 || '.' || (props->>'$.k') || '.0' WHEN 1 THEN '2001:db8:' || user_id || ':' || (props->>'$.k') || '::' END AS masked FROM events")
def fs19(t):
    """Addresses of events: of both kinds, with a number too few, and none."""
    user, k, n = F.col("user_id"), F.get_json_object("props", "$.k"), F.col("event_id") % 4
    ip = F.when(n == 0, F.concat(F.lit("10."), user % 256, F.lit("."), k, F.lit("."), F.col("event_id") % 256)).when(n == 1, F.concat(F.lit("2001:db8:"), user, F.lit(":"), k, F.lit(":3:4:5:"), F.hex("event_id")))
    return t.events.select("event_id", T.masked_ip(ip.when(n == 2, F.concat(F.lit("10.1."), k)).otherwise("unknown")).alias("masked"))


@query("FS20_host", f"SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') AS host FROM pages")
def fs20(t):
    return t.pages.select("page_id", W.host(F.col("url")).alias("host"))


def posts(t):
    """Addresses of posts, by page: both shapes, the page's own, without TLS, with too short a number, and with a third segment."""
    n, id_ = F.col("page_id") % 6, F.col("page_id")
    url = F.when(n == 0, F.concat(F.lit("https://blog.naver.com/User_"), id_, F.lit("/"), id_ + 100)).when(n == 1, F.concat(F.lit("https://m.blog.naver.com/PostView.naver?blogId=Us."), id_, F.lit("&logNo="), id_ + 100))
    url = url.when(n == 2, F.col("url")).when(n == 3, F.concat(F.lit("http://blog.naver.com/user/"), id_ + 100)).when(n == 4, F.concat(F.lit("https://blog.naver.com/user"), id_, F.lit("/12")))
    return t.pages.select("page_id", url.otherwise(F.concat(F.lit(" https://BLOG.naver.com/user/"), id_ + 100, F.lit("/more?x=1 "))).alias("url"))


_POST = "CASE page_id % 6 WHEN 0 THEN 'https://blog.naver.com/user_' || page_id || '/' || (page_id + 100) WHEN 1 THEN 'https://blog.naver.com/us.' || page_id || '/' || (page_id + 100) WHEN 5 THEN 'https://blog.naver.com/user/' || (page_id + 100) END"


@query("FS21_post_url", f"SELECT page_id, {_POST} AS post FROM pages")
def fs21(t):
    return posts(t).select("page_id", W.post_url(F.col("url")).alias("post"))


@query("FS22_publication_check", f"SELECT page_id, CASE WHEN {_POST} IS NULL THEN 'INVALID_PUBLISHED_URL' WHEN page_id % 9 = 0 THEN 'PUBLICATION_ACCOUNT_CONFIG_INVALID' WHEN page_id % 6 <> 5 THEN 'PUBLISHED_ACCOUNT_MISMATCH' END AS error FROM pages")
def fs22(t):
    """Against one account; for some pages none is set up."""
    return posts(t).select("page_id", W.publication_error(F.col("url"), F.when(F.col("page_id") % 9 != 0, "user")).alias("error"))


@query("FS23_source_urls", "SELECT k, least(8, count(DISTINCT u)) AS n FROM (SELECT page_id % 20 AS k, regexp_replace(url, '#.*$', '') AS u FROM pages WHERE regexp_matches(url, '^https?://')) GROUP BY 1")
def fs23(t):
    """How many different addresses each list has, eight at most: counted, never gathered."""
    rows = t.pages.where(F.col("url").rlike("^https?://")).select((F.col("page_id") % 20).alias("k"), W.without_fragment(F.col("url")).alias("u")).distinct()
    return rows.groupBy("k").agg(F.least(F.lit(8), F.count("*")).cast("long").alias("n"))


@query("FS24_fingerprint", "SELECT page_id, sha256(CASE WHEN page_id % 3 = 0 THEN 'id:' || page_id ELSE lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) || '|' || regexp_replace(url, '#.*$', '') END) AS fingerprint FROM pages")
def fs24(t):
    other = F.concat(F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("|"), W.without_fragment(F.col("url")))
    return t.pages.select("page_id", F.sha2(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("id:"), "page_id")).otherwise(other), 256).alias("fingerprint"))


@query("FS25_redaction")
def fs25(t):
    rows = P.with_redaction(t.documents.select("doc_id", "text"), "text", terms=("rights reserved",))
    return rows.select("doc_id", "redaction.text", "redaction.total")


@query("FS26_luhn", "SELECT number, CASE WHEN length(number) BETWEEN 13 AND 19 THEN list_sum(list_transform(range(1, length(number) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(number, length(number) - i + 1, 1)::INTEGER WHEN substr(number, length(number) - i + 1, 1)::INTEGER > 4 THEN substr(number, length(number) - i + 1, 1)::INTEGER * 2 - 9 ELSE substr(number, length(number) - i + 1, 1)::INTEGER * 2 END)) % 10 = 0 ELSE false END AS ok FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]{13,19}')) AS number FROM documents)")
def fs26(t):
    numbers = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[0-9]{13,19}"), F.lit(0))).alias("number")).distinct()
    return numbers.withColumn("ok", P.luhn(F.col("number")))


_RISK = "(?i)(?:대외비|사외비|외부\\s*공유\\s*금지|외부\\s*반출\\s*금지|confidential|internal\\s+(?:use\\s+)?only|non[- ]?disclosure|\\bNDA\\b)"
_SECRET = "(?i)(?:비밀번호|패스워드|password|api[ _-]?key|access[ _-]?token|secret(?:[ _-]?key)?)\\s*[:=：]\\s*(\\S+)"
_NAMED = "(?i)(?:고객명|담당자명|대표자명|신청인명|수신인명)\\s*[:：]?\\s*(?:[가-힣]{2,5}|[A-Za-z][A-Za-z .''-]{1,60})"


@query(
    "FS27_risk_marks",
    f"SELECT doc_id, CASE WHEN regexp_matches(text, '{_RISK}') THEN '{P.HIGH_RISK[0]}' WHEN len(list_filter(regexp_extract_all(text, '{_SECRET}', 1), lambda x: NOT regexp_matches(x, '(?i)^\\[(SENSITIVE|REDACTED)\\]'))) > 0 THEN '{P.SECRET[0]}' WHEN regexp_matches(text, '{_NAMED}') THEN '{P.NAMED[0]}' END AS issue FROM documents",
)
def fs27(t):
    return t.documents.select("doc_id", P.sensitive_issue(F.col("text")).alias("issue"))


@query("FS28_redacted_parts")
def fs28(t):
    """Each conversation's parts in order, redacted, and how much was."""
    rows = P.with_redaction(t.conversations.select("conv_id", "turn", "text"), "text").select("conv_id", "turn", "redaction.text", "redaction.total")
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return rows.groupBy("conv_id").agg(parts.alias("parts"), F.sum("total").alias("redactions"))


@query("FS29_sanitized_html")
def fs29(t):
    return t.pages.select("page_id", H.sanitized(F.col("html")).alias("html"))


@query("FS30_sentence_lengths")
def fs30(t):
    n = T.sentence_lengths(F.col("text"))
    return t.documents.select("doc_id", F.array_size(n).alias("sentences"), F.array_size(F.filter(n, lambda x: x > 80)).alias("long"))


def generated(t):
    """Pages as generated articles: their first paragraphs are the answers of a FAQ, their links sources."""
    part = F.regexp_extract_all("html", F.lit("(?is)<p>(.*?)</p>"), F.lit(1))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    faq = F.transform(F.slice(part, 1, (F.col("page_id") % 6).cast("int")), lambda x: F.struct(F.concat(F.lit("Q. "), title, F.lit("?")).alias("question"), F.concat(F.lit("A. "), F.substring(x, 1, 150)).alias("answer")))
    links = F.transform(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)), lambda x: F.concat(F.lit("https://example.org"), x))
    # a heading and a list for some, marks for others
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<h2>확인할 3가지</h2>"), F.replace("html", F.lit("<b>"), F.lit("<strong>")), F.lit("!!!!!<p>오늘날 중요합니다. 중요합니다. 중요합니다.</p>"))).otherwise(F.col("html"))
    return t.pages.select("page_id", title.alias("title"), F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("url")).alias("summary"), body.alias("body"), faq.alias("faq"), links.alias("urls"))


@query("FS31_style_issues")
def fs31(t):
    return generated(t).select("page_id", Y.friendly_issues(F.col("body"), F.col("faq"), lively=False).alias("issues"))


@query("FS32_publication_issues")
def fs32(t):
    return generated(t).select("page_id", Y.publication_issues(F.col("body"), F.col("faq"), F.col("urls"), F.col("page_id") % 7 == 0).alias("issues"))


@query("FS33_faq_html", "SELECT doc_id, '<strong>Q. ' || replace(replace(replace(regexp_replace(title, '^\\s*[QA][.:]\\s*', ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</strong>' AS question FROM articles")
def fs33(t):
    return t.articles.select("doc_id", H.faq_question(F.col("title")).alias("question"))


@query("FS34_sentence_breaks")
def fs34(t):
    return t.pages.select("page_id", H.with_breaks(F.col("html")).alias("html"))


@query("FS35_sections")
def fs35(t):
    return t.pages.select("page_id", F.array_size(H.merged_sections(F.col("html"), "p", 700, 8)).alias("sections"))


@query("FS36_figures_to_marks")
def fs36(t):
    return t.pages.select("page_id", H.figures_to_marks(F.concat("html", F.lit("<figure><img src='a.png'></figure>"))).alias("html"))


@query("FS37_lock_and_restore")
def fs37(t):
    locked = t.documents.select("doc_id", "text", H.locked(F.col("text")).alias("l"))
    return locked.select("doc_id", F.array_size("l.values").alias("locked"), (H.restored(F.col("l")) == F.col("text")).alias("same"))


@query("FS38_numbers", "SELECT doc_id, array_to_string(list_sort(regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?%?')), ' ') AS numbers FROM documents")
def fs38(t):
    return t.documents.select("doc_id", F.array_join(T.numbers(F.col("text")), " ").alias("numbers"))


@query("FS39_letters", "SELECT o_orderkey, CASE WHEN n >= 18278 THEN chr((65 + (n - 18278) // 17576 % 26)::INTEGER) ELSE '' END || CASE WHEN n >= 702 THEN chr((65 + (n - 702) // 676 % 26)::INTEGER) ELSE '' END || CASE WHEN n >= 26 THEN chr((65 + (n - 26) // 26 % 26)::INTEGER) ELSE '' END || chr((65 + n % 26)::INTEGER) AS letters FROM (SELECT o_orderkey, o_orderkey % 475254 AS n FROM orders)")
def fs39(t):
    return t.orders.select("o_orderkey", T.letters(F.col("o_orderkey") % 475_254).alias("letters"))


@query("FS40_structural_mismatch", "WITH p AS (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages) SELECT a.page_id, list_position(list_transform(list_zip(a.l, b.l), lambda z: coalesce(z[1] = z[2], false)), false)::INTEGER AS first FROM p a JOIN p b ON b.page_id = a.page_id + 1")
def fs40(t):
    links = t.pages.select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("l"))
    both = links.join(links.select((F.col("page_id") - 1).alias("page_id"), F.col("l").alias("m")), "page_id")
    return both.select("page_id", F.nullif(F.array_position(F.zip_with("l", "m", lambda a, b: F.coalesce(a == b, F.lit(False))), False), F.lit(0)).cast("int").alias("first"))


@query("FS41_markers", "SELECT doc_id, len(regexp_extract_all(text, '\\[[^\\]]+\\]')) AS marks, regexp_replace(text, '\\[[^\\]]+\\]', '', 'g') AS stripped FROM documents")
def fs41(t):
    mark = r"\[[^\]]+\]"
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(mark)).cast("long").alias("marks"), F.regexp_replace("text", mark, "").alias("stripped"))


@query("FS42_changes")
def fs42(t):
    """Hunks, and the characters they removed; null where the texts are too far apart."""
    after = F.regexp_replace("text", "(?i)the ", "a ")
    rows = t.documents.select("doc_id", H.changes(F.col("text"), after).alias("h"))
    return rows.select("doc_id", F.array_size("h").alias("hunks"), F.aggregate("h", F.lit(0), lambda s, x: s + x["removed"]).alias("removed"))


@query("FS43_repeated_word", "WITH w AS (SELECT doc_id, string_split(" + _SQ.format("lower(title)") + ", ' ') AS w FROM articles) SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > 0 AS repeated FROM w")
def fs43(t):
    return t.articles.select("doc_id", T.has_repeat(F.lower("title")).alias("repeated"))


_CONTEXT = ("서울 시청 관광 사업계획", "대기업 R&D 발표", "ＨＲ 컨설팅 제안", "수출 회사소개", "교육 IR", "뷰티 입찰 제안")


@query("FS44_category", "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'public_institution' WHEN 1 THEN 'large_company' ELSE 'unknown' END AS client, CASE doc_id % 7 WHEN 0 THEN '관광마케팅' WHEN 1 THEN '연구개발' WHEN 2 THEN '인사·HR' WHEN 3 THEN '해외 무역' WHEN 4 THEN '교육' WHEN 5 THEN '뷰티' ELSE CASE WHEN contains(lower(title), 'hr') THEN '인사·HR' ELSE '비즈니스' END END AS industry, CASE doc_id % 7 WHEN 0 THEN '사업계획서' WHEN 1 THEN '발표자료' WHEN 2 THEN '제안서' WHEN 3 THEN '회사소개서' WHEN 4 THEN 'IR 자료' WHEN 5 THEN '입찰제안서' ELSE CASE WHEN contains(lower(title), 'ir') THEN 'IR 자료' ELSE '비즈니스 문서' END END AS document FROM articles")
def fs44(t):
    """Names of sources of several kinds in front of the titles; every seventh is a title alone."""
    n = (F.col("doc_id") % 7).cast("int")
    name = F.when(n < len(_CONTEXT), F.get(F.array(*map(F.lit, _CONTEXT)), n)).otherwise(F.col("title"))
    return t.articles.select("doc_id", G.context(H.compatible(name)).alias("c")).select("doc_id", "c.*")


@query("FS45_missing_fonts", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN trim(p_brand) || CASE WHEN trim(p_type) <> trim(p_brand) THEN '|' || trim(p_type) ELSE '' END ELSE trim(p_type) END AS fonts FROM part")
def fs45(t):
    """Messages of workers, by part: other errors, and names that repeat or are blank."""
    n = F.col("p_partkey") % 4
    error = F.when(n == 0, F.concat(F.lit("FAILED: "), "p_type")).when(n == 1, F.concat(F.lit("MISSING_FONTS: on "), "p_name", F.lit(": "), "p_brand", F.lit(", "), "p_type", F.lit(" , "), "p_brand", F.lit(".")))
    return t.part.select("p_partkey", F.array_join(W.missing_fonts(error.otherwise(F.concat(F.lit("MISSING_FONTS:not there:"), F.lit(" , ,"), "p_type"))), "|").alias("fonts"))


@query("FS46_meta", "SELECT page_id, substr(" + _PLAIN + ", 1, 155) AS description, CASE WHEN url LIKE 'http%' THEN url ELSE 'https://example.com/' || url END AS absolute FROM pages")
def fs46(t):
    return t.pages.select("page_id", F.substring(T.plain_text(F.col("html")), 1, 155).alias("description"), F.when(F.col("url").startswith("http"), F.col("url")).otherwise(F.concat(F.lit("https://example.com/"), "url")).alias("absolute"))


@query("FS47_requester", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'c' || user_id WHEN event_id % 3 = 0 THEN 'r' || user_id WHEN event_id % 5 = 0 THEN 'f' || user_id ELSE 'unknown' END AS key FROM events")
def fs47(t):
    """Headers that some events lack and others leave empty."""
    has = lambda n, letter: F.when(F.col("event_id") % n == 0, F.concat(F.lit(letter), "user_id"))
    forwarded = F.coalesce(F.concat(F.lit(" "), has(5, "f"), F.lit(" , proxy")), F.lit(" , proxy"))
    return t.events.select("event_id", W.requester(has(2, "c"), F.coalesce(has(3, "r"), F.lit("")), forwarded).alias("key"))


@query("FS48_sql_text", "SELECT o_orderkey, left(o_orderpriority, 5) AS head, concat_ws('/', o_orderstatus, nullif(trim(o_orderpriority), '')) AS label, printf('%05d', o_orderkey::INTEGER) AS padded FROM orders")
def fs48(t):
    return t.orders.select("o_orderkey", F.left("o_orderpriority", F.lit(5)).alias("head"), F.concat_ws("/", "o_orderstatus", F.nullif(F.trim("o_orderpriority"), F.lit(""))).alias("label"), F.format_string("%05d", F.col("o_orderkey").cast("int")).alias("padded"))


@query("FS49_interleaved_figures")
def fs49(t):
    return t.pages.select("page_id", H.interleaved(F.col("html"), F.array(F.lit("<figure>1</figure>"), F.lit("<figure>2</figure>"))).alias("html"))


@query("FS50_draft_lint")
def fs50(t):
    """Drafts as they come from a model are sanitized and get their sentence breaks first."""
    rows = generated(t).withColumn("body", H.with_breaks(H.sanitized(F.col("body"))))
    return rows.select("page_id", Y.draft_issues(F.col("title"), F.col("summary"), F.col("body"), F.col("faq")).alias("issues"))
