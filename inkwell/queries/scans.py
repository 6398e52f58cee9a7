"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import dates as D
from inkwell.functions import text as T
from inkwell.functions import web as W
from inkwell.operators import upsert
from inkwell.queries import query
from inkwell.queries.texts import _HOST, _PLAIN, _SQ
from inkwell.sources import collect


@query("S01_projection", "SELECT event_id, event_type FROM events")
def s01(t):
    return t.events.select("event_id", "event_type")


@query("S02_ordered_scan", "SELECT doc_id, n_chars, lang FROM documents WHERE lang = 'en'")
def s02(t):
    return t.documents.where(F.col("lang") == "en").orderBy(F.desc("n_chars"), "doc_id").select("doc_id", "n_chars", "lang")


@query("S03_key_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def s03(t):
    return t.orders.where("o_orderkey = 77").select("o_orderkey", "o_totalprice")


@query("S04_exactly_one", "SELECT r_regionkey, r_name FROM region WHERE r_name = 'ASIA'")
def s04(t):
    """One row, or an error when the plan runs."""
    rows = t.region.where(F.col("r_name") == "ASIA")
    one = rows.agg(F.count("*").alias("n"), F.first("r_regionkey").alias("r_regionkey"), F.first("r_name").alias("r_name"))
    return one.select(F.when(F.col("n") == 1, F.col("r_regionkey")).otherwise(F.raise_error(F.lit("not exactly one row")).cast("int")).alias("r_regionkey"), "r_name")


@query("S05_count_only", "SELECT count(*) AS n FROM traffic WHERE bot_category = 'ai'")
def s05(t):
    return t.traffic.where(F.col("bot_category") == "ai").agg(F.count("*").alias("n"))


@query("S06_capped_scan", "SELECT id, accessed_at FROM traffic ORDER BY accessed_at DESC, id LIMIT 1000 OFFSET 2000")
def s06(t):
    return t.traffic.orderBy(F.desc("accessed_at"), "id").offset(2000).limit(1000).select("id", "accessed_at")


@query("S07_full_drain", "SELECT count(*) AS n, sum(reserved)::BIGINT AS reserved FROM usage")
def s07(t):
    return t.usage.agg(F.count("*").alias("n"), F.sum("reserved").alias("reserved"))


@query("S08_key_list", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 15 = 0)")
def s08(t):
    keys = t.customer.where("c_custkey % 15 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(keys, "o_custkey", "left_semi")


@query("S09_anchors", "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def s09(t):
    return collect.links(t.pages.select("page_id", "html")).select("page_id", "href")


_LINKS = "regexp_extract_all(html, '<a href=\"(/[^\"]*)\">([^<]*)</a>', {})"


@query("S10_link_ids", f"SELECT page_id, page_id::VARCHAR AS id, title FROM (SELECT page_id, {_SQ.format('t')} AS title, row_number() OVER (PARTITION BY page_id ORDER BY r) AS r FROM (SELECT page_id, unnest({_LINKS.format(2)}) AS t, generate_subscripts({_LINKS.format(2)}, 1) AS r FROM pages) WHERE regexp_matches({_SQ.format('t')}, '(?i)en|tion|an')) WHERE r = 1")
def s10(t):
    """The pages' links in the form of a listing whose links call a script."""
    link = F.concat(F.lit("<a href='javascript:go_view("), "page_id", F.lit(");'>"))
    return collect.js_links(t.pages.select("page_id", F.regexp_replace("html", F.lit('<a href="/[^"]*">'), link).alias("html")), "page_id", keywords="(?i)en|tion|an")


@query("S11_json_listing", "SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events WHERE (props->>'$.k')::INTEGER > 50")
def s11(t):
    return t.events.select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k").where("k > 50")


@query("S12_nested_json", f"SELECT page_id, page_id || '-' || r AS code, {_SQ.format('t')} AS title, CASE WHEN r % 5 <> 0 THEN strftime(DATE '2024-01-01' + r::INTEGER, '%Y-%m-%d') || 'T' || CASE WHEN r % 2 = 0 THEN '09:30:00' ELSE '00:00:00' END || '+09:00' END AS starts FROM (SELECT page_id, unnest({_LINKS.format(2)}) AS t, generate_subscripts({_LINKS.format(2)}, 1) AS r FROM pages) WHERE {_SQ.format('t')} <> ''")
def s12(t):
    """Each page's links as the JSON answer of a form; entries without a title are left out, dates of eight digits become Korean timestamps."""
    titles = F.regexp_extract_all("html", F.lit('<a href="/[^"]*">([^<]*)</a>'), F.lit(1))
    day = lambda k: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), k + 1), "yyyyMMdd")
    entry = lambda x, k: F.struct(F.concat("page_id", F.lit("-"), k + 1).alias("code"), x.alias("name"), F.when((k + 1) % 5 != 0, day(k)).otherwise("soon").alias("day"), F.when((k + 1) % 2 == 0, "09:30").alias("time"))
    bodies = t.pages.select("page_id", F.to_json(F.struct(F.transform(titles, entry).alias("list"))).alias("body"))
    rows = collect.json_listing(bodies, "page_id", "body", "list", "code: string, name: string, day: string, time: string")
    return rows.select("page_id", "code", T.squeeze(F.col("name")).alias("title"), D.korean_stamp(F.col("day"), F.col("time")).alias("starts")).where("title <> ''")


@query("S13_generic_listing")
def s13(t):
    return collect.listing(t.pages, "page_id", "url", keywords="(?i)en|tion|an")


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query("S15_enrichment", f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE {_TITLE} END AS title, {_TITLE} AS heading FROM pages")
def s15(t):
    """Fields that a listing left empty or null come from the detail pages."""
    rows = t.pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("").alias("title"), F.lit(None).cast("string").alias("heading"))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return collect.filled(rows, t.pages.select("page_id", title.alias("title"), title.alias("heading")), "page_id", ["title", "heading"])


@query("S16_detail_fields", "SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def s16(t):
    return t.pages.select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))


_HEADS = ("신청기간", "신청방법", "신청대상", "제외대상")


@query("S17_markdown_block", f"SELECT page_id, {_SQ.format(_TITLE)} AS period, 'online ' || url AS method, CASE WHEN page_id % 3 = 0 THEN '' ELSE '- all - most' END AS target FROM pages")
def s17(t):
    """Blocks of a page in Markdown, each up to the next heading that may follow it."""
    head = lambda k: F.lit(f"\n* {_HEADS[k]}\n")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    target = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(head(2), F.lit("* * all\n  - most\n")))
    doc = F.concat(F.lit("# Notice"), head(0), F.lit("## "), title, head(1), F.lit("[online](https://example.org/x) "), "url", target, head(3), F.lit("none"))
    line = lambda k: rf"^\s*\*\s+{_HEADS[k]}\s*$"
    block = lambda k, *stops: collect.markdown_block(F.col("doc"), line(k), tuple(map(line, stops)))
    rows = t.pages.select("page_id", doc.alias("doc"))
    return rows.select("page_id", block(0, 1, 2).alias("period"), block(1, 2, 3).alias("method"), block(2, 3).alias("target"))


@query("S18_main_content")
def s18(t):
    """A third of the pages with ``main``, a third with a content element, a third with neither."""
    k = F.col("page_id") % 3
    opened = F.when(k == 0, F.replace("html", F.lit("<article>"), F.lit("<main>"))).when(k == 1, F.replace("html", F.lit("<article>"), F.lit("<div id='content'>"))).otherwise(F.col("html"))
    html = F.when(k == 0, F.replace(opened, F.lit("</article>"), F.lit("</main>"))).when(k == 1, F.replace(opened, F.lit("</article>"), F.lit("</div>"))).otherwise(opened)
    return t.pages.select("page_id", html.alias("html")).select("page_id", collect.around(F.col("html"), ("tion", "thon")).alias("text"))


def feeds(t):
    """Each page's links as a feed; some weren't fetched, some aren't feeds."""
    part = lambda k: F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)">([^<]*)</a>'), F.lit(k))
    item = lambda href, title: F.concat(F.lit("<item><title><![CDATA["), title, F.lit("]]></title><link>https://example.org"), href, F.lit("</link><pubDate>"), F.length(title), F.lit("</pubDate><description>&lt;b&gt;About&lt;/b&gt; "), title, F.lit("</description></item>"))
    xml = F.concat(F.lit("<rss><channel>"), F.array_join(F.zip_with(part(1), part(2), item), "\n"), F.lit("</channel></rss>"))
    return t.pages.select("page_id", F.when(F.col("page_id") % 17 != 0, F.when(F.col("page_id") % 19 == 0, F.col("html")).otherwise(xml)).alias("xml"))


_ITEMS = f"(SELECT page_id, unnest({_LINKS.format(1)}) AS href, {_SQ.format('unnest(' + _LINKS.format(2) + ')')} AS title, length(unnest({_LINKS.format(2)}))::VARCHAR AS n, (generate_subscripts({_LINKS.format(2)}, 1) - 1)::INTEGER AS place FROM pages WHERE page_id % 17 <> 0 AND page_id % 19 <> 0)"


@query("S19_feed_items", f"SELECT page_id, place, title, 'https://example.org' || href AS link, n AS published, trim('About ' || title) AS summary, NULL::VARCHAR AS error FROM {_ITEMS} WHERE place < 8 AND title <> '' UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, NULL, CASE WHEN page_id % 17 = 0 THEN 'not fetched' ELSE 'not a feed' END FROM pages WHERE page_id % 17 = 0 OR page_id % 19 = 0")
def s19(t):
    return collect.feed_items(feeds(t), "page_id", "xml")


@query("S20_feed_titles", f"SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY place) - 1)::INTEGER AS place, title FROM {_ITEMS} WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY place) <= 50")
def s20(t):
    return collect.feed_titles(feeds(t), "page_id", "xml")


@query("S21_snapshot", f"SELECT page_id, substr({_PLAIN}, 1, 5000) AS text FROM pages")
def s21(t):
    return t.pages.select("page_id", F.substring(T.plain_text(F.col("html")), 1, 5000).alias("text"))


@query("S22_trusted", f"SELECT page_id, {_HOST} LIKE '%.example.org' OR {_HOST} = 'example.org' AS trusted FROM pages")
def s22(t):
    return t.pages.select("page_id", W.trusted(F.col("url"), ("example.org",)).alias("trusted"))


@query("S23_tree", "WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS node, 'n' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey < 20 THEN 'n' || c_nationkey ELSE 'c' || (c_custkey // 2) END FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), w AS (SELECT 'r' || r_regionkey AS node, 'r' || r_regionkey AS root, 0::BIGINT AS level FROM region UNION ALL SELECT e.node, w.root, w.level + 1 FROM e JOIN w ON e.parent = w.node) SELECT * FROM w")
def s23(t):
    """Regions, nations, suppliers, and customers of whom each leads to two others."""
    name = lambda letter, c: F.concat(F.lit(letter), c)
    nodes = t.region.select(name("r", "r_regionkey").alias("node"))
    edges = t.nation.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("node"))
    edges = edges.unionByName(t.supplier.select(name("n", "s_nationkey").alias("parent"), name("s", "s_suppkey").alias("node")))
    above = F.when(F.col("c_custkey") < 20, name("n", "c_nationkey")).otherwise(name("c", F.floor(F.col("c_custkey") / 2)))
    return collect.tree(nodes, edges.unionByName(t.customer.select(above.alias("parent"), name("c", "c_custkey").alias("node"))))


@query("S26_insert", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier")
def s26(t):
    rows = t.supplier.select("s_suppkey", "s_name")
    return rows.unionByName(rows.withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000))


@query("S27_upsert_last_wins", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey % 100 = 0")
def s27(t):
    rows = t.customer.select("c_custkey", "c_name")
    changed = rows.where("c_custkey % 10 = 0").withColumn("c_name", F.lit("new"))
    added = rows.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), F.lit("new").alias("c_name"))
    return upsert.last_wins(rows, changed.unionByName(added), ["c_custkey"])


@query("S28_upsert_first_wins", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey % 100 = 0")
def s28(t):
    rows = t.customer.select("c_custkey", "c_name")
    added = rows.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), F.lit("new").alias("c_name"))
    return upsert.first_wins(rows, added.unionByName(rows.withColumn("c_name", F.lit("x"))), ["c_custkey"])


@query("S29_upsert_columns", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def s29(t):
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    return upsert.update_columns(rows, rows.where("c_custkey % 10 = 0").select("c_custkey", F.lit("CHANGED").alias("c_mktsegment")), ["c_custkey"], ["c_mktsegment"])


@query("S31_seed", "SELECT n_name AS source, n_nationkey AS priority FROM nation UNION ALL SELECT * FROM (VALUES ('bizinfo', 10), ('k_startup', 20)) v WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = v.col0)")
def s31(t):
    """Seed rows go in where their key isn't there yet."""
    seeds = t.spark.createDataFrame([("bizinfo", 10), ("k_startup", 20), ("bizinfo", 99)], "source string, priority long").unionByName(t.nation.limit(1).select(F.col("n_name").alias("source"), F.lit(-1).cast("long").alias("priority")))
    return upsert.first_wins(t.nation.select(F.col("n_name").alias("source"), F.col("n_nationkey").cast("long").alias("priority")), seeds, ["source"], [F.col("priority")])


@query("S33_sitemap", f"SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS href, 'page' AS kind FROM pages UNION ALL SELECT '/', 'nav'")
def s33(t):
    pages = t.pages.select(F.regexp_replace("url", "[?#].*$", "").alias("href"), F.lit("page").alias("kind")).dropDuplicates(["href"])
    return pages.unionByName(t.spark.createDataFrame([("/", "nav")], "href string, kind string"))


@query("S34_text_export", "SELECT source, 1 AS part, doc_id, '- ' || doc_id AS line FROM documents UNION ALL SELECT DISTINCT source, 0, NULL::BIGINT, '# ' || source FROM documents")
def s34(t):
    """Lines of a text for each source: written sorted by source, part and id, they are the export."""
    heads = t.documents.select("source").distinct().select("source", F.lit(0).alias("part"), F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("# "), "source").alias("line"))
    return t.documents.select("source", F.lit(1).alias("part"), "doc_id", F.concat(F.lit("- "), "doc_id").alias("line")).unionByName(heads)


@query("S35_json_ld", "SELECT n_regionkey, '{\"@type\":\"ItemList\",\"items\":[' || string_agg('{\"name\":\"' || n_name || '\"}', ',' ORDER BY n_name) || ']}' AS json FROM nation GROUP BY 1")
def s35(t):
    names = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("n"))
    items = F.transform("n", lambda x: F.struct(x.alias("name")))
    return names.select("n_regionkey", F.to_json(F.struct(F.lit("ItemList").alias("@type"), items.alias("items"))).alias("json"))


@query("S36_form_filter", "SELECT conv_id, turn, trim(substr(text, 1, 80)) AS name, trim(substr(text, 1, 5000)) AS message FROM conversations WHERE role = 'user' AND conv_id % 7 <> 0 AND trim(substr(text, 1, 80)) <> '' AND trim(substr(text, 1, 5000)) <> ''")
def s36(t):
    """Users' turns as sent forms: one with its hidden field filled in is a robot's and goes; fields are cut to their lengths and must not be empty."""
    forms = t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("name"), F.col("text").alias("message"), F.when(F.col("conv_id") % 7 == 0, "http://x").otherwise("").alias("website"))
    return collect.accepted_forms(forms, "website", {"name": 80, "message": 5000}).select("conv_id", "turn", "name", "message")


@query("S37_prune_subscriptions", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0")
def s37(t):
    gone = t.supplier.where("s_suppkey % 5 = 0").select("s_suppkey")
    return t.supplier.select("s_suppkey").join(gone, "s_suppkey", "left_anti")


@query("S38_page_images", "SELECT l_orderkey, 'page-' || l_linenumber || '-' || l_partkey || '.png' AS name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, 'page-' || l_linenumber || '-' || l_partkey)::INTEGER AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> 'N')")
def s38(t):
    """The lines of an order as pages of a converted document, some of them no images."""
    name = F.concat(F.lit("page-"), "l_linenumber", F.lit("-"), "l_partkey", F.when(F.col("l_returnflag") == "N", ".txt").otherwise(".png"))
    return collect.page_images(t.lineitem.select("l_orderkey", name.alias("name")).distinct(), "l_orderkey", "name")
