"""Composite jobs and the state changes that span tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions import dates as D
from inkwell.functions import html as H
from inkwell.functions import privacy as P
from inkwell.functions import scoring as S
from inkwell.functions import text as T
from inkwell.functions import web as W
from inkwell.operators import queue, rules, selection, similarity, upsert
from inkwell.plans import jobs
from inkwell.queries import query
from inkwell.queries import sorting, state
from inkwell.queries.filters import TS
from inkwell.sources import collect


@query("S14_source_dispatch", "SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN 'english' WHEN url LIKE '%/de/%' THEN 'german' ELSE 'generic' END AS collector FROM pages")
def s14(t):
    """Each source key has its own reader; pages go by the language in their path."""
    readers = {"/en/": "english", "/de/": "german"}
    out = F.lit("generic")
    for mark, name in reversed(readers.items()):
        out = F.when(F.col("url").contains(mark), name).otherwise(out)
    return t.pages.select("page_id", out.alias("collector"))


@query("S24_paths_to_delete", "SELECT 'bucket-' || (l_suppkey % 3) AS bucket, count(*) AS files FROM lineitem WHERE l_orderkey IN (SELECT id FROM work_items WHERE status = 'published') GROUP BY 1")
def s24(t):
    """Files of published items by bucket: deletes come out as rows, none is performed."""
    old = t.work_items.where(F.col("status") == "published").select(F.col("id").alias("l_orderkey"))
    return t.lineitem.join(old, "l_orderkey", "left_semi").groupBy(F.concat(F.lit("bucket-"), F.col("l_suppkey") % 3).alias("bucket")).agg(F.count("*").alias("files"))


@query("S25_append_events", "SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def s25(t):
    """The batch twin of ``streaming.windows.append_log``: what the log holds by day."""
    return t.events.groupBy(F.to_date(D.kst(F.col("ts"))).alias("day")).agg(F.count("*").alias("n"))


@query("S30_conditional_upsert", "SELECT id, CASE WHEN status = 'completed' THEN status WHEN status = 'running' AND lease_expires_at > TIMESTAMP '1998-01-01' THEN status ELSE 'claimed' END AS status FROM jobs")
def s30(t):
    """Replaced unless final or under a lease that still holds."""
    held = (F.col("status") == "completed") | ((F.col("status") == "running") & (F.col("lease_expires_at") > TS("1998-01-01")))
    return t.jobs.select("id", F.when(held, F.col("status")).otherwise("claimed").alias("status"))


@query("A20_redaction_counts")
def a20(t):
    """Of each kind, from the passes of the redaction, and in all."""
    rows = P.with_redaction(t.documents.select("doc_id", "text"), "text")
    return rows.select("doc_id", "redaction.counts.*", "redaction.total")


@query("T19_font_requeue", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 AND s_suppkey % 2 = 0 THEN 'queued' WHEN s_suppkey % 7 = 0 THEN 'failed' ELSE 'done' END AS state FROM supplier")
def t19(t):
    """Failed for want of a font that has come since: queued again."""
    jobs = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, "failed").otherwise("done").alias("state"), F.concat(F.lit("font"), F.col("s_suppkey") % 2).alias("font"))
    fonts = t.spark.createDataFrame([("font0",)], "font string").withColumn("came", F.lit(True))
    met = jobs.join(fonts, "font", "left")
    return met.select("s_suppkey", F.when((F.col("state") == "failed") & F.col("came"), "queued").otherwise(F.col("state")).alias("state"))


@query("T20_cancellation", "SELECT j.id, CASE WHEN w.id IS NOT NULL AND j.status <> 'completed' THEN 'cancelled' ELSE j.status END AS status FROM jobs j LEFT JOIN (SELECT id FROM work_items WHERE status = 'planned') w ON w.id = j.id")
def t20(t):
    doomed = t.work_items.where(F.col("status") == "planned").select("id", F.lit(True).alias("gone"))
    return t.jobs.join(doomed, "id", "left").select("id", F.when(F.col("gone") & (F.col("status") != "completed"), "cancelled").otherwise(F.col("status")).alias("status"))


@query("T26_terminal_hold", "SELECT w.id, CASE WHEN f.item IS NOT NULL AND w.status NOT IN ('published', 'approved') THEN 'on_hold' ELSE w.status END AS status FROM work_items w LEFT JOIN (SELECT DISTINCT item_id AS item FROM jobs WHERE status = 'waiting' AND attempts >= max_attempts) f ON f.item = w.owner")
def t26(t):
    failed = queue.normalized(t.jobs).where(F.col("status") == "failed").select(F.col("item_id").alias("owner"), F.lit(True).alias("failed")).distinct()
    hold = F.col("failed") & ~F.col("status").isin("published", "approved")
    return t.work_items.join(failed, "owner", "left").select("id", F.when(hold, "on_hold").otherwise(F.col("status")).alias("status"))


@query("T29_relayout")
def t29(t):
    """Figures laid out anew in the newest version of each page."""
    newest = upsert.latest(t.pages.withColumn("host", W.host(F.col("url"))), ["host"], "page_id")
    return newest.select("page_id", H.interleaved(F.col("html"), F.array(F.lit("<figure>new</figure>"))).alias("html"))


@query("Q04_partner_queue", "SELECT w.id, w.status, array_to_string(list_filter([CASE WHEN w.url IS NULL THEN 'no_url' END, CASE WHEN n = 0 THEN 'no_assets' END], lambda x: x IS NOT NULL), ',') AS blockers FROM (SELECT wi.*, (SELECT count(*) FROM lineitem WHERE l_orderkey = wi.id) AS n FROM work_items wi WHERE status IN ('in_review', 'approved')) w")
def q04(t):
    assets = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    rows = t.work_items.where(F.col("status").isin("in_review", "approved")).join(assets, "id", "left")
    found = rules.issues({"no_url": F.col("url").isNull(), "no_assets": F.coalesce("n", F.lit(0)) == 0})
    return rows.select("id", "status", F.array_join(found, ",").alias("blockers"))


@query("Q05_morning_collection", "WITH f AS (SELECT min(doc_id) AS doc_id, title FROM articles GROUP BY title), n AS (SELECT * FROM f WHERE title NOT IN (SELECT substr(text, 1, 60) FROM benchmark)) SELECT doc_id, CASE WHEN regexp_matches(title, '(?i)tion') THEN 'A' ELSE 'B' END AS priority FROM n WHERE length(title) >= 20")
def q05(t):
    """Listed, once by title, new, complete and with a priority."""
    once = upsert.first_seen(t.articles.select("doc_id", "title"), ["title"], [F.col("doc_id")])
    known = t.benchmark.select(F.substring("text", 1, 60).alias("title"))
    fresh = once.join(known, "title", "left_anti").where(F.length("title") >= 20)
    return fresh.select("doc_id", F.when(F.col("title").rlike("(?i)tion"), "A").otherwise("B").alias("priority"))


@query("Q06_detail_repair", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), 'from-detail') AS source FROM documents")
def q06(t):
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("source"))
    return collect.filled(rows, t.documents.select("doc_id", F.lit("from-detail").alias("source")), "doc_id", ["source"])


@query(
    "Q07_condense_merge",
    "WITH p AS (SELECT doc_id, substr(body, 1, 200) AS summary, coalesce(max(l.toxic), 0) = 1 AS done FROM articles LEFT JOIN labels l USING (doc_id) WHERE lang = 'en' GROUP BY 1, 2), "
    "t AS (SELECT doc_id FROM p WHERE NOT done ORDER BY length(summary) DESC, doc_id LIMIT 30), a AS (SELECT item_id AS doc_id, CASE WHEN item_id % 5 = 0 THEN '' ELSE substr(min(text), 1, 40) END AS short FROM benchmark WHERE text IS NOT NULL GROUP BY 1) "
    "SELECT p.doc_id, CASE WHEN t.doc_id IS NOT NULL THEN coalesce(nullif(a.short, ''), summary) ELSE summary END AS summary, done OR t.doc_id IS NOT NULL AND a.doc_id IS NOT NULL AS condensed FROM p LEFT JOIN t USING (doc_id) LEFT JOIN a USING (doc_id)",
)
def q07(t):
    """The day's first programs that aren't condensed yet are; an answer without text leaves the old summary, one for another program changes nothing."""
    done = t.labels.groupBy("doc_id").agg((F.coalesce(F.max("toxic"), F.lit(0)) == 1).alias("done"))
    programs = t.articles.where("lang = 'en'").select("doc_id", F.substring("body", 1, 200).alias("summary")).join(done, "doc_id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    targets = programs.where(~F.col("done")).orderBy(F.desc(F.length("summary")), "doc_id").limit(30).select("doc_id", F.lit(True).alias("target"))
    answers = t.benchmark.where("text is not null").groupBy(F.col("item_id").alias("doc_id")).agg(F.min("text").alias("text"))
    answers = answers.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.substring("text", 1, 40)).alias("short"))
    hits = targets.join(answers, "doc_id")
    return programs.join(hits, "doc_id", "left").select("doc_id", F.coalesce(F.nullif("short", F.lit("")), "summary").alias("summary"), (F.col("done") | F.coalesce("target", F.lit(False))).alias("condensed"))


@query("Q08_generation_gate", state.similarity_sql(58) + "SELECT a.doc_id, CASE WHEN worst >= 58 THEN worst ELSE 0 END AS worst, coalesce(worst, 0) >= 58 AS duplicate FROM a LEFT JOIN s USING (doc_id)")
def q08(t):
    """Each text against all before it: the worst similarity from 58 on decides."""
    worst = similarity.worst_before(t.documents.select("doc_id", "text"), "doc_id", 58)
    return worst.select("doc_id", "worst", (F.col("worst") >= 58).alias("duplicate"))


_ROUND = (
    "r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY use_count, created_at DESC, id) AS turn FROM knowledge), g AS (SELECT area, row_number() OVER (ORDER BY use_count, created_at DESC, id) AS g FROM r WHERE turn = 1), "
    "k AS (SELECT id, area, row_number() OVER (ORDER BY turn, g)::INTEGER AS place FROM r JOIN g USING (area) QUALIFY place <= 12)"
)


@query(
    "Q09_column_gate",
    f"WITH {_ROUND}, u AS (SELECT url, arg_max(page_id, (tier, page_id)) AS page_id, min((tier, page_id)) AS place FROM (SELECT url, page_id, CASE WHEN url LIKE '%/en/%' THEN 1 ELSE 2 END AS tier FROM pages WHERE url IS NOT NULL) GROUP BY 1), "
    "c AS (SELECT count(*) AS sources FROM (SELECT * FROM u ORDER BY place LIMIT 30)) "
    "SELECT place, id, regexp_replace(substr(regexp_replace(regexp_replace(lower(area || ' ' || id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS slug, sources, sources >= 2 AS ready FROM k CROSS JOIN c",
)
def q09(t):
    """A column goes out with knowledge by rotation and up to thirty sources, supplied ones before those of feeds; of sources with one address the last
    value wins at the place of the first. Without two sources it isn't ready."""
    picked = upsert.interleave(t.knowledge, "area", [F.col("use_count"), F.desc("created_at"), F.col("id")], 12)
    tier = F.when(F.col("url").contains("/en/"), 1).otherwise(2)
    at = F.struct(tier.alias("tier"), "page_id")
    sources = t.pages.where("url is not null").groupBy("url").agg(F.max_by("page_id", at).alias("page_id"), F.min(at).alias("at")).orderBy("at").limit(30)
    count = sources.agg(F.count("*").alias("sources"))  # one row
    slug = T.slug(F.concat("area", F.lit(" "), "id"))
    return picked.select("place", "id", slug.alias("slug")).crossJoin(F.broadcast(count)).withColumn("ready", F.col("sources") >= 2)


@query("Q11_slide_review")
def q11(t):
    """Scored slides of a deck, the crowded left out (never under three), up to six chosen with regard to their sections, and the cover."""
    rows = t.slides.groupBy("deck", "part").agg(F.max(sorting.slide_score()).cast("double").alias("score"), F.min("line").alias("line"), F.min("density").alias("density"))
    light = selection.without_heavy(rows, "deck", "part", "density", 80, 3)
    place = F.row_number().over(Window.partitionBy("deck").orderBy("part"))
    ranked = light.select("deck", "part", "score", F.col("line").cast("string").alias("section")).withColumn("index", place)
    chosen = selection.diverse(ranked.select("deck", "index", "section", "score"), "deck", 6)
    cover = t.slides.groupBy("deck").agg(F.coalesce(F.min(F.when(F.col("line") == 1, F.col("part"))), F.min("part")).alias("cover"))
    return chosen.join(ranked, ["deck", "index"]).join(cover, "deck").select("deck", "place", "part", (F.col("part") == F.col("cover")).alias("is_cover"))


#: Slots of the week: name, weekday (Sunday is 0), Korean hour, and whether only even ISO weeks have it.
_SLOTS = (("consult-tue", 2, 9, False), ("design-thu", 4, 10, False), ("home-thu", 4, 14, False), ("home-sat", 6, 9, True))


@query(
    "Q13_hourly_operations",
    "WITH r AS (SELECT date_trunc('hour', ts) AS run, count(*) AS calls FROM events GROUP BY 1), k AS (SELECT run, run + INTERVAL 9 HOUR AS l FROM r), "
    f"s AS (SELECT * FROM (VALUES {', '.join(map(str, _SLOTS))}) v(slot, weekday, hour, even_weeks)), "
    "d AS (SELECT strftime(l, '%Y-%m-%d') || '-' || slot AS key, l::DATE AS day, min(run) AS run FROM k JOIN s ON dayofweek(l) = weekday AND hour(l) >= s.hour AND (NOT even_weeks OR weekofyear(l) % 2 = 0) GROUP BY 1, 2), "
    "n AS (SELECT run, count(*) AS scheduled FROM d WHERE day(day) % 3 <> 0 GROUP BY 1) SELECT run, calls, coalesce(scheduled, 0) AS scheduled FROM r LEFT JOIN n USING (run)",
)
def q13(t):
    """Each event as a call of the hourly job; every third day of a month has its work already."""
    slots = t.spark.createDataFrame(_SLOTS, "slot string, weekday int, hour int, even_weeks boolean")
    days = t.events.select(F.explode(F.array(F.to_date("ts"), F.date_add(F.to_date("ts"), 1))).alias("day")).distinct().where(F.dayofmonth("day") % 3 == 0)
    existing = days.join(F.broadcast(slots.select("slot")), F.lit(True)).select(F.concat_ws("-", F.date_format("day", "yyyy-MM-dd"), "slot").alias("schedule_key"))
    return jobs.hourly_operations(t.events, slots, existing, "ts").withColumn("run", F.col("run").cast("timestamp_ntz"))


@query("Q15_review_with_cache")
def q15(t):
    """Redacted, cut into changes (null where the edit goes too far), and only what no cache has."""
    found = state.t16(t).where(F.col("found") == "miss").select("doc_id")
    rows = P.with_redaction(t.documents.select("doc_id", "text").join(found, "doc_id"), "text").select("doc_id", "redaction.text")
    return rows.select("doc_id", F.array_size(H.changes(F.col("text"), F.regexp_replace("text", "(?i)that ", "which "))).alias("hunks"))


@query("Q17_style_revision", "SELECT count(*) FILTER (quality = 0) AS rewrite, count(*) FILTER (quality = 1) AS kept, count(*) FILTER (quality IS NULL) AS deferred, sum(least(n_chars, greatest(1600, floor(0.65::DOUBLE * n_chars + 0.5))))::BIGINT AS least FROM documents LEFT JOIN labels USING (doc_id)")
def q17(t):
    n = F.col("n_chars")
    rows = t.documents.join(t.labels, "doc_id", "left")
    q = F.col("quality")
    return rows.agg(F.count_if(q == 0).alias("rewrite"), F.count_if(q == 1).alias("kept"), F.count_if(q.isNull()).alias("deferred"), F.sum(F.least(n, F.greatest(F.lit(1600), S.half_up(0.65 * n)))).alias("least"))


_EDIT = "regexp_replace(regexp_replace(text, '(?i)the ', 'a ', 'g'), '(?i)phone', 'No. 7', 'g')"
_FACTS = "list_sort(regexp_extract_all({}, '[0-9][0-9,]*(?:\\.[0-9]+)?%?'))"


@query(
    "Q20_manual_revision",
    f"WITH e AS (SELECT doc_id, text, {_EDIT} AS edit, doc_id % 10 = 3 AS moved FROM documents), c AS (SELECT doc_id, {_FACTS.format('text')} = {_FACTS.format('edit')} AS facts, "
    "length(edit) BETWEEN floor(0.8::DOUBLE * length(text)) AND ceil(1.1::DOUBLE * length(text)) AS size, edit <> text AS changed, moved FROM e) "
    "SELECT doc_id, CASE WHEN NOT facts THEN 'facts' WHEN NOT size THEN 'length' WHEN NOT changed THEN 'same' WHEN moved THEN 'conflict' ELSE 'applied' END AS outcome, "
    "CASE WHEN facts AND size AND changed AND NOT moved THEN 2 ELSE CASE WHEN moved THEN 5 ELSE 1 END END AS version FROM c",
)
def q20(t):
    """An edit is applied if it keeps the numbers of the text and about its length, changes something, and finds the version that it was made for."""
    edit = F.regexp_replace(F.regexp_replace("text", "(?i)the ", "a "), "(?i)phone", "No. 7")
    now = t.documents.select("doc_id", "text", F.when(F.col("doc_id") % 10 == 3, 5).otherwise(1).alias("version"))
    n, m = F.length("text"), F.length(edit)
    checked = t.documents.select(
        "doc_id",
        edit.alias("text"),
        F.when(T.numbers(F.col("text")) != T.numbers(edit), "facts").when((m < F.floor(0.8 * n)) | (m > F.ceil(1.1 * n)), "length").when(edit == F.col("text"), "same").alias("issue"),
    )
    good = checked.where("issue is null").select("doc_id", "text", F.lit(1).alias("version"))
    done, conflicts = queue.compare_and_set(now, good, "doc_id", "version", ["text"])
    out = done.select("doc_id", "version").join(checked.select("doc_id", "issue"), "doc_id").join(conflicts.withColumn("lost", F.lit(True)), "doc_id", "left")
    return out.select("doc_id", F.coalesce("issue", F.when(F.col("lost"), "conflict").otherwise("applied")).alias("outcome"), "version")
