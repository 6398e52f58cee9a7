"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.operators import counting as C
from inkwell.operators import geometry, similarity
from inkwell.queries import query

_DAY = "CAST(accessed_at + INTERVAL 9 HOUR AS DATE)"
_TOP12 = "SELECT bot_name FROM traffic GROUP BY 1 ORDER BY count(*) DESC, bot_name LIMIT 12"
_KINDS = "CASE WHEN requested_path LIKE '/columns/%' THEN 'column' WHEN requested_path LIKE '/portfolio/%' THEN 'portfolio' WHEN requested_path LIKE '//%' THEN 'home' ELSE 'page' END"


def page_kind():
    p = F.col("requested_path")
    return F.when(p.startswith("/columns/"), "column").when(p.startswith("/portfolio/"), "portfolio").when(p.startswith("//"), "home").otherwise("page")


@query("A01_group_count", "SELECT coalesce(nullif(country, ''), 'unknown') AS country, count(*) AS n FROM traffic GROUP BY 1")
def a01(t):
    return C.count_by(t.traffic, "country")


@query(
    "A02_six_counts",
    "WITH w AS (SELECT coalesce(bot_category, 'unknown') AS category, bot_name AS bot, bot_operator AS operator, " + _KINDS + " AS kind, coalesce(nullif(country, ''), 'unknown') AS country, requested_path AS path FROM traffic) "
    + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n FROM w GROUP BY 2" for d in ("category", "bot", "operator", "kind", "country", "path")),
)
def a02(t):
    names = {"category": "bot_category", "bot": "bot_name", "operator": "bot_operator", "country": "country", "path": "requested_path"}
    return C.counts_of_each(t.traffic, {**{d: F.col(c) for d, c in names.items()}, "kind": page_kind()})


@query("A03_day_count", f"SELECT {_DAY} AS day, count(*) AS n FROM traffic GROUP BY 1")
def a03(t):
    return t.traffic.groupBy(F.to_date(C.kst("accessed_at")).alias("day")).agg(F.count("*").alias("n"))


@query(
    "A04_day_by_bot",
    f"WITH top AS ({_TOP12}), c AS (SELECT {_DAY} AS day, bot_name, count(*) AS n FROM traffic GROUP BY 1, 2) "
    "SELECT d.day, top.bot_name, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT day FROM c) d CROSS JOIN top LEFT JOIN c ON c.day = d.day AND c.bot_name = top.bot_name",
)
def a04(t):
    counts = t.traffic.groupBy(F.to_date(C.kst("accessed_at")).alias("day"), "bot_name").agg(F.count("*").alias("n"))
    bots = C.top(counts.groupBy("bot_name").agg(F.sum("n").alias("n")), 12, [F.desc("n"), F.col("bot_name")]).select("bot_name")
    grid = counts.select("day").distinct().crossJoin(F.broadcast(bots))  # days by 12 bots
    return C.complete(counts, grid, "day", "bot_name")


@query("A05_weekday_hour", "SELECT dayofweek(accessed_at + INTERVAL 9 HOUR)::INTEGER AS weekday, hour(accessed_at + INTERVAL 9 HOUR)::INTEGER AS hour, count(*) AS n FROM traffic GROUP BY 1, 2")
def a05(t):
    at = C.kst("accessed_at")
    return t.traffic.groupBy((F.dayofweek(at) - 1).alias("weekday"), F.hour(at).alias("hour")).agg(F.count("*").alias("n"))


@query("A06_conditional_counts", "SELECT count(*) FILTER (bot_category = 'ai') AS ai, count(*) FILTER (bot_category = 'search') AS search FROM traffic")
def a06(t):
    return t.traffic.agg(F.count_if(F.col("bot_category") == "ai").alias("ai"), F.count_if(F.col("bot_category") == "search").alias("search"))


@query("A07_distinct_bots", "SELECT count(DISTINCT bot_name) AS bots FROM traffic")
def a07(t):
    return t.traffic.agg(F.countDistinct("bot_name").alias("bots"))


@query("A08_sampled", "SELECT count(*) AS total, least(count(*), 10000) AS sampled, count(*) > 10000 AS truncated FROM traffic")
def a08(t):
    n = F.count("*")
    return t.traffic.agg(n.alias("total"), F.least(n, F.lit(10_000)).alias("sampled"), (n > 10_000).alias("truncated"))


@query(
    "A09_top_and_other",
    "WITH c AS (SELECT bot_operator || '/' || coalesce(bot_category, 'unknown') AS slice, count(*) AS n FROM traffic GROUP BY 1), "
    "r AS (SELECT *, least(row_number() OVER (ORDER BY n DESC, slice), 8) AS r FROM c), "
    "s AS (SELECT r, CASE WHEN r > 7 THEN 'other' ELSE min(slice) END AS slice, sum(n)::BIGINT AS n FROM r GROUP BY r) "
    "SELECT slice, n, round(n / sum(n) OVER (), 6) AS share, round(coalesce(sum(n) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (), 6) AS start FROM s",
)
def a09(t):
    rows = t.traffic.select(F.concat("bot_operator", F.lit("/"), C.known("bot_category")).alias("slice"))
    return C.top_and_other(rows.groupBy("slice").agg(F.count("*").alias("n")), "slice", 7)


@query("A10_bar_share", "WITH c AS (SELECT bot_operator, count(*) AS n FROM traffic GROUP BY 1) SELECT bot_operator, n, greatest(0.02::DOUBLE, round(n / max(n) OVER (), 6)) AS bar FROM c")
def a10(t):
    counts = t.traffic.groupBy("bot_operator").agg(F.count("*").alias("n"))
    return counts.withColumn("bar", F.greatest(F.lit(0.02), F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 6)))


@query(
    "A11_heat_grid",
    "WITH c AS (SELECT dayofweek(accessed_at + INTERVAL 9 HOUR)::INTEGER AS weekday, hour(accessed_at + INTERVAL 9 HOUR)::INTEGER AS hour, count(*) AS n FROM traffic GROUP BY 1, 2) "
    "SELECT w.weekday, h.hour, coalesce(n, 0) AS n FROM (SELECT unnest(range(7))::INTEGER AS weekday) w CROSS JOIN (SELECT unnest(range(24))::INTEGER AS hour) h LEFT JOIN c ON c.weekday = w.weekday AND c.hour = h.hour",
)
def a11(t):
    grid = t.spark.range(7).select(F.col("id").cast("int").alias("weekday")).crossJoin(t.spark.range(24).select(F.col("id").cast("int").alias("hour")))
    return C.complete(a05(t), grid, "weekday", "hour")


def usage_sums(rows, daily_from: str):
    """Attempts and cost of all rows (a month) and of those from ``daily_from``."""
    attempts = F.coalesce("network", "reserved", F.lit(1))
    cost = F.coalesce("accounted", "actual", "estimated", F.lit(0.0))
    daily = F.col("created_at") >= F.lit(daily_from).cast("timestamp_ntz")
    return rows.agg(
        F.sum(attempts).cast("long").alias("monthly_attempts"),
        F.round(F.sum(cost), 4).alias("monthly_cost"),
        F.sum(F.when(daily, attempts).otherwise(0)).cast("long").alias("daily_attempts"),
        F.round(F.sum(F.when(daily, cost).otherwise(0.0)), 4).alias("daily_cost"),
    )


_USAGE = (
    "SELECT sum(a)::BIGINT AS monthly_attempts, round(sum(c), 4) AS monthly_cost, sum(CASE WHEN d THEN a ELSE 0 END)::BIGINT AS daily_attempts, round(sum(CASE WHEN d THEN c ELSE 0 END), 4) AS daily_cost "
    "FROM (SELECT coalesce(network, reserved, 1) AS a, coalesce(accounted, actual, estimated, 0) AS c, created_at >= TIMESTAMP '2024-01-30 00:00:00' AS d FROM usage)"
)


@query("A12_usage_sums", _USAGE)
def a12(t):
    return usage_sums(t.usage, "2024-01-30 00:00:00")


@query("A13_mergeable_sums", _USAGE)
def a13(t):
    """The sums of ten pages, added up."""
    paged = t.usage.withColumn("page", F.col("id") % 10)
    attempts, cost = F.coalesce("network", "reserved", F.lit(1)), F.coalesce("accounted", "actual", "estimated", F.lit(0.0))
    daily = F.col("created_at") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    parts = paged.groupBy("page").agg(F.sum(attempts).alias("a"), F.sum(cost).alias("c"), F.sum(F.when(daily, attempts)).alias("da"), F.sum(F.when(daily, cost)).alias("dc"))
    return parts.agg(F.sum("a").cast("long").alias("monthly_attempts"), F.round(F.sum("c"), 4).alias("monthly_cost"), F.coalesce(F.sum("da"), F.lit(0)).cast("long").alias("daily_attempts"), F.round(F.coalesce(F.sum("dc"), F.lit(0.0)), 4).alias("daily_cost"))


@query("A14_distinct_sets", "SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM conversations GROUP BY 1")
def a14(t):
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


_INVENTORY = "SELECT area, count(*) AS cards, sum(greatest(0, 3 - use_count))::BIGINT AS remaining FROM knowledge GROUP BY 1"


@query("A15_inventory", f"WITH i AS ({_INVENTORY}), a AS (SELECT DISTINCT area FROM knowledge UNION ALL SELECT 'planning') SELECT a.area, coalesce(cards, 0) AS cards, coalesce(remaining, 0) AS remaining FROM a LEFT JOIN i USING (area)")
def a15(t):
    areas = t.knowledge.select("area").distinct().unionByName(t.spark.range(1).select(F.lit("planning").alias("area")))
    found = t.knowledge.groupBy("area").agg(F.count("*").alias("cards"), F.sum(F.greatest(F.lit(0), 3 - F.col("use_count"))).alias("remaining"))
    return areas.join(found, "area", "left").select("area", F.coalesce("cards", F.lit(0)).alias("cards"), F.coalesce("remaining", F.lit(0)).alias("remaining"))


@query("A16_shortages", f"WITH i AS ({_INVENTORY}) SELECT area, remaining, CASE WHEN remaining = 0 THEN 'empty' WHEN remaining <= 60 THEN 'low' ELSE 'enough' END AS level FROM i WHERE remaining <= 100")
def a16(t, low: int = 60, limit: int = 100):
    found = t.knowledge.groupBy("area").agg(F.sum(F.greatest(F.lit(0), 3 - F.col("use_count"))).alias("remaining")).where(F.col("remaining") <= limit)
    return found.withColumn("level", F.when(F.col("remaining") == 0, "empty").when(F.col("remaining") <= low, "low").otherwise("enough"))


_STATUS = "CASE WHEN last_seen_at <= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 3 MINUTE THEN 'offline' WHEN last_error IS NOT NULL THEN 'error' WHEN current_job_id IS NOT NULL THEN 'busy' ELSE 'online' END"


@query("A17_worker_summary", f"SELECT count(*) FILTER (s <> 'offline') AS online, count(*) FILTER (s = 'busy') AS busy, count(*) FILTER (s = 'error') AS error, coalesce(bool_or(s <> 'offline'), false) AS any_online FROM (SELECT {_STATUS} AS s FROM workers)")
def a17(t):
    from inkwell.operators.queue import worker_status

    s = worker_status(F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    online = s != "offline"
    return t.workers.agg(F.count_if(online).alias("online"), F.count_if(s == "busy").alias("busy"), F.count_if(s == "error").alias("error"), F.coalesce(F.bool_or(online), F.lit(False)).alias("any_online"))


@query("A18_retention_totals", "SELECT count(*) AS rules, sum(n)::BIGINT AS purged, count(*) FILTER (n > 1000) AS remaining FROM (SELECT job_type, count(*) AS n FROM jobs WHERE created_at < TIMESTAMP '1998-01-01' GROUP BY 1)")
def a18(t):
    rules = t.jobs.where(F.col("created_at") < F.lit("1998-01-01").cast("timestamp_ntz")).groupBy("job_type").agg(F.count("*").alias("n"))
    return rules.agg(F.count("*").alias("rules"), F.sum("n").alias("purged"), F.count_if(F.col("n") > 1000).alias("remaining"))


@query("A19_outcomes", "SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS updated, count(*) FILTER (toxic = 1) AS failed, count(*) FILTER (quality = 0 AND toxic = 0) AS skipped, count(*) FILTER (quality IS NULL) AS deferred FROM documents LEFT JOIN labels USING (doc_id)")
def a19(t):
    q, x = F.col("quality"), F.col("toxic")
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return rows.agg(F.count_if((q == 1) & (x == 0)).alias("updated"), F.count_if(x == 1).alias("failed"), F.count_if((q == 0) & (x == 0)).alias("skipped"), F.count_if(q.isNull()).alias("deferred"))


@query("A21_term_frequency", "SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS token FROM documents) GROUP BY 1, 2")
def a21(t):
    rows = t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,}"), F.lit(0))).alias("token"))
    return rows.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("A22_median", "SELECT deck, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(median(height), 9) ELSE 0.0::DOUBLE END AS middle FROM rects GROUP BY 1")
def a22(t):
    return t.rects.groupBy("deck").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.round(F.median("height"), 9)).otherwise(0.0).alias("middle"))


@query("A23_contrast", "SELECT vec_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS spread FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def a23(t):
    return t.embeddings.select("vec_id", F.explode(F.col("embedding").cast("array<double>")).alias("x")).groupBy("vec_id").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("spread"))


@query(
    "A24_rarity",
    "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings), "
    "p AS (SELECT a.vec_id, list_sum(list_transform(list_zip(a.b, c.b), lambda z: abs(z[1] - z[2])))::BIGINT AS d, c.vec_id AS other FROM v a JOIN v c ON a.label = c.label AND a.vec_id <> c.vec_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS k FROM p) SELECT vec_id, round(avg(d) / 64, 6) AS rarity FROM r WHERE k <= 4 GROUP BY 1",
)
def a24(t):
    """Mean Hamming distance to the four nearest of the same deck (label)."""
    from inkwell.functions.hashing import sign_bits

    v = t.embeddings.select("vec_id", "label", sign_bits(F.col("embedding")).alias("bits"))
    near = similarity.nearest_hashes(v, "label", "bits", 4).where(F.size("distances") > 0)
    mean = F.aggregate("distances", F.lit(0), lambda a, x: a + x) / F.size("distances")
    return v.join(near.select("label", "bits", F.round(mean / 64, 6).alias("rarity")), ["label", "bits"]).select("vec_id", "rarity")


@query(
    "A25_worst_similarity",
    "WITH a AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) AS w FROM documents), b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) AS w FROM benchmark), "
    "na AS (SELECT doc_id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1), s AS (SELECT doc_id, item_id, count(*) AS c FROM a JOIN b USING (w) GROUP BY 1, 2), "
    "p AS (SELECT doc_id, floor(100 * c / (na.n + nb.n - c) + 0.5)::BIGINT AS score FROM s JOIN na USING (doc_id) JOIN nb USING (item_id)) "
    "SELECT d.doc_id, coalesce(max(score), 0) AS worst, count(score) AS items FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id AND score >= 10 GROUP BY 1",
)
def a25(t):
    """The highest similarity of each text with any item of the benchmark, from ten hundredths on, and with how many items it has that much."""
    met = similarity.jaccard_join(t.documents.select("doc_id", "text"), t.benchmark, "doc_id", "item_id", least=10)
    worst = met.groupBy("doc_id").agg(F.max("score").alias("worst"), F.count("*").alias("items"))
    return t.documents.select("doc_id").join(worst, "doc_id", "left").select("doc_id", F.coalesce("worst", F.lit(0).cast("long")).alias("worst"), F.coalesce("items", F.lit(0).cast("long")).alias("items"))


@query(
    "A26_union_area",
    "WITH r AS (SELECT DISTINCT deck, x AS x0, least(1, x + width) AS x1, y AS y0, least(1, y + height) AS y1 FROM rects WHERE width > 0 AND height > 0), "
    "e AS (SELECT deck, x0 AS x FROM r UNION SELECT deck, x1 FROM r), s AS (SELECT deck, x AS a, lead(x) OVER (PARTITION BY deck ORDER BY x) AS b FROM e), "
    "c AS (SELECT s.deck, s.a, s.b, r.y0, r.y1, max(r.y1) OVER (PARTITION BY s.deck, s.a ORDER BY r.y0, r.y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s JOIN r ON r.deck = s.deck AND r.x0 <= s.a AND r.x1 >= s.b WHERE s.b IS NOT NULL) "
    "SELECT deck, round(sum((b - a) * greatest(0, y1 - greatest(y0, coalesce(reach, y0)))) + 1e-9, 6) AS area FROM c GROUP BY 1",
)
def a26(t):
    return geometry.union_area(t.rects, "deck").select("deck", F.round(F.col("area") + 1e-9, 6).alias("area"))


@query(
    "A27_grid_coverage",
    "SELECT deck, count(DISTINCT cx * 32 + cy) AS cells, round(count(DISTINCT cx * 32 + cy) / 1600, 6) AS coverage FROM (SELECT deck, cx, unnest(range(floor(y * 32)::BIGINT, least(32, ceil((y + height) * 32 - 1e-9))::BIGINT)) AS cy FROM "
    "(SELECT *, unnest(range(floor(x * 50)::BIGINT, least(50, ceil((x + width) * 50 - 1e-9))::BIGINT)) AS cx FROM rects)) GROUP BY 1",
)
def a27(t):
    return geometry.grid_coverage(t.rects, "deck", 50, 32)


@query("A28_flat_share", "SELECT vec_id, count(*) AS shades, round(max(n) / 64, 6) AS modal FROM (SELECT vec_id, c, count(*) AS n FROM (SELECT vec_id, floor(unnest(embedding)::DOUBLE * 8) AS c FROM embeddings) GROUP BY 1, 2) GROUP BY 1")
def a28(t):
    """Different shades of a picture and the share of the commonest (64 pixels)."""
    shades = t.embeddings.select("vec_id", F.explode("embedding").alias("p")).groupBy("vec_id", F.floor(F.col("p").cast("double") * 8).alias("c")).agg(F.count("*").alias("n"))
    return shades.groupBy("vec_id").agg(F.count("*").alias("shades"), F.round(F.max("n") / 64, 6).alias("modal"))


@query("A29_changed_pixels", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CASE WHEN abs(z[1] - z[2]) > 0.1::FLOAT THEN 1 ELSE 0 END)) / 64, 6) AS changed FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def a29(t):
    after = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    moved = F.zip_with("embedding", "after", lambda a, b: (F.abs(a - b) > F.lit(0.1).cast("float")).cast("int"))
    return t.embeddings.join(after, "vec_id").select("vec_id", F.round(F.aggregate(moved, F.lit(0), lambda s, x: s + x) / 64, 6).alias("changed"))


_PHRASES = (("of the", "cliche"), ("in the", "cliche"), ("that", "filler"))


@query(
    "A30_pattern_counts",
    "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(lower(text), '{p}')) AS n{k}" for k, (p, _) in enumerate(_PHRASES)) + ", " + " + ".join(f"len(regexp_extract_all(lower(text), '{p}'))" for p, _ in _PHRASES) + " AS total, "
    "len(list_distinct(regexp_extract_all(lower(text), '[a-z]+ing'))) AS endings FROM documents",
)
def a30(t):
    counts = [F.regexp_count(F.lower("text"), F.lit(p)).cast("long").alias(f"n{k}") for k, (p, _) in enumerate(_PHRASES)]
    endings = F.array_size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+ing"), F.lit(0)))).cast("long")
    rows = t.documents.select("doc_id", *counts, endings.alias("endings"))
    return rows.withColumn("total", F.col("n0") + F.col("n1") + F.col("n2"))


@query("A31_missed_slots", "SELECT CAST(o_orderdate AS DATE) AS day, greatest(0, least(1, count(*) FILTER (o_orderstatus <> 'F') - count(*) FILTER (o_orderstatus = 'F'))) AS missed FROM orders GROUP BY 1")
def a31(t):
    made = F.count_if(F.col("o_orderstatus") == "F")
    return t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.greatest(F.lit(0), F.least(F.lit(1), F.count("*") - made - made)).alias("missed"))


@query("A32_one_or_mixed", "SELECT project, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'mixed' END AS kind FROM (SELECT p_brand || '/' || p_size AS project, p_type AS kind FROM part) GROUP BY 1")
def a32(t):
    rows = t.part.select(F.concat("p_brand", F.lit("/"), "p_size").alias("project"), F.col("p_type").alias("kind"))
    return rows.groupBy("project").agg(F.when(F.countDistinct("kind") == 1, F.min("kind")).otherwise("mixed").alias("kind"))
