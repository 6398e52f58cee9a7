"""Windows, ranking, sorts and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.operators import counting, geometry, ranking, selection, upsert
from inkwell.queries import query

_UNIQUE = ["order", "part", "supp", "line", "quantity", "visual", "rarity"]
_U = '"order", part, supp, line, quantity, visual, rarity'
_SCORE = "floor(0.4::DOUBLE * richness + 0.3::DOUBLE * visual + 0.2::DOUBLE * rarity - CASE WHEN density > 60 THEN 0.35::DOUBLE * (density - 60) ELSE 0 END + 0.5)::BIGINT"


def slide_score():
    return selection.slide_score(F.col("richness"), F.col("visual"), F.col("rarity"), F.col("density"))


@query("W01_duplicate_rank", "SELECT id, url, row_number() OVER (PARTITION BY url ORDER BY published_at ASC NULLS LAST, created_at, id) AS rank FROM work_items WHERE url IS NOT NULL")
def w01(t):
    order = Window.partitionBy("url").orderBy(F.asc_nulls_last("published_at"), "created_at", "id")
    return t.work_items.where("url IS NOT NULL").select("id", "url", F.row_number().over(order).alias("rank"))


@query("W02_first_wins", "SELECT title, min(doc_id) AS doc_id FROM articles GROUP BY 1")
def w02(t):
    return upsert.first_seen(t.articles.select("title", "doc_id"), ["title"], [F.col("doc_id")])


@query("W03_latest_per_type", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def w03(t):
    return upsert.latest(t.events.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "ts", F.desc("event_id")).drop("ts")


@query(
    "W04_round_robin",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY use_count, created_at DESC, id) AS turn FROM knowledge), g AS (SELECT area, row_number() OVER (ORDER BY use_count, created_at DESC, id) AS g FROM r WHERE turn = 1) "
    "SELECT id, area, turn::INTEGER AS turn, row_number() OVER (ORDER BY turn, g)::INTEGER AS place FROM r JOIN g USING (area) QUALIFY place <= 12",
)
def w04(t):
    return upsert.interleave(t.knowledge, "area", [F.col("use_count"), F.desc("created_at"), F.col("id")], 12).select("id", "area", "turn", "place")


@query(
    "W05_interval_merge",
    "WITH i AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate AS start, l_shipdate + INTERVAL 3 DAY AS stop FROM lineitem), n AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY l_suppkey ORDER BY start, stop, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i), "
    "g AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY start, stop, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT l_suppkey, min(start) AS start, max(stop) AS stop, count(*) AS n FROM g GROUP BY l_suppkey, island",
)
def w05(t):
    ties = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    spans = t.lineitem.select("l_suppkey", *ties, F.col("l_shipdate").alias("start"), (F.col("l_shipdate") + F.expr("INTERVAL 3 DAYS")).alias("stop"))
    return geometry.merge_intervals(spans, ["l_suppkey"], "start", "stop", ties)


@query("W06_running_share", "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round(sum(n) OVER (ORDER BY n DESC, event_type ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS share FROM c")
def w06(t):
    counts = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    running = Window.orderBy(F.desc("n"), "event_type").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("share", F.round(F.sum("n").over(running) / F.sum("n").over(Window.partitionBy()), 6))


@query("W07_nth_match", "SELECT doc_id, regexp_extract_all(text, '[0-9]{4,}')[1] AS first, regexp_extract_all(text, '[0-9]{4,}')[2] AS second FROM documents")
def w07(t):
    found = F.regexp_extract_all("text", F.lit("[0-9]{4,}"), F.lit(0))
    return t.documents.select("doc_id", F.get(found, 0).alias("first"), F.get(found, 1).alias("second"))


_TUPLE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate"


@query("W08_ordinal", f"SELECT l_orderkey, l_partkey, l_linenumber % 3 AS kind, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY {_TUPLE}, l_discount, l_tax)::INTEGER AS ordinal FROM lineitem")
def w08(t):
    kind = (F.col("l_linenumber") % 3).alias("kind")
    order = Window.partitionBy("l_orderkey", "kind").orderBy(*_TUPLE.split(", "), "l_discount", "l_tax")
    return t.lineitem.withColumn("kind", F.col("l_linenumber") % 3).select("l_orderkey", "l_partkey", "kind", F.row_number().over(order).alias("ordinal"))


@query("W09_best_per_key", f'SELECT deck, line, max({_SCORE}) AS score, count(*) AS n FROM slides GROUP BY 1, 2')
def w09(t):
    return t.slides.groupBy("deck", "line").agg(F.max(slide_score()).alias("score"), F.count("*").alias("n"))


@query("W10_greedy_selection")
def w10(t):
    """Up to six slides of each deck, each chosen for its score after the decay of its section."""
    rows = t.slides.withColumn("score", slide_score().cast("double")).withColumn("section", F.col("line").cast("string"))
    order = Window.partitionBy("deck").orderBy(*_UNIQUE)
    return selection.diverse(rows.withColumn("index", F.row_number().over(order)).select("deck", "index", "section", "score"), "deck", 6)


@query("W11_near_duplicates")
def w11(t):
    """Titles of a source that resemble none chosen before, best first."""
    rows = t.articles.select("source", "doc_id", "title", F.length("body").alias("score"))
    return selection.distinct_titles(rows, "source", 20, 0.5)


@query("W12_sections", f'WITH r AS (SELECT deck, "order", part, line, row_number() OVER (PARTITION BY deck ORDER BY {_U}) - 1 AS i, count(*) OVER (PARTITION BY deck) AS n FROM slides) SELECT deck, least(4, floor(i * 5 / n))::INTEGER AS section, count(*) AS slides FROM r GROUP BY 1, 2')
def w12(t):
    """Five sections of each deck, by the places of its slides."""
    rows = ranking.placed(t.slides.select("deck", *_UNIQUE), "deck", _UNIQUE)
    section = F.least(F.lit(4), F.floor(F.col("place") * 5 / F.col("total"))).cast("int")
    return rows.groupBy("deck", section.alias("section")).agg(F.count("*").alias("slides"))


@query("W13_groups_of_six", f"WITH r AS (SELECT deck, row_number() OVER (PARTITION BY deck ORDER BY {_SCORE} DESC, {_U}) AS r, part FROM slides) SELECT deck, floor((r - 1) / 6)::INTEGER AS board, min(part) AS first, count(*) AS n FROM r WHERE r <= 30 GROUP BY 1, 2 HAVING count(*) = 6")
def w13(t):
    rows = t.slides.select("deck", "part", F.row_number().over(Window.partitionBy("deck").orderBy(slide_score().desc(), *_UNIQUE)).alias("r")).where("r <= 30")
    return rows.groupBy("deck", F.floor((F.col("r") - 1) / 6).cast("int").alias("board")).agg(F.min("part").alias("first"), F.count("*").alias("n")).where("n = 6")


@query("W14_balanced_boards", "SELECT deck, b AS board, (n // 4 + CASE WHEN b < n % 4 THEN 1 ELSE 0 END)::BIGINT AS slides FROM (SELECT deck, count(*) AS n FROM slides GROUP BY 1) CROSS JOIN (SELECT unnest(range(4))::INTEGER AS b)")
def w14(t):
    counts = t.slides.groupBy("deck").agg(F.count("*").alias("n")).withColumn("board", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return counts.select("deck", "board", (F.floor(F.col("n") / 4) + (F.col("board") < F.col("n") % 4).cast("long")).alias("slides"))


@query("W15_even_samples", "SELECT deck, array_to_string(list_sort(list_distinct(list_transform(range(5), lambda k: floor(k * (n - 1) / 4 + 0.5)::BIGINT))), ',') AS places FROM (SELECT deck, count(*) AS n FROM slides GROUP BY 1) WHERE n > 8")
def w15(t):
    counts = t.slides.groupBy("deck").agg(F.count("*").alias("n")).where("n > 8")
    return counts.select("deck", F.array_join(selection.even_places(F.col("n"), 5), ",").alias("places"))


@query("O01_mixed_sort", "SELECT id, row_number() OVER (ORDER BY published_at DESC NULLS LAST, owner ASC, id) AS place FROM work_items ORDER BY place LIMIT 100")
def o01(t):
    order = [F.desc_nulls_last("published_at"), F.asc("owner"), F.asc("id")]
    head = t.work_items.orderBy(*order).limit(100)
    return head.select("id", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("O02_top_by_count", "SELECT requested_path AS path, count(*) AS n FROM traffic GROUP BY 1 ORDER BY n DESC, max(accessed_at) DESC, path LIMIT 30")
def o02(t):
    counts = t.traffic.groupBy(F.col("requested_path").alias("path")).agg(F.count("*").alias("n"), F.max("accessed_at").alias("last"))
    return counts.orderBy(F.desc("n"), F.desc("last"), "path").limit(30).drop("last")


@query("O03_most_recent", "SELECT id, accessed_at FROM traffic ORDER BY accessed_at DESC, id DESC LIMIT 200")
def o03(t):
    return t.traffic.orderBy(F.desc("accessed_at"), F.desc("id")).limit(200).select("id", "accessed_at")


@query("O04_status_order", "SELECT id, status FROM work_items ORDER BY CASE status WHEN 'in_review' THEN 0 WHEN 'approved' THEN 1 WHEN 'planned' THEN 2 ELSE 3 END, created_at DESC, id LIMIT 120")
def o04(t):
    s = F.col("status")
    rank = F.when(s == "in_review", 0).when(s == "approved", 1).when(s == "planned", 2).otherwise(3)
    return t.work_items.orderBy(rank, F.desc("created_at"), "id").limit(120).select("id", "status")


@query("O05_score_then_index", f"SELECT deck, part, r AS rank FROM (SELECT deck, part, row_number() OVER (PARTITION BY deck ORDER BY {_SCORE} DESC, {_U}) AS r FROM slides) WHERE r <= 10")
def o05(t):
    rows = t.slides.withColumn("rank", F.row_number().over(Window.partitionBy("deck").orderBy(slide_score().desc(), *_UNIQUE)))
    return rows.where("rank <= 10").select("deck", "part", "rank")


_CAND = "WITH c AS (SELECT id, project, (CASE WHEN file_name LIKE '%.pptx' THEN 35 WHEN file_name LIKE '%.png' THEN -40 ELSE 0 END + CASE WHEN file_name LIKE '%red%' THEN 30 ELSE 0 END + least(35, 2 * size_mb))::BIGINT AS score FROM candidates) "


@query("O06_shortlist", _CAND + ", q AS (SELECT *, score >= 55 AS ok, max(score) OVER () >= 55 AS any_ok FROM c) SELECT id, score, greatest(0.56::DOUBLE, least(0.99::DOUBLE, score / 100)) AS confidence FROM q WHERE ok OR NOT any_ok ORDER BY score DESC, id LIMIT 10")
def o06(t):
    return selection.shortlist(t.candidates, 10, 55).select("id", "score", F.greatest(F.lit(0.56), F.least(F.lit(0.99), F.col("score") / 100)).alias("confidence"))


@query("O07_preferred_source", _CAND + ", w AS (SELECT project FROM c ORDER BY score DESC, id LIMIT 1) SELECT c.id, c.project FROM c JOIN w USING (project) ORDER BY c.score DESC, c.id LIMIT 1")
def o07(t):
    rows = t.candidates.withColumn("score", selection.candidate_score())
    winner = rows.orderBy(F.desc("score"), "id").limit(1).select("project")
    return rows.join(winner, "project").orderBy(F.desc("score"), "id").limit(1).select("id", "project")


@query(
    "O08_most_relevant",
    "WITH a AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) AS w FROM benchmark), b AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) AS w FROM documents), "
    "s AS (SELECT doc_id, item_id, count(*) AS c FROM a JOIN b USING (w) GROUP BY 1, 2) SELECT doc_id, arg_max(item_id, (c, -item_id)) AS item_id, max(c) AS shared FROM s GROUP BY 1",
)
def o08(t):
    from inkwell.operators import similarity

    met = similarity.shared_tokens(t.documents.select("doc_id", "text"), t.benchmark, "doc_id", "item_id", similarity.at_least(1), best=True)
    return met.groupBy("doc_id").agg(F.max_by("item_id", F.struct("shared", -F.col("item_id"))).alias("item_id"), F.max("shared").alias("shared"))


@query("O09_best_by_three", "SELECT source, arg_min(doc_id, (len(regexp_extract_all(text, '!!')), len(regexp_extract_all(text, '[|]')), -length(text), doc_id)) AS doc_id FROM documents GROUP BY 1")
def o09(t):
    key = F.struct(F.regexp_count("text", F.lit("!!")), F.regexp_count("text", F.lit("[|]")), -F.length("text"), "doc_id")
    return t.documents.groupBy("source").agg(F.min_by("doc_id", key).alias("doc_id"))


@query("O10_scarcest", "SELECT area FROM (SELECT area, sum(greatest(0, 3 - use_count)) - CASE WHEN area = 'Brand#3' THEN 1 ELSE 0 END AS left_over FROM knowledge GROUP BY 1) ORDER BY left_over, area LIMIT 1")
def o10(t):
    rest = F.sum(F.greatest(F.lit(0), 3 - F.col("use_count"))) - F.when(F.col("area") == "Brand#3", 1).otherwise(0)
    return t.knowledge.groupBy("area").agg(rest.alias("rest")).orderBy("rest", "area").limit(1).select("area")


@query("O11_queue_head", "SELECT job_type, arg_min(id, (created_at, id)) AS id FROM jobs WHERE status = 'waiting' AND attempts < max_attempts GROUP BY 1")
def o11(t):
    ready = t.jobs.where((F.col("status") == "waiting") & (F.col("attempts") < F.col("max_attempts")))
    return ready.groupBy("job_type").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))


@query("O12_capped_batch", "WITH d AS (SELECT id FROM work_items WHERE published_at < TIMESTAMP '1997-01-01') SELECT least(count(*), 1000) AS taken, count(*) >= 1000 AS remaining FROM d")
def o12(t):
    due = t.work_items.where(F.col("published_at") < F.lit("1997-01-01").cast("timestamp_ntz")).select("id").limit(1000)
    return due.agg(F.count("*").alias("taken"), (F.count("*") >= 1000).alias("remaining"))


@query("O13_natural_sort", "SELECT p_brand, row_number() OVER (ORDER BY regexp_extract(p_brand, '([0-9]+)', 1)::INTEGER)::INTEGER AS place FROM (SELECT DISTINCT p_brand FROM part)")
def o13(t):
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    return t.part.select("p_brand").distinct().select("p_brand", F.row_number().over(Window.orderBy(number)).alias("place"))


@query("O14_cover", 'SELECT deck, coalesce(min(part) FILTER (line = 1), min(part)) AS cover FROM slides GROUP BY 1')
def o14(t):
    return t.slides.groupBy("deck").agg(F.coalesce(F.min(F.when(F.col("line") == 1, F.col("part"))), F.min("part")).alias("cover"))


@query(
    "O15_restore_least_bad",
    "WITH s AS (SELECT l_orderkey AS deck, l_partkey AS part, sum(l_quantity) AS load FROM lineitem GROUP BY 1, 2), k AS (SELECT *, load > 30 AS heavy, count(*) FILTER (load <= 30) OVER (PARTITION BY deck) AS light FROM s), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY deck, heavy ORDER BY load, part) AS r FROM k) SELECT deck, part FROM r WHERE NOT heavy OR r <= 3 - light",
)
def o15(t):
    """Without heavy slides, but never under three of a deck: the least heavy come back."""
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("deck"), F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").alias("load"))
    return selection.without_heavy(s, "deck", "part", "load", 30, 3).select("deck", "part")


@query("O16_title_tiers", "WITH c AS (SELECT source, 1 AS tier, doc_id, title FROM articles WHERE lang = 'en' UNION ALL SELECT source, 2, doc_id, title FROM articles WHERE lang <> 'en'), d AS (SELECT *, row_number() OVER (PARTITION BY source, title ORDER BY tier, doc_id) AS k FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tier, doc_id) AS r FROM d WHERE k = 1) SELECT source, title FROM r WHERE r <= 3")
def o16(t):
    tiers = t.articles.withColumn("tier", F.when(F.col("lang") == "en", 1).otherwise(2))
    once = upsert.first_seen(tiers, ["source", "title"], [F.col("tier"), F.col("doc_id")])
    return counting.top(once, 3, [F.col("tier"), F.col("doc_id")], ["source"]).select("source", "title")


@query("O17_history", "WITH d AS (SELECT title, max(doc_id) AS doc_id FROM articles GROUP BY 1) SELECT title, doc_id FROM d ORDER BY doc_id DESC LIMIT 20")
def o17(t):
    newest = upsert.first_seen(t.articles.select("title", "doc_id"), ["title"], [F.desc("doc_id")])
    return newest.orderBy(F.desc("doc_id")).limit(20)


@query("O18_densify", 'WITH d AS (SELECT deck, unnest(range(1, 8))::INTEGER AS line FROM (SELECT DISTINCT deck FROM slides)), s AS (SELECT deck, line, max(part) AS part FROM slides WHERE quantity > 45 GROUP BY 1, 2) SELECT d.deck, d.line, coalesce(part, -1) AS part FROM d LEFT JOIN s ON s.deck = d.deck AND s.line = d.line')
def o18(t):
    grid = t.slides.select("deck").distinct().withColumn("line", F.explode(F.sequence(F.lit(1), F.lit(7))))
    best = t.slides.where("quantity > 45").groupBy("deck", "line").agg(F.max("part").alias("part"))
    return grid.join(best, ["deck", "line"], "left").select("deck", "line", F.coalesce("part", F.lit(-1)).alias("part"))
