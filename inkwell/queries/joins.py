"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions import hashing
from inkwell.operators import similarity, upsert
from inkwell.queries import query


@query("J01_inner_embed", "SELECT l_orderkey, l_partkey, l_quantity, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def j01(t):
    orders = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_quantity").join(orders, "l_orderkey")


@query("J02_left_embed", "SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def j02(t):
    return t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", "s_name", "n_name")


@query("J03_nested_rows", "SELECT o_orderkey, count(l_orderkey) AS n, coalesce(string_agg(l_partkey || ':' || l_linenumber, ',' ORDER BY l_partkey, l_linenumber), '') AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j03(t):
    parts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["l_partkey"], r["l_linenumber"])), ",")
    return t.orders.select("o_orderkey").join(parts, "o_orderkey", "left").select("o_orderkey", F.coalesce(F.array_size("rows"), F.lit(0)).cast("long").alias("n"), F.coalesce(text, F.lit("")).alias("parts"))


@query("J04_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j04(t):
    returned = t.lineitem.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey").join(returned, "o_orderkey", "left_semi")


@query("J05_update_from", "SELECT o_orderkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'hold' ELSE o_orderstatus END AS o_orderstatus FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def j05(t):
    held = t.customer.where(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("o_custkey"))
    return upsert.update_from(t.orders, held, ["o_custkey"], {"o_orderstatus": F.lit("hold")}).select("o_orderkey", "o_orderstatus")


@query(
    "J06_new_only",
    "WITH known AS (SELECT DISTINCT substr(text, 1, 60) AS title FROM benchmark), old AS (SELECT title FROM articles ORDER BY doc_id DESC LIMIT 2000) "
    "SELECT doc_id, title FROM articles a WHERE title NOT IN (SELECT title FROM known) AND NOT EXISTS (SELECT 1 FROM articles b WHERE b.title = a.title AND b.doc_id < a.doc_id) ORDER BY doc_id LIMIT 30",
)
def j06(t):
    known = t.benchmark.select(F.substring("text", 1, 60).alias("title")).distinct()
    fresh = upsert.first_seen(t.articles.select("doc_id", "title"), ["title"], [F.col("doc_id")]).join(known, "title", "left_anti")
    return fresh.orderBy("doc_id").limit(30).select("doc_id", "title")


@query("J07_preferred_lookup", "SELECT o_orderkey, coalesce(a.c_name, b.c_name) AS name FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey AND a.c_acctbal > 0 LEFT JOIN customer b ON b.c_custkey = o_orderkey % 100")
def j07(t):
    first = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("first"))
    second = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("second"))
    rows = t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 100).alias("k"))
    return rows.join(first, "o_custkey", "left").join(second, "k", "left").select("o_orderkey", F.coalesce("first", "second").alias("name"))


@query(
    "J08_calendar_slots",
    "WITH c AS (SELECT day::DATE AS day, slot FROM range(DATE '1998-01-01', DATE '1998-01-15', INTERVAL 1 DAY) r(day) CROSS JOIN (SELECT unnest(range(4)) AS slot)) "
    "SELECT c.day, c.slot, count(w.id) AS items, count(w.id) FILTER (status = 'published') AS published FROM c LEFT JOIN work_items w ON w.schedule_key = strftime(c.day, '%Y-%m-%d') || '/' || c.slot GROUP BY 1, 2",
)
def j08(t):
    days = t.spark.range(1).select(F.explode(F.expr("sequence(DATE'1998-01-01', DATE'1998-01-14')")).alias("day"))
    grid = days.crossJoin(t.spark.range(4).withColumnRenamed("id", "slot")).withColumn("schedule_key", F.concat(F.col("day").cast("string"), F.lit("/"), "slot"))
    made = t.work_items.groupBy("schedule_key").agg(F.count("*").alias("items"), F.count_if(F.col("status") == "published").alias("published"))
    return grid.join(made, "schedule_key", "left").select("day", "slot", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("published", F.lit(0)).alias("published"))


@query("J09_unnest", "SELECT conv_id, turn, unnest(regexp_extract_all(text, '[a-z]+tion')) AS word FROM conversations")
def j09(t):
    words = t.conversations.select("conv_id", "turn", F.regexp_extract_all("text", F.lit("[a-z]+tion"), F.lit(0)).alias("found"))
    return words.select("conv_id", "turn", F.explode("found").alias("word"))


_SHARED = (
    "WITH a AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) AS w FROM documents), b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) AS w FROM benchmark), "
    "na AS (SELECT doc_id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1), s AS (SELECT doc_id, item_id, count(*) AS c FROM a JOIN b USING (w) GROUP BY 1, 2) "
)


@query("J10_similarity_join", _SHARED + "SELECT doc_id, item_id, floor(100 * c / (na.n + nb.n - c) + 0.5)::BIGINT AS score FROM s JOIN na USING (doc_id) JOIN nb USING (item_id) WHERE floor(100 * c / (na.n + nb.n - c) + 0.5) >= 30")
def j10(t):
    return similarity.jaccard_join(t.documents.select("doc_id", "text"), t.benchmark, "doc_id", "item_id", least=30)


@query(
    "J11_hamming_join",
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings), "
    "c AS (SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN i = vec_id % 64 OR i = (vec_id + 7) % 64 THEN 1 - b[i + 1] ELSE b[i + 1] END) AS b FROM v) "
    "SELECT v.vec_id AS a, c.vec_id AS b, list_sum(list_transform(list_zip(v.b, c.b), lambda z: abs(z[1] - z[2])))::INTEGER AS distance FROM v JOIN c ON true WHERE list_sum(list_transform(list_zip(v.b, c.b), lambda z: abs(z[1] - z[2]))) <= 4",
)
def j11(t):
    v = t.embeddings.select("vec_id", hashing.sign_bits(F.col("embedding")).alias("hash"))
    flip = lambda n: F.expr(f"shiftleft(1L, cast(63 - (vec_id + {n}) % 64 AS INT))")
    copies = v.select(F.col("vec_id").alias("b"), F.col("hash").bitwiseXOR(flip(0)).bitwiseXOR(flip(7)).alias("hash"))
    return similarity.hamming_join(v.withColumnRenamed("vec_id", "a"), copies, "a", "b", "hash", 4)


@query("J12_allowed_set", "SELECT conv_id, array_to_string(list_sort(list_intersect(list(DISTINCT role), ['user', 'tool', 'assistant'])), ',') AS allowed FROM conversations GROUP BY 1")
def j12(t):
    allowed = F.array(*map(F.lit, ("user", "tool", "assistant")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.array_sort(F.array_intersect(F.collect_set("role"), allowed)), ",").alias("allowed"))


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"


@query("J13_same_host", f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT page_id, host, min(page_id) OVER (PARTITION BY host) AS first, count(*) OVER (PARTITION BY host) - 1 AS links FROM h")
def j13(t):
    """Each page with the first of its host, which stands for all of them, and how many others share it: pairs would grow with
    the square of a host."""
    h = t.pages.select("page_id", F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"))
    hosts = h.groupBy("host").agg(F.min("page_id").alias("first"), (F.count("*") - 1).alias("links"))
    return h.join(hosts, "host").select("page_id", "host", "first", "links")


@query("J14_merge_results", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'passed' WHEN toxic IS NULL THEN 'failed' WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'passed' ELSE 'needs_revision' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def j14(t):
    status = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "passed").otherwise("needs_revision")
    first = t.labels.select("doc_id", status.alias("status"))
    second = t.documents.where("doc_id % 3 = 0").select("doc_id", F.lit("passed").alias("status"))
    merged = upsert.last_wins(first, second, ["doc_id"])
    return t.documents.select("doc_id").join(merged, "doc_id", "left").select("doc_id", F.coalesce("status", F.lit("failed")).alias("status"))


@query("J15_remap", "SELECT c_custkey, o_orderkey, c_mktsegment FROM customer JOIN orders ON o_custkey = c_custkey")
def j15(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "c_mktsegment")


@query("J16_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def j16(t):
    return t.documents.select("doc_id").join(t.labels.where("toxic = 0"), "doc_id", "left_anti")


@query("J17_conflicts", "SELECT DISTINCT a.id, a.url FROM work_items a JOIN work_items b ON a.url = b.url AND a.id <> b.id")
def j17(t):
    """Counts of addresses are made before rows meet, so an address in very many rows is one row of them."""
    rows = t.work_items.where("url IS NOT NULL").select("id", "url")
    shared = rows.groupBy("url").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("url")
    return rows.join(shared, "url", "left_semi")


@query("J18_purgeable", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT id FROM work_items WHERE status = 'published' AND published_at < TIMESTAMP '1997-01-01')")
def j18(t):
    old = t.work_items.where((F.col("status") == "published") & (F.col("published_at") < F.lit("1997-01-01").cast("timestamp_ntz"))).select(F.col("id").alias("l_orderkey"))
    return t.lineitem.select("l_orderkey", "l_partkey").join(old, "l_orderkey", "left_semi")


@query("J19_newest_worker", "SELECT s_nationkey, arg_max(id, (last_seen_at, -id)) AS worker FROM workers JOIN supplier ON s_suppkey = id GROUP BY 1")
def j19(t):
    rows = t.workers.join(t.supplier, F.col("s_suppkey") == F.col("id"))
    return rows.groupBy("s_nationkey").agg(F.max_by("id", F.struct("last_seen_at", -F.col("id"))).alias("worker"))


@query("U01_union_all", "SELECT id, status FROM work_items WHERE status <> 'published' UNION ALL SELECT id, status FROM (SELECT * FROM work_items WHERE status = 'published' ORDER BY published_at DESC, id LIMIT 50)")
def u01(t):
    hot = t.work_items.where(F.col("status") != "published")
    cold = t.work_items.where(F.col("status") == "published").orderBy(F.desc("published_at"), "id").limit(50)
    return hot.select("id", "status").unionByName(cold.select("id", "status"))


@query("U02_union_last_value", f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT host, min(page_id) AS place, max(page_id) AS value FROM h GROUP BY 1")
def u02(t):
    """Of equal keys the first place and the last value."""
    return t.pages.groupBy(F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host")).agg(F.min("page_id").alias("place"), F.max("page_id").alias("value"))


@query("U03_distinct", "SELECT DISTINCT source, lang FROM documents")
def u03(t):
    return t.documents.select("source", "lang").distinct()


@query("U04_intersection_size", _SHARED + "SELECT doc_id, item_id, c AS shared FROM s WHERE c >= 15")
def u04(t):
    return similarity.shared_tokens(t.documents.select("doc_id", "text"), t.benchmark, "doc_id", "item_id", similarity.at_least(15)).select("doc_id", "item_id", "shared")


@query("U05_except", "SELECT doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def u05(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti").distinct()


@query("U06_multiset_difference", "SELECT l_suppkey FROM (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def u06(t):
    flag = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select("l_suppkey")
    return flag("A").exceptAll(flag("R"))


@query("U07_set_equality", "WITH s AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS r FROM conversations GROUP BY 1) SELECT conv_id, r = ['assistant', 'user'] AS same FROM s")
def u07(t):
    both = F.array(F.lit("assistant"), F.lit("user"))
    return t.conversations.groupBy("conv_id").agg((F.array_sort(F.collect_set("role")) == both).alias("same"))
