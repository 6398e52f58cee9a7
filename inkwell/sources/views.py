"""Editorial views over the star schema: the tables that the operators are used on.

Every view keeps the key of its source. Timestamps are UTC; days are Korean (UTC+9) where it says so.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths that the traffic view draws on, by ``k % 9``.
PATHS = ("/", "/columns", "/portfolio", "/about", "/contact", "/news", "/services", "/process", "/insight")
#: Traffic is looked at up to here; the events end on 2024-01-30.
NOW = "2024-01-31 00:00:00"


def add_zero(column):
    """-0.0 to 0.0."""
    return column + F.lit(0.0)


class Tables:
    """Lazily read tables of one directory, and the views."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def traffic(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        category = F.create_map(*[F.lit(x) for pair in (("purchase", "ai"), ("click", "search"), ("view", "social"), ("signup", "tool")) for x in pair])
        path = F.element_at(F.array(*map(F.lit, PATHS)), F.pmod(k, F.lit(9)) + 1)
        return self.events.select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("accessed_at"),
            F.concat(F.lit("bot-"), "user_id").alias("bot_name"),
            F.try_element_at(category, F.col("event_type")).alias("bot_category"),
            F.concat(F.lit("op-"), F.col("user_id") % 5).alias("bot_operator"),
            F.concat(path, F.lit("/"), k).alias("requested_path"),
            F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("C"), k % 7)).alias("country"),
        )

    @cached_property
    def usage(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.events.select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("created_at"),
            F.when(k % 5 != 0, k % 4).alias("network"),
            (k % 3).alias("reserved"),
            F.when(k % 2 != 0, F.col("value") / 50).alias("accounted"),
            F.when(k % 3 != 0, F.col("value") / 80).alias("actual"),
            (F.col("value") / 100).alias("estimated"),
        )

    @cached_property
    def work_items(self) -> DataFrame:
        at = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
        done = F.col("o_orderstatus") == "F"
        return self.orders.select(
            F.col("o_orderkey").alias("id"),
            at(("blog", "column", "portfolio"), F.col("o_custkey") % 3).alias("channel"),
            at(("article", "case", "news", "guide", "interview"), F.col("o_orderkey") % 5).alias("format"),
            F.when(done, "published").when(F.col("o_orderstatus") == "P", "in_review").when(F.substring("o_orderpriority", 1, 1) <= "2", "approved").otherwise("planned").alias("status"),
            F.col("o_orderdate").alias("created_at"),
            F.when(done, F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("published_at"),
            F.when(done, F.concat(F.lit("u"), F.col("o_orderkey") % 400)).alias("url"),
            F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/"), F.col("o_orderkey") % 4).alias("schedule_key"),
            F.col("o_custkey").alias("owner"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        names = ("convert", "review", "draft", "mockup", "publish", "cover")
        running = F.col("o_orderstatus") == "P"
        return self.orders.select(
            F.col("o_orderkey").alias("id"),
            F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("job_type"),
            F.when(F.col("o_orderstatus") == "F", "completed").when(running, "running").otherwise("waiting").alias("status"),
            (F.col("o_orderkey") % 4).alias("attempts"),
            F.lit(3).alias("max_attempts"),
            F.when(running, F.concat(F.lit("w-"), F.col("o_custkey") % 10)).alias("claimed_by"),
            F.col("o_orderdate").alias("created_at"),
            F.when(running, F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 3 * 15).cast("int"))).alias("lease_expires_at"),
            F.col("o_custkey").alias("item_id"),
        )

    @cached_property
    def workers(self) -> DataFrame:
        return self.supplier.select(
            F.col("s_suppkey").alias("id"),
            (F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(mins=(F.col("s_suppkey") % 6).cast("int"))).alias("last_seen_at"),
            F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey")).alias("current_job_id"),
            F.when(F.col("s_suppkey") % 7 == 0, "failed").alias("last_error"),
        )

    @cached_property
    def rects(self) -> DataFrame:
        """Regions of a slide: x, y, width and height as shares of its size."""
        x, y = F.col("l_partkey") % 100 / 125, F.col("l_quantity") / 64
        return self.lineitem.select(
            F.col("l_orderkey").alias("deck"),
            F.concat("l_returnflag", "l_linestatus").alias("type"),
            x.alias("x"),
            y.alias("y"),
            F.least(1 - x, 0.05 + 3 * F.col("l_discount")).alias("width"),
            F.least(1 - y, 0.05 + 3 * F.col("l_tax")).alias("height"),
        )

    @cached_property
    def slides(self) -> DataFrame:
        return self.lineitem.select(
            (F.col("l_partkey") % 50).alias("deck"),
            F.col("l_orderkey").alias("order"),
            F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("supp"),
            F.col("l_linenumber").alias("line"),
            F.col("l_quantity").alias("quantity"),
            (2 * F.col("l_quantity")).alias("richness"),
            (1000 * add_zero(F.col("l_discount"))).alias("visual"),
            (1250 * add_zero(F.col("l_tax"))).alias("rarity"),
            (F.col("l_partkey") % 100).alias("density"),
        )

    @cached_property
    def candidates(self) -> DataFrame:
        kinds = F.array(*map(F.lit, (".pptx", ".pdf", ".png", ".ppt")))
        return self.part.select(
            F.col("p_partkey").alias("id"),
            F.col("p_brand").alias("project"),
            F.concat("p_name", F.element_at(kinds, (F.col("p_partkey") % 4 + 1).cast("int"))).alias("file_name"),
            F.col("p_size").alias("size_mb"),
            F.col("p_type").alias("kind"),
        )

    @cached_property
    def knowledge(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("id"),
            F.col("p_brand").alias("area"),
            (F.col("p_size") % 5).alias("use_count"),
            F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_partkey").cast("int")).alias("created_at"),
        )

    @cached_property
    def articles(self) -> DataFrame:
        return self.documents.select("doc_id", F.substring("text", 1, 60).alias("title"), F.col("text").alias("body"), "source", "lang")


#: The same views for the SQL that results are checked against.
SQL = {
    "traffic": f"""SELECT event_id AS id, ts AS accessed_at, 'bot-' || user_id AS bot_name,
        CASE event_type WHEN 'purchase' THEN 'ai' WHEN 'click' THEN 'search' WHEN 'view' THEN 'social' WHEN 'signup' THEN 'tool' END AS bot_category,
        'op-' || (user_id % 5) AS bot_operator, {list(PATHS)}[k % 9 + 1] || '/' || k AS requested_path,
        CASE WHEN k % 11 = 0 THEN '' ELSE 'C' || (k % 7) END AS country
        FROM (SELECT *, (props->>'$.k')::INTEGER AS k FROM events)""",
    "usage": """SELECT event_id AS id, ts AS created_at, CASE WHEN k % 5 <> 0 THEN k % 4 END AS network, k % 3 AS reserved,
        CASE WHEN k % 2 <> 0 THEN value / 50 END AS accounted, CASE WHEN k % 3 <> 0 THEN value / 80 END AS actual, value / 100 AS estimated
        FROM (SELECT *, (props->>'$.k')::INTEGER AS k FROM events)""",
    "work_items": """SELECT o_orderkey AS id, ['blog','column','portfolio'][(o_custkey % 3 + 1)::INTEGER] AS channel,
        ['article','case','news','guide','interview'][(o_orderkey % 5 + 1)::INTEGER] AS format,
        CASE WHEN o_orderstatus = 'F' THEN 'published' WHEN o_orderstatus = 'P' THEN 'in_review' WHEN substr(o_orderpriority, 1, 1) <= '2' THEN 'approved' ELSE 'planned' END AS status,
        o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 DAY END AS published_at,
        CASE WHEN o_orderstatus = 'F' THEN 'u' || (o_orderkey % 400) END AS url, strftime(o_orderdate, '%Y-%m-%d') || '/' || (o_orderkey % 4) AS schedule_key, o_custkey AS owner FROM orders""",
    "jobs": """SELECT o_orderkey AS id, ['convert','review','draft','mockup','publish','cover'][(o_orderkey % 6 + 1)::INTEGER] AS job_type,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'running' ELSE 'waiting' END AS status, o_orderkey % 4 AS attempts, 3 AS max_attempts,
        CASE WHEN o_orderstatus = 'P' THEN 'w-' || (o_custkey % 10) END AS claimed_by, o_orderdate AS created_at,
        CASE WHEN o_orderstatus = 'P' THEN o_orderdate + to_minutes((o_orderkey % 3 * 15)::INTEGER) END AS lease_expires_at, o_custkey AS item_id FROM orders""",
    "workers": f"""SELECT s_suppkey AS id, TIMESTAMP '{NOW}' - to_minutes((s_suppkey % 6)::INTEGER) AS last_seen_at,
        CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey END AS current_job_id, CASE WHEN s_suppkey % 7 = 0 THEN 'failed' END AS last_error FROM supplier""",
    "rects": """SELECT l_orderkey AS deck, l_returnflag || l_linestatus AS type, l_partkey % 100 / 125 AS x, l_quantity / 64 AS y,
        least(1 - l_partkey % 100 / 125, 0.05::DOUBLE + 3 * l_discount) AS width, least(1 - l_quantity / 64, 0.05::DOUBLE + 3 * l_tax) AS height FROM lineitem""",
    "slides": """SELECT l_partkey % 50 AS deck, l_orderkey AS "order", l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, l_quantity AS quantity,
        2 * l_quantity AS richness, 1000 * (l_discount + 0.0::DOUBLE) AS visual, 1250 * (l_tax + 0.0::DOUBLE) AS rarity, l_partkey % 100 AS density FROM lineitem""",
    "candidates": """SELECT p_partkey AS id, p_brand AS project, p_name || ['.pptx','.pdf','.png','.ppt'][(p_partkey % 4 + 1)::INTEGER] AS file_name, p_size AS size_mb, p_type AS kind FROM part""",
    "knowledge": """SELECT p_partkey AS id, p_brand AS area, p_size % 5 AS use_count, DATE '2024-01-01' + p_partkey::INTEGER AS created_at FROM part""",
    "articles": """SELECT doc_id, substr(text, 1, 60) AS title, text AS body, source, lang FROM documents""",
}
