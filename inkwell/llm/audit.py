"""Filter interaction audit: what each of five filters removes, in every order of the five.

Native expressions turn a document into a mask, a bit for each filter that it fails; a grouping by text gives the least id of
each text, so that later copies fail the last filter. The masks of a part are counted in 32 cells, and every order and step follows
from the cells: the documents are read once, whatever the number of orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
FEWEST_WORDS, MARKS = 200, "[#$%&*|]"
_COPY = 1 << LETTERS.index("E")


def own_failures(text: Column, words: Column) -> Column:
    """Bits A to D, which a text (not null) decides by itself."""
    n, different = F.size(words), F.size(F.array_distinct(words))
    fails = (n < FEWEST_WORDS, 100 * different < 50 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text), text.rlike(MARKS))
    out = F.lit(0)
    for k, x in enumerate(fails):
        out = out + F.when(x, 1 << k).otherwise(0)
    return out


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the filters that they fail, and how many of them labels call good or toxic.

    Texts don't move: rows meet by the digests of their texts. The rows of a text are added up by id, part and label before they meet its
    least id, so a text in very many rows burdens no task. A null id is later than all others.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.select("id", "part", F.sha2("text", 256).alias("same"), own_failures(F.col("text"), F.col("words")).alias("mask"))
    # documents without an id have no label, and are dealt out by their texts
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("same")).otherwise(0))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id"))
    marks = marks.agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))]).withColumn("spread", F.lit(0).cast("long"))
    rows = rows.join(marks, ["id", "spread"], "left").fillna(0, ["good", "toxic"]).withColumn("key", F.struct(F.col("id").isNull().alias("none"), "id"))
    kind = ["same", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy(*kind, "key").agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("key", "n")).alias("least"))
    first = by_text.groupBy("same").agg(F.min("least.key").alias("first"))
    kept = F.when(F.col("least.key") == F.col("first"), F.col("least.n")).otherwise(0)
    split = F.array(F.struct(F.col("mask"), kept.alias("n")), F.struct((F.col("mask") + _COPY).alias("mask"), (F.col("n") - kept).alias("n")))
    met = by_text.join(first, "same").select("part", "good", "toxic", F.inline(split))
    return met.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col(c) * F.col("n")).alias(c) for c in ("good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each part of
    ``docs`` (doc_id, text, lang), each of the 120 orders of the filters and each step in it.

    A: under 200 words. B: fewer different words than half of them. C: more than 3 % of the characters are ``[A-Z]``. D: holds one of
    ``#$%&*|``. E: the text stands under a smaller id, in any part. Null text is empty, null language the part of the empty string. Of rows that
    repeat an id and a text none is later than another. A document is good or toxic if any label row of its id says so. Columns beside these don't matter; without
    documents there are no parts.
    """
    whole = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    rows = whole.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    bit = lambda k: F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), F.ascii(F.substr("filter_order", k, F.lit(1))) - ord("A")).cast("int")
    before = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(len(LETTERS))), lambda k: k < F.col("step")), F.lit(0), lambda a, k: a + bit(k))
    rows = rows.withColumns({"own": bit(F.col("step")), "before": before})

    def total(of: str, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(where(c["mask"]), c[of]).otherwise(0))

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    now = lambda m: fails(m) & ~gone(m)
    counted = rows.select(
        "part", "filter_order", "step", "own",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("n", now).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", now).alias("good_lost"),
        total("toxic", now).alias("toxic_lost"),
    )
    every = F.sum("removed").over(Window.partitionBy("part", "own"))  # 120 rows
    return counted.withColumn("shapley", every).drop("own")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
      FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, (1 << (ascii(o[step]) - 65)) AS own, list_sum([0] || list_transform(range(1, step), lambda k: 1 << (ascii(o[k]) - 65)))::BIGINT AS before FROM p, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, o, step, own,
        coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, o AS filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
