"""Scores, shortlists and choices that depend on what was chosen before."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators import similarity
from inkwell.operators.lineage import cut

#: Weight of the n-th slide of a section, and of all after.
DECAY = (1.0, 0.65, 0.35, 0.10)
#: Candidates of a key that one task chooses from.
BLOCK = 1000
#: Rows of a day that are judged first, for each that it may keep, and times as many where these don't fill it.
FIRST, MORE = 10, 10


def slide_score(richness: Column, visual: Column, rarity: Column, density: Column) -> Column:
    crowded = F.when(density > 60, F.lit(0.35) * (density - 60)).otherwise(0)
    return F.floor(F.lit(0.4) * richness + F.lit(0.3) * visual + F.lit(0.2) * rarity - crowded + 0.5)


def candidate_score(name: str = "file_name", size: str = "size_mb") -> Column:
    n = F.col(name)
    kind = F.when(n.endswith(".pptx"), 35).when(n.endswith(".png"), -40).otherwise(0)
    return (kind + F.when(n.contains("red"), 30).otherwise(0) + F.least(F.lit(35), 2 * F.col(size))).cast("long")


def shortlist(candidates: DataFrame, k: int, qualified: int) -> DataFrame:
    """The ``k`` best that qualify; where none does, the ``k`` best of all."""
    rows = candidates.withColumn("score", candidate_score())
    good = rows.agg((F.max("score") >= qualified).alias("_any"))
    kept = rows.crossJoin(F.broadcast(good)).where((F.col("score") >= qualified) | ~F.col("_any"))  # one row on the right
    return kept.orderBy(F.desc("score"), "id").limit(k).drop("_any")


def without_heavy(rows: DataFrame, key: str, tie: str, load: str, limit: float, least: int) -> DataFrame:
    heavy = F.col(load) > limit
    light = F.sum((~heavy).cast("int")).over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key, "_heavy").orderBy(load, tie))
    marked = rows.withColumns({"_heavy": heavy, "_light": light}).withColumn("_r", rank)
    return marked.where(~F.col("_heavy") | (F.col("_r") <= least - F.col("_light"))).drop("_heavy", "_light", "_r")


def even_places(n: Column, k: int) -> Column:
    """``k`` places from 0 to n - 1, evenly, rounded half up; each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1) + 0.5)))


def diverse(rows: DataFrame, key: str, k: int) -> DataFrame:
    """(key, index, section, score) to (key, index, place): up to ``k`` a key, always the one of highest score
    after the decay of its section, ties to the smaller index. Scores aren't negative.

    The choices hang on one another, but only the ``k`` best of a section, and only the ``k`` sections with the best heads, can be among them: the rest goes
    before the rows of a key meet, so no task has more than k * k rows of one, however large it is.
    """
    best = Window.partitionBy(key, "section").orderBy(F.desc("score"), "index")
    few = rows.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    heads = few.where("_r = 1").withColumn("_s", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "index"))).where(F.col("_s") <= k)
    few = few.join(heads.select(F.col(key).alias("_key"), F.col("section").alias("_section")), F.col(key).eqNullSafe(F.col("_key")) & F.col("section").eqNullSafe(F.col("_section")), "left_semi")
    # a list of sections, each with its best rows: a step takes the head of highest worth
    section = few.groupBy(key, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "score", "index"))), lambda x: F.struct(x["score"].alias("score"), x["index"].alias("index"))).alias("rows"))
    lists = section.groupBy(key).agg(F.collect_list(F.struct(F.lit(0).alias("used"), "rows")).alias("left"))
    decay = F.array(*[F.lit(d) for d in DECAY])
    kind = dict(rows.dtypes)
    start = F.struct(F.col("left"), F.array().cast(f"array<{kind['index']}>").alias("chosen"))

    def step(a: Column, _: Column) -> Column:
        def worth(s: Column) -> Column:
            head = F.get(s["rows"], s["used"])
            return F.struct((head["score"] * F.element_at(decay, F.least(s["used"] + 1, F.lit(len(DECAY))))).alias("w"), (-head["index"]).alias("i"))

        open_ = F.filter(a["left"], lambda s: s["used"] < F.size(s["rows"]))
        top = F.array_max(F.transform(open_, worth))
        taken = F.transform(a["left"], lambda s: F.struct((s["used"] + ((s["used"] < F.size(s["rows"])) & (worth(s)["i"] == top["i"])).cast("int")).alias("used"), s["rows"].alias("rows")))
        return F.when(F.size(open_) == 0, a).otherwise(F.struct(taken.alias("left"), F.concat(a["chosen"], F.array(-top["i"]).cast(f"array<{kind['index']}>")).alias("chosen")))

    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step, lambda a: a["chosen"])
    out = lists.select(key, F.posexplode(chosen).alias("place", "index"))
    return out.select(key, F.col("index").cast("int").alias("index"), (F.col("place") + 1).alias("place"))


def _words(title: str | None) -> set[str]:
    return set((title or "").lower().split())


def _unlike(words: set[str], kept: list[set[str]], most: float) -> bool:
    return all(len(words & w) < most * max(1, len(words | w)) for w in kept)


def distinct_titles(rows: DataFrame, key: str, k: int, most: float) -> DataFrame:
    """(key, doc_id, title, score) to (key, doc_id): up to ``k`` a key, best score first, whose words have a
    Jaccard similarity under ``most`` (at most 1) to all chosen before.

    In rounds: one task chooses from the ``BLOCK`` best of a key; where these don't fill it, all that resemble
    what was chosen go, over all tasks, and the best of the rest are next. Of these the first is always chosen, so
    there are at most ``k`` rounds.
    """

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_r")
        ids, titles = list(part["_ids"].iloc[0]), list(part["_titles"].iloc[0])
        kept, before = [_words(t) for t in titles], len(ids)
        for doc, title, copies in zip(part["_doc"], part["title"], part["_n"]):
            words = _words(title)
            for _ in range(min(int(copies), k) if not words else 1):  # copies without words resemble nothing
                if len(ids) < k and _unlike(words, kept, most):
                    kept.append(words)
                    ids.append(doc)
                    titles.append(title)
        again = len(ids) < k and len(part) == BLOCK
        return pd.DataFrame({key: [part[key].iloc[0]], "_ids": [ids], "_titles": [titles], "_before": [before], "_again": [again]})

    @F.pandas_udf("boolean")
    def free(docs: pd.Series, titles: pd.Series, ids: pd.Series, chosen: pd.Series) -> pd.Series:
        out, known = [], {}
        for doc, title, own, texts in zip(docs, titles, ids, chosen):
            words, texts = _words(title), tuple(texts)
            if texts not in known:
                known[texts] = [_words(t) for t in texts]
            out.append(_unlike(words, known[texts], most) if words else (doc, title) not in zip(own, texts))
        return pd.Series(out, dtype=bool)

    order = Window.partitionBy(key).orderBy(F.desc("score"), "doc_id", "title")
    none = F.array().cast("array<string>")
    rows = rows.groupBy(key, "doc_id", "title", "score").agg(F.count("*").alias("_n")).withColumn("_doc", F.col("doc_id").cast("string"))
    left, found = rows.withColumns({"_ids": none, "_titles": none}), []
    while True:
        best = left.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= BLOCK)
        now = best.groupBy(key).applyInPandas(choose, f"{key} string, _ids array<string>, _titles array<string>, _before int, _again boolean")
        now = cut(now)
        found.append(now.select(key, F.explode(F.slice("_ids", F.col("_before") + 1, F.lit(k)).cast("array<long>")).alias("doc_id")))
        if now.where("_again").isEmpty():
            return reduce(DataFrame.unionByName, found)
        state = now.where("_again").select(F.col(key).alias("_key"), "_ids", "_titles")
        left = rows.join(state, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").where(free("_doc", "title", "_ids", "_titles"))


def daily_quota(rows: DataFrame, history: DataFrame, k: int, days: int, most: float) -> DataFrame:
    """rows (day: its number, doc_id, title, score) and history (day, title) to (day, doc_id): up to ``k`` rows a day, best score first, whose words resemble
    neither a title of the ``days`` days before nor one chosen that day (a Jaccard similarity under ``most``).

    Rows whose words stand in that history as they are go by a join of equals. The rest are judged best first, as many a day as are likely to fill it: whoever
    comes after the last one chosen has no say. Days that this does not fill are judged anew with ``MORE`` times as many rows, until all of them have been.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("title", F.lit(""))), r"\s+"), lambda w: w != ""))
    same = F.sha2(F.array_join(F.array_sort(words), " "), 256)
    old = cut(history.select("day", same.alias("_h"), words.alias("_t")).distinct())
    reach = old.where(F.size("_t") > 0).select(F.explode(F.sequence(F.col("day") + 1, F.col("day") + days)).alias("day"), "_h").distinct()
    left = cut(rows.withColumn("_h", same).join(reach, ["day", "_h"], "left_anti"))
    order = Window.partitionBy("day").orderBy(F.desc("score"), "doc_id", "title")
    found, n = [], FIRST * k
    while True:
        best = cut(left.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n))
        fresh = best.join(_stale(best, old, words, days, most), ["day", "_h"], "left_anti")
        chosen = distinct_titles(fresh.select(F.col("day").cast("string").alias("day"), "doc_id", "title", "score"), "day", k, most)
        chosen = cut(chosen.select(F.col("day").cast("long").alias("day"), "doc_id"))
        seen = best.groupBy(F.col("day").alias("_day")).agg(F.max("_r").alias("_n")).where(F.col("_n") == n)
        filled = chosen.groupBy(F.col("day").alias("_day")).count().where(F.col("count") >= k)
        again = cut(seen.join(filled, "_day", "left_anti").select("_day").union(seen.where("_day is null").select("_day")).distinct())
        if again.isEmpty():
            return reduce(DataFrame.unionByName, [*found, chosen])
        open_ = F.col("day").eqNullSafe(F.col("_day"))
        found.append(chosen.join(again, open_, "left_anti"))
        left, n = left.join(F.broadcast(again), open_, "left_semi"), n * MORE  # a row for each day


def _stale(rows: DataFrame, old: DataFrame, words: Column, days: int, most: float) -> DataFrame:
    """(day, _h): which of ``rows`` resemble a title of ``old`` (day, _h, _t) of the ``days`` days before. The history is indexed by spans of time, so only titles in reach meet."""
    name = lambda df, key, t: df.select(F.concat_ws("/", "day", "_h").alias(key), t.alias("_t"), F.floor(F.col("day") / (days + 1)).alias("_b"), "day", "_h")
    own, past = name(rows, "_s", words).dropDuplicates(["_s"]), name(old, "_o", F.col("_t"))
    met = similarity.shared_in_sets(own.select("_s", "_t", "_b"), past.select("_o", "_t", "_b"), "_s", "_o", similarity.for_jaccard(max(1, int(100 * most))))
    met = met.where(F.col("shared") >= most * (F.col("n__s") + F.col("n__o") - F.col("shared")))
    met = met.join(own.select("_s", F.col("day").alias("_at"), "_h"), "_s").join(past.select("_o", F.col("day").alias("_when")), "_o")
    return met.where(F.col("_when").between(F.col("_at") - days, F.col("_at") - 1)).select(F.col("_at").alias("day"), "_h").distinct()
