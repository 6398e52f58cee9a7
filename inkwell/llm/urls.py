"""URL filter: rules by host and path, then the ratio of two character language models.

URLs that a rule allows train the model of accepted URLs, those that a rule blocks the model of
rejected ones. A model gives a character after up to ``ORDER`` others by Witten-Bell smoothing: each order
mixes its relative counts with the next lower order, by the number of different followers, and a context
that was never seen passes to the lower order whole. A URL's score is the mean over its characters of the log
ratio accepted to rejected. A fifth of the rule-judged URLs is held out; on it the threshold is calibrated.
DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import join_evenly, stored

#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ORDER = 4
#: Letters, marks and one symbol for digits; any other character counts as "~".
ALPHABET = 26 + 33
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = lambda k: F.coalesce(F.regexp_extract(url, _URL, k), F.lit(""))
    return F.translate(found(1), string.ascii_uppercase, string.ascii_lowercase), found(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def model_text(url: Column) -> Column:
    """What the models read: what follows ``://``, lower case, each digit as 0."""
    rest = F.regexp_replace(url, "(?s)^.*?://", "")
    return F.regexp_replace(F.regexp_replace(F.lower(rest), "[^ -\\x7e]", "~"), "[0-9]", "0")


def _grams(texts: DataFrame, *keep: str) -> DataFrame:
    """The ``ORDER + 1``-gram that ends at each character of text, the end mark too. Cut within the row, so that
    no row carries the text along, and a text of any length takes time in proportion."""
    whole = F.split(F.concat(F.lit("\x02" * ORDER), F.col("text"), F.lit("\x03")), "")
    chars = texts.select(*keep, whole.alias("c"), F.length("text").alias("n"))
    at = lambda i: F.concat(*[F.get(F.col("c"), i + k) for k in range(ORDER + 1)])
    return chars.select(*keep, F.explode(F.transform(F.sequence(F.lit(0), F.col("n")), at)).alias("gram"))


def _log_ratio(counts: DataFrame) -> DataFrame:
    """counts (gram, allow, block, n) of the training URLs; (gram, n, ratio).

    Contexts of up to three characters are ``ALPHABET`` ** 3 at most, some 200,000: they are broadcast, as every n-gram has one of
    very few.
    """
    out = counts.select("gram", "n", F.lit(1.0 / ALPHABET).alias("p_allow"), F.lit(1.0 / ALPHABET).alias("p_block"))
    small = lambda df, length: F.broadcast(df) if length <= 3 else df
    for k in range(1, ORDER + 2):
        level = stored(counts.groupBy(F.substring("gram", ORDER + 2 - k, k).alias("key")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
        context = level.groupBy(F.substring("key", 1, k - 1).alias("context")).agg(
            *[f(c).alias(f"{n}_{c}") for c in ("allow", "block") for n, f in (("n", F.sum), ("t", lambda c: F.count(F.when(F.col(c) > 0, 1))))]
        )
        out = out.withColumns({"key": F.substring("gram", ORDER + 2 - k, k), "context": F.substring("gram", ORDER + 2 - k, k - 1)})
        out = out.join(small(level, k), "key", "left").join(small(context, k - 1), "context", "left")
        mixed = lambda c: (F.coalesce(F.col(c), F.lit(0)) + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))
        new = {f"p_{c}": F.when(F.coalesce(F.col(f"n_{c}"), F.lit(0)) > 0, mixed(c)).otherwise(F.col(f"p_{c}")) for c in ("allow", "block")}
        out = out.withColumns(new).select("gram", "n", "p_allow", "p_block")
    return out.select("gram", "n", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """scored (score, allow, block: held-out counts): the least score to allow, by the smallest sum of both
    error rates, in the middle of the widest gap that has it; 0 where a class is missing."""
    bins = scored.groupBy(F.round("score", 3).alias("bin")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # some thousand bins, whatever the rows
    every = Window.partitionBy()
    wrong = F.try_divide(F.coalesce(F.sum("allow").over(below), F.lit(0)), F.sum("allow").over(every))
    wrong = wrong + F.try_divide(F.sum("block").over(every) - F.coalesce(F.sum("block").over(below), F.lit(0)), F.sum("block").over(every))
    before = F.coalesce(F.lag("bin").over(Window.orderBy("bin")), F.col("bin"))
    cuts = bins.where("bin is not null").select(((F.col("bin") + before) / 2).alias("cut"), (F.col("bin") - before).alias("gap"), wrong.alias("wrong"))
    best = cuts.where("wrong is not null").orderBy("wrong", F.desc("gap"), F.abs("cut"), "cut").first()
    return best["cut"] if best else 0.0


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score): a row for each row of ``pages``.

    Host and path are empty for a null url or one without ``://``. A null url that no rule fits is blocked;
    an empty one is scored as any other. Without training URLs of either kind the models agree, every score is 0,
    and all is allowed. Repeated rows each get a row; URLs may be of any length; other columns are ignored.
    """
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col).alias("page"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "text": model_text(F.col("url"))})
    # URLs that read alike are scored once, under two fingerprints of 64 bits
    one, two = F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")
    kinds = rows.where("text is not null").groupBy("text").agg(F.count("*").alias("times"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("allow"), F.count(F.when(F.col("ruled") == "block", 1)).alias("block"))
    texts = stored(kinds.withColumns({"held": F.pmod(one, F.lit(5)) == 0, "one": one, "two": two}))
    grams = _grams(texts, "one", "two", "allow", "block", "held")
    seen = stored(grams.groupBy("gram").agg(*[F.sum(F.when(~F.col("held"), F.col(c)).otherwise(0)).alias(c) for c in ("allow", "block")], F.count("*").alias("n")))
    ratio = stored(_log_ratio(seen))
    # many URLs start and end alike
    scored = join_evenly(grams.select("one", "two", "gram"), ratio, ["gram"], "n").groupBy("one", "two").agg(F.avg("ratio").alias("score"))
    scored = stored(texts.select("one", "two", "times", "allow", "block", "held").join(scored, ["one", "two"]))
    least = threshold(scored.where("held and allow + block > 0").select("score", "allow", "block"))
    by_score = F.when(F.col("url").isNull(), "block").when(F.col("score") >= least, "allow").otherwise("block")
    columns = ["page", "host", "path", "rule", "ruled", "url"]
    known = join_evenly(rows.where("text is not null").select(*columns, one.alias("one"), two.alias("two")), scored.select("one", "two", "times", "score"), ["one", "two"], "times")
    out = known.select(*columns, "score").unionByName(rows.where("text is null").select(*columns, F.lit(None).cast("double").alias("score")))
    return out.select(F.col("page").alias(id_col), "host", "path", "rule", F.coalesce("ruled", by_score).alias("verdict"), F.round("score", 6).alias("score"))
