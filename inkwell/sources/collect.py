"""Listings as rows: anchors, feeds and JSON pages already fetched into a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators.lineage import cut

#: What a listing's link text and address must be.
TITLE_LENGTH, MOST_LINKS = (8, 220), 60


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``href`` and ``title``: a row for each anchor, in page order as ``place``."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    rows = pages.select("*", F.posexplode(found).alias("place", "_a"))
    return rows.withColumns({"href": F.regexp_extract("_a", r'href="([^"]*)"', 1), "title": T.plain_text(F.col("_a"))}).drop("_a")


def resolved(base: Column, href: Column) -> Column:
    """Absolute address of a link; addresses with a scheme stay, a leading slash goes to the host."""
    root = F.regexp_extract(base, "^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, "^([a-z]+://[^?#]*/)", 1)
    return F.when(href.rlike("^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), href))


def listing(pages: DataFrame, key: str, base: str, keywords: str | None = None, lengths: tuple[int, int] = TITLE_LENGTH, most: int = MOST_LINKS) -> DataFrame:
    """(key, url, title): the first ``most`` different links of a page whose title has a fitting length and holds ``keywords`` (a pattern). The title
    is the link's title attribute or its text."""
    from inkwell.operators.counting import top
    from inkwell.operators.upsert import first_seen

    link = r"""(?is)<a\b([^>]*href\s*=\s*["']([^"'#]+)["'][^>]*)>(.*?)</a>"""
    parts = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(link), F.lit(k)).alias(n) for k, n in ((1, "head"), (2, "href"), (3, "text"))])
    rows = pages.select(key, base, F.posexplode(parts).alias("place", "_a")).select(key, base, "place", "_a.*")
    named = F.regexp_extract("head", r"""(?i)title=["']([^"']+)["']""", 1)
    href = F.col("href")
    for name, value in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        href = F.replace(href, F.lit(name), F.lit(value))
    rows = rows.select(key, base, "place", T.plain_text(F.coalesce(F.nullif(named, F.lit("")), F.col("text"))).alias("title"), href.alias("href"))
    rows = rows.where(F.length("title").between(*lengths) & ~F.col("href").rlike("(?i)^(javascript|mailto|tel):"))
    if keywords:
        rows = rows.where(F.col("title").rlike(keywords))
    rows = rows.withColumn("url", resolved(F.col(base), F.col("href"))).select(key, "place", "title", F.col("url").alias("link"))
    once = first_seen(rows, [key, "link"], [F.col("place")])
    return top(once, most, [F.col("place")], [key]).select(key, F.col("link").alias("url"), "title")


def filled(rows: DataFrame, details: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Empty fields of ``rows`` from ``details``."""
    new = details.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return rows.join(new, key, "left").select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns])


def accepted_forms(forms: DataFrame, trap: str, lengths: dict[str, int]) -> DataFrame:
    """Sent forms without those whose hidden field ``trap`` is filled in; the fields are cut to ``lengths`` and trimmed, and one without any of them goes."""
    rows = forms.where(F.coalesce(F.trim(trap), F.lit("")) == "").withColumns({c: F.trim(F.substring(c, 1, n)) for c, n in lengths.items()})
    for c in lengths:
        rows = rows.where(F.col(c) != "")
    return rows.drop(trap)


def js_links(pages: DataFrame, key: str, html: str = "html", keywords: str | None = None) -> DataFrame:
    """(key, id, title): links that call ``go_view(id)``, the first of each id on a page; with ``keywords``, a pattern that the title must hold."""
    from inkwell.operators.upsert import first_seen

    link = r"""(?is)<a\s+href=['"]javascript:go_view\(([0-9]+)\);['"][^>]*>(.*?)</a>"""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(link), F.lit(1)).alias("id"), F.regexp_extract_all(html, F.lit(link), F.lit(2)).alias("block"))
    rows = pages.select(key, F.posexplode(found).alias("place", "_a")).select(key, "place", "_a.id", "_a.block")
    named = F.regexp_extract("block", r"""(?is)<p\s+class=["']tit["'][^>]*>(.*?)</p>""", 1)
    rows = rows.withColumn("title", T.plain_text(F.coalesce(F.nullif(named, F.lit("")), F.col("block")))).where("title <> ''")
    if keywords:
        rows = rows.where(F.col("title").rlike(keywords))
    return first_seen(rows, [key, "id"], [F.col("place")]).select(key, "id", "title")


def json_listing(pages: DataFrame, key: str, body: str, field: str, item: str) -> DataFrame:
    """(key, the fields of ``item``): a row for each entry of the list ``field`` in a JSON body; a body that doesn't parse has none."""
    rows = F.from_json(body, F.lit(f"`{field}` array<struct<{item}>>"))[field]
    return pages.select(key, F.inline(rows))


def xml_text(text: Column) -> Column:
    """Text of a feed's field: out of its CDATA, entities decoded, tags off, white space squeezed."""
    for pattern, value in ((r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("<[^>]+>", " ")):
        text = F.regexp_replace(text, pattern, value)
    return T.squeeze(text)


def feed_items(feeds: DataFrame, key: str, xml: str, most: int = 8) -> DataFrame:
    """(key, place, title, link, published, summary, error): the first items of each feed, those without title or link left out. A
    feed that wasn't fetched (null), or isn't one, is one row with an error; the others aren't touched."""
    items = F.slice(F.regexp_extract_all(xml, F.lit("(?is)<item>(.*?)</item>"), F.lit(1)), 1, most)
    rows = feeds.select(key, F.when(F.col(xml).isNull(), "not fetched").when(~F.col(xml).rlike("(?i)<(rss|feed|channel)[ >]"), "not a feed").alias("error"), F.posexplode_outer(items).alias("place", "_i"))
    field = lambda tag: xml_text(F.regexp_extract("_i", f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))
    good = F.col("error").isNull() & (F.col("title") != "") & (F.col("link") != "")
    rows = rows.select(key, "place", field("title").alias("title"), field("link").alias("link"), F.nullif(field("pubDate"), F.lit("")).alias("published"), F.substring(field("description"), 1, 1200).alias("summary"), "error")
    blank = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return rows.where(good | F.col("error").isNotNull() & (F.coalesce("place", F.lit(0)) == 0)).select(key, *[blank(c) for c in ("place", "title", "link", "published", "summary")], "error")


def feed_titles(feeds: DataFrame, key: str, xml: str, most: int = 50) -> DataFrame:
    """(key, place, title): the first titles of each feed that aren't empty."""
    titles = F.transform(F.regexp_extract_all(xml, F.lit("(?is)<item>.*?<title>(.*?)</title>"), F.lit(1)), xml_text)
    return feeds.select(key, F.posexplode(F.slice(F.filter(titles, lambda x: x != ""), 1, most)).alias("place", "title"))


def markdown_block(text: Column, start: str, stops: tuple[str, ...]) -> Column:
    """What stands after the first match of ``start`` up to the nearest match of any of ``stops`` (patterns of whole lines), links as their text, marks of
    headings, quotes and lists off."""
    rest = F.regexp_extract(text, f"(?ims){start}(.*)", 1)
    block = F.regexp_replace(rest, f"(?ims)(?:{'|'.join(stops)}).*", "")
    for pattern, value in ((r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?m)^\s*[#>*]+\s*", ""), (r"(?m)^\s*[-*]\s+", "- ")):
        block = F.regexp_replace(block, pattern, value)
    return T.squeeze(block)


def page_images(files: DataFrame, key: str, name: str, most: int = 100) -> DataFrame:
    """(key, name, place): the PNG pages of each converted document in the order of the numbers in their names, the first ``most``."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy(F.regexp_extract(name, "([0-9]+)[^0-9]*$", 1).try_cast("long").asc_nulls_first(), name)
    return files.where(F.lower(name).endswith(".png")).select(key, name, F.row_number().over(order).alias("place")).where(F.col("place") <= most)


def around(html: Column, words: tuple[str, ...], before: int = 300, after: int = 4000, most: int = 32_000) -> Column:
    """Text of ``<main>``, or of a content element in front of the footer; without one, what stands around the first place of each word, in lines; and
    without any, the whole text. ``most`` characters of it."""
    main = F.regexp_extract(html, r"(?is)<main\b[^>]*>(.*?)</main>", 1)
    content = F.regexp_extract(html, r"""(?is)<div\b[^>]*id=["'](?:content|contents|container)["'][^>]*>(.*?)</div>\s*(?:<footer|$)""", 1)
    text = T.plain_text(html)
    part = lambda w: F.when(F.instr(text, w) > 0, F.substr(text, F.greatest(F.lit(1), F.instr(text, w) - before), F.lit(after) + F.least(F.instr(text, w) - 1, F.lit(before))))
    excerpts = F.array_join(F.array_distinct(F.array_compact(F.array(*[part(w) for w in words]))), "\n")
    first = T.plain_text(F.coalesce(F.nullif(main, F.lit("")), F.nullif(content, F.lit(""))))
    return F.substring(F.coalesce(first, F.nullif(excerpts, F.lit("")), text), 1, most)


def tree(nodes: DataFrame, edges: DataFrame, limit: int | None = None, deadline_seconds: float | None = None) -> DataFrame:
    """(node, root, level) of a forest: ``nodes`` are the roots (node), ``edges`` (parent, node), each node once.

    By pointer jumping: each round every node's pointer goes twice as far up, so a chain of n nodes takes log n rounds, and there is no limit to its
    depth. Nodes of a cycle, or under one, have no root and do not come out. ``limit``: so many nodes at most, the upper levels first, by node
    within one. ``deadline_seconds``: after it the rounds end, and only nodes that have reached their root by then come out, as of a crawl that ran out of time.
    """
    import time

    began = time.monotonic()
    roots = nodes.select("node", F.col("node").alias("up"), F.lit(0).cast("long").alias("steps"), F.lit(True).alias("done")).distinct()
    # a pointer: ``steps`` levels up from a node stands ``up``; done if that is a root
    below = edges.join(roots.select("node"), "node", "left_anti").select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps"))
    below = below.join(roots.select(F.col("node").alias("up"), F.lit(True).alias("_root")), "up", "left").select("node", "up", "steps", F.coalesce("_root", F.lit(False)).alias("done"))
    at = cut(roots.unionByName(below))
    while not at.where("not done").isEmpty() and (deadline_seconds is None or time.monotonic() - began < deadline_seconds):
        far = at.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        # a pointer to a node that isn't there, or to its own beginning again, never ends at a root
        open_ = at.where("not done").join(far, "up").where(F.col("_up") != F.col("node")).select("node", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done"))
        # in a cycle of n nodes no pointer may go further than there are nodes
        at = cut(at.where("done").unionByName(open_.where(F.col("steps") <= at.count())))
    found = at.where("done").select("node", F.col("up").alias("root"), F.col("steps").alias("level"))
    return found if limit is None else found.orderBy("level", "node").limit(limit)


