"""The library's table functions for SQL text.

    inkwell.sql.register(spark)
    spark.sql("SELECT page_id, l.* FROM pages, LATERAL html_links(html) l")
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from inkwell.functions import html as H
from inkwell.functions import privacy as P


class _Links(HTMLParser):
    """Anchors of a page in one pass: place, address, and title attribute or text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[int, str, str]] = []
        self.href: str | None = None
        self.named, self.text = "", [""]

    def _end(self) -> None:
        if self.href is not None:
            self.out.append((len(self.out), self.href, self.named or " ".join("".join(self.text).split())))
        self.href = None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self._end()
            found = dict(attrs)
            if found.get("href"):
                self.href, self.named, self.text = found["href"], (found.get("title") or "").strip(), []

    def handle_endtag(self, tag):
        if tag == "a":
            self._end()

    def handle_data(self, data):
        if self.href is not None:
            self.text.append(data)


class HtmlLinks:
    def eval(self, page: str) -> Iterator[tuple]:
        if page:
            parser = _Links()
            parser.feed(page)
            parser.close()
            parser._end()
            yield from parser.out


class DiffHunks:
    def eval(self, before: str, after: str) -> Iterator[tuple]:
        for k, h in enumerate(H.change_hunks(before or "", after or "") or []):
            yield k, h["changed"], h["before"], h["after"], h["removed"]


def register(spark: SparkSession) -> None:
    """``html_links(html)``: (place, href, title). ``diff_hunks(before, after)``: (place, changed, before, after, removed). ``risk_issue(text)``: why a text
    must not go out, or null."""
    spark.udtf.register("html_links", udtf(HtmlLinks, returnType="place int, href string, title string", useArrow=True))
    spark.udtf.register("diff_hunks", udtf(DiffHunks, returnType="place int, changed string, before string, after string, removed int", useArrow=True))
    for name, rule in (("risk_issue", (P.HIGH_RISK, P.SECRET, P.NAMED)), ("high_risk_issue", (P.HIGH_RISK, P.SECRET))):
        cases = " ".join(f"WHEN text RLIKE {_quoted(pattern)} THEN {_quoted(issue)}" for issue, pattern in rule)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS STRING RETURN CASE {cases} END")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
