"""Listings over HTTP as a data source, trees, forms and feeds on odd rows."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from inkwell.sources import collect
from inkwell.sources.fetch import FetchSource


@pytest.fixture(scope="module")
def server():
    seen: list[str] = []

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            page = int(parse_qs(urlsplit(self.path).query).get("page", ["0"])[0])
            self.send_response(404 if page == 3 else 200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(f'<a href="/item/{page}">Çalls for page {page}</a>'.encode())

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"list": [{"code": k, "name": v[0]} for k, v in parse_qs(body).items()]}).encode())

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen
    http.shutdown()


def test_a_failure_stays_with_its_address(spark, server):
    spark.dataSource.register(FetchSource)
    base, _ = server
    urls = [f"{base}/list?page={k}" for k in range(1, 5)] + ["http://127.0.0.1:1/", "no address"]
    rows = spark.read.format("inkwell_fetch").option("urls", json.dumps(urls)).option("pertask", 2).option("timeout", 5).load()
    got = {r["url"]: r for r in rows.collect()}
    assert len(got) == 6 and rows.rdd.getNumPartitions() == 3
    assert [got[u]["status"] for u in urls] == [200, 200, 404, 200, None, None]
    assert [got[u]["error"] is None for u in urls] == [True, True, False, True, False, False]
    links = collect.listing(rows.where("error is null").select(F.col("url").alias("page"), "url", F.col("body").alias("html")), "page", "url", lengths=(8, 220))
    assert {tuple(r) for r in links.collect()} == {(f"{base}/list?page={k}", f"{base}/item/{k}", f"Çalls for page {k}") for k in (1, 2, 4)}


def test_a_form_is_posted(spark, server):
    spark.dataSource.register(FetchSource)
    rows = spark.read.format("inkwell_fetch").option("urls", json.dumps([server[0]])).option("form", json.dumps({"a": "x y", "b": "é"})).load()
    assert {tuple(r) for r in collect.json_listing(rows, "url", "body", "list", "code: string, name: string").select("code", "name").collect()} == {("a", "x y"), ("b", "é")}


def test_a_stream_of_pages_goes_on_where_it_was(spark, server, tmp_path):
    spark.dataSource.register(FetchSource)
    base, seen = server
    seen.clear()

    def run(pages: int) -> list[str]:
        rows = spark.readStream.format("inkwell_fetch").option("template", f"{base}/list?page={{page}}").option("pages", pages).option("perbatch", 2).load()
        query = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/offsets").start()
        query.processAllAvailable()
        query.stop()
        return sorted(seen)

    assert run(4) == [f"/list?page={k}" for k in (1, 2, 3, 4)]
    assert run(6) == [f"/list?page={k}" for k in (1, 2, 3, 4, 5, 6)]  # none twice
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(int(r["url"][-1]) for r in out) == [1, 2, 3, 4, 5, 6] and sum(r["error"] is not None for r in out) == 1


def test_one_of_urls_and_template(spark):
    spark.dataSource.register(FetchSource)
    with pytest.raises(Exception, match="either urls or template"):
        spark.read.format("inkwell_fetch").load().collect()


def test_a_deep_chain_and_cycles(spark):
    n = 10_000
    chain = spark.range(1, n).select((F.col("id") - 1).cast("string").alias("parent"), F.col("id").cast("string").alias("node"))
    ring = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x"), ("z", "under"), ("nowhere", "lost"), ("a", "b"), ("b", "a"), ("self", "self")], "parent string, node string")
    roots = spark.createDataFrame([("0",), ("alone",)], "node string")
    got = {r["node"]: (r["root"], r["level"]) for r in collect.tree(roots, chain.unionByName(ring)).collect()}
    assert got == {str(k): ("0", k) for k in range(n)} | {"alone": ("alone", 0)}
    first = collect.tree(roots, chain.limit(50), limit=5).collect()
    assert sorted((r["level"], r["node"]) for r in first)[:2] == [(0, "0"), (0, "alone")] and len(first) == 5
    near = collect.tree(roots, chain, deadline_seconds=0).collect()
    assert {r["node"] for r in near} == {"0", "1", "alone"}  # no round: what hangs on a root itself


def test_feeds_are_isolated(spark):
    xml = "<rss><item><title><![CDATA[One &amp; all]]></title><link>http://x/1</link><pubDate>now</pubDate><description>&lt;b&gt;D&lt;/b&gt;</description></item><item><title></title><link>http://x/2</link></item>" + "".join(f"<item><title>T{k}</title><link>u{k}</link></item>" for k in range(9)) + "</rss>"
    rows = spark.createDataFrame([("a", xml), ("b", "<html>no feed</html>"), ("c", None), ("d", "<rss></rss>")], "feed string, xml string")
    got = [tuple(r) for r in collect.feed_items(rows, "feed", "xml").orderBy("feed", "place").collect()]
    assert got[0] == ("a", 0, "One & all", "http://x/1", "now", "D", None)
    assert [g[1] for g in got if g[0] == "a"] == [0, 2, 3, 4, 5, 6, 7]
    assert [(g[0], g[-1]) for g in got if g[0] != "a"] == [("b", "not a feed"), ("c", "not fetched")]
    assert [r["title"] for r in collect.feed_titles(rows, "feed", "xml", 3).collect()] == ["One & all", "T0", "T1"]


def test_forms(spark):
    rows = spark.createDataFrame([(1, " Ann ", "hello world", ""), (2, "Bot", "buy", "http://x"), (3, "  ", "hi", None), (4, "Bo", None, None)], "id int, name string, message string, trap string")
    assert [tuple(r) for r in collect.accepted_forms(rows, "trap", {"name": 2, "message": 5}).collect()] == [(1, "A", "hello")]
