"""Queries without SQL over the whole of the smallest tables, against plain Python."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from urllib.parse import urljoin, urlsplit

import pytest
import regex

from inkwell.functions import html as H
from inkwell.functions import privacy as P
from inkwell.functions import text as T
from inkwell.queries import QUERIES

from .conftest import DATA

SPACE = T.SPACE


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{DATA}/{t}.parquet").toPandas().to_dict("records") for t in ("documents", "pages", "labels", "lineitem", "events")}


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: QUERIES[name](spark, str(DATA)).collect()


def squeeze(t):
    return regex.sub(SPACE + "+", " ", t).strip(" ")


def plain(t):
    for p in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "<[^>]+>", "(?i)&[a-z#0-9]+;"):
        t = re.sub(p, " ", t)
    return squeeze(t)


def test_entities(run, tables):
    assert {r["page_id"]: r["html"] for r in run("FS03_decode_entities")} == {p["page_id"]: html.unescape(p["html"]) for p in tables["pages"]}
    assert html.unescape("&amp;#65; &#65; &#x41; &eacute;") == "&#65; A A é"


def test_normalized_tokens(run, tables):
    want = {d["doc_id"]: len({w for w in regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFKC", d["text"]).lower()) if len(w) > 1}) for d in tables["documents"] if d["text"] is not None}
    assert {r["doc_id"]: r["n"] for r in run("FS09_normalized_tokens") if r["n"] is not None} == want


def test_sentence_lengths(run, tables):
    ends = regex.compile(r"(?:(?<![\p{L}\p{N}])\.|\.(?![\p{L}\p{N}])|[!?。？！])+(?:[\"'”’」』)\]]*)?\s*", regex.A)
    want = {}
    for d in tables["documents"]:
        t = d["text"]
        for p in (r"(?i)<br\s*/?>", "<[^>]+>", "(?i)&(?:nbsp|amp|lt|gt|quot|#39);"):
            t = re.sub(p, " ", t)
        n = [len(regex.sub(SPACE, "", s)) for s in ends.split(squeeze(t))]
        n = [x for x in n if x]
        want[d["doc_id"]] = (len(n), sum(x > 80 for x in n))
    assert {r["doc_id"]: (r["sentences"], r["long"]) for r in run("FS30_sentence_lengths")} == want


def interleave(text, figures):
    """By paragraphs: figure k comes after the paragraph nearest to an even share, and after the one of the figure before."""
    ends = [m.end() for m in re.finditer("(?i)</p>", text)]
    places, last = [], 0
    for k in range(len(figures)):
        last = max(last + 1, round((k + 1) * len(ends) / (len(figures) + 1)))
        places.append(last)
    out, at = "", 0
    for n, end in enumerate([*ends, len(text)], 1):
        out, at = out + text[at:end] + "".join(f for f, p in zip(figures, places) if p == n), end
    return out + "".join(f for f, p in zip(figures, places) if p > len(ends) + 1)


def test_interleaved_figures(run, tables):
    assert {r["page_id"]: r["html"] for r in run("FS49_interleaved_figures")} == {p["page_id"]: interleave(p["html"], ["<figure>1</figure>", "<figure>2</figure>"]) for p in tables["pages"]}


def test_relayout_of_the_newest_page_of_a_host(run, tables):
    newest = {}
    for p in sorted(tables["pages"], key=lambda p: p["page_id"]):
        newest[urlsplit(p["url"]).hostname.removeprefix("www.")] = p
    assert {r["page_id"]: r["html"] for r in run("T29_relayout")} == {p["page_id"]: interleave(p["html"], ["<figure>new</figure>"]) for p in newest.values()}


def test_sections(run, tables):
    want = {}
    for p in tables["pages"]:
        sizes = []
        for part in re.split(r"(?i)(?=<p[\s>])", p["html"]):
            n = len(re.sub(r"\s", "", re.sub("<[^>]+>", "", part)))
            if sizes and (sizes[-1] < 700 or len(sizes) >= 8):
                sizes[-1] += n
            else:
                sizes.append(n)
        want[p["page_id"]] = len(sizes)
    assert {r["page_id"]: r["sections"] for r in run("FS35_sections")} == want


def test_generic_listing(run, tables):
    want = set()
    for p in tables["pages"]:
        found = {}
        for _, href, anchor in re.findall(r"""(?is)<a\b([^>]*href\s*=\s*["']([^"'#]+)["'][^>]*)>(.*?)</a>""", p["html"]):
            title = plain(anchor)
            if 8 <= len(title) <= 220 and re.search("(?i)en|tion|an", title) and not re.match("(javascript|mailto|tel):", href):
                found.setdefault(urljoin(p["url"], html.unescape(href)), title)
        want |= {(p["page_id"], u, t) for u, t in list(found.items())[:60]}
    assert {tuple(r) for r in run("S13_generic_listing")} == want and want


def test_main_content(run, tables):
    want = {}
    for p in tables["pages"]:
        m = re.search("(?is)<article>(.*?)</article>", p["html"])
        text = plain(p["html"])
        around = [text[max(0, text.find(w) - 300) : text.find(w) + 4000] for w in ("tion", "thon") if w in text]
        inside = plain(m[1]) if m and (p["page_id"] % 3 == 0 or p["page_id"] % 3 == 1 and re.search("(?is)</article>\\s*(<footer|$)", p["html"])) else ""
        want[p["page_id"]] = (inside or "\n".join(dict.fromkeys(around)) or text)[:32_000]
    assert {r["page_id"]: r["text"] for r in run("S18_main_content")} == want


def redacted(t, terms=()):
    """Text and counts, pass by pass."""
    counts = dict.fromkeys(P.KINDS, 0)
    for kind, p, v, check in [*P.PASSES, *(("custom", "(?i)" + re.escape(w), "[SENSITIVE]", None) for w in terms)]:
        out, at = [], 0
        for m in re.finditer(p, t):
            d = [int(c) for c in m[0] if c.isdigit()]
            if check == "luhn" and (len(set(d)) == 1 or (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10):
                continue
            if check == "10 to 16 digits" and not 10 <= len(d) <= 16:
                continue
            counts[kind] += 1
            out += [t[at : m.start()], v.replace("$1", m[1] or "") if "$1" in v else v]
            at = m.end()
        t = "".join(out) + t[at:]
    return t, counts


def test_redaction_and_counts(run, tables):
    texts = {d["doc_id"]: d["text"] for d in tables["documents"]}
    want = {k: redacted(t, ("rights reserved",)) for k, t in texts.items()}
    assert {r["doc_id"]: (r["text"], r["total"]) for r in run("FS25_redaction")} == {k: (t, sum(n.values())) for k, (t, n) in want.items()}
    plain_counts = {k: redacted(t)[1] for k, t in texts.items()}
    got = {r["doc_id"]: r.asDict() for r in run("A20_redaction_counts")}
    assert got == {k: {"doc_id": k, **n, "total": sum(n.values())} for k, n in plain_counts.items()}
    assert sum(n["email"] for n in plain_counts.values()) > 1


def test_redacted_parts(spark, run):
    parts = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        parts[r["conv_id"]].append((r["turn"], *redacted(r["text"] or "")))
    want = {k: (sorted(x[:2] for x in v), sum(sum(x[2].values()) for x in v)) for k, v in parts.items()}
    assert {r["conv_id"]: ([tuple(p) for p in r["parts"]], r["redactions"]) for r in run("FS28_redacted_parts")} == want


def test_changes(run, tables):
    want = {}
    for d in tables["documents"]:
        hunks = H.change_hunks(d["text"], re.sub("(?i)the ", "a ", d["text"]))
        want[d["doc_id"]] = (None, None) if hunks is None else (len(hunks), sum(h["removed"] for h in hunks))
    assert {r["doc_id"]: (r["hunks"], r["removed"]) for r in run("FS42_changes")} == want


def test_review_of_what_no_cache_has(run, tables):
    misses = {r["doc_id"] for r in run("T16_cache_lookup") if r["found"] == "miss"}
    want = {}
    for d in tables["documents"]:
        if d["doc_id"] in misses:
            t = redacted(d["text"])[0]
            hunks = H.change_hunks(t, re.sub("(?i)that ", "which ", t))
            want[d["doc_id"]] = None if hunks is None else len(hunks)
    assert {r["doc_id"]: r["hunks"] for r in run("Q15_review_with_cache")} == want and want


def titles(tables, k):
    found = defaultdict(list)
    for d in tables["documents"]:
        found[d["source"]].append((-len(d["text"]), d["doc_id"], set(d["text"][:60].lower().split())))
    kept = set()
    for source, rows in found.items():
        chosen = []
        for _, doc, words in sorted(rows, key=lambda x: x[:2]):
            if len(chosen) < k and all(2 * len(words & w) < max(1, len(words | w)) for w in chosen):
                chosen.append(words)
                kept.add((source, doc))
    return kept


def test_titles_unlike_each_other(run, tables):
    assert {(r["source"], r["doc_id"]) for r in run("W11_near_duplicates")} == titles(tables, 20)
    assert len(run("T11_daily_quota")) == len(tables["documents"])


def test_quota_of_days(run, tables):
    good = {x["doc_id"] for x in tables["labels"] if x["quality"] == 1}
    rows = [(d["doc_id"] * 37 % 60, d["doc_id"], set(d["text"][:60].lower().split()), len(d["text"])) for d in tables["documents"]]
    like = lambda a, b: 2 * len(a & b) >= max(1, len(a | b))
    want = set()
    for day in range(60):
        chosen = []
        for _, doc, words, _ in sorted((x for x in rows if x[0] == day), key=lambda x: (-x[3], x[1])):
            recent = (w for d, i, w, _ in rows if i in good and day - 14 <= d < day)
            if len(chosen) < 5 and not any(like(words, w) for w in recent) and not any(like(words, w) for w in chosen):
                chosen.append(words)
                want.add(doc)
    assert {r["doc_id"] for r in run("T11_daily_quota") if r["kept"]} == want and want


def score(x):
    crowded = 0.35 * (x["l_partkey"] % 100 - 60) if x["l_partkey"] % 100 > 60 else 0
    return int(0.4 * 2 * x["l_quantity"] + 0.3 * 1000 * x["l_discount"] + 0.2 * 1250 * x["l_tax"] - crowded + 0.5)


def test_slide_review(run, tables):
    decks = defaultdict(dict)
    for x in tables["lineitem"]:
        s = decks[x["l_partkey"] % 50].setdefault(x["l_partkey"], [-1000, 99])
        s[0], s[1] = max(s[0], score(x)), min(s[1], x["l_linenumber"])
    want = set()
    for deck, slides in decks.items():
        first = [p for x in tables["lineitem"] if (p := x["l_partkey"]) % 50 == deck and x["l_linenumber"] == 1]
        cover = min(first, default=min(slides))
        light = [p for p in slides if p % 100 <= 80]
        heavy = sorted((p % 100, p) for p in slides if p % 100 > 80)[: max(0, 3 - len(light))]
        left, used = sorted(light + [p for _, p in heavy]), defaultdict(int)
        for place in range(1, 7):
            if not left:
                break
            best = max(left, key=lambda p: (slides[p][0] * (1, 0.65, 0.35, 0.1)[min(3, used[slides[p][1]])], -p))
            used[slides[best][1]] += 1
            left.remove(best)
            want.add((deck, place, best, best == cover))
    assert {tuple(r) for r in run("Q11_slide_review")} == want
