"""Text and HTML columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts in a browser know it: Java's \s lacks the no-break space and others.
SPACE = "[\\s   -     　﻿]"
#: Words that tokens leave out.
STOP_WORDS = (
    "그리고", "그러나", "대한", "위한", "통한", "있는", "하는", "해야", "하면", "에서", "으로", "에게", "까지", "관련", "기반", "활용", "방법", "전략", "핵심", "가이드", "안내",
    "기업", "중소기업", "스타트업", "지원", "사업", "정부", "정부지원사업", "2026년", "2026년도", "실무", "우리", "소개", "종합", "정리", "필요", "확인",
)
#: Entities, in the order they are decoded.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is found once, however often it is named."""
    return F.get(F.transform(F.array(value), of), 0)


def squeeze_all(text: Column) -> Column:
    """Runs of white space as one space; single spaces, nearly all there is, are left as they are."""
    return F.regexp_replace(text, f"(?![!-~])(?:{SPACE}{{2,}}|(?! ){SPACE})", " ")


def squeeze(text: Column) -> Column:
    return F.trim(squeeze_all(text))


def plain_text(html: Column) -> Column:
    """Without scripts, styles and tags; a reference becomes a space."""
    for pattern in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "<[^>]+>", "(?i)&[a-z#0-9]+;"):
        html = F.regexp_replace(html, pattern, " ")
    return squeeze(html)


def decoded_text(html: Column) -> Column:
    """As ``plain_text``, but with the common references decoded."""
    for pattern in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "<[^>]+>"):
        html = F.regexp_replace(html, pattern, " ")
    for name, value in ENTITIES:
        html = F.replace(html, F.lit(name), F.lit(value))
    return squeeze(html)


def visible_text(html: Column) -> Column:
    for pattern in (r"(?i)<br\s*/?>", "<[^>]+>", "(?i)&(?:nbsp|amp|lt|gt|quot|#39);"):
        html = F.regexp_replace(html, pattern, " ")
    return squeeze(html)


def visible_length(html: Column) -> Column:
    return F.length(F.regexp_replace(visible_text(html), SPACE, ""))


def headings(html: Column, levels: str = "23") -> Column:
    found = F.regexp_extract_all(html, F.lit(f"(?is)<h[{levels}][^>]*>(.*?)</h[{levels}]>"), F.lit(1))
    return F.filter(F.transform(found, plain_text), lambda h: h != "")


def tokens(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words of two characters or more, with repeats, without stop words (``stop`` takes more of them, such as the publisher's own name)."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[가-힣a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*stop))


def token_set(text: Column) -> Column:
    """Different words of two characters or more after all other marks are cut."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z가-힣]{2,}"), F.lit(0)))


def terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z가-힣]{2,}"), F.lit(0)))


def title_key(title: Column) -> Column:
    """Titles that differ in a leading bracket or in marks alone have one key."""
    return F.regexp_replace(F.lower(F.regexp_replace(title, r"^\s*\[[^\]]*\]\s*", "")), "[^0-9a-z가-힣]", "")


#: Names of regions, and of the bodies that a region has.
REGIONS = (
    "서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종", "경기", "강원", "충북", "충청북도", "충남", "충청남도", "전북", "전라북도", "전남", "전라남도", "경북", "경상북도", "경남", "경상남도", "제주",
    "창원", "김해", "양산", "진주", "거제", "통영", "포항", "구미", "천안", "청주", "전주", "여수", "순천", "수원", "성남", "용인", "고양", "화성", "이천", "하남", "평택",
)
REGION_LEVELS = ("특별시", "광역시", "특별자치시", "특별자치도", "시", "도", "군", "구")
REGION_BODIES = (
    "테크노파크", "창조경제혁신센터", "지방중소벤처기업청", "중소벤처기업청", "경제진흥원", "산업진흥원", "신용보증재단", "테크노밸리", "창업보육센터", "상공회의소", "발전연구원", "일자리재단", "도시공사", "관광공사",
)


def without_regions(text: Column, regions: tuple[str, ...] = REGIONS, bodies: tuple[str, ...] = REGION_BODIES) -> Column:
    """Without names of regions (with their level and a body that follows) and of bodies: texts that differ in these alone are alike."""
    named = F.regexp_replace(text, rf"({'|'.join(regions)})\s*({'|'.join(REGION_LEVELS)})?\s*({'|'.join(bodies)})?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(named, "|".join(bodies), " "), SPACE + "+", " "))


def core_topic(text: Column) -> Column:
    """What a topic is about, wherever it is set: lower case, marks as spaces."""
    return F.trim(F.regexp_replace(F.lower(without_regions(text)), "[^0-9a-z가-힣]+", " "))


def slug(text: Column, most: int = 60) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, most), "-+$", "")


def tidy_line(text: Column, most: int = 110) -> Column:
    one = squeeze(F.regexp_replace(text, r"[\r\n]+", " "))
    return F.when(F.length(one) > most, F.concat(F.rtrim(F.substring(one, 1, most - 1)), F.lit("…"))).otherwise(one)


def summary(text: Column, most: int = 120) -> Column:
    """Up to ``most`` characters, cut at a space if that keeps more than three fifths."""
    one = squeeze(text)
    head = F.substring(one, 1, most)
    last = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (last > 0.6 * most), F.substr(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(one) > most, F.concat(cut, F.lit("…"))).otherwise(one)


def first_email(text: Column) -> Column:
    return F.regexp_extract(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0)


def numbers(text: Column) -> Column:
    """Numbers with thousands commas, decimals and a unit of percent: sorted, with repeats."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?%?"), F.lit(0)))


def letters(n: Column) -> Column:
    """0, 1, ... 25, 26 as A, B, ... Z, AA: whole numbers in bijective base 26."""
    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("text"))

    def step(a: Column, _: Column) -> Column:
        more = F.struct((F.floor(a["left"] / 26) - 1).cast("long").alias("left"), F.concat(F.char((F.lit(65) + F.pmod(a["left"], F.lit(26))).cast("int")), a["text"]).alias("text"))
        return F.when(a["left"] < 0, a).otherwise(more)

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda a: a["text"])  # 14 letters hold any long


def has_repeat(text: Column) -> Column:
    """A word follows itself."""
    w = F.split(F.lower(squeeze(text)), " ")
    return F.exists(F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)


def sentence_lengths(html: Column) -> Column:
    """Characters of each sentence without white space."""
    ends = r"(?=[.!?。？！])(?:(?<![\p{L}\p{N}])\.|\.(?![\p{L}\p{N}])|[!?。？！])+(?:[\"'”’」』)\]]*)?\s*"
    return F.filter(F.transform(F.split(visible_text(html), ends), lambda s: F.length(F.replace(s, F.lit(" "), F.lit("")))), lambda n: n > 0)


def masked_ip(ip: Column) -> Column:
    """IPv4 without its last number, IPv6 with four groups; null for anything else."""
    v4 = F.split(ip, r"\.")
    four = F.when(F.size(v4) == 4, F.concat(F.array_join(F.slice(v4, 1, 3), "."), F.lit(".0")))
    return F.when(ip.contains("."), four).when(ip.contains(":"), F.concat(F.array_join(F.slice(F.split(ip, ":"), 1, 4), ":"), F.lit("::")))
