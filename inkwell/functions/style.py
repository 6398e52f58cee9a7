"""Linters of articles and drafts: what an editor would send back, as lists of issues in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.text import SPACE

#: Worn phrases, and endings that may stand twice.
CLICHES = (
    "오늘날", "빠르게 변화하는", "살펴보겠습니다", "결론적으로", "단순(?:한|히).{0,24}넘어", "알아보겠습니다", "정리해 보았습니다",
    "도움이 되(?:셨|시)길", "무엇보다도", "점점 더", "다양한 (?:방법|측면|요소)", "핵심은 바로", "이러한 (?:점|부분)에서",
)
ENDINGS = ("중요합니다", "필수적입니다", "기대할 수 있습니다")
NUMBERED = r"(?i)<h[23][^>]*>[^<]*(?:[1-9][0-9]?[\s]*(?:가지|단계|개|곳|축)|하나|둘|셋|넷|다섯|세 가지|네 가지|다섯 가지)[^<]*</h[23]>"
PAGE_REFERENCE = rf"(?i)(?:slide|슬라이드|page|페이지){SPACE}*(?:no\.?{SPACE}*)?[0-9]+"
#: Limits of sentences, answers, marks and drafts.
LONGEST_SENTENCE, LONGEST_ANSWER, MOST_EXCLAMATIONS, MOST_QUESTIONS, SAMPLES = 100, 180, 4, 6, 5
DRAFT_LENGTH, DRAFT_HEADINGS, DRAFT_PARAGRAPHS, DRAFT_FAQ = (2500, 3500), 5, 12, 4


def without_prefix(text: Column) -> Column:
    """A question or an answer without its Q. or A."""
    t = F.trim(F.coalesce(text, F.lit("")))
    whole = F.regexp_extract(t, rf"(?is)^<strong>{SPACE}*[QA]{SPACE}*[.．:：]{SPACE}*(.*?)</strong>$", 1)
    bare = F.regexp_replace(t, rf"(?i)^{SPACE}*(?:<strong>{SPACE}*)?[QA]{SPACE}*[.．:：]{SPACE}*(?:</strong>{SPACE}*)?", "")
    return F.trim(F.when(whole != "", whole).otherwise(bare))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def concise_issues(lengths: Column, faq: Column) -> list[Column]:
    """Sentences (their lengths) and FAQ entries (array of question, answer) that are too long; null where there is nothing to say."""
    long = F.size(F.filter(lengths, lambda n: n > LONGEST_SENTENCE))
    plain = lambda x: T.visible_text(without_prefix(x))
    questions = F.exists(faq, lambda f: F.size(T.sentence_lengths(plain(f["question"]))) != 1)
    answers = F.exists(faq, lambda f: T.once(plain(f["answer"]), lambda x: (F.length(F.regexp_replace(x, SPACE, "")) > LONGEST_ANSWER) | ~F.size(T.sentence_lengths(x)).between(1, 2)))
    return [
        F.when(long > 0, _say(f"{LONGEST_SENTENCE}자를 넘는 긴 문장이 ", long, "개 있습니다. 한 문장에 한 가지 내용만 남겨 나누세요.")),
        F.when(questions, "FAQ 질문은 하나의 문장으로 작성하세요."),
        F.when(answers, f"FAQ 답변은 결론부터 1~2문장, 최대 {LONGEST_ANSWER}자로 작성하세요."),
    ]


def _marks(html: Column, plain: Column) -> Column:
    """What ``friendly_issues`` counts, each found once in a text."""
    phrases = F.flatten(F.array(*[F.regexp_extract_all(plain, F.lit(p), F.lit(0)) for p in CLICHES]))
    return F.struct(
        _count(html, r"(?i)<p[\s>]").alias("paragraphs"), _count(html, r"(?i)<strong[\s>]").alias("strong"), phrases.alias("phrases"), F.array(*[_count(plain, e) for e in ENDINGS]).alias("endings"),
        _count(plain, "[!！]").alias("shouts"), _count(plain, "[?？]").alias("asks"), _count(html, r"(?i)<(?:ol|ul)[\s>]").alias("lists"), _count(html, NUMBERED).alias("numbered"), T.sentence_lengths(html).alias("lengths"),
    )


def friendly_issues(html: Column, faq: Column, lively: bool) -> Column:
    """Emphasis, worn phrases, marks and lists, then what ``concise_issues`` says, each issue that holds once. ``lively``: the text must address its reader."""
    plain = T.squeeze_all(F.regexp_replace(html, "<[^>]+>", " "))
    return T.once(T.once(plain, lambda x: _marks(html, x)), lambda m: issues(_friendly(m, faq, lively)))


def _friendly(m: Column, faq: Column, lively: bool) -> list[Column]:
    paragraphs, strong, phrases, shouts, asks, lists, numbered = (m[x] for x in ("paragraphs", "strong", "phrases", "shouts", "asks", "lists", "numbered"))
    counts = [m["endings"][k] for k in range(len(ENDINGS))]
    endings = sum(counts, F.lit(0))
    # an ending is named with its count if it stands three times; samples of phrases come first
    named = F.filter(F.array(*[F.when(n > 2, _say(e, "(", n, "회)")) for e, n in zip(ENDINGS, counts)]), lambda x: x.isNotNull())
    samples = F.slice(F.concat(F.slice(F.array_distinct(phrases), 1, SAMPLES), named), 1, SAMPLES)
    worn = "AI 상투 표현이 반복됩니다."
    return [
        F.when(strong < F.least(F.lit(5), F.greatest(F.lit(3), F.floor(paragraphs / 3))), "본문 핵심어 볼드가 부족합니다."),
        F.when((paragraphs > 0) & (strong > paragraphs * 2), "본문 볼드가 너무 많습니다."),
        F.when((F.size(phrases) > 0) | (endings > 2), F.when(F.size(samples) > 0, _say(worn, " (", F.array_join(samples, ", "), ")")).otherwise(worn)),
        F.when(F.lit(lively) & (shouts == 0) & (asks == 0), "독자에게 말을 거는 질문이나 느낌표가 한 번도 없습니다. 규칙대로 자연스럽게 섞어 주세요."),
        F.when(shouts > MOST_EXCLAMATIONS, _say("느낌표가 ", shouts, f"회입니다. {MOST_EXCLAMATIONS}회 이하로 줄여 주세요.")),
        F.when(asks > MOST_QUESTIONS, _say("질문이 ", asks, "회입니다. 3회 안팎으로 줄여 주세요.")),
        F.when(F.lit(lively) & (lists == 0) & (numbered == 0), "숫자를 앞세운 목록 문단이 없습니다. '확인할 세 가지'처럼 소제목에 숫자를 쓰고 항목을 나눠 주세요."),
        *concise_issues(m["lengths"], faq),
    ]


def issues(found: list[Column]) -> Column:
    """The issues that hold, each once."""
    return F.array_distinct(F.array_compact(F.array(*found)))


def source_urls(urls: Column) -> Column:
    """Up to eight different public addresses, without fragments."""
    good = F.filter(F.transform(urls, lambda u: F.trim(u)), lambda u: u.rlike(r"(?i)^https?://[^\s/?#]"))
    return F.slice(F.array_distinct(F.transform(good, lambda u: F.regexp_replace(u, "#.*$", ""))), 1, 8)


def publication_issues(html: Column, faq: Column, urls: Column, portfolio: Column) -> Column:
    """What keeps a generated article from publication; ``urls`` are its sources, which a portfolio may keep to itself."""
    missing = F.trim(F.coalesce(html, F.lit(""))) == ""
    found = F.array_distinct(F.concat(friendly_issues(html, faq, lively=True), issues(_publication(faq, urls, portfolio))))
    return F.when(missing, F.array(F.lit("검수할 본문이 없습니다."))).otherwise(found)


def _publication(faq: Column, urls: Column, portfolio: Column) -> list[Column]:
    return [
        F.when(~F.size(faq).between(3, 4), "FAQ는 3~4개로 구성하세요."),
        F.when(~portfolio & (F.size(source_urls(urls)) < 2), "본문 하단에 표시할 공개 출처가 2개 미만입니다."),
    ]


def draft_issues(title: Column, summary: Column, html: Column, faq: Column) -> Column:
    """What is wrong with a draft of a portfolio; ``html`` is sanitized and has its sentence breaks."""
    plain = T.squeeze(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "(?is)<script.*?</script>", " "), "(?is)<style.*?</style>", " "), "<[^>]+>", " "))
    seen = T.once(plain, lambda x: F.struct(F.length(F.replace(x, F.lit(" "), F.lit(""))).alias("n"), _count(html, r"(?i)<h2[\s>]").alias("headings"), _count(html, r"(?i)<p[\s>]").alias("paragraphs"), _count(x, PAGE_REFERENCE).alias("pages")))
    return T.once(seen, lambda s: _draft(s["n"], s["headings"], s["paragraphs"], s["pages"], title, summary, html, faq))


def _draft(n: Column, headings: Column, paragraphs: Column, pages: Column, title: Column, summary: Column, html: Column, faq: Column) -> Column:
    asked = F.size(faq)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    inner = publication_issues(html, faq, F.array().cast("array<string>"), F.lit(True))
    before = F.array(
        F.when(n < DRAFT_LENGTH[0], _say("본문이 ", n, "자로 짧음")),
        F.when(n > DRAFT_LENGTH[1], _say("본문이 ", n, "자로 김")),
        F.when(headings < DRAFT_HEADINGS, _say("H2가 ", headings, "개뿐임")),
        F.when(paragraphs < DRAFT_PARAGRAPHS, _say("설명 문단이 ", paragraphs, "개뿐임")),
        F.when(asked < DRAFT_FAQ, _say("FAQ가 ", asked, "개뿐임")),
    )
    after = F.array(F.when(pages > 0, _say("내부 슬라이드·페이지 번호가 ", pages, "곳 노출됨")), F.when(blank(title), "제목 누락"), F.when(blank(summary), "요약 누락"))
    return F.array_compact(F.concat(before, inner, after))
