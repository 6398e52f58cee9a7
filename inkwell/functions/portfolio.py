"""Rules of portfolio articles: figures of the body, proofs of redaction, and the metadata that binds them to slides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import SPACE
from inkwell.operators.manifests import METHOD

#: The version of the rules, and what a SHA-256 looks like.
RULES, SHA = "2026-08-05-public-visual-overrides-v9", "(?i)^[a-f0-9]{64}$"
#: The metadata of an article, as JSON. Numbers that aren't whole come as null.
METADATA = (
    "generated struct<bodyHtml: string>, portfolioMockup struct<mode: string, bodyBoardCount: int, selectedSlideIndexes: array<int>, redactionStatus: string>, "
    "portfolioAssets array<struct<kind: string, url: string, slideIndexes: array<int>>>, portfolioSourceFingerprint string, portfolioRuleVersion string, portfolioGenerationId string, "
    "redactionProof struct<version: int, method: string, verified: boolean, sourceFingerprint: string, manifestHash: string, "
    "slides: array<struct<slideIndex: int, sourceHash: string, redactedHash: string, regionCount: int, changedPixelRatio: double>>>"
)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is found once, however often ``then`` names it: expressions stand in a plan as often as they are named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _count(html: Column, pattern: str) -> Column:
    return F.regexp_count(html, F.lit(pattern))


def figure_issues(html: Column, least: Column) -> list[Column]:
    """Figures of a body (not null): enough of them, each image in one, none next to another, and each after a paragraph."""
    figures, images = _count(html, r"(?i)<figure[\s>]"), _count(html, r"(?i)<img[\s>]")
    n = F.greatest(F.lit(1), F.least(F.lit(10), least))
    return [
        F.when(figures < n, F.concat(F.lit("본문용 다중 페이지 목업이 "), n.cast("string"), F.lit("개 미만입니다."))),
        F.when(figures != images, "본문 이미지는 모두 figure 안에 배치해야 합니다."),
        F.when(html.rlike(rf"(?i)</figure>{SPACE}*<figure[\s>]"), "본문 이미지가 설명 없이 연속으로 배치되어 있습니다."),
        F.when((figures > 0) & ~html.rlike(rf"(?is)<p[\s>].*?</p>{SPACE}*<figure[\s>]"), "이미지는 관련 설명 문단 다음에 배치해야 합니다."),
    ]


def _different(indexes: Column) -> Column:
    return F.size(F.array_distinct(indexes)) == F.size(indexes)


def _whole(indexes: Column) -> Column:
    return ~F.exists(indexes, lambda x: x.isNull() | (x < 0))


def proof_holds(proof: Column, fingerprint: Column, slides: Column) -> Column:
    """Whether a proof of redaction is of this source and of exactly these slides, and each slide's hashes and changed pixels go with the number of its regions."""
    return _let(F.struct(proof.alias("proof"), fingerprint.alias("fingerprint"), slides.alias("slides")), lambda x: _proof_holds(x["proof"], x["fingerprint"], x["slides"]))


def _proof_holds(proof: Column, fingerprint: Column, slides: Column) -> Column:
    wanted = F.array_sort(slides)

    def sound(s: Column) -> Column:
        hashes = s["sourceHash"].rlike(SHA) & s["redactedHash"].rlike(SHA)
        same = s["sourceHash"] == s["redactedHash"]
        changed = F.when(s["regionCount"] == 0, (s["changedPixelRatio"] == 0) & same).otherwise((s["changedPixelRatio"] > 0) & ~same)
        return F.coalesce((s["regionCount"] >= 0) & s["changedPixelRatio"].between(0, 1) & hashes & changed, F.lit(False))

    found = F.array_sort(F.transform(proof["slides"], lambda s: s["slideIndex"]))
    head = (proof["version"] == 2) & (proof["method"] == METHOD) & proof["verified"] & (proof["sourceFingerprint"] == fingerprint) & proof["manifestHash"].rlike(SHA)
    good = head & (F.size(slides) > 0) & _whole(slides) & _different(slides) & (found == wanted) & F.forall(proof["slides"], sound)
    return F.coalesce(good, F.lit(False))


def metadata_issues(m: Column) -> Column:
    """Everything that keeps a portfolio article from publication, by its metadata (``METADATA``)."""
    return _let(m, _metadata_issues)


def _metadata_issues(m: Column) -> Column:
    kinds = "array<struct<kind:string,url:string,slideIndexes:array<int>>>"
    kept = F.filter(F.coalesce(m["portfolioAssets"], F.array().cast(kinds)), lambda a: a["kind"].isin("thumbnail", "body_image"))
    return _let(kept, lambda assets: _let(F.filter(assets, lambda a: a["kind"] == "body_image"), lambda body: _let(_indexes(m, assets, body), lambda x: _issues_of(m, assets, body, x))))


def _valid(indexes: Column) -> Column:
    return F.filter(F.coalesce(indexes, F.array().cast("array<int>")), lambda x: x >= 0)


def _indexes(m: Column, assets: Column, body: Column) -> Column:
    """Slides that were rendered, that were chosen, and those of the boards."""
    each = lambda xs: F.flatten(F.transform(xs, lambda a: _valid(a["slideIndexes"])))
    return F.struct(F.array_sort(F.array_distinct(each(assets))).alias("rendered"), _valid(m["portfolioMockup"]["selectedSlideIndexes"]).alias("selected"), each(body).alias("flat"))


def _issues_of(m: Column, assets: Column, body: Column, indexes: Column) -> Column:
    none = F.array().cast("array<int>")
    html = F.coalesce(m["generated"]["bodyHtml"], F.lit(""))
    mockup, boards = m["portfolioMockup"], m["portfolioMockup"]["bodyBoardCount"]
    raw = F.coalesce(mockup["selectedSlideIndexes"], none)
    rendered, selected, flat = indexes["rendered"], indexes["selected"], indexes["flat"]
    odd = lambda a: (F.size(F.coalesce(a["slideIndexes"], none)) == 0) | ~_whole(F.coalesce(a["slideIndexes"], none)) | ~_different(F.coalesce(a["slideIndexes"], none))
    short, long = mockup["mode"] == "short_psd", mockup["mode"] == "six_grid"
    is_short, is_long = F.coalesce(short, F.lit(False)), F.coalesce(long, F.lit(False))
    fits = F.coalesce(boards.between(3, 5), F.lit(False))
    least = F.when(is_short, 4).when(is_long, F.when(fits, boards).otherwise(3)).otherwise(5)
    figures = _count(html, r"(?i)<figure[\s>]")
    uneven = F.exists(body, lambda a: odd(a) | (is_long & a["slideIndexes"].isNotNull() & (F.size(_valid(a["slideIndexes"])) != 6))) | ~_different(flat) | F.coalesce(is_long & (F.size(flat) != boards * 6), F.lit(False))
    chosen, used = F.array_sort(F.array_distinct(selected)), F.array_sort(F.array_distinct(flat))
    apart = (F.size(selected) != F.size(chosen)) | (F.size(selected) != F.size(raw)) | (chosen != used)
    plain = lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))
    shown = F.array_sort(F.transform(F.regexp_extract_all(html, F.lit(r"""(?i)<img\b[^>]*\bsrc\s*=\s*["']([^"']+)["'][^>]*>"""), F.lit(1)), plain))
    urls = F.array_sort(F.filter(F.transform(body, lambda a: plain(F.coalesce(a["url"], F.lit("")))), lambda u: u != ""))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    fingerprint = F.coalesce(m["portfolioSourceFingerprint"], F.lit(""))
    found = [
        F.when(F.size(selected) == 0, "선정 장표 기록이 비어 있어 포트폴리오 자산을 검증할 수 없습니다."),
        F.when(F.size(rendered) == 0, "대표 썸네일과 본문 목업에 연결된 렌더링 장표 기록이 비어 있습니다."),
        F.when((F.size(assets) == 0) | F.exists(assets, odd), "대표 썸네일과 모든 본문 목업은 비어 있지 않은 고유 장표 인덱스를 가져야 합니다."),
        F.when(~fingerprint.rlike(SHA), "현재 원본과 일치하는 포트폴리오 목업 생성 기록이 없습니다."),
        F.when(~m["portfolioRuleVersion"].eqNullSafe(RULES), "현재 포트폴리오 템플릿·기밀 규칙으로 다시 만든 기록이 없습니다."),
        F.when(F.coalesce(m["portfolioGenerationId"], F.lit("")) == "", "현재 포트폴리오 디자인 세대 기록이 없습니다."),
        F.when(is_short, F.when(~boards.eqNullSafe(4), "짧은 문서는 본문 목업 4장이 모두 확인되어야 합니다.")).when(is_long, F.when(~fits, "긴 문서는 중복 없는 6장 묶음의 본문 목업 3~5장이 확인되어야 합니다.")).otherwise("포트폴리오 목업 제작 방식을 확인할 수 없습니다."),
        F.when(~mockup["redactionStatus"].eqNullSafe("verified"), "기밀 블러 검수를 통과하지 않았습니다."),
        F.when(~proof_holds(m["redactionProof"], fingerprint, rendered), "현재 원본에 연결된 선택적 가림 proof v2가 완전하지 않습니다."),
        *figure_issues(html, least),
        F.when(figures != boards, say("본문 figure 수가 목업 기록 ", boards, "장과 일치하지 않습니다.")),
        F.when(F.size(body) != boards, say("저장된 본문 목업 자산 수가 기록 ", boards, "장과 일치하지 않습니다.")),
        F.when(uneven, "본문 목업 장표는 자산별 고유 인덱스로 구성되어야 하며 긴 문서는 자산마다 정확히 6장이어야 합니다."),
        F.when(apart, "선정 장표 기록과 실제 본문 목업 자산의 장표 구성이 일치하지 않습니다."),
        F.when(shown != urls, "본문 이미지 URL이 현재 기밀 블러 검수를 통과한 목업 자산과 일치하지 않습니다."),
    ]
    return F.array_compact(F.array(*found))


#: Fixed values, first match wins: kinds of clients, industries and documents by words of a source's name.
CLIENTS = (("public_institution", "공공기관|공기관|정부기관|중앙정부|지방자치단체|지자체|시청|군청|도청|교육청"), ("large_company", "대기업|그룹사"))
INDUSTRIES = (
    ("관광마케팅", "관광|여행"), ("연구개발", "연구|r&d|바이오|기술개발|스마트팜"), ("인사·HR", "인사|hr|노무|일터혁신"), ("뷰티", "뷰티|화장품|미용"), ("반려동물", "반려|펫|동물"),
    ("해외 무역", "무역|수출|해외"), ("교육", "교육|학교"), ("경영컨설팅", "경영|컨설팅"),
)
DOCUMENTS = (
    ("사업계획서", "사업계획"), ("회사소개서", "회사소개|브랜드소개"), ("제품소개서", "제품소개"), ("입찰제안서", "입찰"), ("제안서", "제안"), ("발표자료", "발표|프레젠테이션"), ("IR 자료", "ir"),
)


def context(source: Column) -> Column:
    """(client, industry, document) by the first pattern that a source's name holds; ``source`` is composed and in lower case."""

    def first(rules: tuple[tuple[str, str], ...], otherwise: str) -> Column:
        out = F.lit(otherwise)
        for name, pattern in reversed(rules):
            out = F.when(source.rlike(pattern), name).otherwise(out)
        return out

    return F.struct(first(CLIENTS, "unknown").alias("client"), first(INDUSTRIES, "비즈니스").alias("industry"), first(DOCUMENTS, "비즈니스 문서").alias("document"))


def is_cancelled(note: Column) -> Column:
    """Whether a review note is the mark of a cancelled generation."""
    return F.coalesce(note.startswith("generation-cancelled:"), F.lit(False))
