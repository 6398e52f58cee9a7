"""Redaction of personal data, and marks of documents that must not leave the house."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import SPACE

#: An edge of an ASCII word, on whichever side.
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: What stands before an address without a label, its end, and its street or lot.
_PREFIX = rf"(?:[가-힣]{{2,}}(?:특별시|광역시|특별자치시|특별자치도|도){SPACE}+)?(?:[가-힣]{{1,}}(?:시|군|구){SPACE}+){{1,2}}"
_CUE = rf"(?:주소|배송지|거주지|사업장){SPACE}*(?:은|는|이|가|:|：)?{SPACE}*"
_UNIT = rf"[0-9]{{1,5}}(?:-[0-9]{{1,5}})?(?:{SPACE}+[0-9]{{1,4}}(?:동|호))?"
#: Kinds in the order of the report.
KINDS = ("email", "phone", "registration", "account", "card", "address", "name", "custom")
#: Fixed values, in order: (kind, pattern, replacement, further check). Cards come before accounts, which are wider.
PASSES = (
    ("email", rf"(?i){_EDGE}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{_EDGE}", "[EMAIL]", None),
    ("phone", r"(?<![0-9])(?:\+?82[- .]?)?(?:0?1[016789]|0?2|0?[3-6][1-5])[- .]?[0-9]{3,4}[- .]?[0-9]{4}(?![0-9])", "[PHONE]", None),
    ("registration", r"(?<![0-9])[0-9]{6}[- ]?[1-4][0-9]{6}(?![0-9])", "[RESIDENT_ID]", None),
    ("registration", r"(?<![0-9])[0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{5}(?![0-9])", "[BUSINESS_ID]", None),
    ("registration", r"(?<![0-9])[0-9]{6}[- ]?[0-9]{7}(?![0-9])", "[CORPORATE_ID]", None),
    ("card", r"(?<![0-9])[0-9](?:[- ]?[0-9]){12,18}(?![0-9])", "[CARD]", "luhn"),
    ("account", rf"(계좌번호|입금계좌|은행계좌|환불계좌|계좌){SPACE}*[:：]?{SPACE}*[0-9](?:[- ]?[0-9]){{7,19}}", "$1: [ACCOUNT]", None),
    ("account", r"(?<![0-9])[0-9]{2,6}(?:-[0-9]{2,6}){2,4}(?![0-9])", "[ACCOUNT]", "10 to 16 digits"),
    ("name", rf"(이름|성명|고객명|담당자|대표자){SPACE}*[:：]{SPACE}*([가-힣]{{2,5}}|[A-Za-z][A-Za-z .'-]{{1,60}})", "$1: [NAME]", None),
    ("address", rf"(주소|거주지|사업장){SPACE}*[:：]{SPACE}*([^\n]{{5,120}})", "$1: [ADDRESS]", None),
    ("address", rf"(?<![가-힣])(?:{_PREFIX}|{_CUE})[가-힣A-Za-z0-9·.-]{{2,}}(?:대로|로|길){SPACE}+{_UNIT}", "[ADDRESS]", None),
    ("address", rf"(?<![가-힣])(?:{_PREFIX}|{_CUE})[가-힣A-Za-z0-9·.-]{{1,}}(?:읍|면|동|리){SPACE}+(?:산{SPACE}*)?{_UNIT}", "[ADDRESS]", None),
)
#: Fixed values: (issue, pattern), the first that holds; names only count where the text is to be published.
HIGH_RISK = ("대외비·외부공유금지 등 민감자료 표시", rf"(?i)(?:대외비|사외비|외부{SPACE}*공유{SPACE}*금지|외부{SPACE}*반출{SPACE}*금지|confidential|internal{SPACE}+(?:use{SPACE}+)?only|non[- ]?disclosure|{_EDGE}NDA{_EDGE})")
SECRET = ("비밀번호·API 키·접근 토큰 등 비밀값", rf"(?i)(?:비밀번호|패스워드|password|api[ _-]?key|access[ _-]?token|secret(?:[ _-]?key)?){SPACE}*[:=：]{SPACE}*(?!\[(?:SENSITIVE|REDACTED)\])[^{SPACE[1:]}")
NAMED = ("비식별화되지 않은 이름 표기", rf"(?i)(?:고객명|담당자명|대표자명|신청인명|수신인명){SPACE}*[:：]?{SPACE}*(?!\[NAME\])([가-힣]{{2,5}}|[A-Za-z][A-Za-z .'-]{{1,60}})")


def luhn(digits: Column) -> Column:
    """13 to 19 digits, not all the same, with a right check digit."""
    d = F.regexp_replace(digits, "[^0-9]", "")
    return F.call_function("luhn_check", d) & F.length(d).between(13, 19) & ~d.rlike(r"^(\d)\1*$")


_CHECKS = {"luhn": luhn, "10 to 16 digits": lambda t: F.length(F.regexp_replace(t, "[^0-9]", "")).between(10, 16)}


def _checked(df: DataFrame, seen: Column, pattern: str, value: str, holds: Callable[[Column], Column], count: str) -> DataFrame:
    """A pass over ``_text`` whose matches must hold a check of their digits; adds how many do."""
    found = F.when(seen, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    out = df.withColumn("_found", found)
    out = out.withColumn("_found", F.when(F.array_size("_found") > 0, F.transform("_found", lambda m: F.struct(m.alias("m"), holds(m).alias("good")))))
    # the matches stand between the parts of the text, which are one more
    put = lambda part, m: F.concat(part, F.coalesce(F.when(m["good"], value).otherwise(m["m"]), F.lit("")))
    whole = F.array_join(F.zip_with(F.split("_text", pattern, -1), F.col("_found"), put), "")
    n = F.coalesce(F.array_size(F.filter("_found", lambda m: m["good"])), F.lit(0))
    return out.withColumns({count: n, "_text": F.when(F.col("_found").isNotNull(), whole).otherwise(F.col("_text"))}).drop("_found")


def with_redaction(df: DataFrame, text: str, into: str = "redaction", terms: Sequence[str] = ()) -> DataFrame:
    """Adds ``into``: the text after all passes, in order, then ``terms``, the longest first; ``counts`` by kind, from the passes themselves;
    and their ``total``. Null text is empty. Terms are trimmed; shorter than two characters they don't count."""
    words = sorted(dict.fromkeys(t.strip() for t in terms if len(t.strip()) > 1), key=len, reverse=True)
    passes = [*PASSES, *(("custom", "(?iu)" + re.escape(w), "[SENSITIVE]", None) for w in words)]
    out = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    # what no replacement brings into a text: a pass that needs it is left out where it is missing
    out = out.withColumns({"_digit": F.col("_text").rlike("[0-9]"), "_mark": F.col("_text").contains("@"), "_hangul": F.col("_text").rlike("[가-힣]")})
    for k, (kind, pattern, value, check) in enumerate(passes):
        seen = {"email": F.col("_mark"), "name": F.col("_hangul"), "address": F.col("_hangul"), "custom": F.lit(True)}.get(kind, F.col("_digit"))
        if check:
            out = _checked(out, seen, pattern, value, _CHECKS[check], f"_n{k}")
        elif "$" in value:
            out = out.withColumns({f"_n{k}": F.when(seen, F.regexp_count("_text", F.lit(pattern))).otherwise(0), "_text": F.when(seen, F.regexp_replace("_text", pattern, value)).otherwise(F.col("_text"))})
        else:
            out = out.withColumn("_parts", F.when(seen, F.split("_text", pattern, -1)).otherwise(F.array("_text")))
            out = out.withColumns({f"_n{k}": F.size("_parts") - 1, "_text": F.array_join("_parts", value)}).drop("_parts")
    number = {kind: sum((F.col(f"_n{k}") for k, p in enumerate(passes) if p[0] == kind), F.lit(0)) for kind in KINDS}
    total = sum((F.col(f"_n{k}") for k in range(len(passes))), F.lit(0))
    found = F.struct(F.col("_text").alias("text"), F.struct(*[v.alias(k) for k, v in number.items()]).alias("counts"), total.alias("total"))
    return out.withColumn(into, found).drop("_text", "_digit", "_mark", "_hangul", *[f"_n{k}" for k in range(len(passes))])


def high_risk_issue(text: Column) -> Column:
    """Why a text must not be sent anywhere, or null: it is marked as confidential, or holds a secret."""
    return F.when(text.rlike(HIGH_RISK[1]), HIGH_RISK[0]).when(text.rlike(SECRET[1]), SECRET[0])


def sensitive_issue(text: Column) -> Column:
    """As ``high_risk_issue``, and names that were not redacted."""
    return F.coalesce(high_risk_issue(text), F.when(text.rlike(NAMED[1]), NAMED[0]))
