"""URLs, user agents and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, first match wins: (pattern, name, category, operator).
BOTS = (
    ("OAI-SearchBot", "OAI-SearchBot", "ai", "OpenAI"),
    ("ChatGPT-User", "ChatGPT-User", "ai", "OpenAI"),
    ("GPTBot", "GPTBot", "ai", "OpenAI"),
    ("Claude-SearchBot", "Claude-SearchBot", "ai", "Anthropic"),
    ("Claude-User", "Claude-User", "ai", "Anthropic"),
    ("ClaudeBot|Claude-Web|anthropic-ai", "ClaudeBot", "ai", "Anthropic"),
    ("Google-Extended|GoogleOther", "Google-Extended", "ai", "Google"),
    ("Perplexity-User", "Perplexity-User", "ai", "Perplexity"),
    ("PerplexityBot", "PerplexityBot", "ai", "Perplexity"),
    ("Applebot-Extended", "Applebot-Extended", "ai", "Apple"),
    ("CCBot", "CCBot", "ai", "Common Crawl"),
    ("Amazonbot", "Amazonbot", "ai", "Amazon"),
    ("Bytespider", "Bytespider", "ai", "ByteDance"),
    ("meta-externalagent|Meta-ExternalFetcher|FacebookBot", "Meta AI", "ai", "Meta"),
    ("cohere-ai|cohere-training-data-crawler", "cohere-ai", "ai", "Cohere"),
    ("MistralAI-User", "MistralAI-User", "ai", "Mistral"),
    ("DeepSeek", "DeepSeekBot", "ai", "DeepSeek"),
    ("YouBot", "YouBot", "ai", "You.com"),
    ("DuckAssistBot", "DuckAssistBot", "ai", "DuckDuckGo"),
    ("Yeti", "Yeti", "search", "Naver"),
    ("Daumoa", "Daumoa", "search", "Daum/Kakao"),
    ("Googlebot-Image", "Googlebot-Image", "search", "Google"),
    ("Googlebot-News", "Googlebot-News", "search", "Google"),
    ("Googlebot-Video", "Googlebot-Video", "search", "Google"),
    ("Googlebot|Google-InspectionTool|AdsBot-Google", "Googlebot", "search", "Google"),
    ("bingbot|BingPreview|adidxbot", "bingbot", "search", "Microsoft"),
    ("YandexBot|YandexImages", "YandexBot", "search", "Yandex"),
    ("Baiduspider", "Baiduspider", "search", "Baidu"),
    ("DuckDuckBot|DuckDuckGo-Favicons-Bot", "DuckDuckBot", "search", "DuckDuckGo"),
    ("Applebot", "Applebot", "search", "Apple"),
    ("kakaotalk-scrap", "kakaotalk-scrap", "social", "Kakao"),
    ("facebookexternalhit|Facebot", "Facebook preview", "social", "Meta"),
    ("Twitterbot", "Twitterbot", "social", "X"),
    ("LinkedInBot", "LinkedInBot", "social", "LinkedIn"),
    ("Slackbot|Discordbot|TelegramBot|WhatsApp", "Messenger preview", "social", "Messenger"),
    ("AhrefsBot", "AhrefsBot", "seo", "Ahrefs"),
    ("SemrushBot", "SemrushBot", "seo", "Semrush"),
    ("MJ12bot|DotBot|BLEXBot|DataForSeoBot", "SEO crawler", "seo", "SEO tool"),
    ("UptimeRobot|Pingdom|StatusCake|Site24x7", "Uptime monitor", "monitoring", "Monitoring"),
    ("Chrome-Lighthouse|Lighthouse|WebPageTest|GTmetrix", "Performance monitor", "monitoring", "Performance"),
    ("vercel-screenshot|vercel-favicon", "VercelBot", "monitoring", "Vercel"),
    (r"ia_archiver|archive\.org_bot", "Internet Archive", "archive", "Internet Archive"),
    ("python-requests|Python-urllib|aiohttp", "python-http", "tool", "Python"),
    ("Go-http-client", "Go-http-client", "tool", "Go"),
    ("curl/|Wget|Scrapy|HeadlessChrome", "Automated tool", "tool", "Automation"),
)


def bot(agent: Column) -> Column:
    """(name, category, operator) of a crawler's user agent; null for a person's."""
    made = lambda *v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("name", "category", "operator"))])
    out = None
    for pattern, *values in BOTS:
        hit = agent.rlike(f"(?i){pattern}")
        out = F.when(hit, made(*values)) if out is None else out.when(hit, made(*values))
    return out.when(agent.rlike("(?i)bot|crawler|spider|slurp"), made("Other bot", "other", "Unknown"))


def host(url: Column) -> Column:
    """Lower case, without ``www.``; empty where there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def path_kind(path: Column) -> Column:
    """(kind, slug) of a page; the slug is URL-decoded where that works."""
    first, second = F.coalesce(F.get(F.split(path, "/"), 1), F.lit("")), F.coalesce(F.get(F.split(path, "/"), 2), F.lit(""))
    kind = F.when(first == "", "home").when(first == "columns", "column").when(first == "portfolio", "portfolio").otherwise("page")
    return F.struct(kind.alias("kind"), F.coalesce(F.try_url_decode(second), second).alias("slug"))


def loggable(path: Column) -> Column:
    return ~path.rlike("^/(admin|api|auth)")


def trusted(url: Column, domains: tuple[str, ...]) -> Column:
    h = host(url)
    ok = F.lit(False)
    for d in domains:
        ok = ok | (h == d) | h.endswith("." + d)
    return ok


def post(url: Column) -> Column:
    """Account and number of a blog post from either shape of its address, /account/number or a query with blogId and logNo; null where it is neither."""
    u = F.when(F.length(url) <= 500, F.trim(url))
    part = lambda *a: F.try_parse_url(u, *map(F.lit, a))
    path = F.coalesce(part("PATH"), F.lit(""))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.lower(path) == "/postview.naver"
    account = F.lower(F.trim(F.when(query, part("QUERY", "blogId")).otherwise(F.get(segments, 0))))
    number = F.trim(F.when(query, part("QUERY", "logNo")).otherwise(F.get(segments, 1)))
    good = (F.lower(part("PROTOCOL")) == "https") & F.lower(part("HOST")).isin("blog.naver.com", "m.blog.naver.com") & account.rlike("^[a-z0-9_.-]{2,80}$") & number.rlike("^[0-9]{3,30}$")
    return F.when(good, F.struct(account.alias("account"), number.alias("number")))


def post_url(url: Column) -> Column:
    """Both shapes of a blog post's address as one."""
    p = post(url)
    return F.when(p.isNotNull(), F.concat(F.lit("https://blog.naver.com/"), p["account"], F.lit("/"), p["number"]))


def publication_error(url: Column, expected: Column) -> Column:
    """Why an address can't be registered for the account ``expected`` (null: not set up), or null."""
    p = post(url)
    return F.when(p.isNull(), "INVALID_PUBLISHED_URL").when(expected.isNull(), "PUBLICATION_ACCOUNT_CONFIG_INVALID").when(p["account"] != expected, "PUBLISHED_ACCOUNT_MISMATCH")


def requester(cf: Column, real: Column, forwarded: Column) -> Column:
    """The first address that a request's headers name, or "unknown"."""
    named = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(named(cf), named(real), named(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))), F.lit("unknown"))


def retry_after_ms(header: Column, now: Column) -> Column:
    """Milliseconds to wait by a Retry-After header: seconds or an HTTP date; null where it is neither."""
    text = F.trim(header)
    seconds = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    date = F.try_to_timestamp(F.regexp_extract(text, "^[A-Za-z]{3}, ([0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9:]{8}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(seconds * 1000, (F.unix_millis(date) - F.unix_millis(now.cast("timestamp"))).cast("double"))
    return F.when(wait.isNotNull(), F.greatest(F.lit(0.0), wait)).cast("long")


def missing_fonts(message: Column) -> Column:
    """Names in a worker's message about missing fonts, each once, 100 at most."""
    rest = F.regexp_replace(F.regexp_replace(F.substr(message, F.lit(len("MISSING_FONTS:") + 1)), r"^.*?:\s*", ""), "[.]$", "")
    names = F.filter(F.transform(F.split(rest, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(message.startswith("MISSING_FONTS:"), F.slice(F.array_distinct(names), 1, 100)).otherwise(F.array().cast("array<string>"))
