"""Dates, scores, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions import dates as D
from inkwell.functions import hashing, jsons
from inkwell.functions import portfolio as G
from inkwell.functions import scoring as S
from inkwell.functions import web as W
from inkwell.operators import manifests as M
from inkwell.operators import rules, similarity, upsert
from inkwell.queries import query
from inkwell.queries.filters import _EDIT, TS, portfolio_metadata

_K = "ts + INTERVAL 9 HOUR"


@query("FD01_kst_parts", f"SELECT event_id, CAST({_K} AS DATE) AS day, dayofweek({_K})::INTEGER AS weekday, hour({_K})::INTEGER AS hour FROM events")
def fd01(t):
    at = D.kst(F.col("ts"))
    return t.events.select("event_id", F.to_date(at).alias("day"), D.weekday(at).alias("weekday"), F.hour(at).alias("hour"))


@query("FD02_iso_week", "SELECT DISTINCT o_orderdate::DATE AS d, weekofyear(o_orderdate)::INTEGER AS week FROM orders")
def fd02(t):
    return t.orders.select(F.to_date("o_orderdate").alias("d")).distinct().withColumn("week", F.weekofyear("d"))


@query("FD03_due_days", f"SELECT day, d AS due FROM (SELECT day, unnest(range(day - INTERVAL 7 DAY, day, INTERVAL 1 DAY))::DATE AS d FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)) WHERE {_EDIT}")
def fd03(t):
    days = t.orders.select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", F.explode(D.due_days(F.col("day"))).alias("due"))


@query("FD04_next_business_day", "WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) SELECT d, min(n) AS next FROM (SELECT d, unnest(range(d + INTERVAL 1 DAY, d + INTERVAL 15 DAY, INTERVAL 1 DAY))::DATE AS n FROM d) WHERE dayofweek(n) NOT IN (0, 6) AND n NOT IN (DATE '1998-01-01', DATE '1998-03-02') GROUP BY d")
def fd04(t):
    holidays = t.spark.createDataFrame([("1998-01-01",), ("1998-03-02",)], "d string").select(F.col("d").cast("date").alias("d"))
    return D.next_business_day(t.orders.select(F.to_date("o_orderdate").alias("d")).distinct(), holidays, "d")


@query("FD05_budget_window", f"SELECT event_id, date_trunc('day', {_K})::TIMESTAMP - INTERVAL 9 HOUR AS day, date_trunc('month', {_K})::TIMESTAMP - INTERVAL 9 HOUR AS month FROM events")
def fd05(t):
    day, month = D.budget_window(F.col("ts"))
    return t.events.select("event_id", day.alias("day"), month.alias("month"))


@query("FD06_cutoff", "SELECT o_orderkey, o_orderdate - to_hours((24 * (o_orderkey % 400))::INTEGER) AS cutoff FROM orders")
def fd06(t):
    return t.orders.select("o_orderkey", D.cutoff(F.col("o_orderdate"), F.col("o_orderkey") % 400).alias("cutoff"))


@query("FD07_korean_timestamps", "SELECT event_id, CASE WHEN event_id % 10 NOT IN (0, 1) THEN CAST(ts AS DATE)::TIMESTAMP - INTERVAL 9 HOUR END AS \"at\", CASE WHEN event_id % 10 <> 1 THEN CASE WHEN event_id % 10 = 0 THEN '9999-12-31' ELSE strftime(ts, '%Y-%m-%d') END || 'T' || CASE event_id % 3 WHEN 0 THEN strftime(ts, '%H:%M:%S') WHEN 1 THEN strftime(ts, '%H:%M') || ':00' ELSE '23:59:59' END || '+09:00' END AS stamp FROM events")
def fd07(t):
    """Days of eight digits, the one for "open end" and one that is none, alone and with times in several shapes."""
    text = F.when(F.col("event_id") % 10 == 0, "99991231").when(F.col("event_id") % 10 == 1, "soon").otherwise(F.date_format("ts", "yyyyMMdd"))
    time = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "HHmmss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "HH:mm")).otherwise("9")
    local = F.try_to_timestamp(F.nullif(text, F.lit("99991231")), F.lit("yyyyMMdd")).cast("timestamp_ntz")
    return t.events.select("event_id", (local - F.make_dt_interval(hours=F.lit(9))).alias("at"), D.korean_stamp(text, time, "23:59:59").alias("stamp"))


@query("FD08_deadline", "SELECT id, month(lease_expires_at) || '/' || day(lease_expires_at) || CASE WHEN strftime(lease_expires_at, '%H:%M') = '00:00' THEN '' ELSE ' ' || strftime(lease_expires_at, '%H:%M') END AS deadline FROM jobs")
def fd08(t):
    return t.jobs.select("id", D.deadline(F.col("lease_expires_at")).alias("deadline"))


@query("FD09_safe_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2000-01-01' ELSE o_orderdate END AS at FROM orders")
def fd09(t):
    text = F.when(F.col("o_orderkey") % 3 == 0, "no date").otherwise(F.col("o_orderdate").cast("string"))
    return t.orders.select("o_orderkey", D.parsed(text, TS("2000-01-01")).alias("at"))


@query("FD10_lease", "SELECT o_orderkey, o_orderdate + to_seconds(greatest(60, least(86400, o_custkey * 100))) AS lease FROM orders")
def fd10(t):
    return t.orders.select("o_orderkey", D.lease_end(F.col("o_orderdate"), F.col("o_custkey") * 100).alias("lease"))


@query("FD11_slot", "SELECT DISTINCT o_orderdate::DATE AS day, o_orderdate::DATE::TIMESTAMP + INTERVAL 1 HOUR AS slot FROM orders")
def fd11(t):
    return t.orders.select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("slot", D.slot(F.col("day"), 10))


@query("FD12_reusable", "SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-31') - epoch(ts) BETWEEN 0 AND 72 * 3600")
def fd12(t):
    age = F.unix_timestamp(TS("2024-01-31").cast("timestamp")).cast("double") - F.col("ts").cast("timestamp").cast("double")
    return t.events.where(age.between(0, 72 * 3600)).select("event_id")


@query("FD13_range_presets", "SELECT p AS preset, count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - to_days(n)) AS n FROM events CROSS JOIN (VALUES ('day', 1), ('week', 7), ('30d', 30), ('all', 40000)) v(p, n) GROUP BY p")
def fd13(t):
    presets = {"day": 1, "week": 7, "30d": 30, "all": 40_000}
    counted = t.events.agg(*[F.count_if(F.col("ts") >= D.cutoff(TS("2024-01-31"), F.lit(n))).alias(p) for p, n in presets.items()])
    return counted.unpivot([], list(presets), "preset", "n")


@query("FD14_retry_after", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 500) * 1000 WHEN 1 THEN greatest(0, 1000 * (floor(epoch(ts))::BIGINT - epoch(TIMESTAMP '2024-01-15')::BIGINT)) WHEN 2 THEN 1500 END::BIGINT AS ms FROM events")
def fd14(t):
    """Headers of answers that ask to wait: seconds, a date, seconds with a fraction, and one that says nothing."""
    date = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    header = F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 500).cast("string")).when(F.col("event_id") % 4 == 1, date).when(F.col("event_id") % 4 == 2, " 1.5 ").otherwise("later")
    return t.events.select("event_id", W.retry_after_ms(header, TS("2024-01-15")).alias("ms"))


_TF = (
    "WITH a AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS w FROM documents) GROUP BY 1, 2), "
    "s AS (SELECT doc_id, sum(n * n) AS s FROM a GROUP BY 1), d AS (SELECT x.doc_id, sum(x.n * y.n) AS dot FROM a x JOIN a y ON y.doc_id = x.doc_id + 1 AND y.w = x.w GROUP BY 1), p AS (SELECT x.doc_id FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1) "
)


@query("FM01_cosine", _TF + "SELECT p.doc_id, round(coalesce(dot / sqrt(x.s * y.s), 0), 6) AS cosine FROM p LEFT JOIN d USING (doc_id) LEFT JOIN s x ON x.doc_id = p.doc_id LEFT JOIN s y ON y.doc_id = p.doc_id + 1")
def fm01(t):
    """Each text against the next."""
    pairs = t.documents.select("doc_id").join(t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("next")), "doc_id")
    rows = t.documents.select(F.col("doc_id").alias("id"), "text")
    return similarity.cosines(pairs, rows, "doc_id", "next", "id").select("doc_id", F.round("cosine", 6).alias("cosine"))


_PAIR = (
    "WITH a AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS t FROM documents), p AS (SELECT x.doc_id, x.t AS a, y.t AS b, len(list_intersect(x.t, y.t)) AS i FROM a x JOIN a y ON y.doc_id = x.doc_id + 1) "
)


def _pairs(t):
    """Each text and the next: how many different tokens they share, found once, and how many each has."""
    a = t.documents.select("doc_id", similarity.tokens(F.col("text")).alias("a"))
    pairs = a.join(a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    return pairs.select("doc_id", F.size(F.array_intersect("a", "b")).alias("i"), F.size("a").alias("n"), F.size("b").alias("m"))


_SIZES = ("i", "n", "m")


@query("FM02_overlap", _PAIR + "SELECT doc_id, round(coalesce(i / nullif(least(len(a), len(b)), 0), 0), 6) AS overlap FROM p")
def fm02(t):
    return _pairs(t).select("doc_id", F.round(S.overlap_of(*map(F.col, _SIZES)), 6).alias("overlap"))


@query("FM03_jaccard", _PAIR + "SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0::DOUBLE ELSE round(i / (len(a) + len(b) - i), 6) END AS jaccard FROM p")
def fm03(t):
    return _pairs(t).select("doc_id", F.round(S.jaccard_of(*map(F.col, _SIZES)), 6).alias("jaccard"))


@query("FM04_jaccard_hundredths", _PAIR + "SELECT doc_id, floor(100 * CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0::DOUBLE ELSE i / (len(a) + len(b) - i) END + 0.5)::BIGINT AS score FROM p")
def fm04(t):
    return _pairs(t).select("doc_id", S.half_up(100 * S.jaccard_of(*map(F.col, _SIZES))).alias("score"))


@query("FM05_keywords", _PAIR + "SELECT doc_id, floor(70 * coalesce(i / nullif(least(len(a), len(b)), 0), 0) + 0.5)::BIGINT AS score FROM p")
def fm05(t):
    return _pairs(t).select("doc_id", S.half_up(70 * S.overlap_of(*map(F.col, _SIZES))).alias("score"))


@query(
    "FM06_novelty",
    _PAIR + ", f AS (SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0::DOUBLE ELSE i / (len(a) + len(b) - i) END AS j, coalesce(i / nullif(least(len(a), len(b)), 0), 0)::DOUBLE AS o FROM p), "
    "s AS (SELECT *, floor(100 * (j * 0.22::DOUBLE + o * 0.20::DOUBLE + j * 0.25::DOUBLE + o * 0.23::DOUBLE + j * 0.10::DOUBLE) + 0.5)::BIGINT AS score FROM f) SELECT doc_id, score, score >= 58 OR (o >= 0.5 AND j >= 0.34 AND j >= 0.6) OR (j >= 0.78 AND o >= 0.45) AS duplicate FROM s",
)
def fm06(t):
    j, o = S.jaccard_of(*map(F.col, _SIZES)), S.overlap_of(*map(F.col, _SIZES))
    score, duplicate = S.novelty(j, o, j, o, j, F.lit(False), "article")
    return _pairs(t).select("doc_id", score.alias("score"), duplicate.alias("duplicate"))


@query("FM07_history_similarity", _PAIR + "SELECT doc_id, greatest(floor(100 * CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0::DOUBLE ELSE i / (len(a) + len(b) - i) END + 0.5), floor(70 * coalesce(i / nullif(least(len(a), len(b)), 0), 0) + 0.5))::BIGINT AS score FROM p")
def fm07(t):
    return _pairs(t).select("doc_id", F.greatest(S.half_up(100 * S.jaccard_of(*map(F.col, _SIZES))), S.half_up(70 * S.overlap_of(*map(F.col, _SIZES)))).alias("score"))


_BITS = "list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"


@query("FM08_hash_distance", f"SELECT a.vec_id, list_sum(list_transform(list_zip(a.b, c.b), lambda z: abs(z[1] - z[2])))::INTEGER AS distance FROM (SELECT vec_id, {_BITS} AS b FROM embeddings) a JOIN (SELECT vec_id, {_BITS} AS b FROM embeddings) c ON c.vec_id = a.vec_id + 1")
def fm08(t):
    h = t.embeddings.select("vec_id", F.lpad(F.hex(hashing.sign_bits(F.col("embedding"))), 16, "0").alias("a"))
    both = h.join(h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return both.select("vec_id", hashing.distance(hashing.from_hex(F.col("a")), hashing.from_hex(F.col("b"))).alias("distance"))


@query("FM09_difference_hash", "SELECT vec_id, list_sum(list_transform(range(0, 56), lambda i: CASE WHEN embedding[(i // 7 * 8 + i % 7 + 1)::INTEGER] > embedding[(i // 7 * 8 + i % 7 + 2)::INTEGER] THEN 1 ELSE 0 END))::INTEGER AS ones FROM embeddings")
def fm09(t):
    return t.embeddings.select("vec_id", F.bit_count(hashing.difference_hash(F.col("embedding"), 8, 8)).alias("ones"))


@query("FM10_slide_score", "SELECT deck, part, line, quantity, floor(0.4::DOUBLE * richness + 0.3::DOUBLE * visual + 0.2::DOUBLE * rarity - CASE WHEN density > 60 THEN 0.35::DOUBLE * (density - 60) ELSE 0 END + 0.5)::BIGINT AS score FROM slides")
def fm10(t):
    from inkwell.queries.sorting import slide_score

    return t.slides.select("deck", "part", "line", "quantity", slide_score().alias("score"))


_C = "greatest(0::DOUBLE, least(100::DOUBLE, {}))"


@query("FM11_visual_score", "SELECT l_orderkey, l_partkey, l_quantity, round(" + _C.format(f"{_C.format('l_discount / 0.18 * 100')} * 0.55 + {_C.format('l_tax / 0.42 * 100')} * 0.2 + {_C.format('l_quantity / 50 / 0.72 * 100')} * 0.25") + ", 4) AS richness FROM lineitem")
def fm11(t):
    s = S.visual_scores(F.col("l_discount") + 0.0, F.col("l_tax") + 0.0, F.col("l_quantity"), F.col("l_quantity") / 50)
    return t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", F.round(s["richness"], 4).alias("richness"))


@query("FM12_aspect", "SELECT p_partkey, CASE WHEN abs((1 + p_size / 50) / (4 / 3) - 1) <= 0.025 THEN '4:3' WHEN abs((1 + p_size / 50) / sqrt(2) - 1) <= 0.025 THEN 'A4' WHEN abs((1 + p_size / 50) / (16 / 9) - 1) <= 0.025 THEN '16:9' ELSE 'other' END AS aspect FROM part")
def fm12(t):
    return t.part.select("p_partkey", S.aspect(1 + F.col("p_size") / 50).alias("aspect"))


@query("FM13_near_similar", f"SELECT a.vec_id, a.label = c.label AND list_sum(list_transform(list_zip(a.b, c.b), lambda z: abs(z[1] - z[2]))) / 64 <= 0.45 AS near FROM (SELECT vec_id, label, {_BITS} AS b FROM embeddings) a JOIN (SELECT vec_id, label, {_BITS} AS b FROM embeddings) c ON c.vec_id = a.vec_id + 1")
def fm13(t):
    h = t.embeddings.select("vec_id", "label", hashing.sign_bits(F.col("embedding")).alias("a"))
    both = h.join(h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("label2"), F.col("a").alias("b")), "vec_id")
    return both.select("vec_id", ((F.col("label") == F.col("label2")) & (hashing.distance(F.col("a"), F.col("b")) / 64 <= 0.45)).alias("near"))


@query("FM15_token_cost", "SELECT conv_id, sum(octet_length(encode(text)))::BIGINT AS tokens, round(sum(octet_length(encode(text))) * 0.3 / 1000000, 9) AS cost FROM conversations GROUP BY 1")
def fm15(t):
    n = F.sum(F.octet_length("text"))
    return t.conversations.groupBy("conv_id").agg(n.alias("tokens"), F.round(n * 0.3 / 1_000_000, 9).alias("cost"))


@query("FM16_budget", "SELECT id, CASE WHEN id % 50 + 1 > 40 THEN 'daily_calls' WHEN id % 600 + 1 > 500 THEN 'monthly_calls' WHEN estimated + 0.5::DOUBLE > 2 THEN 'daily_cost' WHEN estimated * 10 + 0.5::DOUBLE > 20 THEN 'monthly_cost' END AS broken FROM usage")
def fm16(t):
    i, c = F.col("id"), F.col("estimated")
    return t.usage.select("id", S.budget(i % 50, i % 600, c, c * 10, F.lit(1), F.lit(0.5), (40, 500, 2.0, 20.0)).alias("broken"))


@query("FM17_clamp_modes", "SELECT p_partkey, greatest(0, least(100, p_size * 3 - 20)) AS clamped, CASE WHEN p_size < 5 THEN 'few' WHEN p_size < 20 THEN 'some' ELSE 'many' END AS mode FROM part")
def fm17(t):
    return t.part.select("p_partkey", F.greatest(F.lit(0), F.least(F.lit(100), F.col("p_size") * 3 - 20)).alias("clamped"), F.when(F.col("p_size") < 5, "few").when(F.col("p_size") < 20, "some").otherwise("many").alias("mode"))


@query("FM18_region_safety", "SELECT deck, max(CASE WHEN width >= 0.19 AND height >= 0.28 THEN 1 ELSE 0 END) = 1 AS full, count(*) FILTER (width > 0.15) AS wide FROM rects GROUP BY 1")
def fm18(t):
    return t.rects.groupBy("deck").agg(F.bool_or((F.col("width") >= 0.19) & (F.col("height") >= 0.28)).alias("full"), F.count_if(F.col("width") > 0.15).alias("wide"))


@query("FM19_small_text", "WITH m AS (SELECT *, count(*) OVER (PARTITION BY deck) AS n, median(height) OVER (PARTITION BY deck) AS middle FROM rects) SELECT deck, count(*) AS kept FROM m WHERE NOT (height < 0.07 OR (n >= 3 AND height < 0.85::DOUBLE * middle)) GROUP BY 1")
def fm19(t):
    of = t.rects.groupBy("deck").agg(F.count("*").alias("n"), F.median("height").alias("middle"))
    small = (F.col("height") < 0.07) | ((F.col("n") >= 3) & (F.col("height") < F.lit(0.85) * F.col("middle")))
    return t.rects.join(of, "deck").where(~small).groupBy("deck").agg(F.count("*").alias("kept"))


@query("FM20_image_verdict", "SELECT vec_id, CASE WHEN s >= 40 THEN 'photo' WHEN s >= 20 THEN 'chart' ELSE 'flat' END AS verdict FROM (SELECT vec_id, len(list_distinct(list_transform(embedding, lambda x: floor(x::DOUBLE * 100)))) AS s FROM embeddings)")
def fm20(t):
    s = F.array_size(F.array_distinct(F.transform("embedding", lambda x: F.floor(x.cast("double") * 100))))
    return t.embeddings.select("vec_id", F.when(s >= 40, "photo").when(s >= 20, "chart").otherwise("flat").alias("verdict"))


@query("FM21_heavy", "SELECT deck, count(*) FILTER (width * height >= 0.03) >= 3 OR sum(width * height) >= 0.2 AS heavy FROM rects GROUP BY 1")
def fm21(t):
    """Where an area comes out at the limit itself, the order of the additions would decide: there the rectangles are added up as whole numbers, without rounding."""
    area, unit = F.col("width") * F.col("height"), float(1 << 40)
    decks = t.rects.groupBy("deck").agg((F.count_if(area >= 0.03) >= 3).alias("photos"), F.sum(area).alias("area"))
    close = decks.where(~F.col("photos") & (F.abs(F.col("area") - 0.2) < 1e-9)).select("deck")
    high = F.floor(area * unit)
    parts = t.rects.join(close, "deck").groupBy("deck").agg(F.try_sum(high).alias("high"), F.try_sum(F.floor((area * unit - high) * unit)).alias("low"))
    added = parts.select("deck", ((F.col("high") + F.col("low") / unit) / unit).alias("whole"))
    return decks.join(added, "deck", "left").select("deck", (F.col("photos") | (F.coalesce("whole", "area") >= 0.2)).alias("heavy"))


@query("FM23_length_bounds", "SELECT doc_id, least(n_chars, greatest(1600, floor(0.65::DOUBLE * n_chars + 0.5)))::BIGINT AS least, floor(1.25::DOUBLE * n_chars + 0.5)::BIGINT AS most FROM documents")
def fm23(t):
    n = F.col("n_chars")
    return t.documents.select("doc_id", F.least(n, F.greatest(F.lit(1600), S.half_up(0.65 * n))).alias("least"), S.half_up(1.25 * n).alias("most"))


@query("FM24_priority", "SELECT r_name, CASE r_name WHEN 'ASIA' THEN 1 WHEN 'EUROPE' THEN 2 ELSE 9 END AS priority FROM region")
def fm24(t):
    ranks = F.create_map(F.lit("ASIA"), F.lit(1), F.lit("EUROPE"), F.lit(2))
    return t.region.select("r_name", F.coalesce(F.try_element_at(ranks, F.col("r_name")), F.lit(9)).alias("priority"))


@query("FA01_flatten", "SELECT conv_id, len(list_distinct(flatten(list(regexp_extract_all(text, '[a-z]+tion'))))) AS n FROM conversations GROUP BY 1")
def fa01(t):
    found = F.regexp_extract_all("text", F.lit("[a-z]+tion"), F.lit(0))
    return t.conversations.groupBy("conv_id").agg(F.array_size(F.array_distinct(F.flatten(F.collect_list(found)))).cast("long").alias("n"))


@query("FA02_empty_array", "SELECT count(*) FILTER (len(embedding) = 0) AS empty, count(*) AS n FROM embeddings")
def fa02(t):
    return t.embeddings.agg(F.count_if(F.size("embedding") == 0).alias("empty"), F.count("*").alias("n"))


@query("FA03_remove_by_regex", "SELECT conv_id, array_to_string(list_sort(list_filter(list(DISTINCT role), lambda r: NOT regexp_matches(r, '^sys'))), ',') AS roles FROM conversations GROUP BY 1")
def fa03(t):
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.array_sort(F.filter(F.collect_set("role"), lambda r: ~r.rlike("^sys"))), ",").alias("roles"))


@query("FA04_json_cascade", "SELECT event_id, CASE event_id % 7 WHEN 3 THEN 'line' || chr(10) || 'break' WHEN 4 THEN NULL WHEN 6 THEN NULL ELSE props->>'$.k' END AS k FROM events")
def fa04(t):
    """Answers of a model: plain, fenced, among prose, with a raw line break, cut off, followed by a second value, and without any."""
    p, n = F.col("props"), F.col("event_id") % 7
    raw = F.when(n == 0, p).when(n == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(n == 2, F.concat(F.lit("note "), p, F.lit(" end }")))
    raw = raw.when(n == 3, '{"k": "line\nbreak"} ok').when(n == 4, F.substr(p, F.lit(1), F.length(p) - 1)).when(n == 5, F.concat(p, F.lit(' {"k": -1}'))).otherwise("none")
    return t.events.select("event_id", F.get_json_object(jsons.first_value(raw), "$.k").alias("k"))


@query("FA05_guarded_parse", "SELECT event_id, (props->>'$.k')::INTEGER AS k, (props->>'$.k')::INTEGER < 50 AS ok FROM events")
def fa05(t):
    return t.events.select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k", (F.col("p.k") < 50).alias("ok"))


@query("FA06_unwrap", "SELECT event_id, coalesce(props->>'$.result.k', props->>'$.k') AS k FROM events")
def fa06(t):
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.result.k"), F.get_json_object("props", "$.k")).alias("k"))


@query("FA07_shallow_merge", "SELECT event_id, event_id % 7 AS k, 1 AS extra FROM events")
def fa07(t):
    merged = jsons.merged(F.from_json("props", "map<string,string>"), F.create_map(F.lit("k"), (F.col("event_id") % 7).cast("string"), F.lit("extra"), F.lit("1")))
    return t.events.select("event_id", merged["k"].cast("long").alias("k"), merged["extra"].cast("int").alias("extra"))


@query("FA08_key_subset", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{}' ELSE '{\"channel\":\"' || event_type || '\"}' END AS rest, '{\"k\":' || (props->>'$.k') || '}' AS kept FROM events")
def fa08(t):
    """Metadata without what was generated, and only what must stay for good."""
    whole = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("generated"), F.lit("text")), F.when(F.col("event_id") % 3 != 0, F.create_map(F.lit("channel"), F.col("event_type"))).otherwise(F.create_map().cast("map<string,string>")))
    kept = F.map_filter(whole, lambda k, v: k.isin("k", "novelty"))
    return t.events.select("event_id", F.to_json(jsons.without(whole, ("generated", "k"))).alias("rest"), F.concat(F.lit('{"k":'), kept["k"], F.lit("}")).alias("kept"))


@query("FA09_json_type", "SELECT event_id, CASE WHEN regexp_matches(props->>'$.k', '^[0-9]+$') THEN 'number' ELSE 'other' END AS kind FROM events")
def fa09(t):
    kind = F.schema_of_variant(F.try_variant_get(F.parse_json("props"), "$.k", "variant"))
    return t.events.select("event_id", F.when(kind == "BIGINT", "number").otherwise("other").alias("kind"))


@query("FA10_path_text", "SELECT event_id, props->>'$.k' AS k FROM events")
def fa10(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


_MANIFEST = (
    "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), "
    "s AS (SELECT *, l_linenumber > coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY i), 0) AND l_linenumber <= n + l_orderkey % 9 AS good, "
    "l_partkey % 100 / 95.0::DOUBLE + 0.05::DOUBLE + l_discount <= 1.000001::DOUBLE AND l_partkey % 100 / 95.0::DOUBLE <= 1 AND l_quantity / 60.0::DOUBLE + 0.1::DOUBLE + l_tax <= 1.000001::DOUBLE AND l_partkey % 31 <> 0 AND l_partkey % 29 <> 0 AS fits FROM l), "
    "b AS (SELECT l_orderkey, any_value(n) AS n, min(CASE WHEN NOT good THEN 10 + 3 * i WHEN NOT fits THEN 11 + 3 * i END) AS place FROM s GROUP BY 1) "
)


@query(
    "FA11_manifest_rules",
    _MANIFEST + "SELECT l_orderkey, CASE WHEN n NOT BETWEEN 5 AND 100 THEN 'The expected slide count is invalid.' WHEN l_orderkey % 17 = 0 THEN 'A PowerPoint redaction manifest is required.' "
    "WHEN l_orderkey % 13 = 0 THEN 'Unsupported PowerPoint redaction manifest version.' WHEN l_orderkey % 11 = 0 THEN 'PowerPoint redaction manifest must cover every exported slide.' "
    "WHEN place % 3 = 1 THEN 'Invalid redaction data for exported slide ' || (place - 10) // 3 || '.' WHEN place IS NOT NULL THEN 'Invalid redaction region for exported slide ' || (place - 10) // 3 || '.' END AS error FROM b",
)
def fa11(t):
    """The lines of each order as slides with a region each; some manifests are cut off, of an old version, or a slide short."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = t.lineitem.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("l_orderkey"))})
    kind = F.when(F.col("l_partkey") % 31 == 0, "unknown").otherwise("logo")
    region = F.struct(F.col("i").alias("slideIndex"), kind.alias("type"), F.when(F.col("l_partkey") % 29 == 0, "local_table").otherwise("local_logo").alias("label"), (F.col("l_partkey") % 100 / 95).alias("x"), (F.col("l_quantity") / 60).alias("y"), (0.05 + F.col("l_discount")).alias("width"), (0.1 + F.col("l_tax")).alias("height"))
    slide = F.struct("i", F.struct(F.col("i").alias("slideIndex"), F.col("l_linenumber").alias("sourceSlideNumber"), F.lit("verified").alias("inspectionStatus"), F.array(region).alias("regions")).alias("s"))
    decks = rows.groupBy("l_orderkey").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(slide)), lambda x: x["s"]).alias("slides"))
    k = F.col("l_orderkey")
    slides = F.when(k % 11 == 0, F.slice("slides", 1, F.size("slides") - 1)).otherwise(F.col("slides"))
    body = F.to_json(F.struct(F.when(k % 13 == 0, 1).otherwise(2).alias("version"), F.lit(M.METHOD).alias("method"), (F.col("n") + k % 9).alias("sourceSlideCount"), F.col("n").alias("slideCount"), slides.alias("slides")))
    return M.first_manifest_error(decks.select("l_orderkey", "n", F.when(k % 17 == 0, F.substring(body, 1, 40)).otherwise(body).alias("body")), "l_orderkey", "body", "n")


@query("FA12_proof", "SELECT l_orderkey, l_orderkey % 13 <> 0 AND l_orderkey % 29 <> 0 AS verified FROM lineitem GROUP BY 1")
def fa12(t):
    """The proofs of P31's articles: of another source, or with a share of pixels that can't be, they don't hold."""
    rows, m = portfolio_metadata(t).select("l_orderkey", F.from_json("metadata", G.METADATA).alias("m")), F.col("m")  # read once
    rendered = F.array_distinct(F.flatten(F.transform(m["portfolioAssets"], lambda a: a["slideIndexes"])))
    held = G.proof_holds(m["redactionProof"], m["portfolioSourceFingerprint"], rendered)
    return rows.select("l_orderkey", held.alias("verified"))


@query("FA13_entries", "SELECT event_id, 'k' AS field, props->>'$.k' AS value FROM events")
def fa13(t):
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("field", "value"))


@query("FA14_grid_dedupe", "SELECT deck, count(DISTINCT (floor(x * 500 + 0.5), floor(y * 500 + 0.5))) AS regions FROM rects GROUP BY 1")
def fa14(t):
    cell = [S.half_up(F.col(c) * 500).alias(f"g{c}") for c in ("x", "y")]
    return t.rects.select("deck", *cell).distinct().groupBy("deck").agg(F.count("*").alias("regions"))
