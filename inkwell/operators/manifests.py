"""Deep validation of nested JSON: a manifest of regions to black out on the slides of a presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Version and method, and the labels that each type of region may have.
VERSION, METHOD = 2, "powerpoint_com_shapes_v2"
LABELS = {
    "body_text": ("local_body_text",),
    "small_text": ("local_small_text",),
    "table_content": ("local_table",),
    "chart_label": ("local_chart",),
    "embedded_photo": ("local_picture", "local_linked_picture", "local_media", "local_web_media", "local_picture_fill"),
    "screenshot": ("local_embedded_object", "local_linked_object", "local_control", "local_canvas", "local_diagram", "local_ink", "local_ink_comment", "local_smartart", "local_slicer", "local_ambiguous"),
    "logo": ("local_logo",),
    "footer": ("local_footer",),
    "client_identifier": ("local_identifier",),
    "project_identifier": ("local_project_identifier",),
}
#: Slides of a presentation, of its source, regions of a slide and of all, and the least side of a region.
SLIDES, SOURCE_SLIDES, SLIDE_REGIONS, REGIONS, LEAST_SIDE = (5, 100), 10_000, 2_000, 20_000, 0.002
#: What is wrong, by code.
ERRORS = {
    "expected": "The expected slide count is invalid.",
    "missing": "A PowerPoint redaction manifest is required.",
    "version": "Unsupported PowerPoint redaction manifest version.",
    "method": "Unsupported PowerPoint redaction manifest method.",
    "source_count": "PowerPoint redaction manifest source slide count is invalid.",
    "count": "PowerPoint redaction manifest slide count mismatch.",
    "cover": "PowerPoint redaction manifest must cover every exported slide.",
    "slide": "Invalid redaction data for exported slide {}.",
    "region": "Invalid redaction region for exported slide {}.",
    "regions": "PowerPoint redaction manifest contains too many regions.",
}


def _whole(value: Column, path: str):
    """A JSON number without a fraction, else null: texts and true aren't numbers."""
    v = F.try_variant_get(value, path, "variant")
    number = F.try_variant_get(value, path, "double")
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (number == F.floor(number)), number.cast("long"))


def _number(value: Column, path: str):
    v = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, path, "double"))


def _text(value: Column, path: str):
    v = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(value, path, "string"))


def _with_issues(manifests: DataFrame, body: str, expected: str) -> DataFrame:
    """``manifests`` with _issues: structs of place, path and code. Each manifest is read once, in its row: nothing is shuffled."""
    rows = manifests.withColumns({"_n": F.col(expected), "_v": F.try_parse_json(body)})
    v = F.col("_v")
    slides = F.try_variant_get(v, "$.slides", "array<variant>")
    rows = rows.withColumns({"_object": F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "_source": _whole(v, "$.sourceSlideCount"), "_slides": slides, "_count": _whole(v, "$.slideCount"), "_version": _whole(v, "$.version"), "_method": _text(v, "$.method")})
    fact = lambda s: F.struct(_whole(s, "$.slideIndex").alias("index"), _whole(s, "$.sourceSlideNumber").alias("from"), _text(s, "$.inspectionStatus").alias("status"), F.try_variant_get(s, "$.regions", "array<variant>").alias("regions"))
    known = F.slice("_slides", F.lit(1), F.greatest(F.lit(0), F.coalesce(F.col("_n").cast("int"), F.lit(0))))
    rows = rows.withColumn("_facts", F.when(F.col("_object"), F.transform(known, fact)))
    ok = lambda c: F.coalesce(c, F.lit(False))
    issue = lambda wrong, place, path, code: F.when(wrong, F.struct(place.cast("long").alias("place"), path.alias("path"), F.lit(code).alias("code")))
    top = lambda wrong, place, path, code: issue(wrong, F.lit(place), F.lit(path), code)
    whole, n, has = F.col("_object"), F.col("_n"), F.col("_slides").isNotNull()
    head = [
        top(~ok(n.between(*SLIDES)), 0, "$", "expected"),
        top(~whole, 1, "$", "missing"),
        top(whole & ~ok(F.col("_version") == VERSION), 2, "$.version", "version"),
        top(whole & ~ok(F.col("_method") == METHOD), 3, "$.method", "method"),
        top(whole & ~ok(F.col("_source").between(n, F.lit(SOURCE_SLIDES))), 4, "$.sourceSlideCount", "source_count"),
        top(whole & ~ok((F.col("_count") == n) & has), 5, "$.slideCount", "count"),
        top(whole & ok(has & (F.size("_slides") != n)), 6, "$.slides", "cover"),
    ]
    at = lambda i, offset: F.lit(10) + i.cast("long") * 3 + offset
    path = lambda i: F.concat(F.lit("$.slides["), i, F.lit("]"))
    count = lambda x: F.coalesce(F.array_size(x["regions"]), F.lit(0))
    held = lambda xs: F.aggregate(xs, F.lit(0), lambda so_far, x: so_far + count(x))

    def of_slide(x: Column, i: Column) -> Column:
        rises = x["from"] > F.coalesce(F.get("_facts", i - 1)["from"], F.lit(0))
        good = (x["index"] == i) & x["from"].between(F.lit(1), F.col("_source")) & rises & (x["status"] == "verified") & (F.array_size(x["regions"]) <= SLIDE_REGIONS)
        many = (F.col("_held") > REGIONS) & (held(F.slice("_facts", F.lit(1), i + 1)) > REGIONS)
        return F.array(issue(~ok(good), at(i, 0), path(i), "slide"), issue(ok(many), at(i, 2), path(i), "regions"))

    labels = F.array(*[F.lit(f"{t}/{x}") for t, xs in LABELS.items() for x in xs])
    part = lambda r: F.struct(_whole(r, "$.slideIndex").alias("index"), _text(r, "$.type").alias("type"), _text(r, "$.label").alias("label"), *[_number(r, f"$.{c}").alias(c) for c in ("x", "y", "width", "height")])

    def of_region(p: Column, i: Column, j: Column) -> Column:
        inside = (p["x"] >= 0) & (p["y"] >= 0) & (p["width"] >= LEAST_SIDE) & (p["height"] >= LEAST_SIDE) & (p["x"] <= 1) & (p["y"] <= 1) & (p["x"] + p["width"] <= 1.000001) & (p["y"] + p["height"] <= 1.000001)
        good = (p["index"] == i) & F.array_contains(labels, F.concat_ws("/", p["type"], p["label"])) & inside
        return issue(~ok(good), at(i, 1), F.concat(path(i), F.lit(".regions["), j, F.lit("]")), "region")

    of_regions = lambda x, i: F.transform(F.transform(F.coalesce(x["regions"], F.array().cast("array<variant>")), part), lambda p, j: of_region(p, i, j))
    found = [F.array(*head), *[F.coalesce(F.flatten(F.transform("_facts", f)), F.array().cast("array<struct<place:bigint,path:string,code:string>>")) for f in (of_slide, of_regions)]]
    return rows.withColumn("_held", held(F.col("_facts"))).withColumn("_issues", F.array_compact(F.concat(*found)))


def manifest_issues(manifests: DataFrame, key: str, body: str, expected: str) -> DataFrame:
    """(key, place, path, code): a row for everything that is wrong with each manifest (``body``: JSON; ``expected``: its number of slides), in the order of
    ``place``; numbers of source slides must rise."""
    return _with_issues(manifests, body, expected).select(key, F.inline("_issues"))


def first_manifest_error(manifests: DataFrame, key: str, body: str, expected: str) -> DataFrame:
    """(key, error): the first thing that is wrong with each manifest, null where nothing is."""
    first = _with_issues(manifests, body, expected).select(key, F.array_min(F.transform("_issues", lambda x: F.struct(x["place"], x["code"]))).alias("f"))
    messages = F.create_map(*[F.lit(x) for pair in ERRORS.items() for x in pair])
    slide = F.floor((F.col("f.place") - 10) / 3).cast("string")
    error = F.replace(F.element_at(messages, F.col("f.code")), F.lit("{}"), slide)
    return first.select(key, error.alias("error"))
