"""Sharding by extendible hashing.

A row's hash is 60 bits: 32 of its id, then 28 of its id and text, which part rows that repeat an id. A
shard is a hash prefix. The directory starts with the empty prefix; where the rows under a prefix exceed
the byte limit, and only there, it splits on the next bit, until every shard fits. Sizes are summed for
prefixes of ``STEP`` bits (so at most 2 ** STEP rows come out of a round for each prefix still too large)
and rolled up from there; deeper rounds touch the rows of oversized prefixes alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored

STEP, BITS = 15, 60
LIMIT = 64 << 20


def _hash(id_col: str, text_col: str):
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    part = lambda x, hexes: F.conv(F.substring(F.md5(x), 1, hexes), 16, 10).cast("long")
    return F.shiftleft(part(name, 8), 28) + part(F.concat(name, F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))), 7)


def _prefix(code, bits):
    return F.shiftright(code, BITS - bits)


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def _directories(rows: DataFrame, code: str, size: str, limit: int) -> list[tuple[int, DataFrame]]:
    """For ``STEP`` bits, and as many more in each round as are needed: (p, size, d), the depth of the shard of each prefix ``p``, -1
    where it is still too large."""
    sizes = rows.groupBy(_prefix(F.col(code), STEP).alias("p")).agg(F.sum(size).alias("size"))
    base, found = 0, []
    while True:
        bits = base + STEP
        sizes = stored(sizes)
        levels = sizes.select("p", "size", F.explode(F.sequence(F.lit(base), F.lit(bits))).alias("d"))
        levels = levels.withColumn("q", F.expr(f"shiftright(p, {bits} - d)"))
        fit = levels.groupBy("d", "q").agg(F.sum("size").alias("all")).where(F.col("all") <= limit)
        leaf = levels.join(fit, ["d", "q"]).groupBy("p").agg(F.min("d").alias("d"))
        leaf = stored(sizes.join(leaf, "p", "left").withColumn("d", F.coalesce("d", F.lit(BITS if bits == BITS else -1))))
        found.append((bits, leaf))
        large = leaf.where("d = -1").select("p")
        if bits == BITS or large.isEmpty():
            return found
        over = rows.select(size, code, _prefix(F.col(code), bits).alias("p")).join(large, "p", "left_semi")
        sizes = over.groupBy(_prefix(F.col(code), bits + STEP).alias("p")).agg(F.sum(size).alias("size"))
        base = bits


def _placed(rows: DataFrame, code: str, directories: list[tuple[int, DataFrame]], depth: str) -> DataFrame:
    """``rows`` with the depth of their shards."""
    columns, found = rows.columns, F.lit(None).cast("int")
    for bits, leaf in directories:
        # stored, so that the planner knows the size; the first has at most 2 ** STEP rows, deeper ones those under oversized prefixes
        directory = leaf.select(F.col("p").alias(f"{depth}p{bits}"), F.nullif("d", F.lit(-1)).alias(f"{depth}{bits}"))
        rows = rows.withColumn(f"{depth}p{bits}", _prefix(F.col(code), bits)).join(F.broadcast(directory) if bits == STEP else directory, f"{depth}p{bits}", "left")
        found = F.coalesce(found, F.col(f"{depth}{bits}"))
    return rows.select(*columns, found.cast("int").alias(depth))


def _digits(code: str, depth: str):
    return F.substr(F.lpad(F.bin(F.col(code)), BITS, "0"), F.lit(1), F.col(depth))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes, shard and depth: UTF-8 bytes of the text, the prefix of the row's shard in
    binary digits ("" where one shard holds all), and its length.

    Every shard has at most ``limit`` bytes, unless a single row has more. Rows with equal ids and texts have
    equal hashes; where these alone exceed the limit, the hash of a number for each row gives further bits. Null text has no bytes; a null
    id hashes as "null". Columns of ``docs`` with the names of the result are replaced; any others may have any names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = [c for c in docs.columns if c.lower() not in ("n_bytes", "shard", "depth")]
    code, size, depth, again, deeper = (_unused(docs, x) for x in ("code_", "bytes_", "depth_", "again_", "deeper_"))
    rows = docs.withColumns({size: F.octet_length(text).cast("long"), code: _hash(id_col, text_col)}).select(*own, size, code)
    directories = _directories(rows.select(size, code), code, size, limit)
    out = _placed(rows, code, directories, depth)
    bytes_ = F.col(size).alias("n_bytes")
    usual = out.select(*own, bytes_, _digits(code, depth).alias("shard"), F.col(depth).alias("depth"))
    bits, leaf = directories[-1]
    full = leaf.where((F.col("d") == BITS) & (F.col("size") > limit)).select(F.col("p").alias(code))
    if bits < BITS or full.isEmpty():
        return usual
    # the numbers are given once, in a stored table; what has over ``limit`` bytes is few: all bytes by the limit, at most
    full = stored(full)
    whole = stored(out.join(full, code, "left_semi").withColumn(again, F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS)))
    split = _placed(whole, again, _directories(whole.select(size, again), again, size, limit), deeper)
    split = split.select(*own, bytes_, F.concat(_digits(code, depth), _digits(again, deeper)).alias("shard"), (F.col(depth) + F.col(deeper)).alias("depth"))
    return out.join(full, code, "left_anti").select(*own, bytes_, _digits(code, depth).alias("shard"), F.col(depth).alias("depth")).unionByName(split)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Parquet under ``path``, a folder for each shard."""
    shard(docs, **options).repartition("shard").write.partitionBy("shard").parquet(path)


def sql(limit: int) -> str:
    """The same over ``documents``, for rows that don't repeat id and text."""
    return f"""
WITH r AS (
    SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
           (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT << 28)
           + ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 7))::BIGINT AS code
    FROM documents),
s AS (SELECT code, n_bytes, unnest(range(0, {BITS} + 1)) AS d FROM r),
f AS (SELECT d, code >> ({BITS} - d) AS p FROM s GROUP BY 1, 2 HAVING sum(n_bytes) <= {limit}),
leaf AS (SELECT s.code, min(s.d) AS d FROM (SELECT DISTINCT code, d FROM s) s JOIN f ON f.d = s.d AND f.p = s.code >> ({BITS} - s.d) GROUP BY 1)
SELECT r.doc_id, r.n_bytes, substr(lpad(bin(r.code), {BITS}, '0'), 1, coalesce(leaf.d, {BITS})::BIGINT) AS shard, coalesce(leaf.d, {BITS})::INTEGER AS depth
FROM r LEFT JOIN leaf USING (code)
"""
