"""DartMinHash near-duplicate detection over word shingles.

Texts are lower-cased; words are runs of letters and digits (ASCII punctuation and white space
separate them). A document is the weighted set of its shingles of five words, weighted by how often
each occurs; a text of one to four words has one shingle, all its words. Similarity is the
weighted Jaccard coefficient, sum of minima over sum of maxima.

For each element the darts are a Poisson process on the region [0, weight] x rank axis, drawn by
hashing the element, so that documents share the darts that fall into both their regions. Each dart
hashes to one of ``coordinates`` and the earliest dart of a coordinate is the signature there; two
signatures agree in a coordinate with probability equal to the similarity. Documents that agree in
all coordinates of a band meet; similarities of those that meet are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import LAST_ID, join_evenly, order_id, pieces, release, stored
from ._words import U, grams, inside, mix, words
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4


def shingles(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all shingles in text order and, for each, the index of its text."""
    w = words(column, marks=True)
    at = inside(w.first, n)
    prints, owner = grams(w.prints, n)[at], np.searchsorted(w.first, at, "right") - 1
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    whole = np.array([grams(w.prints[w.first[i] : w.first[i + 1]], int(count[i]), 7)[0] for i in short], U)
    prints, owner = np.concatenate([prints, whole]), np.concatenate([owner, short])
    order = np.argsort(owner, kind="stable")
    return prints[order], owner[order]


def weighted(prints: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, element) with weights, sorted by text and element."""
    order = np.lexsort((prints, owner))
    prints, owner = prints[order], owner[order]
    new = np.ones(len(prints), bool)
    new[1:] = (prints[1:] != prints[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return prints[at], owner[at], np.diff(np.append(at, len(prints))).astype(float)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(float) + 0.5) * 2.0**-53


def signatures(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, texts: int, k: int) -> np.ndarray:
    """Earliest dart of each of ``k`` coordinates by text: array (texts, k) of dart fingerprints, 0 where none.

    Only texts without an element have none. Weights may be any positive numbers: a dart of the cell
    [j, j + 1) of an element counts if its weight coordinate lies below the weight.
    """
    out = np.zeros((texts, k), U)
    total = np.bincount(owner, weight, texts)
    lacking = total > 0
    darts = k * np.log(k) + 2 * k
    while lacking.any():
        best = np.full((texts, k), np.inf)
        out[lacking] = 0
        use = lacking[owner]
        cells = np.ceil(weight[use]).astype(int)
        own = np.repeat(owner[use], cells)
        level = np.arange(len(own)) - np.repeat(np.cumsum(cells) - cells, cells)
        cell = mix(np.repeat(element[use], cells) + level.astype(U) * U(0xD1342543DE82EF95))
        room = np.repeat(weight[use], cells) - level
        limit = darts / total[own]
        rank = np.zeros(len(own))
        thrown = 0
        while len(own):
            thrown += 1
            dart = mix(cell + U(thrown * 0xA0761D6478BD642F % (1 << 64)))
            rank = rank - np.log(_uniform(dart))
            near = rank <= limit
            own, cell, room, limit, rank, dart = own[near], cell[near], room[near], limit[near], rank[near], dart[near]
            other = mix(dart ^ U(0x5851F42D4C957F2D))
            hit = _uniform(mix(other)) < room
            o, c, r, d = own[hit], (other[hit] % U(k)).astype(int), rank[hit], dart[hit]
            late = np.argsort(-r, kind="stable")
            o, c, r, d = o[late], c[late], r[late], d[late]
            better = r < best[o, c]
            best[o[better], c[better]], out[o[better], c[better]] = r[better], d[better]
        lacking = lacking & ~np.isfinite(best).all(axis=1)
        darts *= 2
    return out


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard coefficient of two sorted multisets of fingerprints."""
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    both = np.concatenate([x, y])
    if not len(both):
        return 0.0
    values, index = np.unique(both, return_inverse=True)
    p, q = np.bincount(index[: len(x)], minlength=len(values)), np.bincount(index[len(x) :], minlength=len(values))
    return float(np.minimum(p, q).sum() / np.maximum(p, q).sum())


#: Members of a bucket that are compared with one another in one task.
BLOCK = 512
#: A pair's signatures must agree in this share of the coordinates before its similarity is computed: at a
#: similarity of 0.8 or more, fewer than 40 of 80 coordinates agree with probability 4e-10 (binomial), so no link is lost to it.
SCREEN = 0.5


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        element, owner, weight = weighted(*shingles(b.column("text")))
        sig = signatures(element, owner, weight, b.num_rows, BANDS * ROWS)
        empty = (sig == 0).any(axis=1)
        keys = mix(grams(sig.reshape(-1), ROWS)[::ROWS].reshape(-1, BANDS) + np.arange(BANDS, dtype=U)) if b.num_rows else sig
        short = (sig & U(0xFFFF)).astype(np.uint16)
        yield pa.record_batch(
            [
                b.column("o"),
                b.column("t1"),
                b.column("t2"),
                pa.array([[] if e else k for e, k in zip(empty, keys.astype(np.int64))], pa.list_(pa.int64())),
                pa.array([s.tobytes() for s in short], pa.binary()),
            ],
            names=["o", "t1", "t2", "bands", "sig"],
        )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's blocks with its sorted elements, the k-th time of a shingle as an element of its own
    (so that common elements add up to the sum of minima), by 32 bits: a similarity shifts by less than 1e-5."""
    for b in pieces(batches, "text"):
        prints, owner = shingles(b.column("text"))
        order = np.lexsort((prints, owner))
        prints, owner = prints[order], owner[order]
        first = np.searchsorted(owner, np.arange(b.num_rows + 1))
        new = np.ones(len(prints), bool)
        new[1:] = (prints[1:] != prints[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(new)
        time = np.arange(len(prints)) - np.repeat(start, np.diff(np.append(start, len(prints))))
        element = (mix(prints + time.astype(U) * U(0xD1342543DE82EF95)) >> U(32)).astype(np.uint32)
        blobs = [np.sort(element[i:j]).tobytes() for i, j in zip(first[:-1], first[1:])]
        yield pa.record_batch([b.column("o"), b.column("sig"), b.column("blocks"), pa.array(blobs, pa.binary())], names=["o", "sig", "blocks", "blob"])


def _similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= THRESHOLD * (len(both) - common)


def _links_of(rows: list[tuple]) -> list[tuple[int, int]]:
    """Links that join what is similar among the rows (o, band, comp, lone, sig, blob) of one block.

    A pair is looked at in the first band in which it meets, and pairs go by falling agreement of their
    signatures; those connected already, by ``comp`` or by links found here, aren't computed. Where some
    rows are ``lone``, only pairs with one of them count. Found links come as stars.
    """
    o, band = [r[0] for r in rows], rows[0][1]
    label = np.unique([r[2] for r in rows], return_inverse=True)[1]
    lone = np.array([r[3] for r in rows], bool)
    sig = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(len(rows), BANDS * ROWS)
    left = np.flatnonzero(lone) if lone.any() else np.arange(len(rows))
    found = []
    for part in np.array_split(left, -(-len(left) * len(rows) // 50_000)):
        same = sig[part][:, None, :] == sig[None, :, :]
        near = same.sum(axis=2, dtype=np.int16) >= SCREEN * BANDS * ROWS
        near &= label[part][:, None] != label[None, :]
        if not lone.any():
            near &= part[:, None] < np.arange(len(rows))[None, :]
        i, j = np.nonzero(near)
        both = same[i, j]
        first = both.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        found.append((part[i[first]], j[first], both[first].sum(axis=1)))
    one, two, agree = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(-agree, kind="stable")
    one, two = one[order], two[order]
    linked = set()
    for start in range(0, len(one), 256):
        i, j = one[start : start + 256], two[start : start + 256]
        apart = label[i] != label[j]
        for x, y in zip(i[apart].tolist(), j[apart].tolist()):
            if label[x] != label[y] and _similar(rows[x][5], rows[y][5]):
                label[label == label[y]] = label[x]
                linked |= {x, y}
    hub: dict[int, int] = {}
    return [(o[hub.setdefault(int(label[x]), x)], o[x]) for x in sorted(linked)]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block ``g``: the links of each block, which may go over batches."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        found = _links_of(rows) if len(rows) > 1 else []
        return pa.record_batch([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    now, rows = None, []
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("g", "o", "band", "comp", "lone", "sig", "blob")]
        for g, *row in zip(*columns):
            if g != now:
                if len(rows) > 1:
                    yield out(rows)
                now, rows = g, []
            rows.append(tuple(row))
    yield out(rows)


def _compare(texts: DataFrame, folded: DataFrame, blocks: DataFrame) -> DataFrame:
    """Links among the members of each block. blocks: (o, band, g, comp, lone); a text is in few of them.

    Blocks meet the fingerprints of the texts first, so that the texts themselves move once, and only those in a block go on.
    """
    own = blocks.groupBy("o").agg(F.collect_list(F.struct("g", "band", "comp", "lone")).alias("blocks"))
    own = stored(folded.select("t1", "t2", "rep", "sig", F.col("t1").alias("o")).join(own, "o"))
    rows = (
        texts.withColumnRenamed("o", "rep")
        .join(own, ["t1", "t2", "rep"])
        .select("o", "sig", "blocks", F.lower("text").alias("text"))
        .mapInArrow(_members, "o long, sig binary, blocks array<struct<g:long,band:int,comp:long,lone:boolean>>, blob binary")
        .select("o", "sig", "blob", F.explode("blocks").alias("x"))
        .select("x.g", "o", "x.band", "x.comp", "x.lone", "sig", "blob")
    )
    links = stored(rows.repartition(F.col("g")).sortWithinPartitions("g").mapInArrow(_links, "a long, b long").distinct())
    release(own)
    return links


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(o, t1, t2) of all rows, and (t1, t2, rep, n, root, least, copies) of all texts: root tells the classes apart."""
    rows = docs.select(order_id(id_col).alias("o"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("o", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"), "text")
    signed = stored(rows.select("o", "t1", "t2", F.lower("text").alias("text")).mapInArrow(_sign, "o long, t1 long, t2 long, bands array<long>, sig binary"))
    # of equal texts one stands for all; their signatures are equal, so any row's will do
    folded = stored(signed.groupBy("t1", "t2").agg(F.min("o").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))

    # two texts may claim one id (repeated ids): the text's own fingerprint stands for it
    slots = folded.select(F.col("t1").alias("o"), F.posexplode("bands").alias("band", "key")).select("o", "band", F.xxhash64("band", "key").alias("bucket"))
    full = slots.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    slots = stored(slots.join(full, "bucket").withColumn("parts", F.ceil(F.col("members") / BLOCK)))
    part = F.pmod(F.xxhash64("o", "bucket"), F.col("parts"))
    links = _compare(rows, folded, slots.select("o", "band", F.xxhash64("bucket", part).alias("g"), F.col("o").alias("comp"), F.lit(False).alias("lone")))
    if not slots.where("parts > 1").isEmpty():
        roots = components(links)
        large = slots.where("parts > 1").join(roots.select(F.col("node").alias("o"), "root"), "o", "left").withColumn("comp", F.coalesce("root", "o"))
        sizes = large.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
        large = stored(large.join(main, "bucket").withColumn("lone", F.col("comp") != F.col("main")).where("all > most"))
        rest = F.ceil((F.col("all") - F.col("most")) / BLOCK)
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        one = large.where("lone").select("o", "band", "comp", "lone", "bucket", F.pmod(F.xxhash64("o"), rest).alias("i"), each(F.col("parts")).alias("j"))
        two = large.select("o", "band", "comp", F.lit(False).alias("lone"), "bucket", each(rest).alias("i"), F.pmod(F.xxhash64("o"), F.col("parts")).alias("j"))
        more = one.unionByName(two).select("o", "band", F.xxhash64("bucket", "i", "j", F.lit(2)).alias("g"), "comp", "lone")
        links = links.unionByName(_compare(rows, folded, more))
    roots = components(links)
    named = stored(folded.select("t1", "t2", "rep", "n").join(roots.select(F.col("node").alias("t1"), "root"), "t1", "left").withColumn("root", F.coalesce("root", "t1")))
    release(slots, folded)
    whole = stored(named.groupBy("root").agg(F.min("rep").alias("least"), F.sum("n").alias("copies"), F.count("*").alias("texts")))
    return signed, stored(join_evenly(named, whole, ["root"], "texts").select("t1", "t2", "rep", "n", "root", "least", "copies"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, copies): a row for each row of ``docs``.

    ``class_id`` is the least id of the class, ``copies`` the number of rows in it. Classes are the
    connected components of similarity 0.8 or more; rows with the same text are always together.
    A text without words (null, empty, marks only) is similar to nothing, but rows with the same
    text still share a class. Rows that repeat an id count as documents of their own: where unrelated classes have the
    same least id, and where no row of a class has an id, the class has a negative number of its own, from the
    fingerprint of a text, as its class id (of classes with one least id, one keeps it). Extra columns are ignored.

    Equal texts are folded first; what follows sees one of each. A band bucket of up to ``BLOCK``
    texts is compared whole, in one task. A larger one is cut into blocks at random, differently in
    each band; what these leave unconnected is then compared with all members of its bucket, again in
    blocks. So a group of any size costs what its unconnected rest costs, and no link is passed over
    that the bands show (at 0.8, more than 99.99 in 100; nearly all above).
    """
    signed, classes = _classes(docs, id_col, text_col)
    # unrelated classes may have one least id, and those without an id all do
    keeps = stored(classes.groupBy("least").agg(F.min("root").alias("keeps"), F.count("*").alias("texts")))
    own = F.bitwise_not(F.shiftrightunsigned(F.xxhash64("root"), 1))
    class_id = F.when((F.col("least") == LAST_ID) | (F.col("root") != F.col("keeps")), own).otherwise(F.col("least"))
    named = stored(join_evenly(classes, keeps, ["least"], "texts").withColumn("class_id", class_id))
    found = join_evenly(signed.select("o", "t1", "t2"), named.select("t1", "t2", "n", "class_id", "copies"), ["t1", "t2"], "n")
    return found.select(F.when(F.col("o") != LAST_ID, F.col("o")).alias(id_col), "class_id", "copies")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that stand for their class: the one of least id, one of equal rows.

    Rows of one id and one text count as equal, whatever else they hold: one of them stays.
    """
    signed, classes = _classes(docs, id_col, text_col)
    heads = stored(classes.groupBy("root").agg(F.min(F.struct("rep", "t1", "t2")).alias("head")).select("head.*"))
    release(signed, classes)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), order_id(id_col).alias("rep"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"))
    # partial aggregation in each task before rows move: one row a task comes out of any number of equal ones
    return rows.join(heads, ["rep", "t1", "t2"], "left_semi").groupBy("rep", "t1", "t2").agg(F.first("row").alias("row")).select("row.*")
