"""Substring deduplication with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words. Each window is indexed by its anchor, the least of the
fingerprints of the ``GRAM``-word sequences in it, so equal windows have equal anchors, and the index holds a
seventh of what all windows would take. The index is a log of immutable runs, each bucketed and sorted by anchor; a
new batch of documents becomes a new run, which is merge-joined with the runs of history to find the anchors
that occur in more than one text or twice in one. Only windows of such anchors are then verified, by two 64-bit
fingerprints of the sequence of their 20 words (each word by 64 bits; a false match has a chance of some 1e-19 a pair). When
the log has ``FANOUT`` runs they are compacted into one. A log in a folder of its own outlives the call: a later call opens
it again and dedups new documents against those of old.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import TABLE, join_evenly, order_id, pieces, release, remove, remove_at_exit, shared_folder, stored, with_fields
from ._words import U, Words, grams, inside, mix, sliding_min, words

WINDOW, GRAM, FANOUT = 20, 8, 4
#: Documents in a batch, about; there are ``FANOUT`` batches at least.
BATCH = 50_000_000
#: Anchors, or windows, that a task holds before it passes them on.
HELD = 1 << 20


def _windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: its first word, its text and its anchor."""
    at = inside(w.first, WINDOW)
    if not len(at):
        return at, at, np.zeros(0, U)
    least = sliding_min(grams(w.prints, GRAM), WINDOW - GRAM + 1)
    return at, np.searchsorted(w.first, at, "right") - 1, least[at]


def _places(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of every place that is the anchor of some window: its text and the anchor."""
    at, _, anchor = _windows(w)
    reach = WINDOW - GRAM
    gram = grams(w.prints, GRAM)
    if not len(at):
        return at, anchor
    # a place is an anchor if no window over it has only greater ones: the greatest least is its own
    least = np.zeros(len(gram) + reach, U)
    least[at + reach] = anchor
    place = np.flatnonzero(gram == ~sliding_min(~least, reach + 1))
    return np.searchsorted(w.first, place, "right") - 1, gram[place]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each anchor of each text. ``again``: it stands at more than one place.

    Of the texts held together under one anchor the first row goes into the run and says ``again``;
    the others come out as ``known``: repeated, whatever the rest of the corpus holds. So an anchor
    that very many texts share brings a row for each ``HELD`` anchors.
    """
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def passed() -> Iterator[pa.RecordBatch]:
        anchor, t1, again = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((t1, anchor))
        order = order[_changes(anchor[order], t1[order])]
        anchor, t1, again = anchor[order], t1[order], again[order]
        new = _changes(anchor)
        group = np.cumsum(new) - 1
        several = (np.bincount(group) > 1)[group] if len(group) else again
        again = again | several
        order = np.argsort(t1, kind="stable")
        for i in range(0, len(order), 200_000):
            s = order[i : i + 200_000]
            yield pa.record_batch([pa.array(anchor[s].astype(np.int64)), pa.array(t1[s]), pa.array(again[s]), pa.array(~new[s])], names=["h", "t1", "again", "known"])

    for b in pieces(batches, "text"):
        own, anchor = _places(words(b.column("text")))
        order = np.lexsort((anchor, own))
        own, anchor = own[order], anchor[order]
        first = np.flatnonzero(_changes(own, anchor))
        again = np.diff(np.append(first, len(own))) > 1
        held.append((anchor[first], b.column("t1").to_numpy(zero_copy_only=False)[own[first]], again))
        n += len(first)
        if n > HELD:
            yield from passed()
            n = 0
    if held:
        yield from passed()


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


@contextmanager
def _in_order(spark: SparkSession) -> Iterator[None]:
    """Scans of bucketed tables say in which order their rows are, so that merges sort nothing."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


class FingerprintLog:
    """The log: Parquet tables of (h, t1, again), bucketed and sorted by h.

    Without a ``folder`` it stands in the shared folder and goes with the process. In a folder it stays, with a manifest of the
    runs that hold: the last complete one counts, so a call that fails half way leaves the log as it was.
    Runs share their bucketing, so merging them, or a new run with them, moves no rows.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder.rstrip("/") if folder else None
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[DataFrame] = []
        self.gone: list[DataFrame] = []
        self.turn = 0
        if self.folder:
            self._open()

    def _open(self) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return
        lines = [r[0].split() for r in self.spark.read.text(f"{self.folder}/manifest").collect()]  # a few runs a turn
        self.turn = max((int(x[0]) for x in lines), default=0)
        for turn, buckets, name in lines:
            if int(turn) == self.turn:
                self.buckets = int(buckets)
                if not self.spark.catalog.tableExists(name):
                    self.spark.sql(f"CREATE TABLE {name} (h BIGINT, t1 BIGINT, again BOOLEAN) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {buckets} BUCKETS LOCATION '{self.folder}/{name}'")
                self.runs.append(self.spark.table(name))
                self.runs[-1].name, self.runs[-1].stored_at = name, f"{self.folder}/{name}"

    def commit(self) -> None:
        """Make the runs of now those that a later ``FingerprintLog`` of the same folder opens."""
        if self.folder and self.runs:
            self.turn += 1
            lines = [(f"{self.turn} {self.buckets} {r.name}",) for r in self.runs]
            self.spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(f"{self.folder}/manifest")
        self._clear()

    def _clear(self) -> None:
        """Runs that compaction replaced go, from a lasting log when the manifest no longer has them."""
        for r in self.gone:
            remove(self.spark, r.stored_at)
        self.gone.clear()

    def run(self, rows: DataFrame, lasting: bool = True) -> DataFrame:
        name = f"{TABLE}{uuid.uuid4().hex}"
        home = self.folder if self.folder and lasting else f"{shared_folder(self.spark)}/inkwell"
        path = f"{home}/{name}"
        out = rows.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h")
        out.format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
        if home != self.folder:
            remove_at_exit(self.spark, path)
        table = self.spark.table(name)
        table.name, table.stored_at = name, path
        return table

    def add(self, rows: DataFrame) -> DataFrame:
        """Append a run; (h, t1): the anchors at more than one place, with the texts of all runs they are in."""
        with _in_order(self.spark):
            new, old = self.run(rows), list(self.runs)
            fold = lambda run, k: run.groupBy("h").agg(F.min("t1").alias(f"low{k}"), F.max("t1").alias(f"high{k}"), F.max("again").alias(f"again{k}"))
            met = fold(new, "")
            for k, run in enumerate(old):
                met = met.join(fold(run, k), "h", "left")
            several = F.col("again") | (F.col("low") != F.col("high"))
            for k in range(len(old)):
                several = several | F.coalesce(F.col(f"low{k}") != F.col("low"), F.lit(False)) | F.coalesce(F.col(f"high{k}") != F.col("low"), F.lit(False)) | F.coalesce(F.col(f"again{k}"), F.lit(False))
            hits = self.run(met.where(several).select("h"), lasting=False)
            self.runs.append(new)
            marks = stored(reduce(DataFrame.unionByName, [run.join(hits, "h").select("h", "t1") for run in self.runs]))
            if len(self.runs) >= FANOUT:
                self.compact()
        return marks

    def compact(self) -> None:
        """One run in place of all."""
        old, self.runs = self.runs, [self.run(reduce(DataFrame.unionByName, self.runs).groupBy("h", "t1").agg(F.max("again").alias("again")))]
        self.gone += old
        if not self.folder:
            self._clear()


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows under marked anchors. Of equal windows that a task holds the earliest goes on; the others are
    repeats already, and their places go out as such, a row for each run of them (under a key of their text, which spreads them)."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def passed() -> Iterator[pa.RecordBatch]:
        one, two, age, o, t1, at = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((at, t1, o, age, two, one))
        one, two, age, o, t1, at = one[order], two[order], age[order], o[order], t1[order], at[order]
        first = _changes(one, two)
        rest = [x[~first] for x in (age, o, t1, at)]
        yield from rows(one[first], two[first], *(x[first] for x in (age, o, t1, at)), np.ones(np.count_nonzero(first), np.int32), False)
        order = np.lexsort(rest[::-1])
        age, o, t1, at = (x[order] for x in rest)
        new = _changes(age, o, t1)
        new[1:] |= at[1:] != at[:-1] + 1
        begin = np.flatnonzero(new)
        run = np.diff(np.append(begin, len(at))).astype(np.int32)
        age, o, t1, at = age[begin], o[begin], t1[begin], at[begin]
        yield from rows(mix(mix(o.astype(U)) + t1.astype(U)), np.zeros(len(o), U), age, o, t1, at, run, True)

    def rows(one, two, age, o, t1, at, run, again: bool) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(one), 200_000):
            s = slice(i, i + 200_000)
            columns = [one[s].astype(np.int64), two[s].astype(np.int64), age[s], o[s], t1[s], at[s], run[s], np.full(len(one[s]), again)]
            yield pa.record_batch([pa.array(x) for x in columns], names=["one", "two", "age", "o", "t1", "at", "run", "again"])

    for b in pieces(batches, "text"):
        w = words(b.column("text"))
        at, own, anchor = _windows(w)
        keep = np.zeros(len(at), bool)
        marks = b.column("marks")
        first = np.searchsorted(own, np.arange(b.num_rows + 1))
        for i in range(b.num_rows):
            if (m := marks[i]).is_valid and first[i] < first[i + 1]:
                s = slice(first[i], first[i + 1])
                keep[s] = np.isin(anchor[s], m.values.to_numpy(zero_copy_only=False).astype(U))
        at, own = at[keep], own[keep]
        if len(at):
            one, two = grams(w.prints, WINDOW, 1)[at], grams(w.prints, WINDOW, 2)[at]
            age, o, t1 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("age", "o", "t1"))
            held.append((one, two, age[own], o[own], t1[own], (at - w.first[own]).astype(np.int32)))
            n += len(at)
            if n > HELD:
                yield from passed()
                n = 0
    if held:
        yield from passed()


def covered(starts: np.ndarray, runs: np.ndarray, n_words: int) -> np.ndarray:
    """Words of a text that windows cover: so many of them, one after the other, from each of ``starts``."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + runs - 1 + WINDOW, n_words), -1)
    return np.cumsum(step[:-1]) > 0


def _kept(text_too: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        n, gone, text = [], [], []
        for value, starts, copy in zip(b.column("text"), b.column("starts"), b.column("copy").to_pylist()):
            all_words = (value.as_py() or "").encode().split()
            kept = all_words
            if copy and len(all_words) >= WINDOW:
                kept = []
            elif starts.is_valid and len(starts):
                out = covered(*(starts.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)), len(all_words))
                kept = [w for w, x in zip(all_words, out.tolist()) if not x]
            n.append(len(all_words))
            gone.append(len(all_words) - len(kept))
            text.append(b" ".join(kept))
        columns = {"row": b.column("row"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array([t.decode() for t in text], pa.string())}
        if text_too:
            columns |= {"none": b.column("none"), "text": b.column("text")}
        yield pa.record_batch(list(columns.values()), names=list(columns))


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int | None = None, keep: list[str] | None = None, log: str | None = None, history: DataFrame | None = None
) -> DataFrame:
    """(id, n_words, n_removed, kept and the columns ``keep``): a row for each row of ``docs``.

    Words are runs of characters other than space and ``\\x09-\\x0D``, unchanged. A word goes if a
    window that covers it also starts earlier, in a document of smaller id or earlier in its own;
    windows are judged on the input. ``kept`` joins the rest by one space. Null text is none, and a
    null id sorts last. Rows that repeat an id are ordered by a fingerprint of their texts; rows that
    repeat both are one document, given once for each row. Documents enter the index in
    ``batches`` ranges of ids (without the argument, of ``BATCH`` documents or less): the result is the same for any number.

    ``log``: a folder, such as one in an object store, that keeps the log for later calls. ``history``: the documents (id, text) of the
    earlier calls with this log; all are earlier than ``docs``. Of these only texts that share an anchor with another are looked at again.
    """
    text_too = text_col in (keep or [])  # the text moves once, and comes back beside the result
    keep = [c for c in keep or [] if c != text_col]
    rows = _told_apart(docs, id_col, text_col, 1, keep)
    ids = stored(rows.select("age", "o", "t1", "t2"))
    past = None
    if history is not None:
        past = _told_apart(history, id_col, text_col, 0, [])
        ids = stored(ids.unionByName(past.select("age", "o", "t1", "t2")))
    reps = stored(ids.groupBy("t1", "t2").agg(F.min(F.struct("age", "o")).alias("first"), F.count("*").alias("n")).select("t1", "t2", "first.age", "first.o", "n"))

    index, found, met = FingerprintLog(docs.sparkSession, log), [], []
    for batch in _ranges(docs, id_col, ids.where("age = 1"), batches):
        found.append(stored(_told_apart(batch, id_col, text_col, 1, keep).select("t1", "text").mapInArrow(_anchors, "h long, t1 long, again boolean, known boolean")))
        met.append(index.add(found[-1].where("not known").select("h", "t1", "again")))
    index.commit()
    marks = [*(x.where("known").select("h", "t1") for x in found), *met]
    anchors = reduce(DataFrame.unionByName, marks).groupBy("t1").agg(F.collect_set("h").alias("marks"))
    known = stored(reps.join(anchors, "t1").select("age", "o", "t1", "marks"))
    release(*found, *met)

    texts = rows.select("age", "o", "t1", "text")
    if past is not None:
        texts = texts.unionByName(past.select("age", "o", "t1", "text"))
    probes = (
        texts.join(known, ["age", "o", "t1"])
        .select("age", "o", "t1", "text", "marks")
        .mapInArrow(_probes, "one long, two long, age int, o long, t1 long, at int, run int, again boolean")
    )
    place = F.struct("age", "o", "t1", "at")
    late = probes.withColumn("first", F.min(place).over(Window.partitionBy("one", "two"))).where(F.col("again") | (place != F.col("first")))
    spans = stored(late.where("age = 1").groupBy("o", "t1").agg(F.collect_set(F.struct("at", "run")).alias("starts")))
    copies = join_evenly(ids, reps.select("t1", "t2", F.struct("age", "o").alias("first"), "n"), ["t1", "t2"], "n")
    copies = stored(copies.where((F.col("age") == 1) & (F.struct("age", "o") != F.col("first"))).select("o", "t1").distinct().withColumn("copy", F.lit(True)))
    release(known, ids, reps)
    plan = spans.join(copies, ["o", "t1"], "full")
    shape = with_fields(rows.select("row"), "n_words long, n_removed long, kept string" + ", none boolean, text string" * text_too)
    out = (
        rows.select("row", "o", "t1", "text", "none")
        .join(plan, ["o", "t1"], "left")
        .select("row", "text", "none", "starts", F.coalesce("copy", F.lit(False)).alias("copy"))
        .mapInArrow(partial(_kept, text_too), shape)
    )
    return out.select("row.*", "n_words", "n_removed", "kept", *([F.when(~F.col("none"), F.col("text")).alias(text_col)] if text_too else []))


def _told_apart(docs: DataFrame, id_col: str, text_col: str, age: int, keep: list[str]) -> DataFrame:
    """(row, age, o, text, none, t1, t2): age 0 is history; o orders by id; the fingerprints order and tell apart what shares an id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(F.col(id_col), *keep).alias("row"), F.lit(age).alias("age"), order_id(id_col).alias("o"), text.alias("text"), F.col(text_col).isNull().alias("none"))
    return rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("second"), "text")})


def _ranges(docs: DataFrame, id_col: str, ids: DataFrame, n: int | None) -> list[DataFrame]:
    """``n`` batches by ranges of ids, about equal; repeated ids stay together. The filters are on the column as it is, so
    that a scan passes over row groups of other ranges."""
    n = n or max(FANOUT, -(-ids.count() // BATCH))
    cuts = ids.agg(F.percentile_approx("o", [k / n for k in range(1, n)], 1000)).first()[0] if n > 1 else None
    edges = [None, *sorted(set(cuts or [])), None]
    out, col = [], F.col(id_col).cast("long") if dict(docs.dtypes)[id_col] != "bigint" else F.col(id_col)
    for low, high in zip(edges[:-1], edges[1:]):
        batch = docs if low is None else docs.where((col > low) | col.isNull())
        if high is not None:
            batch = batch.where(col <= high) if low is None else docs.where((col > low) & (col <= high))
        out.append(batch)
    return out
