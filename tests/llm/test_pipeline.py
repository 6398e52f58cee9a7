"""The pipeline's stages on odd rows, each against brute force on its own input."""

from __future__ import annotations

import random
import struct
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import quality
from inkwell.llm.queries import tokenizer

from .conftest import DOCS, sentence
from .test_dedup import brute_classes, brute_removal
from .test_text_models import brute_model, brute_overlap


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean texts, junk, copies, near copies, shared passages, leaks, empties, nulls, null and repeated ids, a long text."""
    r = random.Random(21)
    item = sentence(r, 30)
    passage = sentence(r, 40)
    rows = [(k, sentence(r, r.randint(40, 90)), "en", f"s{k % 3}") for k in range(40)]
    near = rows[4][1].split()
    near[10] = "changed"
    rows += [(100, rows[3][1], "en", "s"), (101, " ".join(near), "en", "s"), (102, rows[3][1].upper(), "en", "s")]
    rows += [(110 + k, f"{sentence(r, 30)} {passage} {sentence(r, 30)}", "en", None) for k in range(3)]
    rows += [(120, f"{sentence(r, 30)} {item} {sentence(r, 20)}", "en", "s"), (121, "$$## %%&& @@!! " * 12, "en", "s"), (122, passage, "en", "s")]
    rows += [(130, None, "en", "s"), (131, "", "en", "s"), (None, sentence(r, 50), "en", "s"), (None, sentence(r, 45), None, None), (7, sentence(r, 60), "en", "s"), (7, sentence(r, 55), "en", "s")]
    rows += [(140, sentence(r, 6000), "en", "s"), (150, rows[5][1], "en", "s"), (150, rows[5][1], "en", "s")]
    d = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(121, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=repr)


def test_each_stage_against_brute_force(spark, folder, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(quality, "FEWEST", 1)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, steps[-1], folder))
        steps.append(out)
    for s in steps[1:-1]:
        assert s.columns == docs.columns
    data = [rows_of(s) for s in steps[:-1]]

    own = [x[1] for x in data[0] if x[0] is not None and x[0] < 40]
    held = {x["t"] for x in spark.createDataFrame([(t,) for t in own], "t string").where(F.pmod(F.xxhash64("t"), F.lit(5)) == 0).collect()}
    perplexity = brute_model([t for t in own if t not in held])
    limit = max(perplexity(t) for t in held)
    # texts in a language without a model are kept
    assert data[1] == sorted((x for x in data[0] if x[1] and (x[2] != "en" or perplexity(x[1]) <= limit * 1.0001)), key=repr)
    assert not any(x[0] in (121, 130, 131) for x in data[1]) and sum(x[0] is not None and x[0] < 40 for x in data[1]) >= 38

    number = {k: x for k, x in enumerate(sorted(data[1], key=lambda x: (x[0] is None, x[0] or 0)))}  # by id, null last
    classes = brute_classes([(k, x[1]) for k, x in number.items()])
    heads = {c for c, _ in classes.values()}
    assert data[2] == sorted((number[k] for k in heads), key=repr)
    assert sum(x[0] is None for x in data[2]) == 2 and sum(x[0] == 7 for x in data[2]) >= 2

    order = sorted(data[2], key=lambda x: (x[0] is None, x[0] or 0))
    one = {}
    for seven in ([x for x in order if x[0] == 7], [x for x in order if x[0] is None]):
        assert len({x[1] for x in seven}) == len(seven)  # of one id: no passages shared, so their order doesn't matter
    for k, (n, gone, kept) in brute_removal([(k, x[1]) for k, x in enumerate(order)]).items():
        if gone < n:
            text = kept if gone else order[k][1]
            one[k] = (order[k][0], text, *order[k][2:4], len(text))
    assert data[3] == sorted(one.values(), key=repr) and any(x[4] < y[4] for x in data[3] for y in data[2] if x[0] is not None and x[0] == y[0])

    items = [x["text"] for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if x["text"]]
    clean = [x for x in data[3] if not any(brute_overlap(x[1], i) for i in items)]
    assert data[4] == clean and len(clean) < len(data[3])

    library = Tokenizer.from_file(tokenizer())
    want = []
    for x in data[4]:
        ids = library.encode(x[1], add_special_tokens=False).ids
        want.append((x[0], *x[2:4], len(ids), struct.pack(f"<{len(ids)}I", *ids), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(r["doc_id"], r["lang"], r["source"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in steps[-1].collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    # the whole run, which removes what stages leave behind
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in whole.collect()), key=repr) == sorted(((x[0], x[3], x[5]) for x in want), key=repr)


def test_stages_pass_clashing_columns_on(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 30")
    for name in ("kept", "n_removed", "row", "rest", "bits", "perplexity", "limit", "t1", "rep", "whole", "one", "id", "label"):
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} "), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert all(r["n_removed"] == f"n_removed {r['doc_id']}" and r["row"] == f"row {r['doc_id']}" for r in out.collect()), name


def test_empty_tables(spark, tmp_path):
    for name, shape in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
