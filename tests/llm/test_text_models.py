"""Tokens, language models, classifiers and leaks."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.llm import bpe, decontam, quality, toxicity
from inkwell.llm.queries import tokenizer

from .conftest import DOCS, sentence

WEIRD = [
    "", "  ", "İstanbul ΣΑΣ ΟΔΟΣ ﬁ ½ ²", "a<|endoftext|>b <|startoftext|> C<|endoftext|", "it's we'll 12345 你好世界 é 🎉🎉 aaaaaaa aaaa aaaaaaaaaaaaaaaaaaa",
    "<|ENDOFTEXT|> hello!!!! ----- '''' 'sabc ''s", "x" * 3000, "नमस्ते ​\x00\x85\xa0y\x1cz", "e\u0301 Å", "\u2028new\u3000wide",
]


def test_encoding_matches_the_library(spark, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer())
    texts = WEIRD + [r[1] for r in corpus] + ["".join(random.Random(k).choices("abcdefgh'ñß .,\n19", k=200)) for k in range(60)]
    rows = bpe.encode_decode(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), tokenizer()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_every_code_point_encodes_as_by_the_library():
    from tokenizers import Tokenizer

    library, walker = Tokenizer.from_file(tokenizer()), bpe.Walker(bpe.load(tokenizer()))
    codes = [c for a, b in ((0, 0xD800), (0xE000, 0x32400), (0xE0000, 0xE0200), (0x10FFF0, 0x110000)) for c in range(a, b)]
    # as a letter or not between letters, twice in a row, and lower-cased
    texts = ["".join(f"a{chr(c)}{chr(c)}a " for c in codes[k : k + 500]) for k in range(0, len(codes), 500)]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = walker.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == found.ids, hex(ord(text[1]))
        assert walker.decode(ids) == library.decode(found.ids, skip_special_tokens=False)


def merges_by_hand(word, merges, end):
    parts = [*word[:-1], word[-1] + end]
    while True:
        pairs = [(merges[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in merges]
        if not pairs:
            return parts
        turn = min(pairs)[0]
        k, out = 0, []
        while k < len(parts):
            if k + 1 < len(parts) and merges.get((parts[k], parts[k + 1])) == turn:
                out.append(parts[k] + parts[k + 1])
                k += 2
            else:
                out.append(parts[k])
                k += 1
        parts = out


@pytest.mark.parametrize("seed", range(6))
def test_automaton_follows_random_merges(seed):
    r = random.Random(seed)
    tokens, merges = ["a", "b", "c", "a</w>", "b</w>", "c</w>"], []
    while len(merges) < 25:
        u, v = r.choice(tokens), r.choice(tokens)
        if not u.endswith("</w>") and u + v not in tokens:
            merges.append([u, v])
            tokens.append(u + v)
    automaton = bpe.Automaton({"model": {"vocab": {t: k for k, t in enumerate(tokens)}, "merges": merges}, "added_tokens": []})
    walker, turns = bpe.Walker(automaton), {tuple(m): k for k, m in enumerate(merges)}
    for _ in range(300):
        word = "".join(r.choices("abc", k=r.randint(1, 14)))
        assert [walker.labels[t] for t in walker.path(word)] == merges_by_hand(word, turns, "</w>"), (word, merges)


def brute_model(texts):
    """Interpolated modified Kneser-Ney over character tuples, by dictionaries."""
    n = quality.ORDER
    rows = lambda t: [quality.START] * (n - 1) + [*t, quality.END]
    counts = {n: Counter()}
    for t in texts:
        sym = rows(t)
        for k in range(n - 1, len(sym)):
            counts[n][tuple(sym[k - n + 1 : k + 1])] += 1
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts = {}
    for k, c in counts.items():
        m = Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] + 2 * m[2] else None
        cuts[k] = [0] + [min(i - 0.05, max(0.05, i - (i + 1) * y * m[i + 1] / m[i])) if y is not None and m[i] else 0.5 for i in (1, 2, 3)]
    totals = {k: Counter() for k in counts}
    rest = {k: Counter() for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            totals[k][g[:-1]] += v
            rest[k][g[:-1]] += cuts[k][min(v, 3)]

    def p(g):
        k = len(g)
        low = p(g[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        if not totals[k][g[:-1]]:
            return low
        c = counts[k][g]
        return (c - cuts[k][min(c, 3)]) / totals[k][g[:-1]] + rest[k][g[:-1]] / totals[k][g[:-1]] * low

    def perplexity(t):
        sym = rows(t)
        logs = [np.log2(p(tuple(sym[k - n + 1 : k + 1]))) for k in range(n - 1, len(sym))]
        return 2 ** -np.mean(logs) if t else None

    return perplexity


@pytest.mark.parametrize("hot", (1 << 20, 300))
def test_perplexity_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(quality, "HOT", hot)
    monkeypatch.setattr(quality, "_SLICE", 100)
    monkeypatch.setattr(quality, "FEWEST", 2)
    r = random.Random(3)
    good = [sentence(r, 30) + ". Über Ñ 12, x! 你好 🎉" for _ in range(30)]
    rows = [(k, t, "en", None, None) for k, t in enumerate(good)] + [(100, "$$ %% && ## @@", "en", None, None), (101, None, "en", None, None), (102, "no model", "xx", None, None), (103, "WORDS", None, None, None)]
    rows += [(3, "an id twice", "en", None, None), (200, good[5], "en", None, None), (None, good[6], "en", None, None)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(100, 1, 0), (100, 0, 0), (None, 1, 0), (102, None, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, DOCS)
    got = quality.classify(df.withColumn("limit", F.lit(1)).withColumn("row", F.lit("clash")).withColumn("trusted", F.lit(True)), labels).collect()
    assert sorted((x["doc_id"] or -1) for x in got) == sorted((x[0] or -1) for x in rows)
    own = [x[1] for x in rows if x[0] is not None and x[0] < 30]
    held = {x["t"] for x in spark.createDataFrame([(t,) for t in own], "t string").where(F.pmod(F.xxhash64("t"), F.lit(5)) == 0).collect()}
    brute = brute_model([t for t in own if t not in held])
    want = sorted((d or -1, brute(t)) for d, t, lang, *_ in rows if lang == "en" and t)
    seen = sorted((x["doc_id"] or -1, x["perplexity"]) for x in got if x["lang"] == "en" and x["n_symbols"])
    for (d, a), (e, b) in zip(want, seen):
        assert d == e and b == pytest.approx(a, rel=1e-4)
    by = {x["doc_id"]: x for x in got}
    assert not by[100]["accepted"] and not by[101]["accepted"]
    assert by[102]["accepted"] and by[102]["perplexity"] is None and by[103]["accepted"] and by[103]["lang"] == ""
    limit = max(brute(t) for t in own if t in held)
    assert all(x["limit"] == pytest.approx(limit, rel=1e-4) for x in got if x["lang"] == "en" and x["n_symbols"])
    kept = quality.accepted(df, labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((x["doc_id"] or -1, x["text"]) for x in kept.collect()) == sorted((x["doc_id"] or -1, t) for x, t in ((x, t) for x in got if x["accepted"] for d, t, lang, *_ in rows if (d, lang or "", len(t or "")) == (x["doc_id"], x["lang"], x["n_symbols"])))


def test_quality_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["accepted"] for r in quality.classify(docs, none).where("n_symbols > 0").collect()} == {True}
    assert quality.classify(docs.where("false"), none).count() == 0


def brute_overlap(text, item):
    cut = lambda t: re.findall(r"[^\s!-/:-@\[-`{-~]+", (t or "").lower())
    d, i = cut(text), cut(item)
    size = min(20, len(i))
    return any(
        low + size <= min(len(i), len(d) - s) and sum(d[s + k] == i[k] for k in range(low, low + size)) >= 0.8 * size
        for s in range(-len(i), len(d)) for low in range(max(0, -s), len(i) - size + 1)
    ) if size else False


def test_no_substitution_hides_an_overlap():
    """Items of 9 to 20 words with as many substitutions as a window may have, wherever these stand: all 4,845 ways for 20 words."""
    from itertools import combinations

    for n in range(9, 21):
        item = [f"w{k}" for k in range(n)]
        ways = list(combinations(range(n), n - math.ceil(0.8 * n)))
        texts = [" ".join("x" if k in way else w for k, w in enumerate(item)) for way in ways]
        found = decontam.found_in(pa.array(texts), decontam.Seeds([(1, " ".join(item))]))
        assert [f[0][2] for f in found] == [n - len(ways[0])] * len(ways), n
        assert len(ways) == 4845 or n < 20


def test_leaks_against_brute_force(spark):
    r = random.Random(5)
    items = [sentence(r, n) for n in (40, 25, 12, 30, 9, 6, 2)] + [None, ""]
    rows, planted = [], set()
    for k in range(60):
        text = sentence(r, 50)
        if k % 3 == 0:
            item = r.randrange(7)
            words = items[item].split()
            for _ in range(len(words) // 12):
                words[r.randrange(len(words))] = "other"
            text = f"{text} {', '.join(words).upper()} {sentence(r, 5)}"
            planted.add(k)
        rows.append((k, text))
    rows += [(90, None), (91, ""), (None, items[0])]
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)] + [(0, items[0], "y")], "item_id long, text string, id string")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash"))
    got = {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(df, bench).collect()}
    want = {(d, i) for d, t in rows for i, x in enumerate(items) if brute_overlap(t, x)}
    assert got <= want
    # a window at the lowest share may lack a seed; whole items with few substitutions may not
    assert len(want - got) <= 0.1 * len(want) and planted - {d for d, _ in got} <= {d for d, t in rows if len((t or "").split()) < 60}
    clean = decontam.remove_contaminated(df, bench)
    assert clean.columns == df.columns
    assert {x["doc_id"] for x in clean.collect()} == {d for d, _ in rows} - {d for d, _ in got}


def test_differences_by_correlation(monkeypatch):
    r = np.random.default_rng(8)
    monkeypatch.setattr(decontam, "_PAIRED", 0)
    monkeypatch.setattr(decontam, "_SPAN", 97)
    for _ in range(60):
        p, q = (np.unique(r.integers(0, 400, r.integers(1, 90))) for _ in range(2))
        assert decontam.differences(p, q).tolist() == sorted({int(a - b) for a in p for b in q})


def test_few_words_repeated_many_times():
    seeds = decontam.Seeds([(1, "yes " * 5000), (2, "yes no " * 300 + "maybe"), (3, "no " * 12)])
    found = decontam.found_in(pa.array(["yes " * 200_000, "yes no " * 5000, "other words", "no " * 30]), seeds)
    assert found[0] == {0: (0, 5000, 5000)}
    assert found[1] == {1: (0, 601, 600)} and found[2] == {} and found[3] == {2: (0, 12, 12)}


def test_leaks_in_blocks_of_the_benchmark(spark, monkeypatch):
    items = [(k, sentence(random.Random(k), 30)) for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(k, f"start {t} end") for k, t in items] + [(99, "clean words")], "doc_id long, text string")
    whole = sorted(map(tuple, decontam.contaminated(df, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 500)
    assert sorted(map(tuple, decontam.contaminated(df, bench).collect())) == whole and len(whole) == 20
    assert decontam.contaminated(df, bench.where("false")).count() == 0
    assert decontam.remove_contaminated(df.where("false"), bench).count() == 0


def test_toxicity_on_held_out_documents(spark):
    r = random.Random(11)
    bad = ["dolt", "oaf", "grundle", "grundled", "grundling"]

    def make(toxic):
        words = sentence(r, r.randint(20, 80)).split()
        for _ in range(r.randint(1, 4) * toxic):
            words.insert(r.randrange(len(words)), r.choice(bad))
        return " ".join(words)

    rows = [(k, make(k % 5 == 0), "en", None, None) for k in range(900)] + [(None, "an oaf", None, None, None), (2000, None, None, None, None), (2000, "", None, None, None)]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(500)] + [(None, 1, 1), (3, None, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.classify(spark.createDataFrame(rows, DOCS).withColumn("toxic", F.lit("clash")), labels).collect()
    assert len(out) == len(rows)
    held = [x for x in out if x["doc_id"] is not None and 500 <= x["doc_id"] < 900]
    right = sum(x["is_toxic"] == (x["doc_id"] % 5 == 0) for x in held)
    assert right >= 0.99 * len(held)
    assert not any(x["is_toxic"] for x in out if x["doc_id"] == 2000)
    none = toxicity.classify(spark.createDataFrame(rows, DOCS), labels.where("false"))
    assert not any(x["is_toxic"] for x in none.collect())
    assert toxicity.classify(spark.createDataFrame([], DOCS), labels).count() == 0


def test_rows_that_share_an_id_train_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "Chain", lambda keys, x, labels, weight, fold, chosen: seen.append((len(x), weight, fold)))
    rows = [(k, f"word{k} text") for k in range(20)] + [(3, f"hot{k} text") for k in range(500)]
    labels = [(k, 1, int(k % 4 == 0)) for k in range(20)]
    toxicity.train(spark.createDataFrame(rows, "o long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert seen[0][0] == 20 and np.allclose(seen[0][1], 1) and sorted(np.bincount(seen[0][2]).tolist()) == [4, 4, 4, 4, 4]


def test_features_are_chosen_without_the_held_out_fold(spark):
    """Against brute force over the same words; what stands in one fold alone isn't chosen for it."""
    from inkwell.llm._words import words

    r = random.Random(2)
    rows = []
    for k in range(400):
        cell = r.randrange(5) * 4 + r.choice((0, 0, 0, 1, 2))
        text = sentence(r, 30, 60) + (" nasty" if cell & 1 and r.random() < 0.8 else "") + (" junky" if cell & 2 and r.random() < 0.7 else "") + (" only" if cell // 4 == 2 and cell & 1 else "")
        rows.append((k, cell, text))
    df = spark.createDataFrame(rows, "o long, cell int, text string")
    sizes = Counter(c for _, c, _ in rows)
    got = {(x["part"], x["feature"]) for x in toxicity.choose(df.select("cell", "text").mapInArrow(toxicity._counted, "feature long, cell int, n long"), sizes).collect()}
    sets = {k: {int(f) for f in toxicity.features(words(pa.array([t]), marks=True))[0].astype(np.int64)} for k, _, t in rows}
    every = set().union(*sets.values())
    kept = [f for f in every if max(sum(f in sets[k] for k, c, _ in rows if c // 4 != p) for p in range(6)) >= 3]
    sure, want = max(toxicity.LEAST, 2 * np.log(len(kept)) - 8), set()
    for p in range(6):
        train = [(sets[k], c) for k, c, _ in rows if c // 4 != p]
        for bit in (2, 1):
            scored = []
            for f in kept:
                table = Counter((f in s, bool(c & bit)) for s, c in train)
                a = table[True, True] + table[True, False]
                g = 2 * sum(n * np.log(n * len(train) / ((table[x, True] + table[x, False]) * (table[True, y] + table[False, y]))) for (x, y), n in table.items() if n)
                if a >= 3 and g >= sure:
                    scored.append((-g, f))
            want |= {(p, f) for _, f in sorted(scored)[: toxicity.FEATURES]}
    assert got == want
    only = int(words(pa.array(["only"]), marks=True).prints.astype(np.int64)[0])
    assert (2, only) not in got and (5, only) in got


def test_later_models_see_earlier_probabilities():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3)) < 0.3
    first = x[:, 0]
    second = first & (rng.random(400) < 0.9)
    every = [np.arange(3)] * (toxicity.FOLDS + 1)
    chain = toxicity.Chain(np.array([1, 2, 3], np.uint64), x, {"low_quality": first, "toxic": second}, np.ones(400), np.arange(400) % toxicity.FOLDS, every)
    assert [len(m) for m in chain.models] == [4, 5]
    assert chain.models[1][3] > 0.5  # the weight of the earlier category


def test_words_kernel():
    from inkwell.llm._words import words

    texts = ["a  b\tc\n", None, "", "ünï\x0bcode", "x" * 3_000_000, "x" * 3_000_000 + " a"]
    w = words(pa.array(texts))
    assert np.diff(w.first).tolist() == [len((t or "").encode().split()) for t in texts]
    assert w.prints[0] == w.prints[-1] and w.prints[w.first[4]] == w.prints[w.first[5]]


def plain_fit(rows, ys, weights):
    """The ridge logistic regression as a sum over documents, minimised by small steps; last coefficient constant."""
    n = len(rows[0]) + 1
    beta = [0.0] * n
    ridge = [toxicity.RIDGE] * (n - 1) + [1e-6]
    rows = [[*map(float, r), 1.0] for r in rows]
    for _ in range(40):
        gradient, curve = [-r * b for r, b in zip(ridge, beta)], [[ridge[i] * (i == j) for j in range(n)] for i in range(n)]
        for row, y, w in zip(rows, ys, weights):
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(row, beta))))
            for i in range(n):
                gradient[i] += w * (y - p) * row[i]
                for j in range(n):
                    curve[i][j] += w * p * (1 - p) * row[i] * row[j]
        for i in range(n):  # elimination
            for j in range(i + 1, n):
                f = curve[j][i] / curve[i][i]
                curve[j] = [a - f * b for a, b in zip(curve[j], curve[i])]
                gradient[j] -= f * gradient[i]
        step = [0.0] * n
        for i in reversed(range(n)):
            step[i] = (gradient[i] - sum(curve[i][j] * step[j] for j in range(i + 1, n))) / curve[i][i]
        beta = [b + s for b, s in zip(beta, step)]
    return beta


def plain_predict(row, beta):
    return 1 / (1 + math.exp(-sum(float(a) * b for a, b in zip([*row, 1], beta))))


def test_chain_against_plain_logistic_regressions():
    """Each category's model sees the categories before it as out-of-fold probabilities; at prediction, as those of the models before."""
    r = random.Random(8)
    x = np.array([[r.random() < 0.4 for _ in range(6)] for _ in range(90)])
    low = np.array([(row[0] or row[1]) and r.random() < 0.8 for row in x])
    toxic = np.array([(row[2] and row[0]) or l and r.random() < 0.3 for row, l in zip(x, low)])
    fold, weight = np.array([k % 5 for k in range(90)]), np.where(toxic, 0.7, 1.1)
    chosen = [np.array(sorted(r.sample(range(6), 4))) for _ in range(5)] + [np.array([0, 1, 2, 4])]
    chain = toxicity.Chain(np.arange(6, dtype=np.uint64), x, {"low_quality": low, "toxic": toxic}, weight, fold, chosen)

    before, models = [[] for _ in x], []
    for y in (low, toxic):
        out = [0.0] * len(x)
        for k in range(5):
            inputs = [[*row[chosen[k]], *b] for row, b in zip(x, before)]
            rest = [i for i in range(len(x)) if fold[i] != k]
            beta = plain_fit([inputs[i] for i in rest], [y[i] for i in rest], [weight[i] for i in rest])
            for i in range(len(x)):
                if fold[i] == k:
                    out[i] = plain_predict(inputs[i], beta)
        models.append(plain_fit([[*row[chosen[-1]], *b] for row, b in zip(x, before)], y, weight))
        before = [[*b, o] for b, o in zip(before, out)]
    want = []
    for row in x:
        first = plain_predict(row[chosen[-1]], models[0])
        want.append([first, plain_predict([*row[chosen[-1]], first], models[1])])
    assert np.allclose(chain.predict(x[:, chosen[-1]]), want, atol=1e-3)
    held = [b[1] for b in before]
    cut = [(2 * sum(w for p, y, w in zip(held, toxic, weight) if y and p >= t) / (sum(w for p, w in zip(held, weight) if p >= t) + weight[toxic].sum()), t) for t in held]
    best = max(cut)[1]
    assert max(p for p in held if p < best) - 1e-3 <= chain.limit <= best + 1e-3
