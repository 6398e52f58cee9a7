from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{int(r.paretovariate(0.6)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages, repeats, empties, nulls, ties and a long text."""
    r = random.Random(7)
    base = [sentence(r, r.randint(30, 120)) for _ in range(40)]
    passage = sentence(r, 60)
    texts = list(base)
    texts += [base[k] for k in (0, 0, 1, 5)]
    for k in range(12):
        words = base[k].split()
        for _ in range(r.choice((1, 2, 6))):
            words[r.randrange(len(words))] = f"n{r.randrange(999)}"
        texts.append(" ".join(words))
    texts += [f"{sentence(r, 25)}\n{passage}\t{sentence(r, 10)}" for _ in range(6)]
    texts += [" ".join(["again"] * 70), f"{passage} x {passage}", "", None, "  \n ", "one two", "one two", "Überall 你好 <|endoftext|> İ", sentence(r, 20_000, 5000)]
    r.shuffle(texts)
    return [(k * 3, t, "en" if k % 4 else None, "s", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture()
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)
