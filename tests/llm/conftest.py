import random

import pytest

LETTERS = "abcdefghij"


def prose(rng, words):
    return " ".join("".join(rng.choices(LETTERS, k=rng.randint(1, 7))) for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars): nulls, empty, blank, copies, near copies, a long text."""
    rng = random.Random(11)
    base = [prose(rng, n) for n in (80, 120, 60, 300)]
    near = base[0].split()
    near[40] = "changed"
    passage = prose(rng, 90)
    texts = [None, "", " ", "...", base[0], base[0], base[1], " ".join(near), base[0].upper(), base[2] + ".\n" + passage, prose(rng, 50) + " " + passage + " " + prose(rng, 20), base[3], "one two", "one two", "a\u00a0b  c\t\n d", "é" * 500, "漢字" * 300, "x" * 5000, prose(rng, 30_000), "<|endoftext|> and ▁ marks"]
    return [(i if i != 6 else None, t, None if i % 5 == 2 else ("en", "fr")[i % 2], None if i % 4 == 0 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names clash with results."""
    extra = "n_words long, contaminated string, length string, spans int, key string, text2 string, lang_pred int, kept string, rejected int, id string, __row int"
    rows = [r + (1, "x", "y", 2, "k", "t", 3, "z", 4, "i", 5) for r in corpus]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
