import random

import pytest

SYLLABLES = ["ka", "lo", "mi", "ter", "san", "ou", "é", "Übe", "ra", "ne"]


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def prose(r, n):
    return "".join(word(r) + r.choice([" ", " ", " ", ", ", ". ", "\n", "  "]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, blanks only, one word, none and null."""
    r = random.Random(7)
    passage = prose(r, 70)
    out = [prose(r, r.randint(1, 160)) for _ in range(40)]
    out += [out[3]] * 4 + [out[5] + " tail"] * 2
    out += [prose(r, 30) + passage + prose(r, 30) for _ in range(8)] + [passage] * 2
    near = prose(r, 200).split(" ")
    for _ in range(12):
        copy = list(near)
        copy[r.randrange(len(copy))] = word(r)
        out.append(" ".join(copy))
    out += ["", " \n\t ", "one", "a b c", None, "\x00 odd \x1f", "x" * 3000, prose(r, 6000), "中文 テキスト " * 60]
    r.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with ids out of order, and columns whose names an operator may use itself."""
    rows = [(7 * i % len(texts) if len(texts) % 7 else i, t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n long").repartition(3).cache()


@pytest.fixture(scope="session")
def by_id(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string, n long")
