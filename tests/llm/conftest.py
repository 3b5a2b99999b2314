import random

import pytest

from quire.llm.base import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def made_texts(n=60, seed=3):
    """Texts with copies, near copies, a null, empty ones, odd white space and a long one."""
    rnd = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "né", "pu") for b in ("ra", "St", "to", "vu", "xi", "zo")]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(3, 80))) for _ in range(n)]
    for i in range(0, 20):
        w = texts[i].split()
        w[rnd.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], texts[1].upper(), texts[2].replace(" ", "\n\t "), "", "   ", None, "one", "one two", " ".join(rnd.choice(vocab) for _ in range(6000))]
    return texts


@pytest.fixture(scope="session")
def docs(spark):
    """Ids with a repeat and a null, and columns whose names clash with those of results."""
    rows = [(i if i != 7 else 6, t, i % 3, "x") for i, t in enumerate(made_texts())]
    rows[9] = (None, *rows[9][1:])
    return spark.createDataFrame(rows, "doc_id long, text string, size int, score string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
