import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls string, n string, label string, k1 string, doc string, first string"


def prose(rng: random.Random, words: int) -> str:
    parts = "an er in on at en ti es or te re th he of it is ou ed al ar st nd to nt".split()
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return " ".join(w.capitalize() if i % 9 == 0 else w + "." if i % 9 == 8 else w for i, w in enumerate(out))


def rows(texts):
    """(doc_id, text) pairs as rows of documents with further columns whose names operators use themselves."""
    return [(i, t, "en", "src", None if t is None else len(t), "x", "x", "x", "x", "x", "x") for i, t in texts]


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda texts: spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture(scope="session")
def edge_texts():
    """Nulls, empty and blank texts, a very long one, repeated rows and a repeated id."""
    rng = random.Random(3)
    a, long_text = prose(rng, 60), "\n".join(prose(rng, 40) for _ in range(400))
    return [(1, a), (2, None), (3, ""), (4, " \n\t "), (5, a), (6, long_text), (7, "one two"), (7, "one two"), (8, prose(rng, 30)), (8, prose(rng, 31)), (None, prose(rng, 20)), (9, a.replace("th", "zz", 1)), (10, "Ünï çode — 東京 🙂 a b\tc"), (-3, prose(rng, 25))]
