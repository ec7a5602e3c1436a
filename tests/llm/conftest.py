import random

import pytest


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) with further columns whose names clash with inner ones."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, 1.5, 7, "x") for r in rows]
        return spark.createDataFrame(full, DOCS + ", score double, n long, token string")

    return make


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    syllables = "ba de fi lo mu na pe ri so tu".split()
    pool = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(400)]

    def make(count, seed):
        return " ".join(random.Random(seed).choices(pool, k=count))

    return make


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
