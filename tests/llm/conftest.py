import random

import pytest

#: Columns with names that operators use inside, and extra ones.
EXTRA = "lang string, source string, n_chars long, shard int, size int, fp string, line string, keeper string, id string, row string, score string, word string, n_lines int"


@pytest.fixture(scope="session")
def make(spark):
    """docs from (doc_id, text, source) rows, with extra columns of clashing names."""

    def build(rows):
        full = [(*((i, t)), "en", s, None if t is None else len(t), 1, 2, "f", "l", "k", "i", "r", "s", "w", 3) for i, t, s in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, {EXTRA}")

    return build


@pytest.fixture
def rng():
    return random.Random(5)
