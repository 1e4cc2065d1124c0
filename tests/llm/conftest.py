import random

import pytest

LONG = "lorem ipsum dolor sit amet " * 8000
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp string, row int, w string, score string, word string, hash string, item string, y int, `turn` int, `a.b` int"


def prose(rng, n, lexicon="the of and to in river stone light house green walk morning paper quiet garden window letter".split()):
    return " ".join(rng.choice(lexicon) + rng.choice(["", "", "", "s", "ing", "ed"]) for _ in range(n))


def rows(found):
    """Full rows of (id, text, lang) with the extra columns whose names operators use inside."""
    return [(i, t, l, "s", None, "x", "x", 1, "x", "x", "x", "x", "x", 1, 1, 1) for i, t, l in found]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty, blank, letterless and very long texts, repeated rows, one id twice, extra columns."""
    rng = random.Random(5)
    found = [(0, None, "en"), (1, "", "en"), (2, " \t\n", None), (3, "123 !!! ² 中", "en"), (4, LONG, "en"), (5, prose(rng, 60), "en"), (5, prose(rng, 60), "de"), (None, prose(rng, 40), "en"), (None, None, None), (7, "same text here again", "fr"), (7, "same text here again", "fr"), (8, " x\x00y  z \x1c \x85", "en"), (9, "a", "es"), (10, "word " * 3000, "en")]
    return spark.createDataFrame(rows(found), COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
