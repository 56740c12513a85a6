import random

import pytest

WORDS = [a + b for a in ("ba", "ko", "mi", "tu", "re", "sal", "ven") for b in ("", "da", "lon", "rit", "shu", "qe")]


def prose(seed: int, n: int) -> str:
    """``n`` words of sentences and lines."""
    rng, out = random.Random(seed), []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice(WORDS))
        if i % 9 == 8:
            out[-1] += "."
        if i % 31 == 30:
            out[-1] += "\n"
    return " ".join(out).replace("\n ", "\n")


#: Columns that operators use inside.
CLASH = "key int, h int, line int, node int, fp0 int, content int, copies int, place int, row int, label int, u int, v int, block int, host int, path int, __llm_id int, __llm_copy int"


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): null, empty, blank, very long, repeated, tied, without words."""
    long_text = prose(1, 20_000)
    return [
        (1, None),
        (2, ""),
        (3, " \n\t\n "),
        (4, long_text),
        (5, prose(2, 120)),
        (5, prose(2, 120)),
        (6, prose(2, 120)),
        (7, "x" * 5000),
        (None, prose(3, 60)),
        (None, None),
        (8, "one"),
        (9, "é" * 3 + " ß́ 中文 🙂 ​"),
        (10, prose(2, 120).replace(" ", "  ", 3)),
        (11, "\n".join(["same line of text here"] * 6)),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    """The odd rows with extra columns of clashing names."""
    extra = [0] * len(CLASH.split(", "))
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *extra) for i, t in odd_rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")
