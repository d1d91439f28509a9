import random

import pytest

WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "rt", "st", "lon", "vira")]


def prose(r: random.Random, n: int) -> str:
    words = [r.choice(WORDS) for _ in range(n)]
    out = []
    for i in range(0, n, 9):
        out.append(" ".join(words[i : i + 9]).capitalize() + ".")
    return " ".join(out)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table_of(spark, texts, first=0):
    """documents of the texts, ids from first."""
    return spark.createDataFrame([(first + i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def edge_rows(r: random.Random) -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = "\n".join(prose(r, 40) for _ in range(1500))
    text = prose(r, 80) + "\n" + prose(r, 70)
    return [
        (1, text, "en", "a", 10), (1, text, "en", "a", 10), (2, text, "en", "a", 10), (3, None, None, None, None), (None, text, "de", None, 5), (None, None, None, None, None), (4, "", "en", "a", 0),
        (5, "  \n\n ", "en", "b", 5), (6, long, "en", "b", len(long)), (7, long + " end", "en", "b", None), (8, "x", "fr", "c", 1), (9, "\n".join(["same line over and over"] * 50), "en", "c", 1), (10, "ünï çødé 你好 \U0001f600 " * 30, "zh", "c", 9),
    ]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(edge_rows(random.Random(5)), DOCS)


@pytest.fixture
def clashing(edges):
    """The same with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ("k", "at", "ls", "h", "rn", "tok", "key", "cell", "th", "src", "cut", "full", "n", "tie", "fp", "node", "root", "keep", "epoch", "s", "c", "rest")
    return edges.withColumns({x: F.lit(7) for x in names})


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCS)
