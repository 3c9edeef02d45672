import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves; a table may have such columns too.
CLASHING = ("key", "cid", "n", "_row", "_key", "ids", "n_tokens", "component", "node", "owner", "size", "position", "_drops", "n_lines",
            "score", "_nth", "bucket", "_id", "tokens", "label", "toxic")


def clash(df):
    """``df`` with extra columns of names that operators use."""
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns])


def sentence(rng, n):
    return " ".join(rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice("aeiou") for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Rows with nulls everywhere, empty and very long texts, ties, repeats and near copies."""
    rng = random.Random(5)
    base = sentence(rng, 300)
    words = base.split()
    near = " ".join(words[:150] + ["other"] + words[151:])
    far = " ".join(words[:200] + sentence(rng, 100).split())
    shared = "This Line Is Shared By Many"
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, near, "en", "b", 1), (4, far, None, "b", 1),
            (5, "", "en", "a", 0), (6, None, None, None, None), (7, "   \n \t\n", "en", None, 3), (8, "one", "de", "c", 3),
            (9, "one", "de", "c", 3), (10, f"{shared}\nfirst\nown line of ten", "en", "a", 9), (11, f"  {shared.upper()} \r\nsecond", "en", "a", 9),
            (12, f"x\n{shared}\n{shared}\n", None, "b", 9), (13, sentence(rng, 60_000), "en", "a", 9), (14, "ÀÉ ñandú 漢字 🙂 ½ \u0085 x", "es", "d", 9),
            (15, "\n".join(["# symbol $ line"] * 5), "en", "a", 9), (16, "12 34 56", "en", "a", 9), (17, "a b c a b c a b", "en", "a", 9)]
    return rows + [(20 + i, sentence(rng, rng.randint(1, 80)), rng.choice(["en", "de"]), rng.choice("abc"), 9) for i in range(40)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS)


@pytest.fixture(scope="session")
def repeated(spark, edge_rows):
    """The same with repeated rows, rows without id, and clashing columns."""
    again = edge_rows[:3] + [(None, "no id here at all, not one", "en", "a", 1), (None, None, None, None, None)]
    return clash(spark.createDataFrame(edge_rows + again, DOCS))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
