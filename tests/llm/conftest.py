import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def word(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 8)))


def prose(seed, n):
    rng = random.Random(seed)
    words = [word(rng) for _ in range(n)]
    return " ".join(w + ("\n" if i % 17 == 16 else "") for i, w in enumerate(words))


def edited(text, seed, share=0.01):
    rng = random.Random(seed)
    return " ".join(word(rng) if rng.random() < share else w for w in text.split(" "))


PASSAGE = prose(99, 70).replace("\n", " ")
BOILER = "All rights reserved by the publisher in the year 2024 and later"


def documents():
    """Copies, near copies, a shared passage, boilerplate, and every odd row."""
    rows = [(i, prose(i, 60 + 7 * i), "en", f"s{i % 3}", None) for i in range(12)]
    rows += [(20 + i, rows[3][1], "en", "s0", 5) for i in range(3)]  # exact copies
    rows += [(30 + i, edited(rows[11][1], i), "en", None, 5) for i in range(4)]  # near copies
    rows += [(40 + i, f"{prose(200 + i, 30)} {PASSAGE} {prose(300 + i, 30)}", "de", "s1", 1) for i in range(4)]
    rows += [(50 + i, f"{prose(400 + i, 40)}\nAll rights reserved by the publisher in the year {2000 + i} and later\n{prose(500 + i, 20)}", None, "s2", 2) for i in range(6)]
    rows += [(60, None, None, None, None), (61, "", "en", "s0", 0), (62, " \n\t ", "en", "s0", 4), (63, "one", "en", "s0", 3), (64, "two words", "en", "s0", 9)]
    rows += [(65, "a" * 30_000, "en", "s0", 1), (66, prose(600, 9000), "fr", "s1", 1)]
    rows += [(None, rows[3][1], "en", "s0", 1), (20, rows[3][1], "en", "s0", 5), (63, "one", "en", "s0", 3)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(docs):
    """The same with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ("key", "m", "bits", "label", "size", "n", "line", "leaf", "version", "at", "spans", "part", "_lines")
    return docs.select("*", *[F.lit(7).alias(n) for n in names])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()), key=repr)
