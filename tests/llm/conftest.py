import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, rid string, fp string"


def words(seed, n, base="w"):
    r = random.Random(seed)
    return " ".join(f"{base}{r.randrange(4000)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): nulls, empty and long texts, exact and near copies, repeated ids, ties."""
    long, base = words(1, 6000), words(2, 120)
    edited = base.split()
    edited[7] = "other"
    shared = words(3, 60)
    out = [
        (1, base), (2, base), (3, " ".join(edited)), (4, base.upper() + "\n"), (5, None), (6, ""), (7, " \t\n"), (8, "two words"), (9, "TWO  words"), (10, long), (11, long[:9000] + " é漢 " + long[9000:]),
        (12, f"{words(4, 40)} {shared} {words(5, 40)}"), (13, f"{words(6, 50)} {shared}"), (14, "ab " * 300), (15, "ab " * 300), (15, words(7, 50)), (None, words(8, 50)), (None, base), (16, words(9, 30)), (16, words(9, 30)),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", None, "x", "y", "z") for i, t in rows], DOCS)
    return df.repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 17)] + [(3, None, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int").withColumn("lang", F.lit("en"))
