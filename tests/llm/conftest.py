from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ce di fo gu la me ni po ru sa te vi wo xu za".split() for b in "n r s t l m".split()]


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


#: Null, empty, blank, tiny and very long texts; null ids and sources; repeated rows.
def odd_rows() -> list[tuple]:
    r = random.Random(5)
    long = prose(r, 60_000) + " " + "x" * 100_000 + " " + prose(r, 50)
    return [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t", "en", None, 3), (4, "word", None, "b", 4), (4, "word", None, "b", 4),
        (None, "no id at all here", "en", "b", 17), (None, None, None, None, None), (5, long, "en", "b", len(long)), (6, "a " * 300, "en", "c", 600), (7, "a " * 300, "en", "c", 600),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with columns that operators might use for themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA)
    for name in ("mix_slot", "mini", "doc", "q_logit", "component", "a", "b", "n", "p", "slots", "buckets", "start", "words", "c0", "jaccard_dropped", "site_host"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda texts, source="s": spark.createDataFrame([(i, t, "en", source, len(t) if t is not None else None) for i, t in enumerate(texts)], SCHEMA)
