import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(n))


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, odd white space, nulls, empty texts and a long text."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(0, 200)) for _ in range(n)]
    passage = prose(rng, 70)
    for i in range(0, n, 6):
        texts[i] = f"{prose(rng, rng.randint(0, 30))}\n{passage} {prose(rng, rng.randint(0, 30))}"
    for i in range(1, n, 9):
        texts[i] = texts[(i * 7) % n].replace(" ", " \t", 2)
    for i in range(2, n, 7):
        words = texts[(i * 5) % n].split(" ")
        if words:
            words[rng.randrange(len(words))] = "edited"
        texts[i] = " ".join(words)
    texts[3], texts[4], texts[5] = None, "", " \n\t "
    texts[10] = "again and again " * 60
    texts[11] = texts[12].upper() if texts[12] else "X"
    texts[13] = prose(rng, 6000)
    return [(i, t, rng.choice(["en", "de", "fr", "es"]), f"src{rng.randrange(6)}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd_docs(spark, rows):
    """The corpus with null ids, repeated rows, null names and extra columns under names that operators use."""
    more = [
        (None, rows[0][1], None, None, None), (None, "only here " * 12, "en", "src1", 0), rows[7], rows[7], (7007, rows[7][1], "de", "web", 3),
        (7008, None, None, "src2", None), (7009, None, "en", None, 0),
    ]
    base = spark.createDataFrame([*rows, *more], SCHEMA)
    clash = ("row", "id", "key", "kept", "sig", "comp", "score", "times", "block", "group", "tokens", "words", "domain", "starts")
    return base.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(clash)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def marks(spark, rows):
    return spark.createDataFrame([(r[0], int(r[0] % 4 != 1), 0) for r in rows if r[0] % 2], "doc_id bigint, quality int, toxic int")
