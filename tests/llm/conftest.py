import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    """A small corpus: copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["é", "漢字", "naïve", "Straße", "x" * 60]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(60), text(300)
    changed = base.split()
    changed[150] = "CHANGED"
    out = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, " ".join(changed), "en", "b"),
        (4, f"{text(40)} {passage}\n\t{text(20)}", "de", "b"),
        (5, f"{text(3)} {passage} {text(30)}", "de", None),
        (6, None, "en", "a"),
        (7, "", "en", None),
        (8, "  \n ", None, "c"),
        (9, "short one", "en", "c"),
        (9, "short one", "en", "c"),
        (10, " ".join(["again"] * 100), "en", "b"),
        (11, text(5000), "en", "a"),
        (None, text(50), "en", "a"),
        (None, base, "en", "a"),
    ]
    out += [(100 + i, text(rng.randrange(1, 120)), "en", rng.choice(["a", "b", "c", None])) for i in range(60)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in out]


@pytest.fixture(scope="session")
def corpus():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names operators use too."""
    df = spark.createDataFrame(corpus, DOC_SCHEMA)
    from pyspark.sql import functions as F

    for name in ("block", "score", "size", "fp", "ids", "part", "Predicted", "shard"):
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(100, 160)] + [(1, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
