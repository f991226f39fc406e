import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and blank texts, repeats, copies, junk, and one very long text."""
    rng = random.Random(5)
    shared, long = sentence(rng, 60), sentence(rng, 30_000)
    texts = [None, "", " \n\t ", "one", "ONE", "one two three", "Zoë naïve 数据 \U0001f600 word", "x " * 300, "a\nb\na\n\nb\nc",
             shared, shared, sentence(rng, 20) + " " + shared + " " + sentence(rng, 20), shared + " tail", "head " + shared,
             long, long[:9000], sentence(rng, 34), sentence(rng, 35), "$$$ ### *** " * 40]
    texts += [sentence(rng, rng.randrange(5, 200)) for _ in range(40)]
    texts += [texts[-1] + " changed", texts[-2].upper(), texts[-3]]
    return [(i, t, "en", None if i % 7 == 0 else f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Repeated rows, repeated and null ids, and extra columns named like the operators' own ones."""
    extra = [(*r, 1, "x", [1]) for r in [*rows[:20], rows[9], rows[9], (None, "null id", None, None, 0), (None, None, None, None, 0)]]
    return spark.createDataFrame(extra, SCHEMA + ", key int, spans string, _matches array<int>").withColumnRenamed("key", "edge")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
