import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}{rng.choice(['', 'a', 'ing', 'é', ','])}" for _ in range(n)]


def corpus(seed=5, n=60):
    """Documents with copies, near copies, shared passages, shared lines, long, empty, blank and null texts."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 70))
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            text = rng.choice(texts)
        elif texts and kind < 0.3:
            parts = rng.choice(texts).split(" ")
            for _ in range(max(1, len(parts) // 60)):
                parts[rng.randrange(len(parts))] = "edited"
            text = " ".join(parts)
        else:
            lines = [" ".join(words(rng, rng.randint(3, 40))) for _ in range(rng.randint(1, 6))]
            if kind < 0.5:
                lines.insert(rng.randrange(len(lines) + 1), passage)
            if kind > 0.8:
                lines.insert(rng.randrange(len(lines) + 1), f"Printed on day {rng.randrange(999)} by the office of records")
            text = "\n".join(lines)
        texts.append(text)
        rows.append((i * 3, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), len(text)))
    rows += [(1, None, "en", "a", None), (2, "", "en", "a", 0), (4, " \t\n ", None, "a", 4), (5, "one", "en", None, 3), (7, "x " * 6000, "en", "a", 12000), (8, "two words\tand\x0btabs\r\n", "de", "b", 20)]
    return rows


#: What may come with a table: a null id, an id twice (same and other text).
ODD = [(None, "no id at all " * 20, "en", "a", 260), (1000, "same row " * 30, "en", "a", 270), (1000, "same row " * 30, "en", "a", 270), (1000, "another text under that id " * 12, "en", "b", 300)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def odd(spark, rows):
    """With odd rows and columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows + ODD, SCHEMA)
    for c in ("rid", "bucket", "part", "row", "key", "n", "ids", "fp", "node", "anchor", "shard", "line", "score"):
        df = df.withColumn(c, F.lit("own"))
    return df.persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
