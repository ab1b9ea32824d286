import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       *[T.StructField(n, T.StringType()) for n in ("score", "queue", "cls", "n", "law", "k", "part", "n_words", "_row", "held")]])


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, and columns with clashing names."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abdeilmnorstu") for _ in range(r.randint(2, 7)))
    base = [word() for _ in range(400)]
    near = base[:]
    near[200] = "changed"
    far = base[:150] + [word() for _ in range(250)]
    long = [word() for _ in range(30_000)]
    texts = [None, "", " \n\t ", "one", "one two three", "one two three", " ".join(base), " ".join(base), " ".join(near), " ".join(far), " ".join(long), "ABC! Éé ünï 漢字 😀 <|endoftext|>", "a  b   c \n\n d", "12345 678", "x" * 5000, " ".join(base).upper()]
    extra = ("x",) * 10
    rows = [(i, t, r.choice(["en", "de"]) if i % 4 else None, r.choice(["s0", "s1"]) if i % 5 else None, None if i % 3 else 1, *extra) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id here at all, none", "en", "s0", 1, *extra), (None, None, None, None, None, *(None,) * 10)]
    rows += [(100 + i, " ".join(word() for _ in range(r.randint(1, 60))), r.choice(["en", "de"]), "s0", 1, *extra) for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
