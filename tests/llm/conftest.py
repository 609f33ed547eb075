import pytest
from pyspark.sql import types as T

NAMES = ["kept", "key", "row", "length", "base", "words", "rank", "spans", "n"]


def prose(seed: int, n: int) -> str:
    import random

    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 8))) for _ in range(n))


def rows() -> list[tuple]:
    """Nulls in each column, empty and white texts, copies, ties, repeated rows, near copies, a very long text."""
    a, b = prose(1, 120), prose(2, 90)
    near = " ".join([*a.split()[:117], "x", "y", "z"])
    texts = [
        (1, a), (2, a.upper()), (3, near), (4, b), (5, None), (6, ""), (7, "   \n\t "), (8, b + "\n" + a), (9, "short one"), (9, "short one"), (10, a), (10, prose(3, 60)), (None, b), (None, None),
        (11, "é" * 30 + " Über straße " + prose(4, 60) + " mail me.x@host.example.org or +1 (469) 555-8958 now, 10.0.0.255 and 300.1.1.1 and 4111 1111 1111 1111 or 4111111111111112"),
        (12, "All rights reserved. " + prose(5, 60) + " Licensed under CC BY-NC 4.0. GNU General Public License"), (13, (prose(6, 40) + "\n") * 4), (14, prose(7, 30_000)),
        (15, "token = \"0641917ea4e9feb9cda83477b57ac2654884f485\" " + prose(8, 55)), (16, "# * $ | " * 40), (17, "one two three " * 30), (18, "\x00\x1c weird   <|endoftext|> \U0001f600 " + prose(9, 60)),
    ]
    return [(i, t, None if k == 3 else "en", None if k == 4 else "src0", None if k == 5 else len(t or "")) + (None,) * len(NAMES) for k, (i, t) in enumerate(texts)]


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(n, T.StringType()) for n in NAMES)])


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """The odd rows as a table on disk, with clashing column names."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, 1 if k in (1, 4, 8, 10, 11, 12) else 0, 0) for k in (1, 4, 8, 10, 11, 12, 16, 17)] + [(None, 1, 0), (1, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")
