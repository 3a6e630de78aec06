import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, put on the inputs to see that they do no harm.
CLASHING = ["size", "shard", "slot", "bucket", "key", "kind", "rank", "comp", "target", "taken", "group", "host", "n", "_rules", "_e", "_id", "_text", "n_tokens", "ids", "archive"]


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéřghiklmnoprstuv") for _ in range(r.randint(1, 9))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): plain, copies, near copies, shared passages, repeats, empty, null, long, odd."""
    passage, base = words(1, 70), words(2, 150)
    rows = [(k, words(100 + k, 20 + 7 * k), f"s{k % 4}") for k in range(12)]
    rows += [(12, base, "s0"), (13, base, "s1"), (14, base.replace(" ", "  ", 1), "s1"), (15, base + " tail", "s2"), (16, "x" + base, None)]
    rows += [(17, words(3, 30) + " " + passage + " " + words(4, 30), "s0"), (18, passage, None), (19, words(5, 9) + "\n" + passage + passage, "s3"), (20, passage[5:120], "s0")]
    rows += [(21, None, "s0"), (22, "", "s1"), (23, "   \n\t ", None), (24, "one two", "s0"), (25, "One Two", "s0"), (26, "a", "s2"), (27, "ab " * 60, "s1"), (28, "z" * 5000, "s2")]
    rows += [(29, "line\n" * 40 + words(6, 40), "s3"), (30, "🇩🇪 naïve <|endoftext|> 数据 don't  stop\r\n\x00 12345", "s0"), (31, "# * $ | < >" * 9, "s1"), (32, words(7, 20000), "s0")]
    rows += [(33, words(2, 150), "s0"), (33, words(2, 150), "s0"), (34, words(8, 60), "s1"), (34, words(9, 60), "s1"), (None, words(10, 40), "s0"), (None, words(2, 150), "s2"), (None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(d, t, "en" if d else None, s, len(t) if t else None) for d, t, s in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labelled(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
