"""Fixtures of the corpus operators: the small documents table with odd rows added."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def odd_rows(texts: list[str]) -> list[tuple]:
    """Nulls, empty, white-space-only, short, very long, repeated and tied rows."""
    long = " ".join(texts[k % 40] for k in range(400))
    rows = [
        (900_001, None, None, None, None), (900_002, "", "en", "src1", 0), (900_003, " \t\n ", "en", None, 4),
        (900_004, "one", "en", "src1", 3), (900_005, "one two", None, "src1", 7), (900_006, "ONE two  three", "en", "src2", 14),
        (900_007, long, "en", "src0", len(long)), (900_008, long + " end", "en", "src0", len(long) + 4),
        (900_009, "a" * 5000, "en", "src3", 5000), (900_010, "ab" * 3000, "de", "src3", 6000),
        (900_011, "x   y\n\n\nz  ", "fr", "zzz", 12), (900_012, "12 345 !! éß中文 \U0001f600", "es", "src4", 20),
        (900_013, "pre <|endoftext|> post", "en", "src5", 22), (900_014, "Café İstanbul", "en", "src5", 14),
        (900_015, "12345 !!", "en", "src5", 8), (900_016, texts[3], "en", "src9", 1), (900_016, texts[3], "en", "src9", 1),
        (900_016, texts[4], "en", "src9", 1), (None, texts[5], "en", "src9", 1), (None, texts[6] + " q", None, "src9", 1),
        (900_017, texts[7].replace("e", "E"), "en", "src9", 1), (900_018, "pre " + texts[8], "en", "src9", 1),
        (900_019, texts[8][50:400] + "é" + texts[9][40:390], "en", "src9", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def plain_rows(spark):
    """The small table's rows as tuples."""
    return [tuple(r) for r in spark.read.schema(SCHEMA).parquet(f"{SMALL}/documents.parquet").collect()]


@pytest.fixture(scope="session")
def rows(plain_rows):
    texts = [r[1] for r in plain_rows if r[1] and len(r[1]) > 500]
    return plain_rows + odd_rows(texts)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with extra columns named like the operators' own."""
    names = ("shard", "size", "row", "n", "cls", "sig", "taken", "component_id", "spans", "tie", "length", "lang_pred", "_maybe")
    df = docs
    for n in names:
        df = df.withColumn(n, docs["n_chars"])
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
