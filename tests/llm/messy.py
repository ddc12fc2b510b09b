"""Rows that operators must bear: nulls, empty and very long texts, repeated rows, columns with clashing names."""

import datetime

from pyspark.sql import DataFrame, SparkSession

LONG = "lorem Ipsum dolor sit amet " * 40_000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, score double, _row bigint, hash string, _text string, n_hit bigint, spans string, at timestamp"
TEXTS = [None, "", " \t\n ", "one", "ONE two", LONG, "Some text that is the same as another text here.", "Some text that is the same as another text here.", "\x00 null byte", "Überall é 日本語 \U0001f600 <|endoftext|>", 'token = "deadbeefdeadbeefdeadbeef00"', "1 2 3 !!! ???"]


def docs(spark: SparkSession) -> DataFrame:
    row = lambda i, t, n: (i, t, None if n % 3 else "en", None if n % 2 else f"s{n}", None, 1, 0.5, 7, "h", "x", 3, "y", datetime.datetime(2020, 1, 1))
    rows = [row(n if n != 3 else None, t, n) for n, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[6], rows[3]], SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
