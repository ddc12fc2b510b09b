"""A training corpus in five stages, each over what the stage before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, packing, quality, secrets, simhash
from millrace.llm.common import bucket, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from labelled rows outside the held-out fold.

    Null and empty texts are scored like any other; repeated rows stay or go together. Empty tables give no rows; extra columns go.
    """
    held_out = bucket(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), held_out)
    scored = quality.score(docs.select(*COLUMNS), model, name="_score")
    return scored.where(F.col("_score") >= quality.THRESHOLD).select(*COLUMNS)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, the one with the smallest id (of rows with that id, the text with the least hash).

    Documents are linked from a Jaccard similarity of 0.8 of their five-word shingles, checked exactly. Rows that share an id but
    whose texts are not alike are in different classes, and each stays; of rows with equal id and text, one. Empty and null
    texts are one class. A class without any id keeps a row, too. Empty tables give no rows; extra columns go.
    """
    named = lambda key, th: (F.coalesce(key, F.lit(0)).alias("key"), key.isNull().alias("no_key"), th.alias("th"))
    kept = simhash.representatives(simhash.similar(docs)).select(*named(F.col("doc_id"), F.col("th")))
    # Partial sums take care of ids and texts that very many rows repeat.
    rows = docs.groupBy(*named(F.col("doc_id"), F.xxhash64("text"))).agg(F.min(F.struct("doc_id", "text", "lang", "source", "n_chars")).alias("x"))
    return rows.join(kept, ["key", "no_key", "th"]).select("x.*").select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark window occurs in; null and empty texts stay, as do repeated rows. Empty tables give no rows; extra columns go."""
    hits = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=("text", "lang", "source", "n_chars"))
    return hits.where("n_hit = 0").select(*COLUMNS)


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in the place of secrets; n_chars is counted anew where there are any. Null texts without any stay null. Extra columns go."""
    found = secrets.scan(docs, keep=("text", "lang", "source", "n_chars"))
    text = secrets.redacted(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed training sequences, one row for each piece, with its ids; a null or empty text is its end id alone. Empty tables give no rows."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("near_duplicates", single),
    ("decontamination", clean),
    ("secrets", safe),
    ("packing", sequences),
]

#: The classifier's scores and the tokenizer's ids can't be had in SQL; tests compare with a plain version instead.
ORACLE_SQL = None


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that run() wrote, in whatever file system the path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next.

    A stage's table goes once the next one is written, as nothing reads it any more; the last one stays for the caller.
    """
    at = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{at}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            dropped(spark, f"{at}/{i - 1}_{STAGES[i - 1][0]}")
    return docs
