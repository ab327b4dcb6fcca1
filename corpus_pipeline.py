"""From raw documents to packed training sequences, in four stages.

Every stage works on all rows its predecessor kept; between stages the rows are written as Parquet in
the shared folder and read again.  All stages but the last return the columns of ``documents``.  Tables
that a stage's result reads go with the caller's ``scratch``; a caller without one keeps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesselon.llm import langid, minhash, packing, pii, store
from tesselon.llm.queries import tokenizer_file


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: store.Scratch | None = None) -> DataFrame:
    """Documents without any letter go; ``lang`` becomes the predicted language of the rest."""
    store.small_batches(spark)
    return langid.relabel(docs, langid.fit(docs, ~langid.held_out()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: store.Scratch | None = None) -> DataFrame:
    """Of each group of documents with five-word shingle similarity 0.8 and more, the smallest id stays.

    Rows that repeat an id and a text are one document; different texts under one id are documents of
    their own.  Rows without an id stay.
    """
    store.small_batches(spark)
    own = scratch or store.Scratch(spark)
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        found = minhash.groups(docs, width=5, similar=80, scratch=own)
        gone = own.written(found.filter("not kept and doc_id is not null").select("doc_id").distinct(), "gone")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    once = docs.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(docs.filter("doc_id is null"))
    rows = own.written(once.withColumn("_row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "rows")
    found = minhash.groups(rows, key="_row", width=5, similar=80, scratch=own).filter("_row is not null").select("_row", "component_id")
    found = found.join(rows.select("_row", F.struct("doc_id", F.xxhash64("text").alias("text"), "_row").alias("place")), "_row")
    stays = found.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place._row").alias("_row"))
    gone = own.written(found.select("_row").join(stays, "_row", "left_anti"), "gone")
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: store.Scratch | None = None) -> DataFrame:
    """Spans of personal data are replaced by marks of their kinds; ``n_chars`` follows."""
    store.small_batches(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: store.Scratch | None = None) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    store.small_batches(spark)
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", remove_personal_data),
    ("packing", pack_sequences),
]

#: Not for SQL: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage read goes once it is done."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with store.Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            with store.Scratch(spark) as own:
                rows = scratch.written(stage(spark, rows, sf_dir, own), name)
            scratch.drop(1)
        name, stage = STAGES[-1]
        return store.written(stage(spark, rows, sf_dir), name)
