"""A corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm import decontam, jaccard, langid, packing, substring
from siltmark.llm.queries import tokenizer_files
from siltmark.session import delete, shared_folder, ship, table

#: A text whose language gets less than this much of its positions' probability is rejected, as is one without letters.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which a language is recognised.

    Each row is judged by its own text: rows without an id stay or go like any other, of rows with one id each goes its own way, repeated rows go alike. A null or empty
    text, or one without a letter, has no language and goes.
    """
    model = langid.fit(docs.filter(langid.remainder(docs["doc_id"], 3) != 1))
    return langid.recognised(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, that with the smallest id.

    Rows are compared by their own text, with or without an id; of rows equal in id and text one stays, of ties (the same smallest id twice) one; texts without words all stay.
    """
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document with a smaller id holds, and drop documents of which nothing is left.

    A row without an id counts as coming after all others; rows with one id take nothing from each other; null and empty texts go.
    """
    cut = substring.dedup(docs)
    kept = cut.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else kept


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold most of a benchmark item. Each row is judged by its own text, with or without an id; null and empty texts and repeated rows stay or go alike."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences, with the token ids of each piece. Repeated rows are packed each; a null text has only the end id; a row without an id keeps a null one."""
    return packing.pack(docs, *tokenizer_files(), with_ids=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packed),
]

#: SQL cannot express the recurrent network nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again in the checkpoint folder, and deleted once the next stage's are there."""
    ship(spark)
    out = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}-{name}")
        docs = spark.read.parquet(f"{out}/{k}-{name}")
        if k:
            delete(spark, [f"{out}/{k - 1}-{STAGES[k - 1][0]}"])
    return docs
