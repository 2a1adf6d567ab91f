"""Training-data pipeline over `documents`: five stages, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import decontaminate, language, line_dedup, near, packing
from recordloom.llm.common import release, stage
from recordloom.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter in them) go."""
    named = language.identify(docs, language.train(docs), keep=COLUMNS)
    return named.filter(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold go; the rest is each document's text from here on, and n_chars its length."""
    kept = line_dedup.line_dedup(docs, with_text=True, carry=("lang", "source", "n_chars"))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates meet by SimHash balls and by minima of shingles, and are judged by whole sets. Of each group one row stays: that with the smallest doc_id (null last), of those the first."""
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), "near-rows")
    grouped = near.groups(rows).join(rows.select("row", "doc_id"), "row")
    kept = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least")).select("least.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's windows contaminate go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontaminate.decontaminate(docs, items, carry=COLUMNS[1:])
    return judged.filter(~F.col("contaminated")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language id", identify_language),
    ("line dedup", drop_common_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: The stages learn and tokenise, which SQL can't express: a test holds the rows of run() against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), None
    for name, step in STAGES:
        made = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            release(last)
        docs = last = made
    return docs
