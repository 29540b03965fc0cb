"""From documents to token ids: a pipeline of five stages.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; the
result is written as Parquet and read again as the next one's docs. All stages but the
last return the columns of documents.

Defined cases: a null or empty text and a text without a letter have no language and go in the
first stage, other short texts in the second; a null language is judged by the nearest
reference, a null source is a source of its own; rows of one id are told apart by their text,
repeated rows and equal texts are one class, of which one row stays, ties by text; texts of any
length are processed whole; an empty table gives an empty result at every stage; extra columns,
whatever their names, are kept up to the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalkit.llm import bpe, langid, mixing, near_dup, quality
from evalkit.llm.common import bound_batches, fresh, materialize, read_table
from evalkit.llm.queries import tokenizer_file


def columns_of(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence."""
    bound_batches(spark)
    row = fresh(docs, "row")
    rows = docs.select("text", F.struct(*columns_of(docs)).alias(row))
    return langid.predict(rows, langid.train(docs)).filter(~F.col("rejected")).select(f"{row}.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence from their language's references keep."""
    bound_batches(spark)
    row = fresh(docs, "row")
    rows = docs.select("text", "lang", F.struct(*columns_of(docs)).alias(row))
    return quality.judge(rows).filter("kept").select(f"{row}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id."""
    bound_batches(spark)
    return near_dup.deduplicate(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    bound_batches(spark)
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, the offsets of their pre-tokens, and whether they decode to the text."""
    bound_batches(spark)
    encoded = bpe.encode_documents(docs.select("doc_id", "source", "text"), tokenizer_file("byte_bpe_50k.tiktoken"))
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "offsets",
                          same.alias("round_trip"))


STAGES = [("language ID", language_id), ("quality rules", quality_rules), ("MinHash near-dedup", near_duplicates),
          ("mixing sources", source_mix), ("byte-level BPE", byte_bpe)]

#: SQL cannot express the trained and sampled stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return docs
