"""From documents to packed training sequences, in five stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import discard, materialize, tables_written
from mosaiq.llm.mixing import mixed_rows
from mosaiq.llm.near_duplicates import without_near_duplicates
from mosaiq.llm.packing import pack
from mosaiq.llm.quality_rules import clean
from mosaiq.llm.queries import tokenizer_path
from mosaiq.llm.substrings import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and from the others the lines that too many documents of their source have.

    Null and empty texts have no words and are rejected. Rows that share an id are judged one by one,
    equal ones alike; a null id is judged like any; a null source is a source of its own. n_chars is
    counted anew where lines went. Whole texts are judged, however long; columns beside COLUMNS are
    dropped; an empty table gives an empty result.
    """
    out = clean(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the one with the smallest id, unchanged.

    Rows that share an id but not their text are different documents, and stay both unless their texts
    are near duplicates; of several rows with the smallest id of a group, the smallest hash of the text
    decides, then the other columns. Rows without a word link with nothing and stay, and so do rows
    without an id. An empty table gives an empty result.
    """
    return without_near_duplicates(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id has are cut out; other texts stay as they are, null too.

    A text that loses words has the rest joined by spaces, and n_chars counted anew. Rows with equal
    ids take nothing from one another; rows without an id neither lose nor take; all rows stay. An
    empty table gives an empty result.
    """
    out = remove_repeats(docs, carry=["lang", "source", "n_chars"], keep_layout=True)
    cut = F.col("n_removed") > 0
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(cut, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, at most twice, the last time perhaps in part; n_chars counted anew.

    Texts without a word, null ones too, are never taken. A null source is a source of its own; rows
    with equal or null ids are drawn one by one. An empty table gives an empty result.
    """
    out = mixed_rows(docs, COLUMNS)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their ids.

    Every row is packed, as often as it comes; null and empty texts have their end alone; null ids are
    kept. An empty table gives no piece.
    """
    return pack(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("near-duplicate removal", near_dedup), ("substring removal", substring_dedup), ("source mixing", mix), ("packing", packing)]

#: Near duplicates, passages and tokenization have no SQL; tests hold each stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. A stage's scratch tables go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = tables_written()
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs, f"stage-{number}")
            discard(spark, mark, (docs,))
    return docs
