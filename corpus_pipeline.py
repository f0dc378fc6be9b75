"""A corpus through quality rules, quality classifier, line dedup, near-duplicate removal and packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import classifier, line_dedup, packing, quality_rules, simhash
from sluice.llm.common import Written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 7). Null and empty texts have no word and go; repeated rows have one verdict; no rows give none; all columns stay, nulls in others too."""
    return quality_rules.keep_good(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more (operator 3), trained on the labels of documents at hand.

    Null and empty texts are scored as texts without words; ties at 0.5 stay; repeated rows get one score; no rows give none."""
    return classifier.keep_better(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that others hold as well (operator 2); those left without a word go. n_chars follows the text.

    Null texts and texts without a word stay as they are; rows with a null id and rows with one id and unlike texts are documents of their own; no rows give none."""
    return line_dedup.keep_new_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 10, shingles of five words): that with the smallest id, null being the last.

    Of repeated rows one stays; texts without a word are copies of each other; no rows give none."""
    return simhash.keep_one(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in packed sequences (operator 5), with their ids (little-endian, unsigned, 32 bits each).

    Null and empty texts give the closing id alone; repeated rows are packed each; no rows give none. Other columns, whatever their names, are not looked at."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("quality_rules", rules), ("quality_classifier", quality), ("line_dedup", new_lines), ("simhash_near_dedup", one_of_each), ("packing", sequences)]

#: No SQL has the classifier, the fingerprints or the tokenizer; tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each but the last is written to the shared folder and read again."""
    written = Written(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            last, docs = docs, written(out)
            if i:
                written.drop(last)
    return out
