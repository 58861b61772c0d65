"""A corpus pipeline of five stages over documents; each stage's result is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelore.llm import decontaminate, line_dedup, mixing, quality, simhash
from framelore.llm.common import drop_since, mark, save
from framelore.llm.queries import remainder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows outside the held-out fold, scores a half or more.

    Null text is scored as no text; repeated rows are kept or go together; an empty table gives an empty one.
    """
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1)
    return quality.keep_good(docs, quality.train(docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines; n_chars of the text that is left.

    Null text stays null; a null source is a source; each row counts for its source, repeated ones too; empty: empty.
    """
    out = line_dedup.drop_boilerplate_lines(docs)
    n = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one with the smallest id.

    Null and empty texts are copies of each other; rows with null id stay; repeated rows stay once; empty: empty.
    """
    return simhash.deduplicate(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Null and empty texts hold none; rows with null id stay; an empty benchmark keeps all.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken.

    One row for each row, repeated ones too; null text has size 0, a null source is a source; empty: empty.
    """
    return mixing.mix_digest(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("mixing", mixing_stage),
]

#: The classifier's training and the near-duplicate search can't be put into SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents; what the stages before it wrote is deleted on the way.

    Nulls, empty texts, repeated rows and empty tables give what each stage's operator gives for them.
    """
    docs, place = table(spark, sf_dir, "documents"), mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, f"stage{k}")
            drop_since(spark, place, keep=docs)
    return docs
