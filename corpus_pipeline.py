"""Five stages from raw documents to a mixed corpus; each is one operator of planforge.llm.

In all stages null and empty texts are clean, and rows are told by id and text together: a null id, or one that several
texts share, is no reason to go. Rows that repeat both go or stay together, but for near-dedup, after which one is left.
Empty tables pass through; columns beside those of documents are not kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planforge.llm import decontaminate, lines, mixing, quality, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SIMILAR = 0.8


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go."""
    return quality.keep_selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat earlier ones go, and documents that had words and have none left."""
    out = lines.drop_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.regexp_replace("text", r"[ \t-\r]+", "") == "")
    return out.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: within two bits, or five-word shingles of Jaccard similarity SIMILAR."""
    return simhash.drop_near(docs, similar=SIMILAR).select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document that the mix takes, with how often it does (copies) and the words that makes (taken)."""
    return mixing.mixed(docs).select(*COLUMNS, "copies", "taken", "target")


STAGES = [
    ("quality classifier", select_quality),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mix_sources),
]

#: The first stage samples by a fitted model and the third walks a graph; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written to the shared folder and read back."""
    from planforge.llm.common import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
