"""The corpus pipeline: quality rules, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import mixing, near_copies, packing, quality_rules, shared

#: Near-duplicates of the pipeline: five-word shingles; SimHashes this near are compared besides MinHash candidates.
WORDS, DISTANCE = 5, 6
#: Exact Jaccard similarity of the shingles from which on texts are near copies.
ALIKE = 0.8
#: Up to so many rows to drop go to all tasks (16 bytes each); more are joined by shuffle.
FEW = 1_000_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written with a number each, so that ids may be null or repeat."""
    (row,) = shared.fresh(docs, "row")
    return shared.materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that neither the base rules nor a learned one rejects.

    Null, empty and blank texts have no words and go; repeated rows are judged alike; without labels of both kinds the base rules
    alone judge. An empty table gives no rows.
    """
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near copies.

    Null, empty and blank texts are copies of each other, so one such row stays; of repeated rows one stays. Texts of any length
    are read whole; ids may be null or repeat; an empty table gives no rows.
    """
    docs, row = _numbered(docs)
    later = near_copies.later_rows(docs.select(F.col(row).alias("doc_id"), "text"), WORDS, DISTANCE, ALIKE).withColumnRenamed("doc_id", row)
    later = F.broadcast(later) if later.count() <= FEW else later
    return docs.join(later, row, "left_anti").select(*(f"`{c}`" for c in docs.columns if c != row))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as their words in the mix come nearest to: none, once or twice.

    Documents without words stay once; repeated rows are taken one by one; null sources are a source. A source's words differ from
    its target by half a document at most where its taken stretch begins and where it ends. An empty table gives no rows.
    """
    docs, row = _numbered(docs)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    (copy,) = shared.fresh(docs, "copy")
    with shared.passing(spark):
        mixed = mixing.mix(shared.materialise(mixing.sizes(docs, row), "sizes"))
        taken = mixed.select(F.col("doc_id").alias(row), times.alias(copy)).where(F.col(copy) > 0)
        taken = shared.materialise(taken, "taken", keep=True)
    # Shuffled at every size: the taken documents grow with the table.
    out = docs.join(taken.hint("merge"), row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
    return out.select(*(f"`{c}`" for c in docs.columns if c != row))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins for all documents of the mix, a row for each piece.

    Repeated rows are pieces of their own, in bins of their own, as they are one cluster; empty documents are pieces without words; documents
    over a bin's size fill bins of their own, and their rest is packed. An empty table gives no rows.
    """
    return packing.pack(packing.rows_of(docs))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]
#: The learned rules have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.materialise(docs, f"stage-{name}")
    return docs
