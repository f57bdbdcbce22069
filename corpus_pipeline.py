"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes what a stage
gives as Parquet in the shared folder and reads it again for the next. Decisions are made
for rows, by a key over all their columns, so that null and repeated ids stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontamination, line_dedup, packing, quality, simhash
from helixframe.llm.queries import END_ID, SEQUENCE, TOKENIZER
from helixframe.llm.shared import row_key, tables, written

#: Encoded parts that a worker keeps; it holds what the stages before packing left as well.
KEPT_PARTS = 400_000


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__row", row_key(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, as low quality or toxic, go."""
    rows = _keyed(docs)
    marked = quality.classify(rows, tables(spark, sf_dir, "labels"), carried=("__row",))
    return rows.join(marked.where(~F.col("keep")).select("__row").distinct(), "__row", "left_anti").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; every document stays."""
    rows = _keyed(docs).withColumn("__at", F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "__row"))
    return line_dedup.dedup_lines(rows, id_col="__at").withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (nulls last)."""
    rows = _keyed(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    first = simhash.near_copies(rows, carried=("__row",)).groupBy("component").agg(F.min_by("__row", order).alias("__row")).select("__row")
    return rows.join(first, "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold eight words in a row of a benchmark item, or a whole shorter one, go."""
    rows = _keyed(docs)
    found = decontamination.contamination(rows, tables(spark, sf_dir, "benchmark"), least_items=1, id_col="__row")
    return rows.join(found.where("contaminated").select("__row").distinct(), "__row", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of all documents in the training sequences."""
    pieces = packing.tokenized_pieces(docs, TOKENIZER, END_ID, SEQUENCE, plain=True, keep=KEPT_PARTS)
    digests = written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pipeline-pieces")
    return packing.pack_best_fit(digests, SEQUENCE)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the classifier's fit, SimHash links or packing; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
