"""Work on tables of VCF records, and smaller text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calls import is_pass
from .text_tables import vcf_header


def tag_numbers(spark: SparkSession, path: str, kind: str = "INFO") -> dict[str, str]:
    """How many values each tag has, as the header says: a number, A, R, G or a dot."""
    return {tag: m["num"] for tag, m in vcf_header(spark, path)[kind].items()}


def record_count(records: DataFrame, passing: bool = False) -> DataFrame:
    """(n): records, or those that pass."""
    kept = records.where(is_pass(F.col("FILTER"))) if passing else records
    return kept.agg(F.count(F.lit(1)).alias("n"))


def selected(records: DataFrame, include: str | None = None, exclude: str | None = None, regions: list[tuple[str, int, int]] = ()) -> DataFrame:
    """Records that satisfy the expressions and lie in one of the regions (closed, from 1); the
    regions become a filter that reaches the scan."""
    out = records.where(include) if include else records
    out = out.where(~F.coalesce(F.expr(exclude), F.lit(False))) if exclude else out
    if regions:
        inside = F.lit(False)
        for chrom, low, high in regions:
            inside |= (F.col("CHROM") == chrom) & F.col("POS").between(low, high)
        out = out.where(inside)
    return out


def marked(records: DataFrame, token: str, where: str) -> DataFrame:
    """``token`` is added to the filter of the records that satisfy ``where``."""
    now = F.when(is_pass(F.col("FILTER")), token).otherwise(F.concat_ws(";", "FILTER", F.lit(token)))
    return records.withColumn("FILTER", F.when(F.expr(where), now).otherwise(F.col("FILTER")))


def in_order(records: DataFrame, contigs: list[str]) -> DataFrame:
    """Records by the header's order of contigs, then position: a range sort, not one task."""
    place = F.array_position(F.array(*[F.lit(c) for c in contigs]), F.col("CHROM"))
    return records.orderBy(F.when(place > 0, place).otherwise(len(contigs) + 1), "CHROM", "POS")


def concatenated(parts: list[DataFrame], contigs: list[str]) -> DataFrame:
    """All records of some tables; tags that a table lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return in_order(out, contigs)


def without_duplicates(records: DataFrame) -> DataFrame:
    """Records that are equal in all columns once."""
    return records.dropDuplicates()


def with_tag(records: DataFrame, values: DataFrame, tag: str, keys: list[str] = ("CHROM", "POS")) -> DataFrame:
    """``records`` with ``tag`` from a table of values by key; null where it has none."""
    return records.drop(tag).join(values.select(*keys, tag), list(keys), "left")


def read_coverage_metrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metrics, histogram) of a metrics file: (class, name, value) of its one table row, and
    (bin, n). A file is small, and its lines are taken as one text."""
    doc = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("l"))
    at = lambda text: F.array_position(F.transform("l", lambda x: x.startswith(text)), True).cast("int")
    head = doc.select("l", at("## METRICS CLASS").alias("m"), at("## HISTOGRAM").alias("h"))
    names, values = F.split(F.get("l", F.col("m")), "\t"), F.split(F.get("l", F.col("m") + 1), "\t")
    kind = F.element_at(F.split(F.get(F.split(F.get("l", F.col("m") - 1), "\t"), F.lit(1)), r"\."), -1)
    metrics = head.where("m > 0").select(kind.alias("class"), F.explode(F.arrays_zip(names.alias("name"), values.alias("value"))).alias("x")).select("class", "x.name", F.col("x.value").try_cast("double").alias("value"))
    rows = head.where("h > 0").select(F.explode(F.slice("l", F.col("h") + 2, F.size("l"))).alias("line")).where("trim(line) <> ''")
    p = F.split("line", "\t")
    return metrics, rows.select(F.get(p, F.lit(0)).cast("long").alias("bin"), F.get(p, F.lit(1)).cast("double").alias("n"))


def read_merged_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Methylation by merged context: chrom, start, end, percent, methylated, unmethylated, coverage."""
    kinds = "chrom string, start long, end long, percent double, methylated long, unmethylated long"
    rows = spark.read.option("sep", "\t").schema(kinds).csv(path).where("start IS NOT NULL")
    return rows.withColumn("coverage", F.col("methylated") + F.col("unmethylated"))


def store_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key): the keys of a keyed store, from its folders."""
    return spark.read.parquet(path).select(key).distinct()
