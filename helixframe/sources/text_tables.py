"""Text formats as tables. Intervals come out half-open from 0 whatever the file has.

Lines are read by Spark's text reader, so files may lie in any store and are split among
tasks; headers, which are small, are taken by the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reshape import cast_tag, explode_ragged, list_stats, missing

_FIELD = re.compile(r"##(INFO|FORMAT)=<ID=([^,]+),Number=([^,]+),Type=([^,]+),Description=\"(.*?)\"")
_SET = re.compile(r"\{([A-Z](?:,[A-Z])*)\}")
FIXED = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER")


def vcf_header(spark: SparkSession, path: str) -> dict:
    """INFO and FORMAT tags (num, type, cat: a sorted category list or None), samples, contigs."""
    lines = [r[0] for r in spark.read.text(path).where(F.col("value").startswith("#")).collect()]  # a header
    out: dict = {"INFO": {}, "FORMAT": {}, "samples": [], "contigs": {}}
    for line in lines:
        if m := _FIELD.match(line):
            cats = _SET.search(m[5])
            out[m[1]][m[2]] = {"num": m[3], "type": m[4], "cat": sorted(cats[1].split(",")) if cats else None}
        elif m := re.match(r"##contig=<ID=([^,>]+)(?:,length=(\d+))?", line):
            out["contigs"][m[1]] = int(m[2]) if m[2] else None
        elif line.startswith("#CHROM"):
            out["samples"] = line.rstrip("\n").split("\t")[9:]
    return out


def _info(tag: str, flag: bool) -> Column:
    text = F.concat(F.lit(";"), F.col("__info"), F.lit(";"))
    if flag:
        return F.when(F.contains(text, F.lit(f";{tag};")), "1")
    found = F.regexp_extract(text, f";{re.escape(tag)}=([^;]*);", 1)
    return F.when(found != "", found)


def read_vcf(spark: SparkSession, path: str, header: dict | None = None, drop_info: list[str] = (), drop_format: list[str] = (), mode: str = "explode", sample: str | None = None, expand: dict[str, int] | None = None) -> DataFrame:
    """Records of a VCF with typed INFO and FORMAT columns.

    ``explode``: a row for each place of the FORMAT lists; ``aggregate``: a row a record
    with statistics of each list; ``raw``: lists as text. Numbers that are missing are 0,
    flags are "1" or null. Only the columns that are used are ever cut from the lines.
    """
    header = header or vcf_header(spark, path)
    if mode not in ("explode", "aggregate", "raw"):
        raise ValueError(f"unknown mode {mode}")
    info = {k: v for k, v in header["INFO"].items() if k not in drop_info}
    fmt = {k: v for k, v in header["FORMAT"].items() if k not in drop_format}
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(parts.alias("p"))
    column = 9 + (header["samples"].index(sample) if sample else 0)
    base = rows.select(*[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(FIXED)], F.get("p", F.lit(7)).alias("__info"), F.split(F.get("p", F.lit(8)), ":").alias("__keys"), F.split(F.get("p", F.lit(column)), ":").alias("__vals"))
    at = lambda tag: F.get("__vals", F.array_position("__keys", tag).cast("int") - 1)
    base = base.select(
        F.col("CHROM"), F.col("POS").cast("bigint").alias("POS"), missing(F.col("ID")).alias("ID"), F.col("REF"), F.col("ALT"), F.coalesce(F.col("QUAL").try_cast("double"), F.lit(0.0)).alias("QUAL"), missing(F.col("FILTER")).alias("FILTER"),
        *[(_info(t, m["type"] == "Flag") if m["type"] == "Flag" else cast_tag(_info(t, False), m["type"] if m["num"] == "1" else "String")).alias(t) for t, m in info.items()],
        *[F.when(F.array_contains("__keys", t), missing(at(t))).alias(f"__f_{t}") for t in fmt],
    )
    lists = [t for t, m in fmt.items() if m["num"] not in ("0", "1")]
    single = [t for t in fmt if t not in lists]
    out = base.withColumnsRenamed({f"__f_{t}": t for t in fmt})
    out = out.withColumns({t: cast_tag(F.col(t), fmt[t]["type"]) for t in single})
    for tag, size in (expand or {}).items():
        if fmt.get(tag, {}).get("num") in (None, "0", "1"):
            raise ValueError(f"{tag} is no list")
        out = out.withColumns({f"{tag}_{i}": cast_tag(F.get(F.split(F.coalesce(F.col(tag), F.lit("")), ","), F.lit(i)), fmt[tag]["type"]) for i in range(size)})
    keep = [t for t in lists if t not in (expand or {})]
    if mode == "explode" and keep:
        out = explode_ragged(out, keep, place="place").drop("place", *(expand or {}))
        return out.withColumns({t: cast_tag(F.col(t), fmt[t]["type"]) for t in keep})
    if mode == "aggregate":
        for tag in keep:
            if fmt[tag]["type"] in ("Integer", "Float"):
                out = list_stats(out, tag).drop(tag)
    return out.drop(*(expand or {}))


def as_variants(records: DataFrame) -> DataFrame:
    """``alleles`` as an array and ``indel``."""
    alleles = F.concat(F.array("REF"), F.split("ALT", ","))
    return records.withColumn("alleles", alleles).withColumn("indel", F.size(F.array_distinct(F.transform("alleles", lambda a: F.length(a)))) > 1)


def write_vcf(df: DataFrame, path: str, header: list[str], info: list[str], sample: str | None = None) -> None:
    """Records as VCF lines in a text dataset, sorted; the header is its own part, first in order."""
    field = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string")))
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    joined = F.concat_ws(";", *map(field, info)) if info else F.lit("")
    line = F.concat_ws("\t", "CHROM", F.col("POS").cast("string"), dot("ID"), "REF", "ALT", dot("QUAL"), F.coalesce("FILTER", F.lit("PASS")), F.when(joined == "", ".").otherwise(joined), *([F.lit("GT"), dot("GT")] if sample else []))
    lines = df.orderBy("CHROM", "POS").select(line.alias("value"))
    head = df.sparkSession.createDataFrame([(x,) for x in [*header, "#" + "\t".join([*FIXED, "INFO", *(["FORMAT", sample] if sample else [])])]], "value string").coalesce(1)
    head.union(lines).write.mode("overwrite").text(path)


def read_bed(spark: SparkSession, path: str, names: list[str] = ("name", "score"), longer_than: int | None = None) -> DataFrame:
    p = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser|@)") & (F.col("value") != ""))
    out = lines.select(F.get(p, F.lit(0)).alias("chrom"), F.get(p, F.lit(1)).cast("bigint").alias("start"), F.get(p, F.lit(2)).cast("bigint").alias("end"), *[F.get(p, F.lit(3 + i)).alias(n) for i, n in enumerate(names)])
    return out if longer_than is None else out.where(F.col("end") - F.col("start") > longer_than)


def write_bed(df: DataFrame, path: str, columns: list[str] = ()) -> None:
    df.orderBy("chrom", "start").select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns]).alias("value")).write.mode("overwrite").text(path)


def read_interval_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(intervals, sequences): from 1 and closed in the file, from 0 and half-open here."""
    lines = spark.read.text(path).where("value <> ''")
    p = F.split("value", "\t")
    data = lines.where(~F.col("value").startswith("@")).select(F.get(p, F.lit(0)).alias("chrom"), (F.get(p, F.lit(1)).cast("bigint") - 1).alias("start"), F.get(p, F.lit(2)).cast("bigint").alias("end"), F.get(p, F.lit(3)).alias("strand"), F.get(p, F.lit(4)).alias("name"))
    seqs = lines.where(F.col("value").startswith("@SQ")).select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chrom"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("bigint").alias("length"))
    return data, seqs


def as_interval_list(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("start") + 1)


SAM = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments with ``pos`` from 0 and tags as a map of text."""
    p = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    tags = F.map_from_entries(F.transform(F.slice(p, F.lit(12), F.greatest(F.size(p) - 11, F.lit(0))), lambda x: F.struct(F.substring(x, 1, 2), F.regexp_extract(x, "^[^:]+:[^:]+:(.*)$", 1))))
    ints = {"flag", "pos", "mapq", "pnext", "tlen"}
    cols = [F.get(p, F.lit(i)).cast("int" if n in ints else "string").alias(n) for i, n in enumerate(SAM)]
    return lines.select(*cols, tags.alias("tags")).withColumn("pos", F.col("pos") - 1)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Reads of a FASTQ: four lines each, a file at a time as one record separator allows."""
    text = spark.read.option("lineSep", "\n@").text(path)
    p = F.split(F.regexp_replace("value", "^@", ""), "\n")
    return text.where("value <> ''").select(F.get(p, F.lit(0)).alias("name"), F.get(p, F.lit(1)).alias("seq"), F.get(p, F.lit(3)).alias("qual"))


def quality_by_position(reads: DataFrame) -> DataFrame:
    """(position, quality, n, share) over all bases."""
    each = reads.select(F.posexplode(F.filter(F.split("qual", ""), lambda x: x != "")).alias("position", "c"))
    n = each.groupBy("position", (F.ascii("c") - 33).alias("quality")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("__t"))), how="cross").withColumn("share", F.col("n") / F.col("__t")).drop("__t")


def read_mpileup(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", "\t")
    return spark.read.text(path).where("value <> ''").select(F.get(p, F.lit(0)).alias("chrom"), F.get(p, F.lit(1)).cast("bigint").alias("pos"), F.get(p, F.lit(2)).alias("ref"), F.get(p, F.lit(3)).cast("int").alias("depth"), F.get(p, F.lit(4)).alias("bases"), F.get(p, F.lit(5)).alias("quals"))


def clean_metrics(df: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """Metric names without brackets, a leading percent sign as PCT_, numeric values only."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(F.col(name)), r"^%\s*", "PCT_"), r"[()]", "")
    return df.select(F.regexp_replace(F.regexp_replace(clean, "%", "PCT_"), " ", "_").alias(name), F.trim(F.col(value).cast("string")).try_cast("double").alias(value)).where(F.col(value).isNotNull())


def shortlist(df: DataFrame, names: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row for each listed metric, null where it is missing."""
    listed = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], f"place int, {name} string")
    return listed.join(df.groupBy(name).agg(F.first(value).alias(value)), name, "left").orderBy("place").select(name, value)


def read_metric_csv(spark: SparkSession, path: str) -> DataFrame:
    return clean_metrics(spark.read.schema("metric string, value string").csv(path))


def json_histograms(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(key, bin, n) of the arrays that a statistics JSON has under ``keys``."""
    schema = T.StructType([T.StructField(k, T.ArrayType(T.DoubleType())) for k in keys])
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    parts = [doc.select(F.lit(k).alias("key"), F.posexplode(F.col("d")[k]).alias("bin", "n")) for k in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sectioned_log(spark: SparkSession, path: str, sep: str = r"\|") -> DataFrame:
    """(line, section, name, value) of a key/value log whose headings have no separator. One
    log is one file of bounded length, so its lines are ordered in one task."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    p = F.split("text", sep)
    rows = lines.where("trim(text) <> ''").select("line", F.trim(F.get(p, F.lit(0)), F.lit(" \t\r")).alias("a"), F.trim(F.get(p, F.lit(1)), F.lit(" \t\r")).alias("b"))
    w = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(F.when(F.col("b").isNull() | (F.col("b") == ""), F.regexp_replace("a", ":$", "")), ignorenulls=True).over(w)).where("b <> ''").select("line", "section", F.col("a").alias("name"), F.col("b").alias("value"))


def monitor_log(spark: SparkSession, path: str) -> DataFrame:
    """MONITORING lines as samples; fields that are no number are 0."""
    p = F.split(F.regexp_extract("value", r"MONITORING,?\s*(.*)$", 1), r",\s*")
    num = lambda i, n: F.coalesce(F.regexp_extract(F.get(p, F.lit(i)), r"(-?[0-9.]+)", 1).try_cast("double"), F.lit(0.0)).alias(n)
    return spark.read.text(path).where(F.col("value").contains("MONITORING")).select(F.get(p, F.lit(0)).try_cast("timestamp").alias("time"), num(1, "cpu"), num(2, "memory"), num(3, "io_read"), num(4, "io_write"), num(5, "io_wait"))


def write_keyed(df: DataFrame, path: str, key: str) -> None:
    """A keyed store: one Parquet folder a key. Reading some keys reads only their folders."""
    df.write.mode("append").partitionBy(key).parquet(path)


def read_keyed(spark: SparkSession, path: str, key: str, keys: list[str] | None = None, skip: list[str] = (), columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.where(F.col(key).isin(keys)) if keys is not None else df
    df = df.where(~F.col(key).isin(*skip)) if skip else df
    return df.select(key, *columns) if columns else df


def to_nested_json(df: DataFrame, group: str, name: str, value: str) -> DataFrame:
    """(group, json): the group's names and values as one object."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name), F.col(value)))))
    return df.groupBy(group).agg(F.to_json(entries).alias("json"))
