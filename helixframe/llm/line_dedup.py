"""Line dedup over overlapping windows of three lines, in Spark expressions.

Lines are what line ends part. Each window of ``width`` consecutive lines is known by two
64-bit hashes. Where a window occurs more than once in the table, all occurrences but the
first (by id, then line) mark the lines they cover, and marked lines go. Which windows
repeat is judged on the input, so that a line may go for any window it lies in.

Nulls: a null text stays null and has no lines; an empty text is one empty line. A text
of fewer lines than ``width`` has no window. Rows that share an id are one document in
no set order, so ids should be unique; a null id sorts first. Other columns are kept,
but columns named ``n_lines`` and ``n_removed`` are replaced. A very long text is worked on
as an array of its lines. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def repeated_windows(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Later occurrences of repeated windows: the id (a struct must not be null), ``line`` (from 0)."""
    lines = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.split(text_col, "\n").alias("lines")).where(F.size("lines") >= width)
    hashed = F.transform(F.sequence(F.lit(0), F.size("lines") - width), lambda i: F.struct(F.xxhash64(F.lit(1), *[F.get("lines", i + k) for k in range(width)]).alias("a"), F.xxhash64(F.lit(2), *[F.get("lines", i + k) for k in range(width)]).alias("b")))
    windows = written(lines.select("id", F.posexplode(hashed).alias("line", "w")).select("id", "line", "w.a", "w.b"), "windows")
    at = F.coalesce(F.col("id"), F.lit(-(2**63))) if docs.schema[id_col].dataType.typeName() != "struct" else F.col("id")
    first = windows.groupBy("a", "b").agg(F.min(F.struct(at.alias("id"), F.col("line"))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", F.col("first.id").alias("first_id"), F.col("first.line").alias("first_line"))
    return windows.join(first, ["a", "b"]).where((at != F.col("first_id")) | (F.col("line") != F.col("first_line"))).select("id", "line")


def dedup_lines(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` without its marked lines, and ``n_lines``, ``n_removed``.

    A document whose every line goes keeps its row, with an empty text.
    """
    covered = repeated_windows(docs, width, id_col, text_col).groupBy("id").agg(F.array_sort(F.collect_set("line")).alias("at")).select(F.col("id").alias("__id"), "at")
    reach = width
    firsts = F.filter("at", lambda x, i: (i == 0) | (x > F.get("at", i - 1) + reach))
    ends = F.transform(F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) > x + reach)), lambda x: x + width)
    runs = covered.select("__id", firsts.alias("firsts"), ends.alias("ends"))
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(id_col).alias("own"), F.col(text_col).alias("__text"))
    joined = rows.join(runs, rows["own"].eqNullSafe(runs["__id"]), "left")
    lines = F.split("__text", "\n")
    cuts = F.transform(F.sequence(F.lit(0), F.size("firsts")), lambda k: F.slice("__lines", F.coalesce(F.get("ends", k - 1), F.lit(0)) + 1, F.coalesce(F.get("firsts", k), F.size("__lines")) - F.coalesce(F.get("ends", k - 1), F.lit(0))))
    gone = F.aggregate(F.zip_with("ends", "firsts", lambda e, f: e - f), F.lit(0), lambda x, y: x + y)
    kept = F.when(F.col("firsts").isNull(), F.col("__text")).otherwise(F.array_join(F.flatten(cuts), "\n"))
    return (
        joined.withColumn("__lines", F.when(F.col("__text").isNotNull(), lines))
        .withColumn("__kept", kept)
        .withColumn("n_lines", F.coalesce(F.size("__lines"), F.lit(0)).cast("long"))
        .withColumn("n_removed", F.coalesce(gone, F.lit(0)).cast("long"))
        .select(*[F.col("__kept").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
    )


SQL = """
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, i AS line, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS win
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM lines WHERE len(l) >= 3)
), ranked AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY win ORDER BY doc_id, line) AS k FROM w
), gone AS (
  SELECT DISTINCT doc_id, line + d AS line FROM ranked, (VALUES (0), (1), (2)) t(d) WHERE k > 1
), each AS (
  SELECT doc_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS line FROM lines
), kept AS (
  SELECT e.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
         string_agg(e.s, chr(10) ORDER BY e.line) FILTER (WHERE g.line IS NULL) AS body
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.line = g.line GROUP BY e.doc_id
)
"""
