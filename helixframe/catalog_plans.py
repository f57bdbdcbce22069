"""Queries for joins and grouping sets, variant annotation, concordance and copy numbers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, t
from .operators import relational
from .plans import concordance, copy_number, variants
from .sources import records, text_tables
from .storage import scratch_path


@query("small_cross", "SELECT n_nationkey, k FROM nation, (VALUES (0), (1), (2)) v(k)")
def small_cross(spark, d):
    return relational.with_each(t(spark, d, "nation").select("n_nationkey"), [0, 1, 2], "k")


@query("rollup_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, (grouping(l_returnflag) + grouping(l_linestatus))::INTEGER AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(spark, d):
    return relational.rolled_up(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], n=F.count(F.lit(1)), suppliers=F.count_distinct("l_suppkey"))


@query("cube_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n, (grouping(l_returnflag) + grouping(l_linestatus))::INTEGER AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, d):
    return relational.cubed(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], n=F.count(F.lit(1)))


@query("grouping_sets", "SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def grouping_sets(spark, d):
    return relational.grouped_by_sets(t(spark, d, "lineitem"), [["l_returnflag"], ["l_linestatus"]], n=F.count(F.lit(1)))


@query("top_per_group", "SELECT o_custkey, o_orderkey, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_per_group(spark, d):
    return relational.top(t(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("as_of_join", """WITH p AS (SELECT user_id, ts, max(event_id) AS last_purchase FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, p.last_purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def as_of_join(spark, d):
    ev = t(spark, d, "events")
    bought = ev.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return relational.last_before(ev.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", ["last_purchase"]).select("event_id", "last_purchase")


@query("map_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders")
def map_lookup(spark, d):
    return t(spark, d, "orders").select("o_orderkey", relational.looked_up(F.col("o_orderstatus"), {"F": 1, "O": 2}, 0).alias("code"))


# A reference made of parts: twenty letters for each, with some gaps.
_LETTERS = "translate(left(md5(p_partkey::VARCHAR), 20), '0123456789abcdef', 'AAAAACCGGGTTTNAC')"
_REF = f"ref AS (SELECT string_agg({_LETTERS}, '' ORDER BY p_partkey) AS s FROM part)"
_SITES = f"""{_REF}, site AS (SELECT DISTINCT (l_partkey * 17) % (20 * (SELECT count(*) FROM part) - 100) + 40 AS pos, l_linenumber % 3 AS kind FROM lineitem),
v AS (SELECT pos, kind, CASE kind WHEN 1 THEN substr(s, pos, 2) ELSE substr(s, pos, 1) END AS r, CASE kind WHEN 0 THEN 'T' WHEN 1 THEN substr(s, pos, 1) ELSE substr(s, pos, 1) || substr(s, pos + 1, 1) END AS a, s FROM site, ref)"""


def _pieces(spark, d):
    letters = F.translate(F.left(F.md5(F.col("p_partkey").cast("string").cast("binary")), F.lit(20)), "0123456789abcdef", "AAAAACCGGGTTTNAC")
    first = t(spark, d, "part").agg(F.min("p_partkey")).first()[0]
    return t(spark, d, "part").select(F.lit("ref").alias("chrom"), ((F.col("p_partkey") - first) * 20).alias("start"), letters.alias("seq"))


def _variants(spark, d, blocks, size):
    n = t(spark, d, "part").count()
    sites = t(spark, d, "lineitem").select(F.lit("ref").alias("chrom"), ((F.col("l_partkey") * 17) % (20 * n - 100) + 40).alias("pos"), (F.col("l_linenumber") % 3).alias("kind")).distinct()
    rows = variants.with_reference(sites, blocks, size)
    at = F.col("pos") - 1
    base, two, nxt = variants.bases_between(at, at + 1), variants.bases_between(at, at + 2), variants.bases_between(at + 1, at + 2)
    ref = F.when(F.col("kind") == 1, two).otherwise(base)
    alt = F.when(F.col("kind") == 0, "T").when(F.col("kind") == 1, base).otherwise(F.concat(base, nxt))
    return rows.select("chrom", "pos", "kind", ref.alias("ref"), F.array(ref, alt).alias("alleles"), (F.col("kind") > 0).alias("indel"))


@query("variant_annotation", f"""WITH {_SITES}, h AS (SELECT *, CASE kind WHEN 2 THEN length(regexp_extract(substr(s, pos + 1, 256), '^(A+|C+|G+|T+|N+)')) WHEN 1 THEN CASE WHEN substr(s, pos + 2, 1) = substr(s, pos + 1, 1) THEN 1 + length(regexp_extract(substr(s, pos + 2, 256), '^(A+|C+|G+|T+|N+)')) ELSE 0 END ELSE 0 END AS hmer FROM v)
SELECT pos, r AS ref, a AS alt, CASE kind WHEN 1 THEN 'del' WHEN 2 THEN 'ins' END AS indel_classify, (CASE kind WHEN 0 THEN 0 ELSE 1 END)::INTEGER AS indel_length, hmer::INTEGER AS hmer_indel_length, CASE WHEN hmer > 0 THEN substr(s, pos + 1, 1) END AS hmer_indel_nuc,
CASE WHEN kind > 0 THEN substr(s, pos - 4, 5) ELSE substr(s, pos - 5, 5) END AS left_motif, CASE WHEN kind = 0 THEN substr(s, pos + 1, 5) WHEN hmer > 0 THEN substr(s, pos + hmer + 1, 5) ELSE substr(s, pos + length(r), 5) END AS right_motif,
round(length(regexp_replace(substr(s, pos - 4, 10), '[AT]', '', 'g')) / 10.0, 6) AS gc FROM h""")
def variant_annotation(spark, d):
    blocks = variants.reference_blocks(_pieces(spark, d), 500)
    out = variants.annotated(_variants(spark, d, blocks, 500), blocks, size=500)
    return out.select("pos", "ref", F.get("alleles", F.lit(1)).alias("alt"), "indel_classify", "indel_length", "hmer_indel_length", "hmer_indel_nuc", "left_motif", "right_motif", F.round("gc_content", 6).alias("gc"))


@query("centred_motif", f"WITH {_SITES} SELECT pos, substr(s, pos - 3, 7) AS motif FROM v WHERE kind = 0")
def centred_motif(spark, d):
    blocks = variants.reference_blocks(_pieces(spark, d), 500)
    rows = variants.with_reference(_variants(spark, d, blocks, 500).where("kind = 0"), blocks, 500)
    return rows.select("pos", variants.centred_motif(3).alias("motif"))


@query("gap_share", f"""WITH {_REF}, i AS (SELECT DISTINCT l_partkey * 11 % (10 * (SELECT count(*) FROM part)) AS start, 50 + l_linenumber * 200 AS n FROM lineitem)
SELECT start, n::INTEGER AS n, round(length(regexp_replace(substr(s, start + 1, n), '[^N]', '', 'g')) / n::DOUBLE, 5) AS gap FROM i, ref WHERE start + n <= length(s)""")
def gap_share(spark, d):
    n = t(spark, d, "part").count()
    rows = t(spark, d, "lineitem").select(F.lit("ref").alias("chrom"), (F.col("l_partkey") * 11 % (10 * n)).alias("start"), (50 + F.col("l_linenumber") * 200).alias("n")).distinct().withColumn("end", F.col("start") + F.col("n")).where(F.col("end") <= 20 * n)
    return variants.gap_share(rows, _pieces(spark, d), ["start", "n"], 500).select("start", "n", "gap")


_MARKS = "['TP', 'FP', 'FP_CA', 'IGN', NULL]"
_EVALUATED = f"""e AS (SELECT o_orderkey, {_MARKS}[(o_custkey % 5 + 1)::INTEGER] AS call, ['TP', 'FN', 'FN_CA', 'OUT', NULL][(o_orderkey % 5 + 1)::INTEGER] AS base,
CASE WHEN o_custkey % 7 = 0 THEN [NULL, NULL]::INTEGER[] ELSE [(o_custkey % 2)::INTEGER, (o_custkey % 3)::INTEGER] END AS c, CASE WHEN o_orderkey % 7 = 0 THEN [NULL, NULL]::INTEGER[] ELSE [(o_orderkey % 3)::INTEGER, (o_orderkey % 2)::INTEGER] END AS g FROM orders)"""


def _evaluated(spark, d):
    pick = lambda key, *marks: F.get(F.array(*[F.lit(m) for m in marks]), (F.col(key) % 5).cast("int"))
    none = F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))
    gt = lambda key, a, b: F.when(F.col(key) % 7 == 0, none).otherwise(F.array((F.col(key) % a).cast("int"), (F.col(key) % b).cast("int")))
    return t(spark, d, "orders").select("o_orderkey", F.array(F.lit("A"), F.lit("C"), F.lit("G")).alias("alleles"), gt("o_custkey", 2, 3).alias("gt_called"), gt("o_orderkey", 3, 2).alias("gt_truth"), pick("o_custkey", "TP", "FP", "FP_CA", "IGN", None).alias("call"), pick("o_orderkey", "TP", "FN", "FN_CA", "OUT", None).alias("base"))


@query("concordance_classes", f"""WITH {_EVALUATED}, k AS (SELECT * FROM e WHERE NOT (coalesce(call = 'IGN', false) AND (base IS NULL OR base = 'OUT') OR call IS NULL AND coalesce(base = 'OUT', false))),
f AS (SELECT o_orderkey, base, c, CASE WHEN call = 'TP' AND (base IS NULL OR base = 'TP') THEN c WHEN call = 'FP_CA' AND (base IS NULL OR base = 'FN_CA') THEN CASE WHEN c[2] = 0 THEN [c[1], c[1]] WHEN c[1] = 0 THEN [c[2], c[2]] ELSE [c[1], 0] END ELSE g END AS g FROM k),
x AS (SELECT *, c[1] IS NULL AS nc, g[1] IS NULL AND g[2] IS NULL AS ng, list_filter(c, lambda v: v <> 0) AS co, list_filter(g, lambda v: v <> 0) AS go, len(list_filter(c, lambda v: v = 0)) AS cr, len(list_filter(g, lambda v: v = 0)) AS gr FROM f),
y AS (SELECT *, CASE WHEN nc THEN 'fn' WHEN ng THEN 'fp' WHEN len(list_intersect(co, go)) > 0 THEN 'tp' WHEN len(list_filter(co, lambda v: NOT list_contains(go, v))) > 0 THEN 'fp' ELSE 'fn' END AS a, CASE WHEN nc THEN 'fn' WHEN ng THEN 'fp' WHEN gr < cr THEN 'fn' WHEN gr > cr THEN 'fp' WHEN c <> g THEN 'fp' ELSE 'tp' END AS b FROM x),
z AS (SELECT *, CASE WHEN b = 'tp' AND a = 'fp' THEN 'fp' ELSE b END AS b2, coalesce(base IN ('FN', 'FN_CA'), false) AS lost FROM y),
w AS (SELECT o_orderkey, CASE WHEN lost AND a = 'fp' THEN 'fn' ELSE a END AS a, CASE WHEN lost AND b2 = 'fp' THEN 'fn' ELSE b2 END AS b, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS held FROM z)
SELECT o_orderkey, CASE WHEN NOT held THEN 'fn' ELSE a END AS classify, CASE WHEN NOT held AND a <> 'fn' THEN 'fn' ELSE b END AS classify_gt, held AS scored FROM w""")
def concordance_classes(spark, d):
    calls = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1.0).alias("score")).distinct()
    return concordance.classified(_evaluated(spark, d), calls, ["o_orderkey"]).select("o_orderkey", "classify", "classify_gt", F.col("score").isNotNull().alias("scored"))


@query("call_labels", f"""WITH {_EVALUATED} SELECT o_orderkey, CASE WHEN call = 'TP' THEN coalesce(c[1], 9) WHEN call = 'FP' THEN 0 WHEN call = 'FP_CA' THEN CASE CASE WHEN g[1] IS NULL OR g[2] IS NULL THEN 0 ELSE g[1] END WHEN 0 THEN 0 WHEN 1 THEN -2 ELSE 1 END ELSE -1 END::INTEGER AS a,
CASE WHEN call = 'TP' THEN coalesce(c[2], 9) WHEN call = 'FP' THEN 0 WHEN call = 'FP_CA' THEN CASE CASE WHEN g[1] IS NULL OR g[2] IS NULL THEN 0 ELSE g[2] END WHEN 0 THEN 0 WHEN 1 THEN -2 ELSE 1 END ELSE -1 END::INTEGER AS b FROM e""")
def call_labels(spark, d):
    ev = _evaluated(spark, d)
    rows = concordance.labelled(ev.select("o_orderkey", F.array(F.lit("A"), F.lit("G")).alias("alleles"), F.col("gt_called").alias("gt")), ev.select("o_orderkey", "alleles", F.col("gt_truth").alias("gt"), "call"), ["o_orderkey"])
    label = concordance.true_genotype(F.col("call"), F.col("gt"), F.col("alleles"), F.col("gt_eval"), F.col("alleles_eval"))
    return rows.select("o_orderkey", F.coalesce(F.get(label, F.lit(0)), F.lit(9)).alias("a"), F.coalesce(F.get(label, F.lit(1)), F.lit(9)).alias("b"))


@query("unmatched_marks", f"WITH {_EVALUATED} SELECT call, count(*) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1")
def unmatched_marks(spark, d):
    return concordance.unmatched(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), _evaluated(spark, d), ["o_orderkey"], "call")


@query("tight_breakpoints", """WITH c AS (SELECT o_custkey, o_orderkey % 5000 AS pos, o_orderkey % 5000 + 10000 + o_orderkey % 700 AS stop, (o_orderkey % 13)::INTEGER AS w FROM orders), o AS (SELECT *, min(pos) OVER g AS lo, max(stop) OVER g AS hi FROM c WINDOW g AS (PARTITION BY o_custkey)),
p AS (SELECT o_custkey, arg_min(pos, w * 100000 + pos) FILTER (WHERE abs(pos - lo) <= 2500) AS pos, arg_min(stop, w * 100000 - stop) FILTER (WHERE abs(stop - hi) <= 2500) AS stop FROM o GROUP BY 1) SELECT o_custkey, pos, stop AS "end" FROM p""")
def tight_breakpoints(spark, d):
    key = F.col("o_orderkey")
    rows = t(spark, d, "orders").select("o_custkey", (key % 5000).alias("pos"), (key % 5000 + 10000 + key % 700).alias("end"), F.lit(0).alias("ci_low"), (key % 13).cast("int").alias("ci_high"))
    return copy_number.tightest_breakpoints(rows, "o_custkey")


@query("split_read_support", """WITH r AS (SELECT o_orderkey, 1000 + o_custkey % 60 AS ps, 1100 + o_custkey % 60 AS pe, o_orderkey % 2 = 0 AS pl, 1950 + o_orderkey % 90 AS ss, 2050 + o_orderkey % 90 AS se, o_orderkey % 3 = 0 AS sl FROM orders),
f AS (SELECT *, abs(ss - 2000) <= 40 AND NOT (abs(ps - 1000) <= 40 AND NOT abs(ss - 2000) <= 40) AND NOT abs(ps - 2000) <= 40 AS fits FROM r)
SELECT o_orderkey, CASE WHEN NOT fits THEN NULL WHEN pl AND NOT sl THEN 'DUP' WHEN NOT pl AND sl THEN 'DEL' END AS kind, CASE WHEN NOT fits THEN NULL WHEN pl AND NOT sl THEN se - ps WHEN NOT pl AND sl THEN ss - pe END AS insert FROM f""")
def split_read_support(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    read = lambda start, length, left: F.struct(F.lit("c").alias("chrom"), F.lit(False).alias("reverse"), start.alias("start"), (start + length).alias("end"), left.alias("left"), (~left).alias("right"))
    rows = t(spark, d, "orders").select("o_orderkey", read(1000 + cust % 60, 100, key % 2 == 0).alias("p"), F.array(read(1950 + key % 90, 100, key % 3 == 0)).alias("s"))
    return rows.select("o_orderkey", copy_number.read_support(F.col("p"), F.col("s"), F.lit(1000), F.lit(2000), 40).alias("x")).select("o_orderkey", "x.kind", "x.insert")


@query("repeat_copies", """WITH b AS (SELECT (least(floor((l_partkey % 100) / 100.0 / 0.05), 19) + 0.5) * 0.05 AS bucket, l_quantity AS depth, l_returnflag = 'R' AS rep FROM lineitem), r AS (SELECT bucket, depth, row_number() OVER (PARTITION BY bucket ORDER BY depth) AS k, count(*) OVER (PARTITION BY bucket) AS n FROM b WHERE NOT rep),
p AS (SELECT bucket, avg(depth) AS base FROM r WHERE k > round_even(n * 0.1, 0) AND k <= n - round_even(n * 0.1, 0) GROUP BY 1), a AS (SELECT depth, row_number() OVER (ORDER BY depth) AS k, count(*) OVER () AS n FROM b WHERE NOT rep), o AS (SELECT avg(depth) AS overall FROM a WHERE k > round_even(n * 0.1, 0) AND k <= n - round_even(n * 0.1, 0))
SELECT round(avg(depth * overall / base) / max(overall) * 2 * 6, 4) AS copies FROM b LEFT JOIN p ON round(b.bucket, 6) = round(p.bucket, 6), o WHERE rep""")
def repeat_copies(spark, d):
    rows = t(spark, d, "lineitem").select(((F.col("l_partkey") % 100) / 100.0).alias("gc"), F.col("l_quantity").cast("double").alias("depth"), "l_returnflag")
    return copy_number.repeat_copies(rows.where("l_returnflag <> 'R'"), rows.where("l_returnflag = 'R'"), 6).select(F.round("copies", 4).alias("copies"))


@query("marker_calls", """WITH m AS (SELECT p_partkey, (p_size % 11)::DOUBLE AS a, 10.0::DOUBLE AS n, (p_partkey % 11)::DOUBLE AS b, CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE 10.0 END::DOUBLE AS k FROM part), s AS (SELECT *, CASE WHEN a / n < 0.1 THEN 'r' WHEN a / n > 0.9 THEN 'v' ELSE 'h' END AS x, CASE WHEN k = 0 THEN NULL WHEN b / k < 0.1 THEN 'r' WHEN b / k > 0.9 THEN 'v' ELSE 'h' END AS y FROM m)
SELECT p_partkey, CASE WHEN y IS NOT NULL AND x <> y THEN 'Marker sites disagree' WHEN x = 'r' THEN 'Homozygous REF markers call' WHEN x = 'v' THEN 'Homozygous ALT markers call' ELSE 'Heterozygous markers call' END AS kind, CASE WHEN x = 'h' AND (y IS NULL OR y = 'h') THEN round(20 * (a + b) / (n + k), 6) END AS alt FROM s""")
def marker_calls(spark, d):
    n = F.when(F.col("p_partkey") % 5 == 0, 0.0).otherwise(10.0)
    out = copy_number.marker_call(F.array((F.col("p_size") % 11).cast("double"), (F.col("p_partkey") % 11).cast("double")), F.array(F.lit(10.0), n), F.lit(20.0))
    return t(spark, d, "part").select("p_partkey", out.alias("x")).select("p_partkey", "x.kind", F.round("x.alt", 6).alias("alt"))


@query("record_tools", """WITH r AS (SELECT DISTINCT l_returnflag AS chrom, l_partkey AS pos, l_linestatus AS s FROM lineitem), u AS (SELECT chrom, pos, CASE WHEN s = 'F' AND pos % 2 = 0 THEN 'LOW;even' WHEN s = 'F' THEN 'LOW' WHEN pos % 2 = 0 THEN 'even' ELSE 'PASS' END AS filter FROM r WHERE chrom IN ('A', 'N') AND pos BETWEEN 10 AND 150)
SELECT chrom, pos, filter, p_size AS size FROM u LEFT JOIN part ON pos = p_partkey""")
def record_tools(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("CHROM"), F.col("l_partkey").alias("POS"), F.when(F.col("l_linestatus") == "F", "LOW").otherwise("PASS").alias("FILTER"))
    kept = records.selected(rows, exclude="CHROM = 'R'", regions=[("A", 10, 150), ("N", 10, 150), ("R", 1, 150)])
    both = records.without_duplicates(records.concatenated([kept.where("FILTER = 'LOW'"), kept.where("FILTER = 'PASS'")], ["N", "A"]))
    sizes = t(spark, d, "part").select(F.explode(F.array(F.lit("A"), F.lit("N"))).alias("CHROM"), F.col("p_partkey").alias("POS"), F.col("p_size").alias("size"))
    out = records.with_tag(records.marked(both, "even", "POS % 2 = 0"), sizes, "size")
    return out.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.col("FILTER").alias("filter"), "size")


@query("record_counts", "SELECT count(*) AS n, count(*) FILTER (WHERE l_linestatus <> 'F') AS passing FROM lineitem")
def record_counts(spark, d):
    rows = t(spark, d, "lineitem").select(F.when(F.col("l_linestatus") == "F", "LOW").otherwise("PASS").alias("FILTER"))
    return records.record_count(rows).crossJoin(records.record_count(rows, passing=True).withColumnRenamed("n", "passing"))  # one row each


@query("coverage_metrics", "SELECT 'WgsMetrics' AS class, 'MEAN' AS name, round(avg(l_quantity), 6) AS value FROM lineitem UNION ALL SELECT 'histogram', l_linenumber::VARCHAR, count(*)::DOUBLE FROM lineitem GROUP BY 2")
def coverage_metrics(spark, d):
    path = scratch_path(spark, "metrics")
    li = t(spark, d, "lineitem")
    mean = li.agg(F.concat(F.lit("## htsjdk\n## METRICS CLASS\tpicard.WgsMetrics\nMEAN\tNAME\n"), F.round(F.avg("l_quantity"), 6).cast("string"), F.lit("\tx\n\n## HISTOGRAM\tjava.lang.Integer\ncoverage\tcount\n")).alias("a"))
    bins = li.groupBy("l_linenumber").count().agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", F.col("l_linenumber").cast("string"), F.col("count").cast("string")))), "\n").alias("b"))
    mean.crossJoin(bins).select(F.concat("a", "b").alias("value")).coalesce(1).write.text(path)  # one row
    metrics, histogram = records.read_coverage_metrics(spark, path)
    return metrics.where("value IS NOT NULL").union(histogram.select(F.lit("histogram"), F.col("bin").cast("string"), "n"))


@query("merged_contexts", "SELECT l_returnflag AS chrom, l_partkey AS start, (l_linenumber + l_suppkey % 9)::BIGINT AS coverage FROM lineitem")
def merged_contexts(spark, d):
    path = scratch_path(spark, "contexts")
    t(spark, d, "lineitem").select(F.concat_ws("\t", "l_returnflag", F.col("l_partkey").cast("string"), (F.col("l_partkey") + 2).cast("string"), F.lit("50"), F.col("l_linenumber").cast("string"), (F.col("l_suppkey") % 9).cast("string")).alias("value")).write.text(path)
    return records.read_merged_contexts(spark, path).select("chrom", "start", "coverage")


@query("store_keys", "SELECT DISTINCT o_orderstatus FROM orders")
def store_keys(spark, d):
    path = scratch_path(spark, "keyed")
    text_tables.write_keyed(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, "o_orderstatus")
    return records.store_keys(spark, path, "o_orderstatus")
