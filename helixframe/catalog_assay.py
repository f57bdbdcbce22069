"""Queries for pile-ups, selections of calls, training, error records and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, t
from .operators import calls, rules
from .plans import methylation, pileup, systematic_errors, training
from .storage import scratch_path
from .streaming import windows


@query("call_differences", """WITH x AS (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'tp' WHEN 1 THEN 'fp' ELSE 'fn' END AS c, CASE o_orderkey % 3 WHEN 0 THEN 'tp' WHEN 1 THEN 'fp' ELSE 'fn' END AS g, o_orderkey % 2 AS hmer, o_orderstatus FROM orders)
SELECT o_orderkey, c = 'tp' AND g = 'fp' AS fp_diff, c = 'tp' AND g = 'fn' AS fn_diff, hmer = 0 AND o_orderstatus = 'F' AS single, o_orderstatus = 'P' AS blacklisted FROM x""")
def call_differences(spark, d):
    three = lambda c: F.when(F.col(c) % 3 == 0, "tp").when(F.col(c) % 3 == 1, "fp").otherwise("fn")
    filters = F.when(F.col("o_orderstatus") == "P", "BLACKLIST;LOW").otherwise("PASS")
    return t(spark, d, "orders").select("o_orderkey", calls.genotype_only(three("o_custkey"), three("o_orderkey"), "fp").alias("fp_diff"), calls.genotype_only(three("o_custkey"), three("o_orderkey"), "fn").alias("fn_diff"), calls.outside_homopolymer(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 2, F.lit(1), single=True).alias("single"), calls.has_token(filters, "BLACKLIST").alias("blacklisted"))


@query("call_track", """WITH k AS (SELECT o_orderkey, o_custkey, coalesce(nullif(o_totalprice, 0), 1) AS s FROM orders WHERE o_orderstatus <> 'P'), c AS (SELECT quantile_cont(s, 0.1) AS cut FROM k)
SELECT 'chr' || o_custkey % 5 AS chrom, o_orderkey - 1 AS start, o_orderkey AS "end", o_custkey AS name, CASE WHEN s > cut THEN '0,0,255' ELSE '121,121,121' END AS colour FROM k, c""")
def call_track(spark, d):
    rows = t(spark, d, "orders").select(F.concat(F.lit("chr"), (F.col("o_custkey") % 5).cast("string")).alias("chrom"), F.col("o_orderkey").alias("pos"), "o_custkey", F.nullif("o_totalprice", F.lit(0.0)).alias("score"), F.when(F.col("o_orderstatus") == "P", "LOW_SCORE").otherwise("PASS").alias("filter"))
    return calls.as_track(calls.scored_above(rows, "score"), "o_custkey", F.col("above"))


@query("source_sets", "SELECT o_custkey, string_agg(DISTINCT x, ',' ORDER BY x) AS sources, count(DISTINCT o_orderkey) FILTER (WHERE o_totalprice <= 200000 OR o_orderstatus <> 'F') AS kept FROM (SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus, unnest([o_orderstatus, o_orderpriority]) AS x FROM orders) GROUP BY 1")
def source_sets(spark, d):
    rows = t(spark, d, "orders").withColumn("sources", F.array("o_orderstatus", "o_orderpriority", F.lit("")))
    kept = calls.supported(-F.col("o_totalprice"), F.array("o_orderstatus"), 200_000, "F")
    return rows.groupBy("o_custkey").agg(F.array_join(calls.source_set(F.col("sources")), ",").alias("sources"), F.count_distinct(F.when(kept, F.col("o_orderkey"))).alias("kept"))


@query("class_categories", "SELECT 'dbsnp' AS category, count(*) FILTER (WHERE l_returnflag = 'A') AS n FROM lineitem UNION ALL SELECT 'unknown', count(*) FILTER (WHERE l_returnflag = 'N') FROM lineitem UNION ALL SELECT 'blacklist', count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem")
def class_categories(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "tp").when(F.col("l_returnflag") == "N", "unknown").otherwise("fp")
    return calls.category_counts(t(spark, d, "lineitem").select(kind.alias("c")), "c")


@query("filter_ratios", "SELECT round(count(*) FILTER (WHERE l_quantity >= 10 AND l_tax < 0.05)::DOUBLE / count(*), 8) AS recall, round(count(*) FILTER (WHERE l_quantity >= 10)::DOUBLE / count(*), 8) AS second FROM lineitem")
def filter_ratios(spark, d):
    made = [{"name": "q", "field": "l_quantity", "op": "ge", "value": 10, "type": "quality"}, {"name": "tax", "field": "l_tax", "op": "lt", "value": 0.05, "type": "quality"}, {"name": "flag", "field": "l_returnflag", "op": "eq", "value": "A", "type": "label"}]
    steps = [r.asDict() for r in rules.funnel(t(spark, d, "lineitem"), made).orderBy("step").collect()]  # a row for each rule
    recall = rules.row_ratio(steps, {"type": "label"}, {"type": "quality"})
    return spark.range(1).select(F.round(F.lit(recall), 8).alias("recall"), F.round(F.lit(rules.row_ratio(steps, {"name": "tax"}, {"type": "raw"})), 8).alias("second"))


@query("pileup_reference_counts", """WITH x AS (SELECT p_partkey, ['A', 'C', 'G', 'T', 'N'][(p_partkey % 5 + 1)::INTEGER] AS r, p_size AS a, p_size % 7 AS c, NULL::INTEGER AS g, p_size % 3 AS t, p_size % 4 AS d FROM part)
SELECT p_partkey, CASE r WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN coalesce(g, 0) WHEN 'T' THEN t ELSE 0 END AS ref, a + c + t + d - CASE r WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'T' THEN t ELSE 0 END AS other FROM x""")
def pileup_reference_counts(spark, d):
    size, ref = F.col("p_size"), F.get(F.array(*map(F.lit, "ACGTN")), (F.col("p_partkey") % 5).cast("int"))
    own, other = pileup.reference_counts(ref, {"A": size, "C": size % 7, "G": F.lit(None).cast("int"), "T": size % 3, "DEL": size % 4})
    return t(spark, d, "part").select("p_partkey", own.alias("ref"), other.alias("other"))


@query("pileup_shares", "SELECT p_partkey AS pos, 'G' AS base, round((p_size % 5 + 1)::DOUBLE / (p_size + 20), 8) AS share FROM part")
def pileup_shares(spark, d):
    bases = F.concat(F.lit("..+1A,^]*"), F.repeat(F.lit("g"), F.col("p_size") % 5 + 1))
    rows = t(spark, d, "part").select(F.lit("c").alias("chrom"), F.col("p_partkey").alias("pos"), F.lit("t").alias("ref"), (F.col("p_size") + 20).alias("depth"), bases.alias("bases"))
    return pileup.substitution_shares(pileup.allele_counts(rows)).select("pos", "base", F.round("share", 8).alias("share"))


@query("neutral_points", "SELECT c_custkey AS pos FROM customer WHERE NOT EXISTS (SELECT 1 FROM part WHERE c_custkey >= p_partkey * 9 AND c_custkey < p_partkey * 9 + p_size % 5)")
def neutral_points(spark, d):
    spans = t(spark, d, "part").select(F.lit("c").alias("chrom"), (F.col("p_partkey") * 9).alias("start"), (F.col("p_partkey") * 9 + F.col("p_size") % 5).alias("end")).where("end > start")
    return pileup.neutral(t(spark, d, "customer").select(F.lit("c").alias("chrom"), F.col("c_custkey").alias("pos")), spans, 20).select("pos")


@query("low_background_ratio", """WITH x AS (SELECT p_partkey, (p_partkey % 3)::INTEGER AS g, (p_size % 10) / 20.0 AS v, (p_partkey % 4) / 20.0 AS b FROM part) SELECT p_partkey, CASE WHEN g <> 1 THEN false WHEN v = 0 THEN true WHEN b = 0 THEN false WHEN v / b >= 3 OR v >= 0.4 THEN false ELSE true END AS failed FROM x""")
def low_background_ratio(spark, d):
    shares = lambda x: F.array(x.cast("double"))
    one = F.struct(F.array(F.lit(0), (F.col("p_partkey") % 3).cast("int")).alias("gt"), shares((F.col("p_size") % 10) / 20).alias("vaf"), shares((F.col("p_partkey") % 4) / 20).alias("background"))
    return t(spark, d, "part").select("p_partkey", pileup.low_background_ratio(F.array(one), 3.0, 0.4).alias("failed"))


@query("control_methylation", "SELECT CASE WHEN event_type LIKE 'c%' THEN 'c' ELSE 'p' END AS genome, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS median FROM events WHERE event_type LIKE 'c%' OR event_type LIKE 'p%' GROUP BY 1")
def control_methylation(spark, d):
    out = methylation.control_percentages(t(spark, d, "events"), ["c", "p"], "event_type", "value")
    return out.select("genome", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median")])


@query("value_distribution", "WITH s AS (SELECT avg(value) AS a, stddev_samp(value) AS b, median(value) AS c FROM events) SELECT 'mean' AS metric, round(a, 6) AS value, 'all' AS detail FROM s UNION ALL SELECT 'std', round(b, 6), 'all' FROM s UNION ALL SELECT 'median', round(c, 6), 'all' FROM s")
def value_distribution(spark, d):
    return methylation.distribution(t(spark, d, "events"), "value", "all").withColumn("value", F.round("value", 6))


def _tail(k: str, n: str, p: str) -> str:
    return f"list_sum(list_transform(range({k}, {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))"


@query("error_records", f"""WITH x AS (SELECT p_partkey, 20 AS fr, p_size AS rr, (p_partkey % 6 + 1)::BIGINT AS fa, (p_size % 4 + 1)::BIGINT AS ra, p_partkey % 3 > 0 AS seen FROM part),
e AS (SELECT *, CASE WHEN seen THEN 3.0 / 103 ELSE 1.0 / 51 END AS pf, CASE WHEN seen THEN 2.0 / 52 ELSE 1.0 / 51 END AS pr, CASE WHEN seen THEN 6.0 / 157 ELSE 3.0 / 104 END AS pa FROM x),
p AS (SELECT p_partkey, {_tail('fa', '(fr + fa)', 'pf')} AS f, {_tail('ra', '(rr + ra)', 'pr')} AS r, {_tail('(fa + ra)', '(fr + rr + fa + ra)', 'pa')} AS a FROM e)
SELECT p_partkey, round(f, 8) AS p_forward, round(r, 8) AS p_reverse, round(f * r, 8) AS p_strand, round(f * r * 0.5, 8) AS p_scaled, round(greatest(f, r), 8) AS p_lesser, round(a, 8) AS p_alt FROM p""")
def error_records(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    actual = F.array(F.lit(20).cast("long"), size.cast("long"), key % 6 + 1, (size % 4 + 1).cast("long"))
    rows = t(spark, d, "part").select("p_partkey", actual.alias("actual"), F.array(F.lit(100.0), F.lit(50.0), F.lit(3.0), F.lit(2.0)).alias("expected"), (key % 3 > 0).alias("seen"), F.lit(True).alias("snp"), F.lit(0.5).alias("frequency"))
    out = systematic_errors.record(rows)
    return out.select("p_partkey", *[F.round(c, 8).alias(c) for c in ("p_forward", "p_reverse", "p_strand", "p_scaled", "p_lesser", "p_alt")])


@query("fold_training", "SELECT (l_partkey % 3)::INTEGER AS fold, count(*) AS n, true AS between, true AS right FROM lineitem GROUP BY 1")
def fold_training(spark, d):
    rows = t(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", (F.col("l_partkey") % 3).cast("int").alias("fold"), (F.col("l_quantity") > 25).alias("label"))
    features = ["l_quantity", "l_extendedprice", "l_discount"]
    models = training.fold_models(rows, features, "label", "fold", 3, rounds=3, depth=3)
    out = training.scored(rows, models, features, "fold")
    right = F.avg(((F.col("score") > 0.5) == F.col("label")).cast("double"))
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.every(F.col("score").between(0, 1)).alias("between"), (right > 0.95).alias("right"))


@query("call_qualities", "WITH x AS (SELECT p_partkey, (p_size + 1) / 100.0 AS a, 0.3 AS b, 0.2 AS c FROM part), y AS (SELECT *, list_reverse_sort([10 * log10(a), 10 * log10(b), 10 * log10(c)]) AS l FROM x) SELECT p_partkey, round(l[1] - l[2], 6) AS gq, round(10 * log10(b) - 10 * log10(a), 6) AS qual FROM y")
def call_qualities(spark, d):
    rows = t(spark, d, "part").select("p_partkey", ((F.col("p_size") + 1) / 100).alias("a"), F.lit(0.3).alias("b"), F.lit(0.2).alias("c"))
    return rows.select("p_partkey", *[F.round(x, 6).alias(n) for n, x in training.call_qualities(["a", "b", "c"]).items()])


def _streamed(spark, d, plan):
    """The result of a streaming plan over all events, whose last state is written batch by batch."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "stream")
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    plan(events).writeStream.outputMode("complete").foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", scratch_path(spark, "stream-state")).start().awaitTermination()
    return spark.read.parquet(path)


@query("stream_windows", "SELECT epoch_us(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01')) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    out = _streamed(spark, d, lambda e: windows.windowed(e, "ts", ["event_type"], "value", "1 day", "2 hours"))
    return out.select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sessions", """WITH s AS (SELECT user_id, epoch_us(ts) AS a, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), g AS (SELECT user_id, a, sum(CASE WHEN p IS NULL OR a >= p + 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS i FROM s)
SELECT user_id, min(a) AS start, count(*) AS n FROM g GROUP BY user_id, i""")
def stream_sessions(spark, d):
    out = _streamed(spark, d, lambda e: windows.sessions(e, "ts", "user_id", "6 hours", "1 hour"))
    return out.select("user_id", F.unix_micros("start").alias("start"), "n")
