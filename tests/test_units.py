"""Single operators on inline rows."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import dna, encoders, genotype, numeric, special
from helixframe.operators import folds, graph, intervals, merge, metrics, reshape, rules
from helixframe.plans import annotators, cohort, flow, recalibration, signal
from helixframe.sources import text_tables


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_rule_masks_follow_sql_nulls(spark):
    df = spark.createDataFrame([(10, "A", None), (None, "B", 2.0), (30, None, None)], "score long, kind string, x double")
    count = lambda r: rules.passing(df, [r]).count()
    assert count({"field": "score", "op": "ge", "value": 10}) == 2
    assert count({"field": "kind", "op": "not_in", "values": ["A", None]}) == 1
    assert count({"field": "x", "op": "is_null"}) == 2
    assert count({"fields": ["score", "x"], "op": "any_not_null"}) == 3


def test_rule_parsing_and_checks():
    assert rules.parse_rule("name=q:field=score:op=in:value=1,2.5,x:type=quality") == {"name": "q", "field": "score", "op": "in", "type": "quality", "values": [1, 2.5, "x"]}
    assert rules.parse_downsample("random:10:3") == {"method": "random", "size": 10, "seed": 3}
    for bad in ({"filters": [{"op": "eq", "value": 1}]}, {"filters": [{"field": "a", "op": "xx"}]}, {"downsample": {"method": "head", "size": 0}}):
        with pytest.raises(ValueError):
            rules.check_rules(bad)


def test_stats_merge(spark):
    df = spark.range(10).withColumnRenamed("id", "v")
    text = rules.stats_json(df, {"filters": [{"field": "v", "op": "lt", "value": 4, "name": "low"}]})
    both = json.loads(rules.merge_stats([text, text]))
    assert both["filters"][1]["funnel"] == 8 and both["combinations"] == {"0": 12, "1": 8}


def test_random_downsample_is_stable(spark):
    df = spark.range(100).withColumnRenamed("id", "v")
    pick = lambda: [r[0] for r in rules.downsample(df.repartition(7), [], {"method": "random", "size": 9, "seed": 1}, ["v"]).collect()]
    assert len(pick()) == 9 and pick() == pick()


def test_ragged_lists(spark):
    df = spark.createDataFrame([(1, "1,2,.", "7"), (2, None, "")], "k int, a string, b string")
    assert [tuple(r) for r in reshape.explode_ragged(df, ["a", "b"]).orderBy("k", "place").collect()] == [(1, 0, "1", "7"), (1, 1, "2", None), (1, 2, None, None), (2, 0, None, None)]
    s = reshape.list_stats(spark.createDataFrame([("1,0,.,1e5,4",), (".",)], "a string"), "a").collect()
    assert tuple(s[0])[1:] == (1.666667, 0.0, 4.0, 3, 1) and tuple(s[1])[1:] == (None, None, None, 0, 0)


def test_nearest_and_coverage(spark):
    p = spark.createDataFrame([("1", 5), ("1", 50), ("2", 5)], "chrom string, pos long")
    iv = spark.createDataFrame([("1", 10, 20, "a"), ("1", 44, 49, "b")], "chrom string, start long, end long, name string")
    assert [tuple(r) for r in intervals.nearest(p, iv).orderBy("chrom", "pos").collect()] == [("1", 5, "a", 5), ("1", 50, "b", 2), ("2", 5, None, None)]


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    found = {r[0]: r[1] for r in graph.components(e).collect()}
    assert set(found[i] for i in range(1, 41)) == {1} and found[101] == 100


def test_accuracy_of_empty_classes(spark):
    df = spark.createDataFrame([("tp",), ("tp",), ("tp",), ("fp",), ("fn",)], "c string")
    r = metrics.accuracy(df, [], "c").first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"]) == (3, 1, 1, 0.75, 0.75, 0.75)
    assert metrics.accuracy(df.limit(0), [], "c").first()["precision"] == 1.0


def test_collapse_keeps_the_best(spark):
    df = spark.createDataFrame([(1, "1", 100, 200, 5.0), (2, "1", 105, 206, 9.0), (3, "1", 900, 950, 1.0)], "id long, chrom string, start long, end long, q double")
    out = {r["id"]: list(r["members"]) for r in merge.collapsed(df, "id", 10, 0.8, [F.col("q").desc()]).collect()}
    assert out == {2: [1, 2], 3: [3]}


def test_sequences(spark):
    r = one(spark, dna.reverse_complement(F.lit("ACGTNacg")), dna.run_length(F.lit("ACCCG"), F.lit(1)), dna.alignment_end(F.lit(10), F.lit("5S10M2D3I4M")), dna.longest_clip(F.lit("5S10M7S")), dna.clip_position(F.lit(10), F.lit("5S10M7S")))
    assert tuple(r) == ("cgtNACGT", 3, 26, 7, 20)
    assert dna.flow_key_of("TTGCA") == [2, 1, 1, 1] and len(dna.all_substitutions()) == 192
    assert dna.pileup_counts_of("A", ".,$^Fg+2acT*") == {"A": 2, "G": 1, "+AC": 1, "T": 1, "*": 1}
    assert one(spark, dna.key_sequence(F.array(F.lit(2), F.lit(0), F.lit(1))))[0] == "TTC"
    assert [r[0] for r in spark.createDataFrame([("TGCA",), ("N",)], "s string").select(dna.flow_key(F.col("s"))).collect()] == [[1, 1, 1, 1], None]


def test_numbers(spark):
    p = F.lit(0.01)
    r = one(spark, numeric.phred(p), numeric.unphred(F.lit(20.0)), numeric.safe_ratio(F.lit(1), F.lit(0)), numeric.bracket(F.lit(1.5), [1, 2, 3], [10, 20, 40]), numeric.mean_over_folds(F.array(F.lit(0.9), F.lit(None), F.lit(0.9))))
    assert [round(x, 9) for x in r] == [20.0, 0.01, 0.0, 15.0, 0.9]


def test_genotypes(spark):
    r = one(spark, genotype.pl_index(F.lit(2), F.lit(1)), genotype.gt_of_index(F.lit(4)), genotype.pl_subset(F.array(*map(F.lit, [5, 1, 9, 3, 7, 8])), F.array(F.lit(0), F.lit(2))), genotype.indel_kind(F.array(F.lit("ACC"), F.lit("A"))))
    assert (r[0], r[1], r[2], tuple(r[3])) == (4, [1, 2], [2, 0, 5], ("del", 2))
    assert genotype.genotype_order(2) == [(0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2)]


def test_encoders(spark):
    r = one(spark, encoders.motif_code(F.lit("ATX"), True), encoders.strand_category(F.lit(0.5)), encoders.filled_end_tag(F.lit(None), F.lit("Q")))
    assert tuple(r) == (21, "MIXED", "END_UNREACHED")


def test_probabilities():
    assert math.isclose(special.log_binomial(4, 2, 0.5), math.log(6 / 16))
    assert math.isclose(special.binomial_tail(3, 10, 0.3), sum(math.exp(special.log_binomial(10, k, 0.3)) for k in range(3, 11)))
    k = special.detection_threshold(1000, 0.001, 0.01)
    assert special.binomial_tail(k, 1000, 0.001) < 0.01 <= special.binomial_tail(k - 1, 1000, 0.001)
    assert special.library_size(10, 10) is None and special.multinomial_ratio([2, 2], [1, 1]) == 1.0


def test_folds():
    m = folds.manifest({"a": 10, "b": 9, "c": 5, "d": 1}, 2)
    assert m == {"test": ["d"], "folds": {"a": 0, "b": 1, "c": 1}}
    with pytest.raises(ValueError):
        folds.check_manifest(m, {"z": 1})


def test_grid_mass_and_monotone(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("v"))
    assert math.isclose(recalibration.grid_array(recalibration.on_grid(df, "v", 0, 90, 31), 31).sum(), 1000)
    assert recalibration.monotone(np.array([1.0, 3.0, 2.0, 4.0])).tolist() == [1.0, 2.5, 2.5, 4.0]
    signal_ = np.zeros(101)
    signal_[50] = 1
    assert math.isclose(recalibration.convolved(signal_, recalibration.gaussian(2.0, 1.0)).sum(), 1, rel_tol=1e-9)


def test_smoothed_quality_rises(spark):
    df = spark.range(4000).select((F.col("id") % 60).cast("double").alias("s"), ((F.col("id") % 60) + (F.col("id") % 7) * 8 > 50).alias("y"))
    _, q = recalibration.smoothed_quality(df, "s", "y", 2.0, cells=256)
    assert (np.diff(q) >= 0).all() and q[-1] > q[0]


def test_flow_matrix(spark):
    df = spark.createDataFrame([(1, [[0.1, 0.7], [0.9, 0.3]])], "k int, m array<array<double>>")
    r = df.select(flow.best_path(F.col("m")), flow.path_log2(F.col("m"), flow.best_path(F.col("m")))).first()
    assert r[0] == [1, 0] and math.isclose(r[1], math.log2(0.9) + math.log2(0.7))
    assert flow.sparse(df, "m", 0.5).count() == 2


def test_outliers_and_detection(spark):
    rows = [("s", i, 9 if i == 30 else 0, 100.0) for i in range(60)]
    df = spark.createDataFrame(rows, "sig string, pos int, reads int, cov double")
    assert [r["pos"] for r in signal.outlier_loci(df, ["sig"], ["pos"], "reads", "cov", 41, 0.05).collect()] == [30]
    f = spark.createDataFrame([("matched", 30, 10000), ("control", 1, 10000)], "k string, supporting_reads long, corrected_coverage long")
    assert signal.detection(f, "k", "matched", "control")["detected"]


def test_annotators(spark):
    class Twice(annotators.Annotator):
        def expressions(self, df):
            return {"twice": F.col("id") * 2}

    out = annotators.annotate(spark.range(3), [Twice(), annotators.Scorer(lambda x: x["twice"] * 1.0, ["twice"])])
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(0, 0, 0.0), (1, 2, 2.0), (2, 4, 4.0)]


def test_two_class_cutoff(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 1.1, 0.9, 2.0, 2.1)], "x double")
    assert math.isclose(cohort.two_class_cutoff(df, "x").first()["cutoff"], 1.55)


VCF = """##fileformat=VCFv4.2
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">
##INFO=<ID=DB,Number=0,Type=Flag,Description="Known">
##INFO=<ID=PREV,Number=1,Type=String,Description="Base before {A,C,G,T}">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=RL,Number=.,Type=Integer,Description="Lengths">
##contig=<ID=chr1,length=1000>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1
chr1\t10\t.\tA\tC\t30\tPASS\tDP=7;DB;PREV=G\tGT:RL\t0/1:5,6,.
chr1\t20\trs1\tAT\tA\t.\t.\tPREV=.\tGT:RL\t1/1:9
"""


def test_vcf(spark, tmp_path):
    path = tmp_path / "a.vcf"
    path.write_text(VCF)
    head = text_tables.vcf_header(spark, str(path))
    assert head["INFO"]["PREV"]["cat"] == ["A", "C", "G", "T"] and head["samples"] == ["S1"] and head["contigs"] == {"chr1": 1000}
    rows = text_tables.read_vcf(spark, str(path)).orderBy("POS", "RL").collect()
    assert [(r["POS"], r["RL"], r["DP"], r["DB"], r["PREV"]) for r in rows] == [(10, 0, 7, "1", "G"), (10, 5, 7, "1", "G"), (10, 6, 7, "1", "G"), (20, 9, 0, None, None)]
    agg = text_tables.read_vcf(spark, str(path), mode="aggregate", drop_info=["DP"]).orderBy("POS").first()
    assert (agg["RL_mean"], agg["RL_count"]) == (5.5, 2) and "DP" not in agg.asDict()
    assert [r["indel"] for r in text_tables.as_variants(text_tables.read_vcf(spark, str(path), mode="raw")).orderBy("POS").collect()] == [False, True]


def test_intervals_sam_fastq_metrics(spark, tmp_path):
    (tmp_path / "a.interval_list").write_text("@SQ\tSN:1\tLN:50\n1\t11\t20\t+\tx\n")
    data, seqs = text_tables.read_interval_list(spark, str(tmp_path / "a.interval_list"))
    assert tuple(data.first())[:3] == ("1", 10, 20) and tuple(seqs.first()) == ("1", 50)
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nr1\t0\t1\t11\t60\t5M\t*\t0\t0\tACGTA\tIIIII\tNM:i:2\tRG:Z:a:b\n")
    r = text_tables.read_sam(spark, str(tmp_path / "a.sam")).first()
    assert r["pos"] == 10 and r["tags"] == {"NM": "2", "RG": "a:b"}
    (tmp_path / "a.fastq").write_text("@r1\nAC\n+\nI!\n@r2\nA\n+\nI\n")
    reads = text_tables.read_fastq(spark, str(tmp_path / "a.fastq"))
    assert sorted(map(tuple, reads.collect())) == [("r1", "AC", "I!"), ("r2", "A", "I")]
    assert {(r[0], r[1]): r[2] for r in text_tables.quality_by_position(reads).collect()} == {(0, 40): 2, (1, 0): 1}
    (tmp_path / "m.csv").write_text("Mean (cov),3\n% PF reads,x\n% dup,0.5\n")
    assert sorted(map(tuple, text_tables.read_metric_csv(spark, str(tmp_path / "m.csv")).collect())) == [("Mean_cov", 3.0), ("PCT_dup", 0.5)]


def test_keyed_store(spark, tmp_path):
    path = str(tmp_path / "store")
    text_tables.write_keyed(spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int"), path, "key")
    assert [r["v"] for r in text_tables.read_keyed(spark, path, "key", ["b"]).collect()] == [2]


def test_streaming_windows(spark, tmp_path, sf):
    from helixframe.streaming import windows

    src = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.coalesce(2).write.parquet(str(tmp_path / "in"))
    stream = windows.windowed(windows.event_stream(spark, str(tmp_path / "in"), src.schema), "ts", ["event_type"], "value", "1 day", "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == src.count()


def test_unpivot_covers_all_orders(spark, sf):
    from helixframe.catalog import QUERIES

    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    got = QUERIES["unpivot_long"](spark, sf)
    assert got.count() == 2 * lines.count()
    assert got.select("l_orderkey").distinct().count() == lines.select("l_orderkey").distinct().count()


def test_catalog_texts_are_whole(spark, tmp_path):
    from helixframe.catalog import QUERIES

    text = "a" * 90 + " c\x01g" + " g" * 50
    spark.createDataFrame([(1, text, "s"), (2, None, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda name: {r["doc_id"]: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    coded = text.replace("c", "G").replace("g", "G").replace("a", "A").replace(" ", "N")
    assert rows("revcomp")[1]["rc"] == coded.translate(str.maketrans("ACGT", "TGCA"))[::-1] and rows("revcomp")[2]["rc"] == ""
    assert rows("gc_share")[1]["gc"] == round((coded.count("G") + coded.count("C")) / len(coded), 8) and rows("gc_share")[2]["gc"] is None
    places = sorted((r["place"], r["a"]) for r in QUERIES["ragged_explode"](spark, str(tmp_path)).collect() if r["doc_id"] == 1)
    assert places == list(enumerate(text.split(" ")))


def test_weighted_scores_keep_their_decimals(spark, sf):
    from helixframe.catalog import QUERIES, SQL

    assert ", 3), 2) AS score" in SQL["collapse_weighted"]
    scores = [r["score"] for r in QUERIES["collapse_weighted"](spark, sf).select("score").collect()]
    assert any(s != round(s) for s in scores) and all(s == round(s, 2) for s in scores)


def test_weighted_majority_sums_in_any_order(spark):
    # rows come in another order each time they are read, as shuffled rows do on a cluster
    shuffled = lambda frames: (f.sample(frac=1, random_state=np.random.default_rng()) for f in frames)
    df = spark.range(0, 6000, 1, 2).selectExpr("id % 100 AS k", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS v", "rand(1) AS w").localCheckpoint()
    mixed = df.mapInPandas(shuffled, df.schema)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = merge.weighted_majority(mixed, ["k"], "v", F.col("w")).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    sums = {}
    for r in df.collect():
        sums[r["k"], r["v"]] = sums.get((r["k"], r["v"]), 0) + r["w"]
    assert sorted(map(tuple, got)) == [(k, max("ab", key=lambda v: sums[k, v])) for k in range(100)]


def test_weighted_majority_of_missing_values(spark, tmp_path):
    import duckdb

    from helixframe.catalog import QUERIES, SQL

    rows = [(None, "a", 1.0), (None, "b", 2.0), (1, None, 5.0), (1, "a", 4.0), (2, "b", None), (2, "a", None), (3, "b", 1.0), (3, "a", 1.0), (3, None, 1.0), (4, "a", float("nan")), (4, "b", 9.0), (5, None, None), (6, "a", None), (6, "b", -1.0)]
    orders = spark.createDataFrame(rows, "o_custkey long, o_orderpriority string, o_totalprice double")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    c = duckdb.connect()
    c.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    expected = c.sql(SQL["weighted_majority"]).fetchall()
    assert len(expected) == 7
    assert order(QUERIES["weighted_majority"](spark, str(tmp_path)).collect()) == order(expected)
    present = merge.weighted_majority(orders, ["o_custkey"], "o_orderpriority", F.col("o_totalprice"))
    assert order(present.collect()) == order([(None, "b"), (1, "a"), (2, "a"), (3, "a"), (4, "a"), (6, "b")])
