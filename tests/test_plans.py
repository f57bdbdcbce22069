"""Small cases of rules, records, copy numbers, reference lookups, sweeps and streams."""

import math

import pytest
from pyspark.sql import functions as F

from helixframe.operators import calls, intervals, ordered, reshape, rules
from helixframe.plans import concordance, copy_number, systematic_errors, training, variants
from helixframe.sources import records, text_tables
from helixframe.storage import scratch_root


def test_rows_before():
    steps = [{"name": "raw", "type": "raw", "rows": 100}, {"name": "q", "type": "quality", "rows": 60}, {"name": "r", "type": "region", "rows": 30}, {"name": "l", "type": "label", "rows": 3}]
    assert rules.row_ratio(steps, {"type": "label"}, {"type": "quality"}) == 0.3
    assert rules.row_ratio(steps, {"name": "r"}, {"type": "raw"}) == 0.6
    for bad in ({"type": "none"}, {"name": "raw_"}):
        with pytest.raises(ValueError):
            rules.rows_before(steps, **bad)
    with pytest.raises(ValueError):
        rules.rows_before(steps[1:], type="raw")


def test_many_rules_give_the_patterns_that_occur(spark):
    made = [{"name": f"r{i}", "field": "id", "op": "gt", "value": i, "type": "quality"} for i in range(22)]
    out = rules.patterns(spark.range(4), made).collect()
    assert sorted(map(tuple, out)) == [("0" * 22, 1), ("1" + "0" * 21, 1), ("11" + "0" * 20, 1), ("111" + "0" * 19, 1)]


def test_scratch_needs_a_shared_folder():
    class Other:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master, applicationId = "yarn", "x"

    with pytest.raises(ValueError):
        scratch_root(Other)


def test_reference_lookup_across_blocks(spark):
    seq = "ACGT" * 30 + "AAAAAAAAAAAA" + "CGTN" * 20
    pieces = spark.createDataFrame([("c", i, seq[i : i + 7]) for i in range(0, len(seq), 7)], "chrom string, start long, seq string")
    blocks = variants.reference_blocks(pieces, 25, 20)
    sites = spark.createDataFrame([("c", p) for p in range(1, len(seq) + 1)], "chrom string, pos long")
    rows = variants.with_reference(sites, blocks, 25).select("pos", variants.bases_between(F.col("pos") - 6, F.col("pos") + 5).alias("s")).collect()
    assert all(s == seq[max(p - 6, 0) : p + 5] for p, s in rows) and len(rows) == len(seq)
    rec = spark.createDataFrame([("c", 120, "T", ["T", "TA"], True), ("c", 120, "TAA", ["TAA", "T"], True), ("c", 2, "C", ["C", "G"], False), ("c", 122, "A", ["A", "AC"], True)], "chrom string, pos long, ref string, alleles array<string>, indel boolean")
    got = variants.annotated(rec, blocks, 3, 4, 25).select("indel_classify", "indel_length", "hmer_indel_length", "hmer_indel_nuc", "left_motif", "right_motif").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("ins", 1, 12, "A", "CGT", "CGT"), ("del", 2, 12, "A", "CGT", "CGT"), (None, 0, 0, None, "A", "GTA"), ("ins", 1, 0, None, "TAA", "AAA")], key=str)


def test_regions_change_nothing(spark):
    rows = [("a", (i * 37) % 900, (i * 37) % 900 + i % 23) for i in range(200)] + [("b", 5, 2000), ("b", 100, 101), (None, 1, 4)]
    df = spark.createDataFrame([r for r in rows if r[1] < r[2]], "chrom string, start long, end long")
    other = df.select("chrom", (F.col("start") + 11).alias("start"), (F.col("end") + 30).alias("end"))
    for made in (lambda r: intervals.merged(df, region=r), lambda r: intervals.depth_runs([df, other], region=r), lambda r: intervals.intersected([df], [other], region=r)):
        assert sorted(map(str, made(None).collect())) == sorted(map(str, made(50).collect()))
    points = spark.createDataFrame([("a", i * 13) for i in range(90)] + [("c", 1)], "chrom string, pos long")
    named = df.withColumn("name", F.concat_ws(":", "start", "end"))
    assert sorted(map(str, intervals.nearest(points, named).collect())) == sorted(map(str, intervals.nearest(points, named, region=40).collect()))


def test_next_nonzero_and_skyline_with_nulls(spark):
    df = spark.createDataFrame([("k", 1, 0), ("k", 2, None), ("k", 3, 7), ("k", 4, 0)], "k string, at int, v int")
    out = df.select("at", ordered.next_nonzero("v", "at", ["k"], ["at"]).alias("n")).collect()
    assert sorted(map(tuple, out)) == [(1, 3), (2, 3), (3, 3), (4, None)]
    best = spark.createDataFrame([("k", 1, 9), ("k", 2, 5), ("k", 2, 5), ("k", 3, 5), ("k", 0, 9)], "k string, x int, y int")
    assert sorted(map(tuple, ordered.skyline(best, ["k"], "x", "y").collect())) == [("k", 1, 9), ("k", 3, 5)]


def test_small_variant_by_plain_sums():
    best, qual, own = copy_number.small_variant(40, 4, 10.2)
    like = [math.comb(40, 4) * p**4 * (1 - p) ** 36 for p in [k / 10 * 0.997 + (1 - k / 10) * 0.003 for k in range(11)]]
    post = [x / sum(like) for x in like]
    assert best == max(range(11), key=post.__getitem__) == 1
    assert qual == pytest.approx(-10 * math.log10(post[0]), rel=1e-6) and own == pytest.approx(-10 * math.log10(1 - post[1]), rel=1e-6)
    assert copy_number.small_variant(0, 0, 3.0) == (0, 0.0, 0.0) and copy_number.small_variant(10, 0, 2.0)[:2] == (0, 0.0)


def test_small_variants_and_markers(spark):
    df = spark.createDataFrame([(40, 4, 10.2, "x"), (40, 4, 10.2, "y"), (0, 0, 2.0, "z")], "n int, alt int, copies double, id string")
    out = {r["id"]: r["alt_copies"] for r in copy_number.small_variants(df, "n", "alt", "copies").collect()}
    assert out == {"x": 1, "y": 1, "z": 0}
    none = spark.range(1).select(copy_number.marker_call(F.array(F.lit(0.0)), F.array(F.lit(0.0)), F.lit(4.0)).alias("m")).first()["m"]
    assert none["kind"] == "No coverage at marker sites" and none["alt"] is None


def test_classes_of_edge_genotypes(spark):
    rows = [([0, 1], [0, 1]), ([0, 1], [1, 1]), ([1, 1], [0, 1]), ([0, 2], [0, 1]), ([None, None], [0, 1]), ([0, 1], [None]), ([0, 0], [0, 1])]
    df = spark.createDataFrame(rows, "c array<int>, g array<int>")
    got = [tuple(r) for r in df.select(concordance.allele_class(F.col("c"), F.col("g")), concordance.genotype_class(F.col("c"), F.col("g"))).collect()]
    assert got == [("tp", "tp"), ("tp", "fn"), ("tp", "fp"), ("fp", "fp"), ("fn", "fn"), ("fp", "fp"), ("fn", "fn")]


def test_error_record_without_reads(spark):
    df = spark.createDataFrame([([5, 0, 1, 0], [9.0, 9.0, 0.0, 0.0], False, True, 0.01), ([0, 0, 0, 0], [9.0, 9.0, 0.0, 0.0], True, True, 0.5)], "actual array<long>, expected array<double>, seen boolean, snp boolean, frequency double")
    a, b = systematic_errors.record(df).collect()
    assert a["p_reverse"] == -1 and a["p_forward"] == pytest.approx(1 - (1 - 1 / 51) ** 6) and a["p_strand"] == a["p_lesser"] == a["p_forward"]
    assert (b["p_forward"], b["p_reverse"], b["p_strand"], b["p_alt"]) == (-1, -1, 1, None)


def test_test_rows_get_the_mean_of_all_models(spark):
    df = spark.range(300).select((F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 3 < 2, (F.col("id") % 3).cast("int")).alias("fold"), (F.col("id") % 10 > 4).alias("label"))
    out = training.scored(df, training.fold_models(df, ["x"], "label", "fold", 2, rounds=2, depth=2), ["x"], "fold").collect()
    for r in out:
        want = r[f"score_{r['fold']}"] if r["fold"] is not None else None
        assert r["score"] == pytest.approx(want) if want is not None else min(r["score_0"], r["score_1"]) - 1e-9 <= r["score"] <= max(r["score_0"], r["score_1"]) + 1e-9


def test_files_of_several_lines(spark, tmp_path):
    (tmp_path / "log").write_text("Started |\tx\n READS:\n n reads |\t5\n share |\t2%\n")
    assert [(r["section"], r["name"], r["value"]) for r in text_tables.sectioned_log(spark, str(tmp_path / "log")).collect()][1:] == [("READS", "n reads", "5"), ("READS", "share", "2%")]
    (tmp_path / "json").write_text('{\n "a": [1, 2],\n "b": [3]\n}')
    assert sorted(map(tuple, text_tables.json_histograms(spark, str(tmp_path / "json"), ["a", "b"]).collect())) == [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)]
    (tmp_path / "none").write_text("## htsjdk\n## METRICS CLASS\tx.y.Z\nA\tB\n1\tq\n")
    metrics, histogram = records.read_coverage_metrics(spark, str(tmp_path / "none"))
    assert sorted(map(tuple, metrics.collect()), key=str) == [("Z", "A", 1.0), ("Z", "B", None)] and histogram.count() == 0


def test_lists_and_filters(spark):
    df = spark.createDataFrame([([1, 2],), (None,)], "v array<int>")
    assert [tuple(r)[1:] for r in reshape.expand_list(df, "v", 3).collect()] == [(1, 2, None), (None, None, None)]
    rows = spark.createDataFrame([("a", 1, "PASS"), ("a", 2, None), ("b", 3, "LOW")], "CHROM string, POS long, FILTER string")
    assert records.record_count(rows, passing=True).first()["n"] == 2
    assert [r["POS"] for r in records.in_order(rows, ["b", "a"]).collect()] == [3, 1, 2]
    assert [r["FILTER"] for r in records.marked(rows, "x", "POS > 1").orderBy("POS").collect()] == ["PASS", "x", "LOW;x"]
    kept = spark.createDataFrame([(10, ["own"]), (99, ["own"]), (99, ["own", "b"]), (99, None)], "n int, s array<string>").where(calls.supported(F.col("n"), F.col("s"), 50, "own"))
    assert kept.count() == 2
