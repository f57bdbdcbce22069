"""Call selections and assay tables on inline rows."""

import pytest
from pyspark.sql import functions as F

from helixframe.operators import calls
from helixframe.plans import assay


def test_call_selections(spark):
    df = spark.createDataFrame([(1, "tp", "LOW_SCORE;X", True, 0, 1, ["A", "GGC"]), (2, "fn", None, True, 6, 2, ["A", "T"]), (3, "tp", "PASS", False, 0, 3, None)], "id int, c string, f string, indel boolean, hmer int, length int, alleles array<string>")
    ids = lambda m: [r["id"] for r in df.where(m).orderBy("id").collect()]
    assert ids(calls.missed(F.col("c"), F.col("f"))) == [1, 2]
    assert ids(calls.in_homopolymer(F.col("indel"), F.col("hmer"), 5, 7)) == [2]
    assert ids(calls.outside_homopolymer(F.col("indel"), F.col("hmer"), F.col("length"), True)) == [1]
    assert ids(calls.outside_homopolymer(F.col("indel"), F.col("hmer"), F.col("length"))) == []
    assert ids(calls.genotype_only(F.col("c"), F.lit("fp"), "fp")) == [1, 3]
    assert ids(calls.gc_insertion(F.col("alleles")) != "PASS") == [1]
    assert ids(calls.cleared(F.col("f")).isNull()) == [1, 2, 3]


def test_split_alternatives(spark):
    df = spark.createDataFrame([(["A", "C", "G"], [1, 2], [50, 40, 30, 20, 0, 10]), (["A"], [0, 0], [0])], "alleles array<string>, gt array<int>, pl array<int>")
    rows = calls.split_alternatives(df).orderBy("alt_index").collect()
    assert [r["alleles"] for r in rows] == [["A", "C"], ["A", "G"]]
    assert [len(r["pl"]) for r in rows] == [3, 3]
    # likelihoods of 0/0, 0/alt, alt/alt, less their least
    assert [list(r["pl"]) for r in rows] == [[20, 10, 0], [40, 10, 0]]


def test_substitutions_and_frequencies(spark):
    df = spark.createDataFrame([("A", "C", "G", "T")] * 2 + [("A", "N", "G", "T")], "l string, r string, x string, a string")
    rows = {r["substitution"]: r["n"] for r in assay.substitution_counts(df, "l", "r", "x", "a").collect()}
    assert len(rows) == 192 and sum(rows.values()) == 2 and rows["ACG>ATG"] == 2
    one = spark.createDataFrame([("x", 1, 0.5), ("y", 3, 0.0)], "c string, n long, e double")
    got = {r["c"]: (r["n"], r["observed"], r["ratio"]) for r in assay.summed_frequencies([one, one], "c", "n", "e").collect()}
    assert got == {"x": (2, 0.25, 0.5), "y": (6, 0.75, None)}


def test_family_and_quality(spark):
    r = spark.range(1).select(assay.family(F.lit("chr12")).alias("a"), assay.family(F.lit("12")).alias("b"), assay.filter_quality(F.lit(0.5), F.lit(0.05), 0.01).alias("q")).first()
    assert (r["a"], r["b"]) == ("chr", None) and r["q"] == pytest.approx(30)
