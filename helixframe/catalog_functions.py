"""Queries for the scalar functions and the file formats, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, t
from .functions import dna, encoders, genotype, numeric
from .operators import calls, folds, merge, metrics, reshape, rules
from .plans import assay, cohort, flow
from .sources import text_tables
from .storage import scratch_path

_P = "(((event_id % 97) + 1) / 100.0)::DOUBLE"


def _share():
    return ((F.col("event_id") % 97 + 1) / 100.0).cast("double")


def _r(x, name, digits=6):
    return F.round(x, digits).alias(name)


@query("quality_scalars", f"""WITH x AS (SELECT event_id, value, user_id % 5 AS d, {_P} AS p FROM events)
SELECT event_id, round(CASE WHEN d = 0 THEN 0.0 ELSE value / d END, 6) AS ratio, round(-10 * log10(greatest(1 - p, 1e-6)), 6) AS capped, round(-10 * log10(greatest(1 - p, 1e-6)) + 10 * log10(greatest(p, 1e-6)), 6) AS logit,
round(p, 6) AS back, round((p / (1 - p) * (0.1 / 0.9) / (0.5 / 0.5)) / (1 + p / (1 - p) * (0.1 / 0.9) / (0.5 / 0.5)), 6) AS moved, round(1 - 10 ** (-p), 6) AS correct FROM x""")
def quality_scalars(spark, d):
    p = _share()
    return t(spark, d, "events").select("event_id", _r(numeric.safe_ratio(F.col("value"), F.col("user_id") % 5), "ratio"), _r(numeric.capped_phred(p), "capped"), _r(numeric.logit_phred(p), "logit"), _r(numeric.from_logit_phred(numeric.logit_phred(p)), "back"), _r(numeric.other_prior(p, 0.5, 0.1), "moved"), _r(numeric.phred_correct(10 * p), "correct"))


_L = "(-10 * log10(greatest(1 - {0}, 1e-6)) + 10 * log10(greatest({0}, 1e-6)))"


@query("fold_probabilities", f"""WITH x AS (SELECT event_id, user_id, {_P} AS p, 1 - {_P} / 2 AS q FROM events), y AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN ({_L.format('p')} + {_L.format('q')}) / 2 ELSE {_L.format('p')} END AS m FROM x)
SELECT event_id, round(1 / (1 + 10 ** (-m / 10)), 6) AS mean, round(CASE user_id % 3 WHEN 0 THEN p WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN q END ELSE 1 / (1 + 10 ** (-m / 10)) END, 6) AS score FROM y""")
def fold_probabilities(spark, d):
    p = _share()
    probs = F.array(p, F.when(F.col("user_id") % 2 == 0, 1 - p / 2))
    fold = F.when(F.col("user_id") % 3 < 2, (F.col("user_id") % 3).cast("int"))
    return t(spark, d, "events").select("event_id", _r(numeric.mean_over_folds(probs), "mean"), _r(numeric.out_of_fold(probs, fold), "score"))


@query("quality_text", """SELECT p_partkey, chr(33 + p_size) || chr(33 + (p_partkey % 40)::INTEGER) AS quals, round(10 ** (-p_size / 10.0) + 10 ** (-(p_partkey % 40) / 10.0), 6) AS errors FROM part""")
def quality_text(spark, d):
    a, b = F.col("p_size"), F.col("p_partkey") % 40
    text = numeric.phred_text(F.array(F.pow(F.lit(10.0), -(a + 0.5) / 10), F.pow(F.lit(10.0), -(b + 0.5) / 10)))
    back = F.aggregate(numeric.text_quals(text), F.lit(0.0), lambda s, x: s + x)
    return t(spark, d, "part").select("p_partkey", text.alias("quals"), _r(back, "errors"))


@query("count_arrays", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber::DOUBLE AS a, l_quantity::DOUBLE AS b, 7.0::DOUBLE AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(a * 100 / (a + b + c), 0)::BIGINT AS scaled_a, round_even(b * 100 / (a + b + c), 0)::BIGINT AS scaled_b, round((b + 1) / (a + b + c + 3), 6) AS share_b,
CASE WHEN b > 30 THEN 3 WHEN b > 20 THEN 2 WHEN b > 10 THEN 1 ELSE 0 END AS place FROM x""")
def count_arrays(spark, d):
    table = F.array(F.col("l_linenumber").cast("double"), F.col("l_quantity").cast("double"), F.lit(7.0))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.get(numeric.scaled_table(table, F.lit(100)), F.lit(0)).alias("scaled_a"), F.get(numeric.scaled_table(table, F.lit(100)), F.lit(1)).alias("scaled_b"), _r(F.get(numeric.plus_one_shares(table), F.lit(1)), "share_b"), numeric.insert_place(F.array(F.lit(10.0), F.lit(20.0), F.lit(30.0)), F.col("l_quantity")).alias("place"))


@query("gaps_and_brackets", """SELECT p_partkey, least(30, floor(0.5 * greatest(p_size, p_partkey % 100)))::BIGINT AS gap,
round(CASE WHEN p_size <= 5 THEN 1.0 WHEN p_size < 20 THEN 1 + (p_size - 5) * 0.2 WHEN p_size < 40 THEN 4 + (p_size - 20) * 0.25 ELSE 9.0 END, 6) AS quality, regexp_replace(p_brand || ' ' || p_name, '[^A-Za-z0-9_.+-]', '_', 'g') AS clean FROM part""")
def gaps_and_brackets(spark, d):
    return t(spark, d, "part").select("p_partkey", numeric.scaled_gap(F.col("p_size"), F.col("p_partkey") % 100, 30, 0.5).cast("long").alias("gap"), _r(numeric.bracket(F.col("p_size"), [5, 20, 40], [1, 4, 9]), "quality"), numeric.sanitized(F.concat_ws(" ", "p_brand", "p_name")).alias("clean"))


@query("genotype_scalars", """WITH x AS (SELECT c_custkey, (c_custkey % 3)::INTEGER AS a, (c_nationkey % 3)::INTEGER AS b, (c_custkey % 21)::INTEGER AS i, c_acctbal FROM customer), y AS (SELECT *, floor((sqrt(8.0 * i + 1) - 1) / 2)::INTEGER AS hi FROM x)
SELECT c_custkey, least(a, b) || '/' || greatest(a, b) AS gt, NOT (least(a, b) = 0 AND greatest(a, b) = 1) AS other, (i - hi * (hi + 1) / 2)::INTEGER AS lo, hi, CASE WHEN least(a, b) = 0 AND greatest(a, b) <= 1 THEN a + b WHEN a = 1 AND b = 1 THEN 2 END AS code,
CASE i % 3 WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' ELSE '1/1' END AS label, CASE WHEN a = b THEN 1 ELSE 0 END AS same, CASE i % 4 WHEN 0 THEN '1/1' WHEN 1 THEN '0/1' ELSE './1' END AS copies, CASE WHEN a = 0 THEN '0/1' WHEN a = 1 THEN './1' END AS sv, CASE WHEN a = 0 THEN '0/1' WHEN a = 1 AND b <> 0 THEN '0/1' WHEN a = 1 THEN './.' ELSE '1/1' END AS het FROM y""")
def genotype_scalars(spark, d):
    a, b, i = (F.col("c_custkey") % 3).cast("int"), (F.col("c_nationkey") % 3).cast("int"), (F.col("c_custkey") % 21).cast("int")
    gt, at = F.array(a, b), genotype.gt_of_index(i)
    kind = F.when(a == 0, "DEL").when(a == 1, "DUP").otherwise("INV")
    text, filters = F.when(a == 0, "0/0").when(a == 1, "./.").otherwise("1/1"), F.when(b == 0, "PASS").otherwise("LOW")
    return t(spark, d, "customer").select(
        "c_custkey", F.array_join(genotype.sorted_gt(gt), "/").alias("gt"), genotype.different_gt(gt, F.array(F.lit(1), F.lit(0))).alias("other"), F.get(at, F.lit(0)).alias("lo"), F.get(at, F.lit(1)).alias("hi"), genotype.label_code(gt).alias("code"),
        F.array_join(genotype.decoded_label(i % 3), "/").alias("label"), encoders.heterozygous_code(gt).alias("same"), genotype.copy_number_gt((i % 4).cast("double")).alias("copies"), genotype.svtype_gt(kind).alias("sv"), genotype.hom_to_het(text, filters).alias("het"),
    )


@query("likelihood_subset", """WITH x AS (SELECT c_custkey, 1 + (c_custkey % 3)::INTEGER AS k, (c_nationkey % 4)::INTEGER AS g FROM customer), y AS (SELECT *, 11 AS p0, (c_custkey * (k * (k + 1) // 2 + 1)) % 97 AS p1, (c_custkey * (k * (k + 1) // 2 + k + 1)) % 97 AS p2 FROM x)
SELECT c_custkey, p0 - least(p0, p1, p2) AS a, p1 - least(p0, p1, p2) AS b, p2 - least(p0, p1, p2) AS c, CASE WHEN g = k THEN '0/1' ELSE '0/0' END AS gt FROM y""")
def likelihood_subset(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", F.array(F.lit(0), (F.col("c_custkey") % 3).cast("int") + 1).alias("pick"), (F.col("c_nationkey") % 4).cast("int").alias("g"), F.array(F.lit(11).cast("long"), *[F.col("c_custkey") * (i + 1) % 97 for i in range(1, 10)]).alias("pl"))
    out = genotype.pl_subset(F.col("pl"), F.col("pick"))
    return rows.select("c_custkey", *[F.get(out, F.lit(i)).alias(n) for i, n in enumerate("abc")], F.array_join(genotype.recoded_gt(F.array(F.lit(0), F.col("g")), F.col("pick")), "/").alias("gt"))


@query("indel_kinds", """WITH x AS (SELECT p_partkey, (p_size % 3 + 1)::INTEGER AS r, (p_partkey % 4 + 1)::INTEGER AS a, (p_partkey % 7 + 1)::INTEGER AS b FROM part), y AS (SELECT *, greatest(abs(a - r), abs(b - r)) AS n FROM x)
SELECT p_partkey, n > 0 AS indel, CASE WHEN n = 0 THEN NULL WHEN a - r = -n OR b - r = -n THEN 'del' ELSE 'ins' END AS kind, CASE WHEN n > 0 THEN n END AS length FROM y""")
def indel_kinds(spark, d):
    alleles = F.array(F.repeat(F.lit("A"), F.col("p_size") % 3 + 1), F.repeat(F.lit("C"), (F.col("p_partkey") % 4 + 1).cast("int")), F.repeat(F.lit("G"), (F.col("p_partkey") % 7 + 1).cast("int")))
    kind = genotype.indel_kind(alleles)
    return t(spark, d, "part").select("p_partkey", genotype.is_indel(alleles).alias("indel"), kind["kind"].alias("kind"), kind["length"].alias("length"))


@query("annotation_codes", """WITH x AS (SELECT p_partkey, p_size, p_type, translate(left(p_name, 4), 'abcdefghijklmnopqrstuvwxyz', 'ACGTNACGTNACGTNACGTNACGTNA') AS motif FROM part)
SELECT p_partkey, translate(regexp_replace(motif, '[^ACGTN]', 'x', 'g'), 'ATGCNx', '123450')::BIGINT AS rightward, translate(regexp_replace(reverse(motif), '[^ACGTN]', 'x', 'g'), 'ATGCNx', '123450')::BIGINT AS leftward, CASE p_type WHEN 'PROMO' THEN 2 WHEN 'ECONOMY' THEN 1 ELSE 0 END AS code,
CASE WHEN p_size % 3 > 0 THEN 'MIXED' WHEN p_size % 2 = 0 THEN 'UNDETERMINED' ELSE 'END_UNREACHED' END AS tag, p_size % 3 > 0 AND p_size % 2 = 0 AS mixed, CASE WHEN p_size / 20.0 >= 1.5 THEN 'gain' WHEN p_size / 20.0 <= 0.6 THEN 'loss' ELSE 'neutral' END AS segment, CASE WHEN p_size / 20.0 - 1 >= 0.5 THEN 'DUP' WHEN p_size / 20.0 - 1 <= -0.5 THEN 'DEL' ELSE 'NEU' END AS kind,
CASE WHEN p_size % 7 + p_size % 5 NOT BETWEEN 4 AND 8 THEN 'UNDETERMINED' WHEN p_size % 5 = 0 THEN 'PLUS' WHEN p_size % 7 = 0 THEN 'MINUS' WHEN (p_size % 5)::DOUBLE / (p_size % 7 + p_size % 5) BETWEEN 0.27 AND 0.73 THEN 'MIXED' ELSE 'UNDETERMINED' END AS strand FROM x""")
def annotation_codes(spark, d):
    motif = F.translate(F.substring("p_name", 1, 4), "abcdefghijklmnopqrstuvwxyz", "ACGTNACGTNACGTNACGTNACGTNA")
    size, ratio = F.col("p_size"), F.col("p_size") / 20.0
    start = F.when(size % 3 > 0, "MIXED").when(size % 3 == 0, "UNDETERMINED")
    return t(spark, d, "part").select(
        "p_partkey", encoders.motif_code(motif).alias("rightward"), encoders.motif_code(motif, leftward=True).alias("leftward"), encoders.coded(F.col("p_type"), {"PROMO": 2, "ECONOMY": 1}, 0).alias("code"), encoders.filled_end_tag(start, F.when(size % 2 == 0, "TA")).alias("tag"),
        encoders.is_mixed(start, F.when(size % 2 == 0, "MIXED")).alias("mixed"), encoders.gain_loss(ratio, 1.5, 0.6).alias("segment"), encoders.log_ratio_type(ratio - 1, 0.5, -0.5).alias("kind"), encoders.strand_category_of_counts(size % 7, size % 5).alias("strand"),
    )


@query("call_selections", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 3 WHEN 0 THEN 'tp' WHEN 1 THEN 'fp' ELSE 'fn' END AS c, CASE l_suppkey % 3 WHEN 0 THEN 'tp' WHEN 1 THEN 'fp' ELSE 'fn' END AS g, l_returnflag = 'R' AS low, l_linestatus = 'F' AS indel, l_linenumber - 1 AS hmer FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c = 'fn' OR c = 'tp' AND low AS missed, c = 'tp' AND g = 'fn' AS gt_only, indel AND hmer BETWEEN 2 AND 4 AS hmer_indel, indel AND hmer = 0 AS other_indel, CASE WHEN l_partkey % 5 = 0 THEN 'CG_NON_HMER_INDEL' ELSE 'PASS' END AS blacklist, NOT low AS passes, CASE WHEN low THEN 'LOW_SCORE' ELSE 'PASS' END AS filled,
CASE WHEN c = 'fp' AND low THEN 'tn' WHEN c = 'tp' AND low THEN 'fn' ELSE c END AS after, CASE WHEN low THEN 'fp' ELSE 'tp' END AS call FROM x""")
def call_selections(spark, d):
    three = lambda c: F.when(F.col(c) % 3 == 0, "tp").when(F.col(c) % 3 == 1, "fp").otherwise("fn")
    low, indel, hmer = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", F.col("l_linenumber") - 1
    filters = F.when(low, "LOW_SCORE").otherwise("")
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", calls.missed(three("l_partkey"), filters).alias("missed"), calls.genotype_only(three("l_partkey"), three("l_suppkey"), "fn").alias("gt_only"), calls.in_homopolymer(indel, hmer, 2, 4).alias("hmer_indel"), calls.outside_homopolymer(indel, hmer, F.lit(2)).alias("other_indel"),
        calls.gc_insertion(F.array(F.lit("C"), F.when(F.col("l_partkey") % 5 == 0, "CCG").otherwise("CA"))).alias("blacklist"), calls.is_pass(filters).alias("passes"), calls.filled(filters).alias("filled"), metrics.after_filter(three("l_partkey"), low).alias("after"), metrics.filter_call(calls.filled(filters)).alias("call"),
    )


@query("list_columns", """WITH x AS (SELECT event_id, event_type, user_id, string_split(event_type || ',' || user_id || ',.', ',') AS l FROM events)
SELECT event_id, l[1] AS tags_0, l[2] AS tags_1, NULL::VARCHAR AS tags_2, NULL::VARCHAR AS tags_3, user_id::BIGINT AS as_int, 0.0::DOUBLE AS as_float, l[2] || '/' || l[1] AS subset, user_id AS s_user, event_type AS s_kind FROM x""")
def list_columns(spark, d):
    rows = t(spark, d, "events").select("event_id", F.concat_ws(",", "event_type", F.col("user_id").cast("string"), F.lit(".")).alias("tags"), F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("s"))
    flat = reshape.flat_columns(reshape.expand_list(rows, "tags", 4))
    return flat.select("event_id", *[f"tags_{i}" for i in range(4)], reshape.cast_tag(F.col("tags_1"), "Integer").alias("as_int"), reshape.cast_tag(F.col("tags_2"), "Float").alias("as_float"), F.array_join(reshape.allele_subset(F.split("tags", ","), F.array(F.lit(1), F.lit(0))), "/").alias("subset"), "s_user", "s_kind")


@query("cigar_clips", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 4)::INTEGER AS a, l_quantity::INTEGER AS m, (l_suppkey % 3)::INTEGER AS dl, (l_suppkey % 5)::INTEGER AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(a, b) AS longest, a > 0 AS at_left, b > 0 AS at_right, CASE WHEN a = 0 AND b = 0 THEN NULL WHEN a >= b THEN l_partkey ELSE l_partkey + m + dl END AS place, 9 - dl AS mismatches FROM x""")
def cigar_clips(spark, d):
    part = lambda n, op: F.when(n > 0, F.concat(n.cast("int").cast("string"), F.lit(op))).otherwise("")
    text = F.concat(part(F.col("l_partkey") % 4, "S"), part(F.col("l_quantity"), "M"), part(F.col("l_suppkey") % 3, "D"), part(F.col("l_suppkey") % 5, "S"))
    rows = t(spark, d, "lineitem").withColumn("cigar", text)
    c = F.col("cigar")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", dna.longest_clip(c).alias("longest"), dna.clipped_left(c).alias("at_left"), dna.clipped_right(c).alias("at_right"), dna.clip_position(F.col("l_partkey"), c).alias("place"), dna.mismatches(F.lit(9), c).alias("mismatches"))


@query("supplementary_alignments", "SELECT c_custkey, 'chr' || c_nationkey AS chrom, c_custkey - 1 AS pos, '-' AS strand, '5S' || c_custkey || 'M' AS cigar, 60 AS mapq, (c_nationkey % 7)::INTEGER AS nm, 2 AS n FROM customer")
def supplementary_alignments(spark, d):
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    sa = F.concat(F.lit("chr"), nation, F.lit(","), key, F.lit(",-,5S"), key, F.lit("M,60,"), (F.col("c_nationkey") % 7).cast("string"), F.lit(";chrX,1,+,9M,0,0;"))
    rows = t(spark, d, "customer").select("c_custkey", dna.supplementary(sa).alias("s"))
    return rows.select("c_custkey", F.get("s", F.lit(0)).alias("x"), F.size("s").alias("n")).select("c_custkey", "x.*", "n")


@query("flow_keys", """WITH x AS (SELECT p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyz ', 'ACGTACGTACGTACGTACGTACGTACG') AS s FROM part) SELECT p_partkey, s AS bases, length(s)::INTEGER AS n, length(s) - 1 - (length(s) - length(rtrim(s, right(s, 1)))) AS before_last, length(s) - length(ltrim(s, left(s, 1))) AS run,
left(s, 1) || substr(s, 2, 1) || substr(s, 3, 1) || '>' || left(s, 1) || 'T' || substr(s, 3, 1) AS sub, CASE WHEN p_partkey % 2 = 0 THEN left(s, 4) ELSE translate(substr(s, 3, 1) || substr(s, 2, 1) || left(s, 1) || substr(s, 4, 1), 'ACGT', 'TGCA') END AS oriented FROM x""")
def flow_keys(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.translate("p_name", "abcdefghijklmnopqrstuvwxyz ", "ACGTACGTACGTACGTACGTACGTACG").alias("s"))
    rows = rows.withColumn("key", dna.flow_key(F.col("s")))
    at = lambda i: F.substring("s", i, 1)
    return rows.select("p_partkey", dna.key_sequence(F.col("key")).alias("bases"), F.aggregate("key", F.lit(0), lambda a, b: a + b).alias("n"), F.element_at(dna.key_bases(F.col("key")), -1).cast("long").alias("before_last"), dna.run_length(F.col("s"), F.lit(0)).cast("long").alias("run"), dna.substitution(at(1), at(2), at(3), F.lit("T")).alias("sub"), dna.read_oriented(F.substring("s", 1, 4), F.col("p_partkey") % 2 == 0).alias("oriented"))


@query("pileup_counts", "SELECT p_partkey, (p_size % 5 + p_partkey % 3 + 1)::INTEGER AS ref, 1 AS alt, 2 AS insertions, 1 AS deleted FROM part")
def pileup_counts(spark, d):
    bases = F.concat(F.repeat(F.lit("."), F.col("p_size") % 5), F.lit("+2AC^]g+2ac"), F.repeat(F.lit(","), (F.col("p_partkey") % 3).cast("int")), F.lit(",$*"))
    found = t(spark, d, "part").select("p_partkey", dna.pileup_counts(F.lit("t"), bases).alias("m"))
    return found.select("p_partkey", F.col("m")["T"].alias("ref"), F.col("m")["G"].alias("alt"), F.col("m")["+AC"].alias("insertions"), F.col("m")["*"].alias("deleted"))


@query("rules_from_text", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 12 AND l_returnflag IN ('A', 'N') AND l_tax < 0.05 GROUP BY 1")
def rules_from_text(spark, d):
    config = rules.with_cli({"filters": [{"name": "tax", "field": "l_tax", "op": "lt", "value": 0.05, "type": "quality"}]}, ["name=q:field=l_quantity:op=ge:value=12:type=quality", "name=f:field=l_returnflag:op=in:value=A,N:type=region"], "head:5")
    return rules.passing(t(spark, d, "lineitem"), config["filters"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("rule_columns", "SELECT o_orderkey, coalesce(o_totalprice > 100000, false) AS high, o_totalprice > 100000 OR nullif(o_orderstatus, 'F') IS NULL AS open_or_null, o_totalprice > 100000 AND nullif(o_orderstatus, 'F') IS NOT NULL AS not_null FROM orders")
def rule_columns(spark, d):
    rule = {"name": "high", "field": "o_totalprice", "op": "gt", "value": 100000, "type": "quality"}
    rows = rules.with_masks(t(spark, d, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("F"))), [rule])
    return rows.select("o_orderkey", F.col(rules.PREFIX + "high").alias("high"), rules.null_passing(rules.mask(rule), "status").alias("open_or_null"), rules.null_failing(rules.mask(rule), "status").alias("not_null"))


@query("alternatives_split", """WITH x AS (SELECT c_custkey, unnest([1, 2]) AS alt_index, c_custkey % 3 AS a, c_nationkey % 3 AS b FROM customer)
SELECT c_custkey, alt_index, CASE alt_index WHEN 1 THEN 'C' ELSE 'CA' END AS alt, (CASE WHEN a = alt_index THEN 1 ELSE 0 END + CASE WHEN b = alt_index THEN 1 ELSE 0 END)::INTEGER AS n_alt FROM x""")
def alternatives_split(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", F.array(F.lit("A"), F.lit("C"), F.lit("CA")).alias("alleles"), F.array((F.col("c_custkey") % 3).cast("int"), (F.col("c_nationkey") % 3).cast("int")).alias("gt"), F.array(*[F.lit(i) for i in range(6)]).alias("pl"))
    out = calls.split_alternatives(rows)
    return out.select("c_custkey", "alt_index", F.get("alleles", F.lit(1)).alias("alt"), F.aggregate("gt", F.lit(0), lambda s, x: s + x).alias("n_alt"))


@query("fold_roles", """WITH s AS (SELECT l_returnflag AS chrom, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT chrom, row_number() OVER (ORDER BY n, chrom) AS k FROM s), f AS (SELECT chrom, CASE WHEN k > 1 THEN (3 - k)::INTEGER END AS fold FROM r)
SELECT chrom, fold, CASE WHEN chrom = 'A' THEN 'test' WHEN chrom = 'N' THEN 'val' ELSE 'train' END AS role, CASE WHEN chrom = 'N' THEN 1 WHEN chrom = 'R' THEN 0 END AS role_fold FROM f""")
def fold_roles(spark, d):
    sizes = {r[0]: r[1] for r in t(spark, d, "lineitem").groupBy("l_returnflag").count().collect()}  # one row a sequence
    made = folds.manifest(sizes, 2)
    folds.check_manifest(made, sizes)
    rows = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("chrom")).distinct()
    role = folds.chrom_role(F.col("chrom"), ["A"], ["N"])
    return rows.select("chrom", folds.fold_column(F.col("chrom"), made["folds"]).alias("fold"), role.alias("role"), folds.role_fold(role).alias("role_fold"))


@query("labelled_union", "SELECT label, count(*) AS n, sum(l_partkey)::BIGINT AS keys FROM (SELECT l_returnflag = 'R' AS label, l_partkey FROM lineitem) GROUP BY 1")
def labelled_union(spark, d):
    rows = t(spark, d, "lineitem").select("l_returnflag", "l_partkey")
    return folds.labelled_union(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag <> 'R'")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("keys"))


@query("matched_draws", "WITH n AS (SELECT o_orderstatus, count(*) AS pool FROM orders GROUP BY 1), w AS (SELECT l_linestatus AS s, count(DISTINCT l_suppkey) AS need FROM lineitem GROUP BY 1) SELECT s AS stratum, draw, least(need, pool) AS n FROM w JOIN n ON s = o_orderstatus, range(3) t(draw)")
def matched_draws(spark, d):
    targets = t(spark, d, "lineitem").select(F.col("l_linestatus").alias("stratum"), "l_suppkey").distinct()
    pool = t(spark, d, "orders").select(F.col("o_orderstatus").alias("stratum"), "o_orderkey")
    return folds.matched_draws(targets, pool, "stratum", ["o_orderkey"], 3).groupBy("stratum", "draw").agg(F.count(F.lit(1)).alias("n")).select("stratum", F.col("draw").cast("long").alias("draw"), "n")


@query("window_read_counts", "SELECT l_returnflag AS chrom, (l_partkey * 10 // 100) * 100 AS start, count(*) AS count FROM lineitem GROUP BY 1, 2")
def window_read_counts(spark, d):
    reads = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("chrom"), (F.col("l_partkey") * 10).alias("pos"))
    return cohort.window_counts(reads, 100).select("chrom", "start", "count")


@query("flow_paths", "SELECT vec_id, round(log2(0.5) + log2(0.7), 6) AS path, 0 AS first, 1 AS second FROM embeddings")
def flow_paths(spark, d):
    m = F.array(F.array(F.lit(0.5), F.lit(0.2)), F.array(F.lit(0.3), F.lit(0.7)), F.array(F.lit(0.2), F.lit(0.1)))
    rows = t(spark, d, "embeddings").select("vec_id", m.alias("m"))
    best = flow.best_path(F.col("m"))
    return rows.select("vec_id", best.alias("best"), "m").select("vec_id", F.round(flow.path_log2(F.col("m"), F.col("best")), 6).alias("path"), F.get("best", F.lit(0)).cast("int").alias("first"), F.get("best", F.lit(1)).cast("int").alias("second"))


@query("genome_families", "SELECT regexp_extract(event_type || user_id, '^[A-Za-z]+') AS family, count(*) AS n FROM events GROUP BY 1")
def genome_families(spark, d):
    return t(spark, d, "events").select(assay.family(F.concat("event_type", F.col("user_id").cast("string"))).alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("value_sets", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1")
def value_sets(spark, d):
    found = t(spark, d, "customer").groupBy("c_nationkey").agg(merge.value_set("c_mktsegment").alias("s"))
    return found.select("c_nationkey", F.array_join(F.array_sort("s"), ",").alias("segments") if dict(found.dtypes)["s"].startswith("array") else F.col("s").alias("segments"))


# Files that are written and read back.


@query("vcf_round_trip", """SELECT 'chr' || l_returnflag AS chrom, l_partkey AS pos, CASE WHEN l_linestatus = 'F' THEN 'LOW' ELSE 'PASS' END AS filter, count(*) AS n, sum(l_linenumber)::BIGINT AS depth, round(sum(l_tax), 4) AS af, count(*) FILTER (WHERE l_linenumber > 4) AS flags, count(*) FILTER (WHERE l_linenumber = 1) AS homs FROM lineitem GROUP BY 1, 2, 3""")
def vcf_round_trip(spark, d):
    li = t(spark, d, "lineitem")
    rows = li.select(F.concat(F.lit("chr"), "l_returnflag").alias("CHROM"), F.col("l_partkey").alias("POS"), F.lit(None).cast("string").alias("ID"), F.lit("A").alias("REF"), F.lit("C").alias("ALT"), F.col("l_quantity").alias("QUAL"), F.when(F.col("l_linestatus") == "F", "LOW").alias("FILTER"), F.col("l_linenumber").alias("DP"), F.col("l_tax").alias("AF"), F.when(F.col("l_linenumber") > 4, "x").alias("EXT"), F.when(F.col("l_linenumber") == 1, "1/1").otherwise("0/1").alias("GT"))
    header = ["##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="depth">', '##INFO=<ID=AF,Number=1,Type=Float,Description="share">', '##INFO=<ID=EXT,Number=1,Type=String,Description="one of {x,y}">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="genotype">', "##contig=<ID=chrA,length=1000>"]
    path = scratch_path(spark, "vcf")
    text_tables.write_vcf(rows, path, header, ["DP", "AF", "EXT"], "sample")
    back = text_tables.as_variants(text_tables.read_vcf(spark, path))
    return back.groupBy(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.col("FILTER").alias("filter")).agg(F.count(F.lit(1)).alias("n"), F.sum("DP").alias("depth"), F.round(F.sum("AF"), 4).alias("af"), F.count("EXT").alias("flags"), F.count(F.when(F.col("GT") == "1/1", 1)).alias("homs"))


@query("bed_round_trip", 'SELECT l_returnflag AS chrom, l_partkey AS start, l_partkey + l_quantity::BIGINT AS "end", l_linestatus AS name FROM lineitem WHERE l_quantity::BIGINT > 20')
def bed_round_trip(spark, d):
    path = scratch_path(spark, "bed")
    text_tables.write_bed(t(spark, d, "lineitem").select(F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"), F.col("l_linestatus").alias("name")), path, ["name"])
    return text_tables.read_bed(spark, path, ["name"], longer_than=20)


@query("interval_list_round_trip", """SELECT l_returnflag AS chrom, l_partkey AS start, l_partkey + 5 AS "end", '+' AS strand, l_linestatus AS name, 1000 AS length FROM lineitem""")
def interval_list_round_trip(spark, d):
    path = scratch_path(spark, "interval-list")
    closed = text_tables.as_interval_list(t(spark, d, "lineitem").select(F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 5).alias("end"), F.col("l_linestatus").alias("name")))
    head = spark.range(1).select(F.explode(F.array(*[F.lit(f"@SQ\tSN:{c}\tLN:1000") for c in "ANR"])).alias("value"))
    head.union(closed.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("+"), "name"))).write.text(path)
    data, sizes = text_tables.read_interval_list(spark, path)
    return data.join(sizes, "chrom").withColumn("length", F.col("length").cast("int"))


@query("sam_round_trip", "SELECT o_orderkey, (o_custkey % 4096)::INTEGER AS flag, o_custkey::INTEGER - 1 AS pos, o_orderpriority AS priority, o_orderstatus AS status FROM orders")
def sam_round_trip(spark, d):
    path = scratch_path(spark, "sam")
    o = t(spark, d, "orders")
    line = F.concat_ws("\t", F.col("o_orderkey").cast("string"), (F.col("o_custkey") % 4096).cast("string"), F.lit("chr1"), F.col("o_custkey").cast("string"), F.lit("60"), F.lit("10M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGT"), F.lit("IIII"), F.concat(F.lit("pr:Z:"), "o_orderpriority"), F.concat(F.lit("st:A:"), "o_orderstatus"))
    o.select(line.alias("value")).write.text(path)
    back = text_tables.read_sam(spark, path)
    return back.select(F.col("qname").cast("long").alias("o_orderkey"), "flag", "pos", F.col("tags")["pr"].alias("priority"), F.col("tags")["st"].alias("status"))


@query("mpileup_round_trip", "SELECT p_brand AS chrom, p_partkey AS pos, 'A' AS ref, p_size AS depth, repeat('.', p_size) AS bases, repeat('I', p_size) AS quals FROM part WHERE p_size > 0")
def mpileup_round_trip(spark, d):
    path = scratch_path(spark, "mpileup")
    p = t(spark, d, "part").where("p_size > 0")
    p.select(F.concat_ws("\t", "p_brand", F.col("p_partkey").cast("string"), F.lit("A"), F.col("p_size").cast("string"), F.repeat(F.lit("."), F.col("p_size")), F.repeat(F.lit("I"), F.col("p_size"))).alias("value")).write.text(path)
    return text_tables.read_mpileup(spark, path)


@query("fastq_quality", "WITH x AS (SELECT unnest(range(2)) AS position, unnest([5, p_size % 40]) AS quality FROM part) SELECT position::INTEGER AS position, quality::INTEGER AS quality, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM x), 8) AS share FROM x GROUP BY 1, 2")
def fastq_quality(spark, d):
    path = scratch_path(spark, "fastq")
    p = t(spark, d, "part")
    p.select(F.concat(F.lit("@r"), F.col("p_partkey").cast("string"), F.lit("\nAC\n+\n"), F.char(F.lit(38)), F.char(33 + F.col("p_size") % 40)).alias("value")).write.text(path)
    found = text_tables.quality_by_position(text_tables.read_fastq(spark, path))
    return found.select("position", "quality", "n", F.round("share", 8).alias("share"))


@query("metric_csv", "SELECT 'PCT_Mean_' || c_custkey AS metric, round(c_acctbal, 2) AS value FROM customer")
def metric_csv(spark, d):
    path = scratch_path(spark, "metrics")
    t(spark, d, "customer").select(F.concat(F.lit("% (Mean) "), F.col("c_custkey").cast("string")).alias("metric"), F.round("c_acctbal", 2).cast("string").alias("value")).write.csv(path)
    return text_tables.read_metric_csv(spark, path)


@query("keyed_store", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def keyed_store(spark, d):
    path = scratch_path(spark, "keyed")
    text_tables.write_keyed(t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, "o_orderstatus")
    back = text_tables.read_keyed(spark, path, "o_orderstatus", ["F", "O"], columns=["o_totalprice"])
    return back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("nested_json", """SELECT CAST(c_nationkey AS VARCHAR) AS nation, '{' || string_agg('"' || c_name || '":' || c_custkey, ',' ORDER BY c_name) || '}' AS json FROM customer GROUP BY c_nationkey""")
def nested_json(spark, d):
    return text_tables.to_nested_json(t(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("nation"), "c_name", "c_custkey"), "nation", "c_name", "c_custkey")


@query("monitor_lines", "SELECT event_id::DOUBLE AS cpu, user_id::DOUBLE AS memory, 0.0::DOUBLE AS io_read FROM events")
def monitor_lines(spark, d):
    path = scratch_path(spark, "monitor")
    t(spark, d, "events").select(F.concat(F.lit("x MONITORING, 2024-01-01 00:00:00, CPU: "), F.col("event_id").cast("string"), F.lit(", Mem: "), F.col("user_id").cast("string"), F.lit(", none, 1, 2")).alias("value")).write.text(path)
    return text_tables.monitor_log(spark, path).select("cpu", "memory", "io_read")


@query("json_arrays", "WITH v AS (SELECT c_nationkey::INTEGER AS b, count(*)::DOUBLE AS n FROM customer GROUP BY 1), r AS (SELECT n, (row_number() OVER (ORDER BY b) - 1)::INTEGER AS bin FROM v) SELECT 'cov' AS key, bin, n FROM r")
def json_arrays(spark, d):
    path = scratch_path(spark, "json")
    counts = t(spark, d, "customer").groupBy("c_nationkey").count().agg(F.array_sort(F.collect_list(F.struct("c_nationkey", F.col("count").cast("double").alias("n")))).alias("v"))
    counts.select(F.to_json(F.struct(F.col("v.n").alias("cov"))).alias("value")).coalesce(1).write.text(path)
    return text_tables.json_histograms(spark, path, ["cov"])
