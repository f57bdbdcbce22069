"""Each stage of the pipeline on planted cases."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm.shared import written


@pytest.fixture(scope="module")
def stages():
    return dict(corpus_pipeline.STAGES)


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def prose(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))


def test_near_copies_go_and_clean_documents_stay(spark, stages, sf):
    rng = np.random.default_rng(1)
    a, b = prose(rng, 200), prose(rng, 150)
    near = a.split()
    near[100] = "other"
    docs = table(spark, [a, b, " ".join(near), a, None, "", prose(rng, 90)])
    out = stages["SimHash near-dedup"](spark, docs, sf)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 1, 4, 6]


def test_benchmark_passages_go(spark, stages, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    rng = np.random.default_rng(2)
    docs = table(spark, [prose(rng, 50), prose(rng, 20) + " " + item + " " + prose(rng, 20), None])
    assert sorted(r["doc_id"] for r in stages["benchmark decontamination"](spark, docs, sf).collect()) == [0, 2]


def test_repeated_lines_go(spark, stages, sf):
    docs = table(spark, ["a b\nc d\ne f\nown", "x\na b\nc d\ne f", None])
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages["line dedup"](spark, docs, sf).collect()}
    assert out == {0: ("a b\nc d\ne f\nown", 15), 1: ("x", 1), 2: (None, 0)}


def test_whole_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert sizes == sorted(sizes, reverse=True) and packed.select("doc_id").distinct().count() == sizes[-1]
    assert all(stage(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(0), sf).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_similarity_decides_near_copies(spark, stages, sf):
    """A nine-word text and the same less its last word share 4 of 5 shingles and are near
    copies; pairs that share 7 of 10 are not, though fingerprints are close."""
    rng = np.random.default_rng(12)
    texts, expected = [], []
    for _ in range(40):
        words = prose(rng, 9).split()
        expected.append(len(texts))
        texts += [" ".join(words), " ".join(words[:8])]
    for _ in range(40):
        words = prose(rng, 140).split()
        cut = [*words[:116], *prose(rng, 24).split()]  # 112 of 160 shingles are shared
        expected += [len(texts), len(texts) + 1]
        texts += [" ".join(words), " ".join(cut)]
    out = stages["SimHash near-dedup"](spark, table(spark, texts), sf)
    assert sorted(r["doc_id"] for r in out.collect()) == expected


def test_null_and_repeated_ids_stay_apart(spark, stages, sf):
    rng = np.random.default_rng(13)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean, copy = [prose(rng, 60) for _ in range(4)], prose(rng, 80)
    rows = [(None, clean[0]), (None, clean[1]), (7, clean[2]), (7, clean[3]), (9, copy), (None, copy), (None, copy), (None, item), (7, item + " x")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = lambda name: sorted(((r["doc_id"], r["text"]) for r in stages[name](spark, docs, sf).collect()), key=str)
    near = got("SimHash near-dedup")
    assert [r for r in near if item not in r[1]] == sorted([*rows[:4], (9, copy)], key=str)
    assert got("benchmark decontamination") == sorted(rows[:7], key=str)


def test_quality_judges_rows(spark, stages, sf):
    """Rejected rows of a null id take no other row along: what stays is what stays with ids."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").dropDuplicates(["text"])
    labelled = [r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id").collect()]
    blank = docs.withColumn("doc_id", F.when(F.col("doc_id").isin(labelled), F.col("doc_id")))
    kept = [sorted(r["text"] for r in stages["quality classifier"](spark, d, sf).select("text").collect()) for d in (docs, blank)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < docs.count()


def test_lines_of_null_ids_stay_apart(spark, stages, sf):
    rows = [(1, "a b\nc d\ne f"), (None, "x\na b\nc d\ne f\ny"), (None, "p\nq\nr\ns\nt"), (4, "k\nl\nm"), (4, "k\nl\nm\nn")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r["doc_id"], r["text"]) for r in stages["line dedup"](spark, docs, sf).collect()]
    # nulls come first in the order of ids, so that the passage stays with the null id
    assert (None, rows[1][1]) in out and (None, rows[2][1]) in out and (1, "") in out and len(out) == 5
    assert {t for i, t in out if i == 4} in ({"k\nl\nm", "n"}, {"", "k\nl\nm\nn"})
