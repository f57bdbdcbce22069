"""Operators against brute force: null, empty, long and repeated texts, ties, empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm import chat, components, decontamination, line_dedup, packing, quality, queries, secrets, simhash, suffix_dedup, token_files, tokens, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, extra string"
ODD = [None, "", " ", "a", "a  b\n\n c ", "one two. three,four\nFive!! .,six", "<|endoftext|> x", "é.\nÉ, x.\ty  z 日本", "word " * 3000, "same same same", "same same same", " x .y", "tail\n"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], DOCS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.TOKENIZER)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("documents", "embeddings"):
        c.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_encoder_equals_the_library(library):
    enc = tokens.ChunkEncoder(queries.TOKENIZER, keep=40)
    texts = [t or "" for t in ODD] + ["a\x1cb \x1c c", "don't  stop 's\n\n x", " .a ,b \n", "ab.,\n,c a.\nb. \n", "x!,y 1,234.5"]
    for text in texts * 2:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def simple_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        open_ = [i for i, room in enumerate(bins) if room >= n]
        if open_:
            i = min(open_, key=lambda i: bins[i])
            bins[i] -= n
        else:
            bins.append(capacity - n)
    return Counter(bins)


def test_runs_are_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for capacity in (1, 7, 64, 100):
        lengths = rng.integers(1, capacity + 1, 400).tolist()
        runs, bins = packing.best_fit_runs(Counter(lengths), capacity)
        used = defaultdict(int)
        for length, lo, hi, k, first, offset in runs:
            for nth in range(hi - lo):
                assert offset + nth % k * length + length <= capacity
                used[first + nth // k] += length
        assert Counter(capacity - u for u in used.values()) == simple_best_fit(lengths, capacity) and len(used) == bins


def test_packing(spark, odd, library):
    rows = packing.pack_documents(odd, queries.TOKENIZER, 2, 1024).collect()
    bins, texts = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        texts[r["doc_id"]].append((r["piece"], r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for i, text in enumerate(ODD):
        parts = sorted(texts[i])
        assert [x for p in parts for x in p[2]] == [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert all(len(p[2]) == 1024 for p in parts[1:])
    assert packing.pack_documents(odd.limit(0), queries.TOKENIZER, 2, 1024).count() == 0
    made = packing.sequences(packing.pack_documents(odd, queries.TOKENIZER, 2, 1024)).collect()
    assert sum(len(r["ids"]) // 4 for r in made) == sum(r["length"] for r in rows)


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1001, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack_bits(ids, width)
    assert len(data) == -(-1001 * width // 8) and token_files.unpack_bits(data, width, 1001).tolist() == ids.tolist()


def test_token_files(spark, odd, library):
    manifest = token_files.write_token_files(odd, queries.TOKENIZER, 2, docs_per_file=5, block_ids=64)
    rows = sorted(token_files.read_token_files(manifest, ids_a_read=100).collect())
    at = 0
    for r, text in zip(rows, ODD):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()) == (at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert len(rows) == len(ODD) and manifest.count() > 1
    one = token_files.TokenFile(manifest.orderBy("shard").first()["path"])
    assert one.document(3).tolist() == one.range(int(one.starts[3]), int(one.starts[3] + one.lengths[3])).tolist()
    assert token_files.read_token_files(token_files.write_token_files(odd.limit(0), queries.TOKENIZER, 2)).count() == 0


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", r"[\INST] [\\MSG] <\s>", "[SEP]", "", None, "[", "a\nb<", r"\[INST]"]
    rows = [(c, i, r, t) for c in (1, 2) for i, (r, t) in enumerate(zip(["user", "assistant", "assistant", "system", "user", None, "assistant", "[MSG]\n"], hard if c == 1 else hard[::-1]))]
    rows += [(None, 0, "user", "x"), (3, 1, "user", "same"), (3, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).withColumns({"t": chat.read_turns(F.col("formatted")), "l": chat.read_loss(F.col("segments"))}).collect()}
    for c in (1, 2, 3, None):
        mine = sorted([(t, r or "", x or "") for k, t, r, x in rows if k == c])
        assert [tuple(x) for x in got[c]["t"]] == [m[1:] for m in mine]
        assert got[c]["l"] == "".join(m[2] for m in mine if m[1] == "assistant")
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
    assert chat.format_chats(df.limit(0)).count() == 0


def brute_repeats(docs, length):
    first = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        out.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(t, gone) if not g)))
    return sorted(out)


def test_suffix_dedup(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcd é"), n))
    a, b = word(400), word(120)
    texts = [a, word(30) + a[50:250] + word(20), b * 4, "z" * 700, a, None, "", word(10), "z" * 60 + b, a[:49], a[:50], b + word(40) + b]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(4, word(90), "y")], DOCS)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == brute_repeats(rows, 50)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_equal_runs_by_brute_force():
    rng = np.random.default_rng(5)
    for n in (64, 200, 900):
        text = rng.integers(0, 3, n).astype(np.uint8)
        text[n // 2 : n // 2 + 30] = text[:30]
        ring = bytes(text) * 3
        for length in (2, 9, 50):
            order, run = suffix_dedup.equal_runs(text, length)
            keys = [ring[p : p + length] for p in order]
            assert keys == sorted(keys)
            assert run.tolist() == np.cumsum([0] + [x != y for x, y in zip(keys, keys[1:])]).tolist()


def brute_groups(prints, near):
    up = {i: i for i in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if near(prints[i], prints[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute_print(text):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    parts = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, odd):
    got = {r["doc_id"]: (int(bytes(r["fingerprint"]).hex(), 16), r["component_id"]) for r in simhash.simhash_components(odd).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(ODD)}
    groups = brute_groups(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert got == {i: (prints[i], groups[i]) for i in prints}
    assert simhash.simhash_components(odd.limit(0)).count() == 0


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 4)), replace=False)) for x in np.repeat(base, 12)]
    nodes = {i: p for i, p in enumerate(dict.fromkeys(prints))}
    df = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for i, p in nodes.items()], "node long, fingerprint binary")
    found = components.components(simhash.tiled_links(simhash.keyed_by_blocks(df, 2), 2))
    up = {r["node"]: r["component"] for r in found.collect()}
    assert {i: up.get(i, i) for i in nodes} == brute_groups(nodes, lambda a, b: (a ^ b).bit_count() <= 2)


def test_near_copies(spark):
    rng = np.random.default_rng(11)
    doc = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows, truth = [], {}
    for g in range(30):
        words = doc(int(rng.integers(80, 400)))
        for c in range(3):
            copy = list(words)
            for at in rng.choice(len(words), c * len(words) // 150, replace=False):
                copy[at] = "changed"
            truth[len(rows)] = 3 * g
            rows.append((len(rows), " ".join(copy), "x"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == truth


def test_crowded_components_lose_no_link(spark):
    """Blocks and tile pairs far smaller than a component give what a comparison of all gives."""
    rng = np.random.default_rng(14)
    texts = ["", "a b"]
    for _ in range(4):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
        for c in rng.integers(0, 12, 14):
            copy = list(words)
            copy[:c] = [f"v{x}" for x in rng.integers(0, 10**6, c)]
            texts.append(" ".join(copy[: len(copy) - int(rng.integers(0, 6))]))
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    truth = brute_groups(dict(enumerate(sets)), lambda a, b: len(a & b) >= 0.8 * max(1, len(a | b)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    marked = simhash.wide_fingerprints(docs).withColumnRenamed("doc_id", "node")
    near = marked.select("text_key", F.lit(0).cast("long").alias("component"), "node", "fingerprint")
    assert 4 < len(set(truth.values())) < len(texts) - 8
    for block, tile in ((512, 2048), (4, 2), (9, 5)):
        found = components.components(simhash.alike_links(docs, near, 5, 256, 0.8, block=block, tile=tile))
        up = {r["node"]: r["component"] for r in found.collect()}
        assert {i: up.get(i, i) for i in truth} == truth


def test_hot_key_in_tiles(spark):
    """A key with several tiles of fingerprints: one group is joined, the others stay apart."""
    rng = np.random.default_rng(15)
    prints = {0}
    while len(prints) < 4500:  # within two bits of one that is there
        prints.add(int(sum(1 << int(b) for b in rng.choice(40, 2, replace=False))) | (int(rng.integers(0, 8)) << 60))
        prints.add(int(rng.integers(0, 2**63)))
    nodes = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(1, i, bytearray(int(x).to_bytes(8, "big"))) for i, x in enumerate(nodes)], "key long, node long, fingerprint binary")
    up = {r["node"]: r["component"] for r in components.components(simhash.tiled_links(df, 2)).collect()}
    group = np.arange(len(nodes))
    for i in range(len(nodes)):
        for g in np.unique(group[np.bitwise_count(nodes ^ nodes[i]) <= 2]):
            group[group == g] = group[i]
    truth = {i: int(np.flatnonzero(group == group[i])[0]) for i in range(len(nodes))}
    assert {i: up.get(i, i) for i in truth} == truth


def test_line_dedup(spark, duck):
    got = sorted(map(tuple, queries.op5_line_dedup(spark, SF).collect()))
    assert got == sorted(duck.sql(queries.OP5_SQL).fetchall())
    block = "l1\nl2\nl3"
    df = spark.createDataFrame([(1, block + "\nown", "x"), (2, "top\n" + block + "\nl4\n" + block, "x"), (3, None, "x"), (4, "", "x"), (5, block, "x")], DOCS)
    out = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"], r["extra"]) for r in line_dedup.dedup_lines(df).collect()}
    assert out == {1: (block + "\nown", 4, 0, "x"), 2: ("top\nl4", 8, 6, "x"), 3: (None, 0, 0, "x"), 4: ("", 1, 0, "x"), 5: ("", 3, 3, "x")}


def test_decontamination(spark):
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w[:12])), (2, "short one"), (3, None), (4, "  "), (5, " ".join(w[20:28])), (5, " ".join(w[20:28])), (6, "Same same same same same same same same same")]
    docs = [(1, "x " + " ".join(w[2:10]) + " y", ""), (2, " ".join(w[:7]), ""), (3, None, ""), (4, "a SHORT, one! b " + " ".join(w[18:30]), ""), (5, "same " * 30, ""), (6, " ".join(w), "")]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    expected = []
    for i, text, _ in docs:
        words, hit, found = pattern.findall((text or "").lower()), set(), set()
        for k, t in items:
            own = pattern.findall((t or "").lower())
            n = min(8, len(own))
            for a in range(len(own) - n + 1 if own else 0):
                for b in range(len(words) - n + 1):
                    if words[b : b + n] == own[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(k)
        expected.append((i, len(words), len(hit), len(found), sorted(map(str, found)), len(found) >= 2))
    for block in (500_000, 3):
        got = decontamination.contamination(df, bench, block_words=block)
        assert sorted(tuple(r) for r in got.drop("spans").collect()) == expected
    assert decontamination.contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    for _ in range(50):
        h = rng.integers(0, 50, 60, dtype=np.uint64)
        kept = set(decontamination.winnow(h, 5).tolist())
        assert all(kept & set(range(a, a + 5)) for a in range(56))


def test_top_k(spark, duck):
    got = sorted(map(tuple, queries.op8_exact_top_k(spark, SF).collect()))
    assert got == sorted(duck.sql(queries.ORACLE_SQL["op8_exact_top_k"]).fetchall())
    rows = [(0, [1.0, 0.0]), (1, [0.5, None]), (2, [float("nan"), 1.0]), (3, None), (4, [0.5, 0.5]), (5, [0.5, 0.1]), (6, [-1.0, 0.3]), (20, [1.0]), (40, [0.25, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted(map(tuple, topk.exact_top_k(df, df.where("vec_id % 20 = 0"), k=3).collect()))
    assert out == [(0, 1, 4, 2048), (0, 2, 5, 2048), (0, 3, 40, 1024), (40, 1, 0, 1024), (40, 2, 4, 512), (40, 3, 5, 512)]
    assert topk.exact_top_k(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [1, 40, 10**6])
def test_top_k_index_by_brute_force(spread):
    rng = np.random.default_rng(4)
    vectors = np.floor(64 * rng.normal(0, 0.12, (6000, 64)) + 60 * rng.normal(0, 0.2, (10, 64))[rng.integers(0, 10, 6000)]).astype(np.int64) * spread
    vectors[5000:5200] = vectors[:200]  # ties
    ids = np.arange(6000)
    ids[5990:] = 3  # rows that repeat a query's id
    best = topk.Best(40, 20)
    for a in range(0, 6000, 500):
        block = topk.IndexBlock(ids[a : a + 500], vectors[a : a + 500])
        for row in range(40):
            block.search(best, row, row, vectors[row])
    scores = vectors[:40] @ vectors.T
    for i in range(40):
        order = sorted((j for j in range(6000) if ids[j] != i), key=lambda j: (-scores[i, j], ids[j]))[:20]
        assert best.ids[i].tolist() == [ids[j] for j in order] and best.scores[i].tolist() == [scores[i, j] for j in order]


def test_top_k_over_many_blocks(spark, duck):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("group", F.lit("x")).withColumn("dims", F.lit(1))
    out = topk.exact_top_k(df, df.where("vec_id % 20 = 0"), block_rows=16, query_rows=2)
    assert sorted(map(tuple, out.collect())) == sorted(duck.sql(queries.ORACLE_SQL["op8_exact_top_k"]).fetchall())


def test_secrets(spark):
    key = "Zx9Qw3Er7Ty1Ui5Op2As8Df4Gh6Jk0Lb"
    texts = ["é password: 'hunter2hunter2' token=short api_key = abcdefgh12", "AKIA" + "A1" * 8 + " " + "0f" * 20, f"blob {key} end", "plain words only, theverylongwordwithoutdigitsinit", None, "token: token: abcdefghijk", "id 123e4567-e89b-12d3-a456-426614174000 ok", "Token='" + key + "'"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in secrets.scan(df).select("doc_id", secrets.listed(F.col("base")).alias("b"), secrets.listed(F.col("added")).alias("a")).collect()}
    assign = re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert got[i]["b"] == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    assert got[2]["a"] == "entropy_key:5:37" and not any(got[i]["a"] for i in (0, 1, 3, 4, 5, 6, 7))


def test_entropy_windows_by_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcdef012345XYZ+/")[: int(k)], 60)) for k in rng.integers(2, 17, 40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, w in df.select("t", secrets.high_windows(F.col("t"), 2.5)).collect():
        entropy = [-sum(c / 20 * math.log2(c / 20) for c in Counter(t[i : i + 20]).values()) for i in range(41)]
        high = [i for i, e in enumerate(entropy) if e >= 2.5 - 1e-9]
        assert (w["first"], w["last"]) == ((high[0], high[-1]) if high else (None, None))


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    true = [(r["quality"] == 1 and r["toxic"] == 0) == got[r["doc_id"]]["keep"] for r in labels.collect() if r["doc_id"] in got]
    assert sum(true) / len(true) > 0.9
    odd = spark.createDataFrame([(1, None, None, None), (2, "", "s", "en"), (2, "", "s", "en")], "doc_id long, text string, source string, lang string")
    assert quality.classify(odd, labels.limit(0)).where("keep").count() == 3
    assert quality.classify(odd.limit(0), labels).count() == 0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fitted = labels.where("doc_id % 4 <> 0")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs, fitted).collect()}
    true = [(r["quality"] == 1 and r["toxic"] == 0) == got[r["doc_id"]] for r in labels.where("doc_id % 4 = 0").collect()]
    assert sum(true) / len(true) > 0.9


def test_shrinking_pulls_small_hosts_to_the_mean(spark):
    rows = [(i, "bad!! ###" if i % 2 else "fine words", "big" if i < 40 else "small", "en") for i in range(42)]
    docs = spark.createDataFrame([(i, t, "junk" if i >= 60 else s, g) for i, t, s, g in rows] + [(100 + i, "bad!! ###", "junk", "en") for i in range(40)], "doc_id long, text string, source string, lang string")
    labels = docs.select("doc_id", F.when(F.col("text").startswith("bad"), 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert got[100]["prior_low"] > got[41]["prior_low"] > 0 and got[0]["keep"] and not got[100]["keep"]


def test_simhash_with_null_ids(spark):
    """Fingerprints that only null ids hold link like others, and large ids stay exact."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    big = 2**53 + 1
    rows = [(None, "alone at last"), (None, text), (big, "quite another text"), (big + 2, text + " x y")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS)
    alone = simhash.simhash_components(df).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, alone), key=str) == sorted([(None, None), (None, None), (big, big), (big + 2, big + 2)], key=str)
    keyed = lambda nodes: simhash.tiled_links(nodes.withColumn("key", F.lit(1).cast("long")).select("key", "node", "fingerprint"), 64)
    out = simhash.grouped(simhash.fingerprints(df), keyed).collect()  # a radius that links all
    assert {r["component_id"] for r in out} == {big} and len(out) == 4


def test_queries_give_the_ids_of_a_plain_call(spark, tmp_path):
    plain = Tokenizer.from_file(queries.TOKENIZER)
    texts = [*ODD, "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n x. y, z", "one <|endoftext|", "after that"]
    enc = tokens.ChunkEncoder(queries.TOKENIZER, keep=40, plain=True)
    ids = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(enc.encode(t or ""), "<u4").tolist() for t in texts] == ids and 50256 in ids[-4]
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    starts = np.cumsum([0] + [len(x) + 1 for x in ids]).tolist()
    files = sorted(map(tuple, queries.op6_token_binary(spark, str(tmp_path)).collect()))
    assert files == [(i, starts[i], len(x) + 1, crc([*x, 2])) for i, x in enumerate(ids)]
    first = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in queries.op1_best_fit_packing(spark, str(tmp_path)).where("piece = 0").collect()}
    assert all(first[i] == (len(x) + 1, crc([*x, 2])) for i, x in enumerate(ids) if len(x) < 1024)


def test_secrets_by_class_within_a_run(spark):
    """Hex keys behind a name, keys beside examples, alphabets and base spans are found."""
    rng = np.random.default_rng(8)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 28)) for _ in range(60)]
    key = "Zx9Qw3Er7Ty1Ui5Op2As8Df4Gh6Jk0Lb"
    texts = [p + h for h in hexes for p in ("sig=", "key=", "v1/", "hash_")]
    n = len(texts)
    texts += [f"/example/of/a/{key} end", f"0123456789/{key}", f"{key}/token=abcdefgh12", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "x/123e4567-e89b-12d3-a456-426614174000/y"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    got = {r[0]: r[1] for r in secrets.scan(df).select("doc_id", secrets.listed(F.col("added"))).collect()}
    entropy = lambda t: -sum(c / 20 * math.log2(c / 20) for c in Counter(t).values())
    for i in range(n):
        h, at = hexes[i // 4], len(texts[i]) - 28
        high = [k for k in range(9) if entropy(h[k : k + 20]) >= 3.1 - 1e-9]
        assert got[i] == (f"entropy_hex:{at + high[0]}:{at + high[-1] + 20}" if high else "")
    spans = {i: [s.split(":") for s in got[n + i].split(",") if s] for i in range(5)}
    assert all(len(spans[i]) == 1 and spans[i][0][0] == "entropy_key" for i in range(3)) and not spans[3] and not spans[4]
    for i in range(3):
        at = texts[n + i].index(key)
        assert int(spans[i][0][1]) <= at and int(spans[i][0][2]) >= at + 32


def test_top_k_takes_the_valid_row_of_a_repeated_query(spark):
    rows = [(i, v) for i in range(0, 200, 20) for v in ([float("nan"), 1.0], [None, 1.0], [0.5, 0.5], [0.5, 0.25], [float("inf"), 0.0], [])]
    df = spark.createDataFrame(rows + [(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    out = topk.exact_top_k(df.where("vec_id in (1, 2)"), df.where("vec_id % 20 = 0"), k=2).collect()
    assert sorted(map(tuple, out)) == sorted(x for i in range(0, 200, 20) for x in [(i, 1, 1, 2048), (i, 2, 2, 1024)])


CLASHING = ("n_lines", "n_removed", "sequence_id", "offset", "ends", "firsts", "at", "lines", "fingerprint", "component", "keep", "id", "row", "own", "text_key", "block", "n_words", "spans", "hashes", "name", "start", "length", "part", "kind")


def clashing(spark):
    texts = [None, "", "a b c d e f g h i j", "x\ny\nz\nw", "x\ny\nz\nv", "x\ny\nz\nw", "long " * 40_000]
    df = spark.createDataFrame([(i if i != 4 else None, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in CLASHING})


def test_columns_of_any_name_are_no_matter(spark):
    df = clashing(spark)
    bench = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "z w"), (None, "q"), (3, None)], "item_id long, text string").withColumns({c: F.lit(7) for c in CLASHING})
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (6, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    lines = line_dedup.dedup_lines(df)
    assert lines.columns == [c for c in df.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    assert sorted((r["doc_id"], r["n_removed"]) for r in lines.collect() if r["doc_id"] is not None) == [(0, 0), (1, 0), (2, 0), (3, 3), (5, 4), (6, 0)]
    assert suffix_dedup.remove_repeats(df).count() == 7
    assert simhash.simhash_components(df).count() == 7 and simhash.near_copies(df).count() == 7
    hits = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontamination.contamination(df, bench).collect()}
    assert hits[2] == (10, 8, ["1"]) and hits[3] == (4, 2, ["2"]) and hits[0] == (0, 0, []) and hits[6] == (40_000, 0, [])
    assert secrets.scan(df).count() == 7
    assert quality.classify(df, labels).count() == 7
    pieces = packing.tokenized_pieces(df, queries.TOKENIZER, queries.END_ID, 64).withColumns({c: F.lit(7) for c in ("sequence_id", "offset")})
    packed = packing.pack_best_fit(pieces, 64)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 64").count() == 0
    assert token_files.read_token_digests(token_files.write_token_files(df, queries.TOKENIZER, queries.END_ID)).count() == 7
    chats = df.select(F.lit(1).alias("conv_id"), "doc_id", F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text", "n_lines", "start")
    assert chat.format_chats(chats).count() == 1


def test_suffix_dedup_splits(spark):
    """Small slices and buckets, and minimizers that count as hot, change nothing."""
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcde"), rng.integers(2, 7))) for _ in range(40)]
    base = [" ".join(rng.choice(words, rng.integers(3, 200))) for _ in range(30)]
    rows = [(int(i), "".join(b[(a := int(rng.integers(0, len(b)))) : a + 150] for b in rng.choice(base, rng.integers(0, 4)))) for i in range(90)]
    rows += [(100 + i, f"{i * 7919:09d}LICENSE boilerplate text that everybody has, in all of it{i % 5:07d}") for i in range(40)] + [(200, "a" * 700), (201, "a" * 60), (5, "ab" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    first: dict[bytes, int] = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(first.get(t[k : k + 50], i), i)
    want = []
    for i, t in rows:
        gone = {p for k in range(len(t) - 49) if first[t[k : k + 50]] < i for p in range(k, k + 50)}
        want.append((i, len(t), len(gone), sum(p - 1 not in gone for p in gone), "".join(c for p, c in enumerate(t) if p not in gone)))
    for sizes in ({}, {"slice_bytes": 2000, "bucket_bytes": 3000}, {"slice_bytes": 1000, "bucket_bytes": 1500, "hot_slices": 1}):
        got = [(r[0], r[1], r[2], r[3], bytes(r[5]).decode()) for r in suffix_dedup.remove_repeats(df, **sizes).collect()]
        assert sorted(got) == sorted(want)
    for length in (10, 65):
        with pytest.raises(ValueError):
            suffix_dedup.remove_repeats(df, length)


def test_decontamination_in_blocks_and_salts(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(60)]
    docs = [(i, " ".join(np.concatenate([rng.choice(words, 20), items[int(rng.integers(60))][1].split()[3:15], rng.choice(words, 9)]))) for i in range(80)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in docs:
        w, hit, found = t.split(), set(), set()
        for k, item in items:
            v = item.split()
            n = min(8, len(v))
            windows = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)}
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found.add(str(k))
        want.append((i, len(w), len(hit), sorted(found)))
    for size in ({}, {"block_words": 40, "salt_rows": 7}):
        got = decontamination.contamination(df, bench, **size).select("doc_id", "n_words", "n_hit", "item_ids").collect()
        assert sorted(map(tuple, got)) == want


def test_quality_by_plain_python(spark):
    """Host and path posteriors, shrunk step by step in plain Python from the same evidence."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).join(docs.select("doc_id", "source", "lang"), "doc_id").collect()
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for kind in ("low", "toxic"):
        path_of = lambda r: (r["source"] or "\0", "/".join(x for x in (r["source"], r["lang"]) if x is not None))
        paths, hosts = defaultdict(list), defaultdict(list)
        for r in rows:
            paths[path_of(r)].append(r[f"e_{kind}"]), hosts[path_of(r)[0]].append(r[f"e_{kind}"])
        overall = sum(r[f"e_{kind}"] for r in rows) / len(rows)

        def strength(groups, prior):
            chance = [prior(g) * (1 - prior(g)) for g in groups]
            beyond = sum(len(v) * (sum(v) / len(v) - prior(g)) ** 2 for g, v in groups.items()) - sum(chance)
            return min(max(max(chance) / max(beyond / sum(map(len, groups.values())), 1e-6), 1.0), 1e6)

        s = strength(hosts, lambda g: overall)
        host_mean = {g: (sum(v) + s * overall) / (len(v) + s) for g, v in hosts.items()}
        s = strength(paths, lambda g: host_mean[g[0]])
        path_mean = {g: (sum(v) + s * host_mean[g[0]]) / (len(v) + s) for g, v in paths.items()}
        for r in rows:
            prior = path_mean[path_of(r)]
            odds = logit(r[f"e_{kind}"]) + logit(prior) - logit(overall)
            assert r[f"prior_{kind}"] == pytest.approx(prior, rel=1e-9) and r[f"p_{kind}"] == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-6)
    assert all(r["keep"] == (r["p_low"] < 0.5 and r["p_toxic"] < 0.5) for r in rows)


def test_few_links_are_joined_in_few_jobs(spark):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(300)]
    pairs = chain + [(int(x), int(y)) for x, y in rng.integers(1000, 3000, (1500, 2))] + [(5, 5), (-7, 4000)]
    df = spark.createDataFrame([pairs[i] for i in rng.permutation(len(pairs))], "a long, b long").repartition(4)
    spark.sparkContext.setJobGroup("few-links", "few links")
    got = dict(components.components(df).collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links"))
    spark.sparkContext.setJobGroup("other", "other")
    parent = {}
    for x, y in pairs:
        x, y = sorted((_top(parent, x), _top(parent, y)))
        parent[y] = x
    want = {n: _top(parent, n) for p in pairs if p[0] != p[1] for n in p}
    assert got == want and 0 < jobs < 8
    assert dict(components.components(df, in_task=0).collect()) == want
    assert components.components(df.limit(0)).count() == 0


def _top(parent, x):
    while parent.setdefault(x, x) != x:
        x = parent[x]
    return x


def test_top_k_leaves_postings_once_rescoring_is_less_work(monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(4000, 32))
    vectors = np.floor(64 * vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.int64)
    ids, rescored, met = np.arange(4000), [], []
    blocks = [topk.IndexBlock(ids[i::2], vectors[i::2]) for i in range(2)]
    best = topk.Best(20, 10)
    for q in range(20):
        blocks[0].search(best, q, q, vectors[q])
    rescore, bincount = topk.IndexBlock._rescore, np.bincount
    monkeypatch.setattr(topk.IndexBlock, "_rescore", lambda self, best, row, q_id, q, who: (rescored.append(len(who)), rescore(self, best, row, q_id, q, who)))
    monkeypatch.setattr(np, "bincount", lambda x, *a: (met.append(len(x)), bincount(x, *a))[1])
    for q in range(20):
        blocks[1].search(best, q, q, vectors[q])
    for q in range(20):
        scores = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:10]
        assert best.ids[q].tolist() == order and best.scores[q].tolist() == scores[order].tolist()
    assert 0 < sum(met) < 0.8 * 20 * 2000 * 32 and 0 < sum(rescored) < 0.25 * 20 * 2000


def test_best_keeps_ties_to_smaller_ids():
    best = topk.Best(1, 3)
    best.merge(0, np.array([5, 7, 5, 5, 1]), np.array([9, 4, 8, 2, 1]))
    best.merge(0, np.array([5, 5, 4, 5, 5]), np.array([3, 1, 0, 7, 6]))
    assert best.ids[0].tolist() == [4, 1, 2] and best.scores[0].tolist() == [7, 5, 5]
