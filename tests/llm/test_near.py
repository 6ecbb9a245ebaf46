"""Operators 5, 6 and 8 against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ragloom.llm import copies, neighbours, simhash, topk
from ragloom.llm.components import connected_components
from ragloom.llm.neighbours import embedding_components
from ragloom.llm.topk import products, search, top_inner_products


def components_of(n: int, links) -> list[int]:
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(400, 460)]
    want = components_of(461, links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    for i in {x for a, b in links if a != b for x in (a, b)}:
        assert got[i] == want[i]
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_fingerprint_is_the_bit_majority():
    text = "The quick\tBROWN fox  jumps over Äpfel"
    words = "the quick brown fox jumps over Äpfel".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("Two Words") == xxhash.xxh64_intdigest("two words", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    rng = random.Random(8)
    long = [f"w{rng.randrange(300)}" for _ in range(150_000)]
    sums = np.zeros(64, np.int64)
    for x in zip(long, long[1:], long[2:], strict=False):
        sums += np.uint64(xxhash.xxh64_intdigest(" ".join(x), 42)) >> np.arange(64, dtype=np.uint64) & np.uint64(1) != 0
    assert simhash.fingerprint(" ".join(long)) == sum(1 << b for b in range(64) if 2 * sums[b] > len(long) - 2)


def near_prints(n: int, rng) -> np.ndarray:
    """Distinct fingerprints, many of them within a few bits of each other."""
    base = [rng.getrandbits(64) for _ in range(n // 8)]
    out = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(8)}
    return np.array(sorted(x & (1 << 64) - 1 for x in out), np.uint64)


def test_trie_join_finds_all_pairs():
    bits = near_prints(800, random.Random(5))
    a, b = simhash.trie_pairs(np.zeros(len(bits), int), bits)
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    diff = np.bitwise_count(bits[:, None] ^ bits[None])
    assert got == {(i, j) for i, j in zip(*np.nonzero(diff <= 2), strict=True) if i < j} and len(got) == len(a)


def test_links_connect_what_brute_force_connects(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 8)
    monkeypatch.setattr(simhash.groups, "__defaults__", (16,))
    bits = near_prints(400, random.Random(9))
    rows = spark.createDataFrame([(int(x),) for x in bits.view(np.int64)], "bits long")
    links = [(r["a"], r["b"]) for r in simhash.links(rows).collect()]
    place = {int(x): i for i, x in enumerate(bits.view(np.int64))}
    diff = np.bitwise_count(bits[:, None] ^ bits[None])
    want = components_of(len(bits), [(i, j) for i, j in zip(*np.nonzero(diff <= 2), strict=True) if i < j])
    assert components_of(len(bits), [(place[a], place[b]) for a, b in links]) == want


def test_links_of_a_wider_budget(spark, monkeypatch):
    monkeypatch.setattr(simhash.groups, "__defaults__", (16,))
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(60)]
    spread = sum(1 << k for k in (2, 20, 40, 60))  # a bit in each of three blocks, and one more
    bits = np.array(sorted({x for b in base for x in (b, b ^ spread)}), np.uint64)
    rows = spark.createDataFrame([(int(x),) for x in bits.view(np.int64)], "bits long")
    place = {int(x): i for i, x in enumerate(bits.view(np.int64))}
    diff = np.bitwise_count(bits[:, None] ^ bits[None])
    want = components_of(len(bits), [(i, j) for i, j in zip(*np.nonzero(diff <= 4), strict=True) if i < j])
    links = [(place[r["a"]], place[r["b"]]) for r in simhash.links(rows, 4).collect()]
    assert components_of(len(bits), links) == want and len(set(want)) < len(bits)


def test_simhash_rows(spark):
    rows = [(5, "one two three four"), (2, "One TWO three four"), (9, None), (7, ""), (8, "  "), (None, "one two three four"), (2, "One TWO three four"), (11, "other text here now")]
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, bits int, component string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.simhash_components(docs).collect())
    assert got == [(-1, 2), (2, 2), (2, 2), (5, 2), (7, 7), (8, 7), (9, 7), (11, 11)]
    assert simhash.simhash_components(docs.limit(0)).collect() == []


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres[i % 30] + rng.normal(size=16) * 0.12 for i in range(600)]).reshape(600, 16).astype(np.float32)
    x[10] = x[40] = x[11]
    rows = [(i, [float(v) for v in x[i]], 0, 1.0) for i in range(600)]
    rows += [(700, None, 0, 1.0), (701, [0.0] * 16, 0, 1.0), (702, [float("nan")] * 16, 0, 1.0), (703, [None] * 16, 0, 1.0), (704, [], 0, 1.0), (705, [1.0, 2.0], 0, 1.0), (706, [2.0, 4.0], 0, 1.0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, rep double")
    got = {r["vec_id"]: r for r in embedding_components(vectors).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = components_of(600, [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    assert sum(got[i]["n_links"] for i in range(600)) >= 0.98 * near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(600))
    assert np.mean([got[i]["component_id"] == want[i] for i in range(600)]) > 0.98
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (700, 701, 702, 703, 704))
    assert got[705]["n_links"] == 1 and got[706]["component_id"] == 705 and not got[706]["kept"]
    assert embedding_components(vectors.limit(0)).collect() == []


def test_a_vector_may_have_the_id_minus_one(spark):
    e = np.eye(8)
    ids = [-1, 5, -4, -1 - 2**40, 7]
    near = [(i, [float(v) for v in e[0] + 0.01 * e[k + 1]]) for k, i in enumerate(ids)] + [(9, [float(v) for v in e[7]])]
    for rows in (near, near[::-1], [near[0], near[2]], [near[2], near[0]]):
        got = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
        linked = [i for i, _ in rows if i != 9]
        assert all(got[i] == (min(linked), len(linked) - 1) for i in linked)


def test_audit_sees_rare_and_small_links(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32))
    x[1] = x[0] + 0.01 * rng.normal(size=32)  # a pair in 3,000 vectors
    rare = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "rep long, vector array<double>, weight long")
    nothing = spark.createDataFrame([], "a long, b long, n long")
    assert neighbours.audit(rare, nothing, 0.95) == 0.0
    assert neighbours.audit(rare, spark.createDataFrame([(0, -1, 1)], "a long, b long, n long"), 0.95) == 0.5
    # A large cluster doesn't outweigh pairs.
    y = np.concatenate([x[0] + 0.01 * rng.normal(size=(40, 32)), np.repeat(x[10:30], 2, axis=0) + 0.01 * rng.normal(size=(40, 32))])
    mixed = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(y)], "rep long, vector array<double>, weight long")
    large = spark.createDataFrame([(i, -1, 39) for i in range(40)], "a long, b long, n long")
    assert neighbours.audit(mixed, large, 0.95) == 0.5
    monkeypatch.setattr(neighbours, "found_links", lambda *_: nothing)
    with pytest.raises(RuntimeError, match="recall"):
        embedding_components(mixed.select(F.col("rep").alias("vec_id"), F.col("vector").alias("embedding")))


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 12)) * rng.uniform(0.1, 3, size=(400, 1)), 3)
    x[50:90] = x[3]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(400)] + [(1000, None, 0), (1100, [None], 0), (1200, [float("inf")], 0), (1300, [0.5], 0), (None, [1.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_inner_products(vectors, lambda i: i % 100 == 0).collect())
    ints = np.floor(x * 1024).astype(int)
    ints, ids = np.r_[ints, np.array([[512] + [0] * 11])], np.r_[np.arange(400), 1300]
    want = []
    for q in np.flatnonzero(ids % 100 == 0):
        scores, rest = ints @ ints[q], ids != ids[q]
        order = np.lexsort((ids[rest], -scores[rest]))[:10]
        want += [(int(ids[q]), k + 1, int(ids[rest][o]), int(scores[rest][o])) for k, o in enumerate(order)]
    assert got == sorted(want)
    few = vectors.where(F.col("vec_id").isin(100, 101))
    assert [(r["query_id"], r["vec_id"]) for r in top_inner_products(few, lambda i: i % 100 == 0).collect()] == [(100, 101)]
    assert top_inner_products(vectors.limit(0), lambda i: i % 100 == 0).collect() == []


def test_huge_products_stay_in_range():
    big = np.array([[2**62, 2**62]], dtype=np.int64)
    assert products(big, big)[0, 0] == 2**63 - 1 and products(big, -big)[0, 0] == -(2**63)
    assert search(np.array([1]), np.array([[3]]), np.array([-(2**63)]), np.array([1, 2]), np.array([[1], [2]]), np.eye(1)) == [(1, 2, 6)]


def test_skewed_lengths_part_most_pairs(spark, monkeypatch, caplog):
    monkeypatch.setattr(topk, "BUCKET", 100)
    monkeypatch.setattr(topk, "BLOCK", 10)
    rng = np.random.default_rng(14)
    x = rng.normal(size=(2000, 8)) * np.exp(rng.normal(size=(2000, 1)) * 2)
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    with caplog.at_level("INFO", logger="ragloom.llm.topk"):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_inner_products(vectors, lambda i: i % 20 == 0).collect())
    ints = np.floor(x * 1024).astype(int)
    want = []
    for q in range(0, 2000, 20):
        scores, rest = ints @ ints[q], np.arange(2000) != q
        order = np.lexsort((np.arange(2000)[rest], -scores[rest]))[:10]
        want += [(q, k + 1, int(np.arange(2000)[rest][o]), int(scores[rest][o])) for k, o in enumerate(order)]
    assert got == sorted(want)
    met, of = (int(w) for w in caplog.messages[-1].split()[:3:2])
    assert of >= 150 and met < of / 3


def test_repeated_ids_of_queries_and_candidates(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.5, 0.0]), (3, [2.0, 0.0]), (3, [1.0, 1.0]), (3, [2.0, 0.0])]
    got = top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 100 == 0).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 3, 512 * 2048), (2, 3, 512 * 2048), (3, 3, 512 * 1024)]


def test_embeddings_without_and_with_the_same_id(spark):
    e = np.eye(6)
    near = lambda k, j: [float(v) for v in e[k] + 0.01 * e[j]]
    rows = [(None, near(0, 1)), (None, near(0, 2)), (4, near(1, 2)), (4, near(1, 3)), (4, near(2, 3)), (9, near(2, 4)), (None, near(2, 5)), (7, near(3, 4)), (7, near(3, 4))]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted([(0, 1, 0, True), (0, 1, 0, True), (4, 1, 4, True), (4, 1, 4, True), (4, 2, 4, True), (9, 2, 4, False), (0, 2, 4, False), (7, 1, 7, True), (7, 1, 7, True)])


def test_hubs_are_split(spark):
    links = spark.createDataFrame([(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(500, 530)] + [(399, 530)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links, hub=50).collect()}
    assert got == {i: 0 for i in [*range(400), *range(500, 531)]}


def test_groups_refuse_a_limit_that_loses_links(spark):
    with pytest.raises(ValueError, match="differ"):
        simhash.groups(spark.createDataFrame([(1,)], "bits long"), 3)
    assert [bin(m).count("1") for m in simhash.cut_free(0b1111, 3)] == [1, 1, 2]


def test_large_groups_of_near_copies_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(copies, "BLOCK", 4)
    monkeypatch.setattr(copies, "BLOCK_CHARS", 4000)
    monkeypatch.setattr(copies, "TRIE", 4)
    rng = random.Random(21)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(40):
        own = list(base)
        for k in rng.sample(range(150), rng.randrange(6)):
            own[k] = f"x{i}"
        rows.append((i, " ".join(own)))
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for _, t in rows]
    pairs = [(i, j) for i in range(40) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    got = {r["node"]: r["component"] for r in copies.copy_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    keys = [copies.key_of(copies.words_of(t)) for _, t in rows]
    want, seen = components_of(40, pairs), {}
    assert len(set(want)) > 1 or len(pairs) > 100
    for k, c in zip(keys, want, strict=True):
        assert seen.setdefault(c, got.get(k, k)) == got.get(k, k)
    assert len(set(seen.values())) == len({keys[i] for i in range(40) if want[i] == i})


@pytest.mark.parametrize("trie", [4, 64, 512])
def test_near_prints_connect_what_brute_force_connects(monkeypatch, trie):
    monkeypatch.setattr(copies, "TRIE", trie)
    rng = random.Random(31)
    base = [rng.getrandbits(64) for _ in range(12)]
    bits = np.array([rng.choice(base) ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(9))) for _ in range(300)], np.uint64)
    bits[5] = bits[6] = bits[7]
    group = np.array([rng.randrange(4) if i % 3 else 9 for i in range(300)])
    near = (np.bitwise_count(bits[:, None] ^ bits[None]) <= 10) & (group[:, None] == group[None])
    want = components_of(300, [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    a, b = copies.near_prints(group, bits, 10)
    assert components_of(300, list(zip(a.tolist(), b.tolist(), strict=True))) == want and 20 < len(set(want)) < 200


def test_near_copies_come_from_blocks_of_bits_too(spark, monkeypatch):
    rng = random.Random(41)
    text = lambda: [f"w{rng.randrange(900)}" for _ in range(1500)]
    base = [text() for _ in range(6)]
    near = [[*b[:700], f"x{i}", *b[701:]] for i, b in enumerate(base)]
    rows = [(i, " ".join(t)) for i, t in enumerate(base + near)] + [(20, ""), (21, None)]
    bits = [copies.majority(copies.shingles(copies.words_of(t))) for _, t in rows]
    want = {i for i in range(6) if (bits[i] ^ bits[i + 6]).bit_count() <= copies.EXACT}
    assert len(want) > 2
    # Groups of minima that hold one text each, as those of an unlucky pair.
    sketches = copies.sketches
    monkeypatch.setattr(copies, "sketches", lambda docs, column: sketches(docs, column).withColumn("bands", F.when(F.size("bands") > 0, F.array(F.xxhash64("key"))).otherwise(F.col("bands"))))
    got = {r["node"]: r["component"] for r in copies.copy_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    keys = [copies.key_of(copies.words_of(t)) for _, t in rows]
    assert {i for i in range(6) if keys[i] in got and got[keys[i]] == got[keys[i + 6]]} == want
    assert len(got) == 2 * len(want)
