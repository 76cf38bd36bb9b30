"""Exact and near copies against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quadrille.llm import exact_dedup, simhash
from quadrille.llm.common import spread_join
from quadrille.llm.components import components


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_groups_equal_brute_force(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    by = defaultdict(list)
    for r in rows:
        by[lowered(r.text)].append(r.doc_id)
    want = []
    for r in rows:
        group = by[lowered(r.text)]
        keep = max((i for i in group if i is not None), default=None)
        want.append((r.doc_id, keep, len(group), r.doc_id == keep, hashlib.sha256(lowered(r.text).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.groups(odd_docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert exact_dedup.groups(no_docs).count() == 0


def test_deduplicated_keeps_one_row_of_each_text(odd_docs, no_docs):
    kept = exact_dedup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [lowered(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({lowered(r.text) for r in odd_docs.collect()})
    assert {r.doc_id for r in kept.collect() if lowered(r.text).startswith("alpha")} == {2}
    assert exact_dedup.deduplicated(no_docs).count() == 0


@pytest.mark.parametrize("most", [300, 5_000, 10**9])
def test_grace_recursion_at_any_table_size(tmp_path, most):
    rng = random.Random(3)
    contents = [b"%d" % rng.randrange(300) * rng.randrange(1, 4) for _ in range(2_000)]
    records = [(hashlib.sha256(c).digest(), c, [i, 1, 1]) for i, c in enumerate(contents)]
    got = {c: v for _, c, v in exact_dedup.grace(iter(records), str(tmp_path), most=most)}
    assert {c: (v[0], v[1]) for c, v in got.items()} == {c: (max(i for i, x in enumerate(contents) if x == c), contents.count(c)) for c in set(contents)}
    assert not list(tmp_path.iterdir())


def test_contents_of_one_digest_stay_apart(tmp_path):
    digest = b"\1" * 32
    records = [(digest, b"%d" % (i % 5), [i, 1, 1]) for i in range(50)]
    got = list(exact_dedup.grace(iter(records), str(tmp_path), most=10))
    assert len(got) == 5 and all(v[1] == 10 for _, _, v in got)


def plain_fingerprint(text):
    words = lowered(text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "one", "a b c", "a b c d", "A B c D e", "é É x y z", "x\xa0y z w v", "a b\tc\nd e f g h i j"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def near(prints, ids):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    by = defaultdict(list)
    for i, k in enumerate(ids):
        by[find(i)].append(k)
    return [min((x for x in by[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_near_groups_equal_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(9)
    base = [rng.choice("abcdefgh") * 3 + str(rng.randrange(99)) for _ in range(150)]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = str(rng.randrange(10**6))
        rows.append((100 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [simhash.fingerprint(t) for _, t in rows]
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, near(prints, [i for i, _ in rows]), strict=True)]
    got = [tuple(r) for r in simhash.groups(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = simhash.deduplicated(docs)
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted({c for _, _, c in want if c is not None})
    assert simhash.groups(no_docs).count() == 0 and simhash.deduplicated(no_docs).count() == 0
    assert simhash.deduplicated(odd_docs).columns == odd_docs.columns


def close_prints(rng, n):
    """Fingerprints, each with another that differs in at most four bits, and all ways that small clusters chain."""
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    flips = np.zeros(len(base), np.uint64)
    for _ in range(4):
        flips |= np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)
    return np.unique(np.concatenate([base, base ^ flips]))


def test_bands_part_the_bits():
    for bits in (2**64 - 1, 2**64 - 1 - (0x7FFFF << 8), 0xFF00FF00FF00FF00):
        masks = simhash.bands(bits)
        assert len(masks) == 4 and sum(masks) == bits == masks[0] | masks[1] | masks[2] | masks[3]
    assert [m.bit_count() for m in simhash.bands(2**64 - 1)] == [19, 15, 15, 15]


def test_trees_lose_no_pair():
    """Of two near fingerprints one meets the other at its home, and no tree makes a fingerprint visit without a radius."""
    fps = close_prints(np.random.default_rng(4), 600)
    trees = simhash.forest(fps, 40 * len(fps))
    assert max(t.leaves for t in trees) > 20
    home, come = defaultdict(set), defaultdict(set)
    for tree in trees:
        visits = 0
        for leaf, rows, own in tree.route(fps, np.ones(len(fps), bool)):
            home[leaf] |= set(rows[own].tolist())
            come[leaf] |= set(rows.tolist())
            visits += int((~own).sum())
        assert (visits > 0) == (tree.radius > 0)
    met = {(a, b) for leaf in home for a in home[leaf] for b in come[leaf] if a != b}
    for a in range(len(fps)):
        assert sum(a in home[leaf] for leaf in home) == len(trees)
        for b in np.nonzero(np.bitwise_count(fps ^ fps[a]) <= 4)[0].tolist():
            assert a == b or (a, b) in met or (b, a) in met


@pytest.mark.parametrize("split", [60, 10**9])
def test_links_of_split_shards_equal_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT_ROWS", split)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 40)
    monkeypatch.setattr(simhash, "OWN_BLOCK", 50)
    rng = np.random.default_rng(5)
    spread = close_prints(rng, 400)
    tight = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 19, 200, dtype=np.uint64))
    fps = np.unique(np.concatenate([spread, tight]))
    found = components(simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"))).collect()
    got = {r.node: r.root for r in found}
    want = near([int(x) for x in fps], [int(x) for x in fps.view(np.int64)])
    assert [got.get(int(x), int(x)) for x in fps.view(np.int64)] == want


def test_a_hot_key_is_spread(spark):
    rows = spark.range(3_000).selectExpr("id", "if(id % 3 = 0, 7, id) AS k", "1 AS salt")
    table = spark.range(3_000).selectExpr("id AS k", "id * 2 AS v", "3 AS hot")
    counts = rows.groupBy("k").count().withColumnRenamed("count", "n")
    got = spread_join(rows, table, "k", F.col("id"), counts, 3_000)
    assert got.columns == ["k", "id", "salt", "v", "hot"]
    assert sorted((r.id, r.k, r.v) for r in got.collect()) == [(i, 7 if i % 3 == 0 else i, 14 if i % 3 == 0 else 2 * i) for i in range(3_000)]


def test_blocks_connect_what_pairs_connect():
    far = 0xFFFFFFFF00000000
    fps = np.array([0, 1, 3, far, far + 15, far + 255, 0xFFFF00000000], np.uint64)
    nodes, least = simhash._near(fps[:3], fps)
    assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == {0: 0, 1: 0, 3: 0}
    nodes, least = simhash._near(fps, fps)
    assert dict(zip(nodes.tolist(), least.tolist(), strict=True))[far + 255] == far


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100} and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
