"""WARC round trips, and nearest neighbours against brute force."""

import base64
import gzip
import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import neighbours, warc
from quadrille.llm.common import new_path


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>{'text ' * (i * 37 % 400)}{i % 40}</p>") for i in range(300)]
    rows += [(900, None, None), (901, "http://é x/\r\ny%20", ""), (None, "u", "same"), (None, "u", "same"), (7, "http://h/7", rows[7][2]), (902, "big", "ab" * 500_000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("split_bytes", [1_000, 8_000_000])
def test_archives_give_back_every_page(spark, pages, split_bytes):
    rows, frame = pages
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    by = defaultdict(list)
    for i, p in payloads:
        by[p].append(i)
    want = []
    for i, p in payloads:
        first = max((x for x in by[p] if x is not None), default=None)
        kind = "response" if i == first else "revisit"
        want.append((i, len(p), sha(p), kind, first if kind == "revisit" else None))
    archives = warc.write_archives(frame, new_path(spark, "warc-test"), file_bytes=20_000)
    assert archives.count() > 4
    got = warc.read_archives(archives, split_bytes=split_bytes)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == sorted(want, key=repr)
    whole = {r.page_id: bytes(r.payload) for r in got.where("record_type = 'response' AND page_id IS NOT NULL").collect()}
    assert whole == {i: p for (i, p), w in zip(payloads, want, strict=True) if w[3] == "response" and i is not None}


def test_archives_of_nothing(spark, pages):
    archives = warc.write_archives(pages[1].limit(0), new_path(spark, "warc-test"))
    assert archives.count() == 0 and warc.read_archives(archives).count() == 0


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_each_record_has_one_range():
    """False magic bytes between members, and ranges that end inside a record's magic."""
    members = [warc.record(i, f"u{i}", b"x" * (i * 50), None, False) for i in range(20)]
    data = b""
    places = []
    for i, m in enumerate(members):
        data += b"\x1f\x8b\x08junk" if i % 4 == 0 else b""
        data += gzip.compress(b"no record") if i % 5 == 0 else b""
        places.append(len(data))
        data += m
    for step in (1, 3, 64, 997, 10**6):
        found = [at for s in range(0, len(data), step) for at, _ in warc.members(Bytes(data), s, min(s + step, len(data)), len(data))]
        assert found == places
    assert gzip.decompress(members[3]).startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_a_changed_payload_is_refused():
    whole = gzip.decompress(warc.record(1, "u", b"payload", None, False)).replace(b"payload\r\n\r\n", b"paybacK\r\n\r\n")
    with pytest.raises(ValueError, match="does not match"):
        warc.parsed(whole)


def member(lines, block, version="WARC/1.0"):
    return gzip.compress("\r\n".join([version, *lines, "", ""]).encode() + block + b"\r\n\r\n")


def test_archives_of_other_writers(spark, tmp_path):
    """WARC 1.0, all types, header names in other cases, lines that go on, no lengths, digests of other kinds or none."""
    http = b"HTTP/1.0 200 OK\r\ncontent-type: text/html\r\n\r\n<p>one</p>"
    known = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\ntwo"
    data = [
        member(["WARC-Type: warcinfo", "Content-Type: application/warc-fields", "Content-Length: 10"], b"software:x"),
        member(["warc-type: Response", "warc-target-uri: <http://a/>", "content-type: application/http;", " msgtype=response", f"CONTENT-LENGTH: {len(http)}"], http),
        member(["WARC-Type: request", "Content-Type: application/http; msgtype=request", "Content-Length: 18"], b"GET / HTTP/1.1\r\n\r\n"),
        member(["WARC-Type: metadata", "Content-Length: 4", "Page-Id: x1"], b"a: b", "WARC/1.1"),
        member(["WARC-Type: response", f"Content-Length: {len(known)}", f"WARC-Payload-Digest: SHA1:{sha(b'two')}"], known),
        member(["WARC-Type: response", f"Content-Length: {len(known)}", "WARC-Payload-Digest: md5:abc"], known),
        member(["WARC-Type: resource"], b"no length"),
        member(["WARC-Type: revisit", "Content-Length: 0"], b""),
        member(["WARC-Type: response", "Content-Length: 12", "WARC-Target-URI: dns:a"], b"not by HTTP!"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(data))
    archives = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", sum(map(len, data)), 1)], "path string, bytes long, page_id int")
    for step in (37, 10**6):
        got = [(r.record_type, r.payload and bytes(r.payload), r.payload_bytes, r.payload_digest) for r in warc.read_archives(archives, split_bytes=step).orderBy("at").collect()]
        assert got == [
            ("warcinfo", b"software:x", 10, sha(b"software:x")),
            ("response", b"<p>one</p>", 10, sha(b"<p>one</p>")),
            ("request", b"", 0, sha(b"")),
            ("metadata", b"a: b", 4, sha(b"a: b")),
            ("response", b"two", 3, sha(b"two")),
            ("response", b"two", 3, "abc"),
            ("resource", b"no length", 9, sha(b"no length")),
            ("revisit", None, None, None),
            ("response", b"not by HTTP!", 12, sha(b"not by HTTP!")),
        ]
    assert {r.target_uri for r in warc.read_archives(archives).collect()} == {None, "http://a/", "dns:a"}


def test_pages_with_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "u", "x", 5, 6, "d"), (2, "u", "x", 5, 6, "d")], "page_id long, url string, html string, first long, n long, digest string")
    got = warc.read_archives(warc.write_archives(frame, new_path(spark, "warc-test")))
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got.collect()) == [(1, "revisit", 2), (2, "response", None)]


def brute(rows, queries, k):
    """(query, rank, id, distance) over distinct rows."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for q, v in queries:
        d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), d[j]) for j in order]
    return out


def test_search_recall_scores_and_ties(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1_500, 24)).astype(np.float32)
    x[200:260] = x[100]
    x[400:700] = x[300] + rng.normal(size=(300, 24)).astype(np.float32) * 0.01
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(5_000, None), (5_100, [0.0] * 24), (5_200, [float("nan")] + [1.0] * 23), (5_300, [1.0, 2.0]), (5_400, [float("inf")] * 24), (5_500, [None] + [1.0] * 23), (None, [1.0] * 24), rows[100]]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in neighbours.search(frame, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert set(got) == set(want)
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    assert [a for a, _ in got[100]] == [*range(200, 210)] and [a for a, _ in got[200]] == [100, *range(201, 210)]
    exact = {i: np.array(v) for i, v in rows}
    for q, found in got.items():
        assert len(found) == 10 and all(np.isclose(s, np.sqrt(((exact[q] - exact[i]) ** 2).sum()), rtol=1e-14, atol=0) for i, s in found)


def test_search_of_few_and_of_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in neighbours.search(frame, F.col("id") % 100 == 0).collect()]
    assert sorted(got) == [(0, 1, 3), (0, 2, 100), (100, 1, 3), (100, 2, 0)]
    assert neighbours.search(frame.limit(0), F.col("id") % 100 == 0).count() == 0


def test_a_walk_ends_only_when_its_beam_is_expanded(spark):
    """A chain of 31 nodes, each linked with the next: the other end is 30 steps away."""
    chain = [(i, bytearray(np.array([i], np.float32).tobytes()), [(1.0, i + 1)] if i < 30 else []) for i in range(31)]
    state = spark.createDataFrame(chain, f"node long, h binary, near {neighbours.EDGE}")
    found, met = neighbours.walked(state, spark.createDataFrame([(0,)], "q long"), 128, np.float32)
    assert sorted((r.v, r.d) for r in found.collect()) == [(i, float(i * i)) for i in range(31)]
    assert sum(m.count() for m in met) == 31
    found, met = neighbours.walked(state, spark.createDataFrame([(15,)], "q long"), 4, np.float32, 1)
    assert sorted(r.v for r in found.collect()) == [15, 16, 17, 18] or sorted(r.v for r in found.collect()) == [13, 14, 15, 16, 17]


def test_the_beam_grows_with_the_graph():
    beams = [neighbours.beam_of(n) for n in (0, 1, neighbours.BEAM_NODES, 51_282, 205_000, 10**6)]
    assert beams[:3] == [neighbours.BEAM] * 3 and beams[2] < beams[3] < beams[4] < beams[5]


def test_a_large_vector_and_near_copies_take_no_precision(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[500:700] = x[500] + rng.normal(size=(200, 16)) * 1e-5
    x[899] = 1e6
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = defaultdict(set)
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 10)
    assert sum(len(got[q] & {a for a, _ in want[q]}) for q in want) >= 0.95 * 10 * len(want)


def test_ties_beyond_those_scored_go_to_the_smaller_id(spark):
    rows = [(i, [float(i == j) for j in range(60)]) for i in range(60)]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()
    got = {q: sorted(r.vec_id for r in found if r.query_id == q) for q in (0, 20, 40)}
    assert got == {0: [*range(1, 11)], 20: [*range(10)], 40: [*range(10)]}


@pytest.mark.parametrize("near,far", [(1, 1), (1_500, 4)])
def test_small_groups_that_lie_apart_find_each_other(spark, near, far):
    """Two distinct vectors, and a tight group of four far away from a large one: every query has all k, or all there are."""
    rng = np.random.default_rng(9)
    x = np.r_[rng.normal(size=(near, 8)) * 1e-3 + 1, rng.normal(size=(far, 8)) * 1e-3 - 1]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.search(frame, F.col("id") >= near - (near == 1)).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = brute(rows, rows[near - (near == 1) :], 10)
    assert dict(got) == {q: [a for a, _ in found] for q, found in want.items()}


def test_a_query_walks_every_shard_in_few_stages(spark):
    """Each shard's graph and walks are one task; before, every round and step was joins over the whole table."""
    rng = np.random.default_rng(12)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(5_000, 16)))]
    assert [neighbours.shards_of(n) for n in (1, 4_096, 4_097, 51_282, 786_432, 3_145_728, 6_553_600)] == [1, 1, 6, 6, 48, 48, 100]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(2)
    spark.sparkContext.setJobGroup("walks", "walks")
    found = neighbours.search(frame, F.col("id") % 100 == 0).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("walks")
    spark.sparkContext.setJobGroup("after", "after")
    assert 0 < len(jobs) < 40
    got = defaultdict(set)
    for r in found:
        got[r.query_id].add(r.vec_id)
    want = brute(rows, rows[::100], 10)
    assert sum(len(got[q] & {a for a, _ in want[q]}) for q in want) >= 0.95 * 10 * len(want)
