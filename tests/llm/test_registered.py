"""What is registered, and the contracts' columns on the smallest tables."""

import math
import os
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from test_archives_and_neighbours import brute
from test_dedup import near
from test_mix_and_pack import check_pieces, plain_ids
from test_scans import brute_licenses, plain_spans

from quadrille.llm import registry, simhash

FOLDER = Path(os.environ.get("QUADRILLE_TABLES", "/root/testdata/sf0.001"))

COLUMNS = {
    "op1_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op2_mixing": "doc_id size source_size target taken",
    "op3_nearest": "query_id rank vec_id score",
    "op4_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op5_license_scan": "doc_id template containment",
    "op6_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7_toxicity": "doc_id held_out score predicted",
    "op8_simhash": "doc_id fingerprint component_id",
    "op9_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op10_quality": "doc_id held_out score predicted",
}


def test_all_ten_are_registered():
    assert sorted(registry.QUERIES) == sorted(COLUMNS) and set(registry.ORACLES) <= set(COLUMNS)


@pytest.mark.skipif(not FOLDER.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns_and_sql(spark, name):
    frame = registry.QUERIES[name](spark, str(FOLDER))
    assert set(COLUMNS[name].split()) <= set(frame.columns)
    found = [tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect()]
    assert found or name == "op5_license_scan"
    if name in registry.ORACLES:
        base = duckdb.connect()
        for path in FOLDER.glob("*.parquet"):
            base.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        told = base.execute(registry.ORACLES[name])
        names = [d[0] for d in told.description]
        want = [tuple(r[names.index(c)] for c in sorted(names)) for r in told.fetchall()]
        assert sorted(names) == sorted(frame.columns) and len(found) == len(want)
        for a, b in zip(sorted(found, key=repr), sorted(want, key=repr), strict=True):
            assert all(math.isclose(x, y) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def documents(spark):
    if not FOLDER.exists():
        pytest.skip("no tables")
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(spark, name):
    return registry.QUERIES[name](spark, str(FOLDER)).collect()


def test_secrets_of_the_query(spark, documents):
    import hashlib

    rows = rows_of(spark, "op4_secret_scan")
    assert {r.doc_id for r in rows} == set(documents) and len(rows) == len(documents)
    for r in rows:
        base = plain_spans(documents[r.doc_id])
        kinds = Counter(s.split(":")[0] for s in base.split(",") if s)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


def test_licenses_of_the_query(spark, documents):
    assert {(r.doc_id, r.template) for r in rows_of(spark, "op5_license_scan")} == {(i, n) for i, t in documents.items() for n in brute_licenses(t)}


def test_pieces_of_the_query(spark, documents):
    by = check_pieces(rows_of(spark, "op6_packing"), documents, 4096)
    assert {i for i, _ in by} == set(documents)
    for (i, n), pieces in by.items():
        want, at = np.array(plain_ids(documents[i]), "<u4"), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(want[at : at + r.length].tobytes())
            at += r.length
        assert at == n == len(want)


def test_components_of_the_query(spark, documents):
    ids = list(documents)
    prints = [simhash.fingerprint(documents[i]) for i in ids]
    want = {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, near(prints, ids), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows_of(spark, "op8_simhash")} == want


@pytest.mark.parametrize(("name", "cut"), [("op7_toxicity", 0.3), ("op10_quality", 0.7)])
def test_scores_of_the_query(spark, documents, name, cut):
    rows = rows_of(spark, name)
    assert {r.doc_id for r in rows} == set(documents) and len(rows) == len(documents)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        if name == "op7_toxicity":
            assert r.n_spans == sum(1 for s in r.spans.split(",") if s) and all(0 <= int(a) < int(b) <= len(documents[r.doc_id]) for a, b in (s.split(":") for s in r.spans.split(",") if s))


def test_neighbours_of_the_query(spark):
    if not FOLDER.exists():
        pytest.skip("no tables")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect() if r.embedding is not None]
    want, got = brute(rows, [r for r in rows if r[0] % 100 == 0], 10), defaultdict(list)
    for r in rows_of(spark, "op3_nearest"):
        got[r.query_id].append((r.vec_id, r.score))
    assert {q: len(f) for q, f in got.items()} == {q: len(f) for q, f in want.items()}
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    exact = {(q, a): d for q, v in rows if q % 100 == 0 for a, d in zip([i for i, _ in rows], np.sqrt(((np.array([x for _, x in rows]) - np.array(v)) ** 2).sum(1)), strict=True)}
    assert all(np.isclose(d, exact[q, a], rtol=1e-12) for q, f in got.items() for a, d in f)
