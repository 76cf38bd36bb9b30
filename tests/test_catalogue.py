"""Every registered query against its SQL, on the smallest tables."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quadrille.plans import catalogue

FOLDER = Path(os.environ.get("QUADRILLE_TABLES", "/root/testdata/sf0.001"))
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    if not FOLDER.exists():
        pytest.skip(f"no tables in {FOLDER}")
    base = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        base.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return base


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    return float(value) if isinstance(value, (int, float)) else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, str(FOLDER))
    got = rows(frame.columns, frame.collect())
    told = duck.execute(catalogue.ORACLES[name])
    assert got == rows([d[0] for d in told.description], told.fetchall())


def test_sample_keeps_its_sizes(spark):
    if not FOLDER.exists():
        pytest.skip(f"no tables in {FOLDER}")
    frame = catalogue.QUERIES["q_sample"](spark, str(FOLDER))
    counts = {r.stratum: r["count"] for r in frame.groupBy("stratum").count().collect()}
    assert counts and all(n <= (4 if s.endswith("true") else 2) for s, n in counts.items())
    assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, catalogue.QUERIES["q_sample"](spark, str(FOLDER)).collect()))


def test_entry_imports_without_the_training_subpackage():
    code = "import sys; sys.modules['quadrille.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'q_pr' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": str(ROOT)})


@pytest.mark.parametrize("name", ["q_pr", "q_match", "q_ap", "q_map", "q_size_quartile"])
def test_matching_writes_no_table_of_pairs(spark, monkeypatch, name):
    from quadrille.operators import grouping, matching

    labels = []
    for module in (matching, grouping):
        wrote = module.written
        monkeypatch.setattr(module, "written", lambda frame, label, wrote=wrote: (labels.append(label), wrote(frame, label))[1])
    catalogue.QUERIES[name](spark, str(FOLDER)).collect()
    assert not {"match-edges", "match-pairs"} & set(labels)


@pytest.mark.parametrize("name", ["q_nms", "q_lineage", "q_candidates", "q_nms_sweep"])
def test_suppression_writes_no_table_of_conflicts(spark, monkeypatch, name):
    from quadrille.operators import suppress

    labels, wrote = [], suppress.written
    monkeypatch.setattr(suppress, "written", lambda frame, label: (labels.append(label), wrote(frame, label))[1])
    catalogue.QUERIES[name](spark, str(FOLDER)).collect()
    assert "blocks" in labels and "conflicts" not in labels
