"""The stages of the corpus pipeline, held against brute force on small tables."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from test_dedup import near, plain_fingerprint
from test_mix_and_pack import plain_ids, plain_mix
from quadrille.llm import exact_dedup, packing, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables: clean, toxic, copied and nearly copied documents, some of them labelled."""
    path = tmp_path_factory.mktemp("tables")
    clean = [f"{'river stone light field ' * 3} {' '.join(f'word{(i * 31 + j * 7) % 911}' for j in range(60))}" for i in range(160)]
    rows = [(i, t + (" zzbad zzbadly you" if i % 4 == 0 else ""), "en", f"s{i % 3}", len(t), i % 4 == 0) for i, t in enumerate(clean)]
    rows += [(1_000 + i, clean[1].upper() if i % 2 else clean[1], "en", "s1", 9, False) for i in range(5)]
    rows += [(2_000 + i, clean[2] + f" extra{i}", None, None, None, False) for i in range(4)]
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], 1, int(r[5])) for r in rows[:140]], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages_in_order(spark, folder, monkeypatch):
    monkeypatch.setattr(toxicity, "SURPRISE", 4.0)
    path, rows = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = stages["toxicity"](spark, docs, path)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows if not r[5]}
    once = stages["exact_dedup"](spark, kept, path)
    best = {}
    for r in kept.collect():
        key = exact_dedup.normalised(r.text)
        best[key] = max(best.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(best.values())
    apart = stages["simhash_near_dedup"](spark, once, path)
    left = {r.doc_id for r in apart.collect()}
    assert left <= {r.doc_id for r in once.collect()} and len(left & {2, 2_000, 2_001, 2_002, 2_003}) < 5
    mixed = stages["mixing"](spark, apart, path)
    count = lambda f: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in f.collect())
    assert mixed.columns == docs.columns and abs(count(mixed) - count(apart)) <= 4
    packed = stages["packing"](spark, mixed, path).collect()
    ids = packing.Ids.of(packing.tokenizer_path())
    assert sum(r.length for r in packed) == sum(len(ids(r.text)) // 2 + 1 for r in mixed.collect())


def test_run_equals_plain_steps(spark, folder, monkeypatch):
    """The documents, the tokens of each and the sequences, by plain computation from the tables."""
    monkeypatch.setattr(toxicity, "SURPRISE", 4.0)
    path, rows = folder
    clean = {r[0]: r for r in rows if not r[5]}
    once = sorted({exact_dedup.normalised(r[1]): i for i, r in sorted(clean.items())}.values())
    apart = sorted(set(near([plain_fingerprint(clean[i][1]) for i in once], once)))
    want = Counter()
    for i, words, _, _, taken in plain_mix([(i, clean[i][1], clean[i][3]) for i in apart]):
        text = clean[i][1]
        cut = re.match(r"(?:[^ ]+ *){%d}" % (taken % words), text).group() if taken % words else None
        tokens = taken // words * len(plain_ids(text)) + (len(plain_ids(cut)) if cut else 0)
        want += Counter({i: tokens})  # documents of no tokens are left out
    packed = corpus_pipeline.run(spark, path).collect()
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == want and len(apart) < len(once) < len(clean) < len(rows)
    at = Counter()
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 4_096


def test_stages_of_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
