"""Mixing against a plain computation, packing against the tokenizer itself."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import mixing, packing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_mix(rows):
    """(id, size, source_size, target, taken) by sequential rules."""
    sources = defaultdict(int)
    for _, text, source in rows:
        sources[source] += size(text)
    names = sorted((s for s in sources if s is not None)) + ([None] if None in sources else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sources.values())), set(names)
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * sources[s]}
        for s in over or free:
            target[s] = float(3 * sources[s]) if over else share * weight[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    out = []
    for s in names:
        own = sorted((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), -1 if i is None else i, size(t)) for i, t, x in rows if x == s)
        budget = int(target[s] + 1e-9)
        epochs = budget // sources[s] if sources[s] else 0
        rest = budget - epochs * sources[s]
        for _, i, n in own:
            take = min(rest, n)
            rest -= take
            out.append((None if i == -1 else i, n, sources[s], round(target[s], 6), epochs * n + take))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(i, "w " * (i * 7 % 23), ["small", "big", "tiny", None, "Ωmega", ""][min(5, i % 9)]) for i in range(200)] + [(900, "x " * 500, "huge"), (901, "y", "one")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def mix_rows(docs):
    out, names = mixing.mix(docs, mixing.words(F.col("text")))
    return sorted(((r["doc_id"], r[names["size"]], r[names["source_size"]], round(r[names["target"]], 6), r[names["taken"]]) for r in out.collect()), key=repr)


def test_mix_equals_plain_computation(sources, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    rows, docs = sources
    assert mix_rows(docs) == plain_mix(rows)
    odd = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    got = mix_rows(odd_docs)
    assert got == plain_mix(odd) and mix_rows(no_docs) == []
    assert all(taken <= 3 * n for _, n, _, _, taken in got)


def test_rows_of_a_hot_id_are_spread(spark, monkeypatch):
    """4,000 equal rows with a null id, and 600 others: the whole budget is taken, in ranges of about the same size."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    monkeypatch.setattr(mixing, "HOT_IDS", 10)
    docs = spark.range(4_600).selectExpr("if(id < 4000, null, id) AS doc_id", "'a b c' AS text", "if(id % 2 = 0, 's', 't') AS source", "map('k', id % 2) AS more")
    out, names = mixing.mix(docs, mixing.words(F.col("text")))
    got = out.collect()
    assert len(got) == 4_600 and sum(r.doc_id is None for r in got) == 4_000 and out.columns[:4] == docs.columns
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r[names["taken"]]
        assert r[names["taken"]] <= 9
    assert dict(taken) == {"s": 4_600, "t": 9_200}
    numbered = mixing._numbered(docs, "doc_id", "nth", 4_600)
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("/"), F.col("nth")), F.lit(""))).cast("binary"))
    assert max(r["count"] for r in numbered.groupBy("source", F.substring(digest, 1, 1)).count().collect()) < 400


def test_mixed_rows_hold_the_words_taken(sources, odd_docs, no_docs):
    rows, docs = sources
    words = defaultdict(int)
    for r in mixing.mixed(docs).collect():
        words[r.doc_id] += size(r.text)
    assert {i: n for i, n in words.items() if n} == {i: t for i, _, _, _, t in plain_mix(rows) if t}
    assert mixing.mixed(odd_docs).columns == odd_docs.columns and mixing.mixed(no_docs).count() == 0


@pytest.mark.parametrize(("text", "n", "want"), [("a b c", 2, "a b "), ("  a  b c", 1, "  a  "), ("a b", 2, "a b"), ("é\tß x", 1, "é\t")])
def test_first_words(spark, text, n, want):
    f = spark.createDataFrame([(text, n)], "t string, n long")
    assert f.select(mixing.first_words(F.col("t"), F.col("n"))).first()[0] == want


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [2]


TEXTS = [None, "", "Hello, WORLD's 123 don't!!", "ΟΔΟΣ Σίσυφος ς", "a <|endoftext|> b", "x\x1cy z\x1f", "naïve é ﬁ Å İstanbul", "😀🎉 中文 字", "a b c", "'s 't we'll", "tab\tnew\nline", "ß ẞ", "​﻿ word"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_tokenizer_s(text):
    ids = packing.Ids.of(packing.tokenizer_path())
    assert np.frombuffer(ids(text or ""), "<u2").tolist() == plain_ids(text)[:-1]


def test_ids_of_any_string():
    """50,000 strings of all code points, marks and white space, each as the tokenizer gives it."""
    from tokenizers import Tokenizer

    rng, ids = np.random.default_rng(1), packing.Ids.of(packing.tokenizer_path())
    whole = Tokenizer.from_file(packing.tokenizer_path())
    pools = [np.r_[32:127], np.r_[0:0x300], np.r_[0x300:0x370, 0x8D0:0x900, 97:123], np.r_[0x370:0x3000], np.r_[9:14, 28:33, 0x85, 0xA0, 0x2000:0x200C, 0x2028:0x2030, 0x3000, 65:91], np.r_[0x3000:0xD800, 0xE000:0xFFFF], np.r_[0x10000:0x20000]]
    texts = ["".join(map(chr, rng.choice(pools[rng.integers(len(pools))], 1 + int(rng.integers(4))))) + "".join(map(chr, rng.choice(pools[rng.integers(len(pools))], int(rng.integers(5))))) for _ in range(50_000)]
    texts += ["\u0301\u08d0", "a\u0301\u08d0 \u0301", "\ua7da", "\U00016eb7 x"]
    simple = [chr(c) for c in range(0x3000) if packing.SIMPLE.fullmatch(chr(c))]
    texts += ["".join(rng.choice(simple, 1 + int(rng.integers(6)))) for _ in range(10_000)] + [chr(c) for c in range(0x4E00, 0x9FFF)]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, w in zip(texts, want, strict=True) if np.frombuffer(ids(t), "<u2").tolist() != w] == []


def test_repeated_rows_are_spread_over_groups(spark):
    """6,000 equal rows beside 500 others: groups stay near their bound, and none takes all copies."""
    docs = spark.range(6_500).selectExpr("if(id < 6000, 5, id) AS doc_id", "if(id < 6000, 'the same few words', concat('other ', id)) AS text")
    rows = packing.pack(docs, packing.tokenizer_path(), length=64, group_docs=100).select("doc_id", "doc_tokens", "sequence_id", "offset", "start", "length").collect()
    check_pieces(rows, None, 64)
    firsts = [r for r in rows if r.start == 0]
    assert sum(r.doc_id == 5 for r in firsts) == 6_000 and len(firsts) == 6_500
    by = defaultdict(int)
    for r in firsts:
        by[r.sequence_id >> 32] += 1
    assert len(by) >= 60 and max(by.values()) <= 200


def test_a_group_that_outgrows_its_bound_is_cut(spark, monkeypatch):
    monkeypatch.setattr(packing, "HOT_IDS", 1)
    docs = spark.range(900).selectExpr("1 AS doc_id", "'one text' AS text")
    rows = packing.pack(docs, packing.tokenizer_path(), length=32, group_docs=50).select("doc_id", "doc_tokens", "sequence_id", "offset", "start", "length").collect()
    check_pieces(rows, None, 32)
    assert sum(r.start == 0 for r in rows) == 900


def check_pieces(rows, texts, length):
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id, r.doc_tokens].append(r)
        seqs[r.sequence_id].append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and (at == length or at & (at - 1) == 0)
    return by


def test_pieces_rebuild_every_document(spark, odd_docs, no_docs):
    texts = {i: t for i, t in enumerate(TEXTS)} | {100 + i: "word " * (i * 13 % 300) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.pack(docs, packing.tokenizer_path(), length=256, group_docs=20).collect()
    by = check_pieces(rows, texts, 256)
    assert {k[0] for k in by} == set(texts)
    for (i, n), pieces in by.items():
        want, at = np.array(plain_ids(texts[i]), "<u4"), 0
        assert n == len(want)
        for r in sorted(pieces, key=lambda r: r.start):
            part = want[at : at + r.length].tobytes()
            assert (r.start, r.ids_crc32, bytes(r.ids)) == (at, zlib.crc32(part), part)
            at += r.length
        assert at == n
    odd = packing.pack(odd_docs, packing.tokenizer_path()).collect()
    check_pieces(odd, None, 4096)
    assert sum(r.length for r in odd) == sum(len(plain_ids(r.text)) for r in odd_docs.collect())
    assert packing.pack(no_docs, packing.tokenizer_path()).count() == 0


def test_tournament_finds_the_first_bin():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(1, 100, rng.integers(1, 60)).tolist()
        tree, room = packing.Tournament(len(sizes), 100), [100] * len(sizes)
        for s in sizes:
            want = next(i for i, r in enumerate(room) if r >= s)
            room[want] -= s
            assert tree.first(s) == want


@pytest.mark.parametrize("lengths", [[], [1], [4096], [5000, 3, 4096 * 3], [4095, 2, 2], [100] * 77])
def test_filled_bins_have_no_padding(lengths):
    bins = packing.filled(packing.first_fit(lengths, 4096), 4096)
    sizes = [sum(p[2] for p in b) for b in bins]
    assert sum(sizes) == sum(lengths) and all(s == 4096 or s & (s - 1) == 0 for s in sizes)
    covered = sorted((d, at + i) for b in bins for d, at, n in b for i in range(n))
    assert covered == [(d, i) for d, n in enumerate(lengths) for i in range(n)]
