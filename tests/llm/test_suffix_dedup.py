import hashlib
import random

import numpy as np
import pytest

from textvane.llm import suffix_dedup as S


def brute(rows, length=50):
    last = float("inf")
    docs = [(last if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    starts = {}
    for doc, data in docs:
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            starts[w] = min(doc, starts.get(w, doc))
    out = []
    for doc, data in docs:
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if starts[data[s : s + length]] < doc:
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((None if doc == last else doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def random_rows(seed, n=120):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choices("abcde é", k=rnd.randint(40, 160))) for _ in range(8)] + ["x" * 90, "ab" * 60]
    rows = []
    for doc in rnd.sample(range(1000), n):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            if rnd.random() < 0.5:
                p = rnd.choice(passages)
                a = rnd.randint(0, len(p) // 3)
                parts.append(p[a : rnd.randint(a, len(p))])
            else:
                parts.append("".join(rnd.choices("abcdefghij klm", k=rnd.randint(0, 60))))
        rows.append((doc, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed, block_bytes, hot_segments", [(1, 1 << 22, 64), (2, 600, 64), (3, 600, 2), (4, 200, 0), (5, 1 << 22, 5)])
def test_random_texts(spark, seed, block_bytes, hot_segments):
    """One block or many; frequent anchors sent as segments or as single strings."""
    rows = random_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = S.drop_repeated_passages(docs, block_bytes=block_bytes, hot_segments=hot_segments)
    got = sorted(map(tuple, found.collect()), key=repr)
    want = brute(rows)
    assert sum(r[2] for r in want) > 1000
    assert got == want


def test_odd_rows(odd_docs, odd_rows):
    assert sorted(map(tuple, S.drop_repeated_passages(odd_docs, block_bytes=20_000).collect()), key=repr) == brute(odd_rows)


def test_kept_bytes_and_empty(spark, no_docs):
    assert S.drop_repeated_passages(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "q" * 10 + "z" * 60), (2, "z" * 60 + "r")], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept) for r in S.drop_repeated_passages(docs, keep_bytes=True).collect()}
    assert kept == {1: b"q" * 10 + b"z" * 60, 2: b"r"}


def test_hashes_and_least():
    data = np.random.default_rng(0).integers(0, 4, 500).astype(np.uint8)
    for length in (1, 2, 5, 24, 50):
        hashes = S.string_hashes(data, length)
        by = {}
        for i, h in enumerate(hashes.tolist()):
            by.setdefault(h, set()).add(data[i : i + length].tobytes())
        assert len(hashes) == 501 - length and all(len(x) == 1 for x in by.values())
    values = np.random.default_rng(1).integers(0, 1000, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 27, 64):
        assert np.array_equal(S.sliding_least(values, width), [values[i : i + width].min() for i in range(201 - width)])


def test_levels_grow_geometrically():
    family, random = S.LevelFamily(), np.random.default_rng(0)
    seen = {}
    for block in range(40):
        keys = np.unique(random.integers(0, 5000, 100).astype(np.uint64))
        for k in keys.tolist():
            seen.setdefault(k, set()).add(block)
        family.add(S.Level(keys, np.full(keys.size, block, np.int32), np.zeros(keys.size, bool)))
        sizes = [x.keys.size for x in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    whole = family.whole()
    twice = {k for k, t in zip(whole.keys.tolist(), whole.twice.tolist()) if t}
    assert twice == {k for k, blocks in seen.items() if len(blocks) > 1}


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(S, "string_hashes", lambda data, length: np.zeros(max(0, data.size - length + 1), np.uint64))
    data = np.frombuffer(b"aaaabbbbaaaa", np.uint8)
    assert S.least_holders(data, np.array([0, 4, 8]), np.array([5, 1, 3]), 4).tolist() == [3, 1, 3]


def test_distinct_segments():
    data = np.frombuffer(b"abcdefgh-abcdefgh+abcdefgx", np.uint8)
    starts, counts = np.array([0, 9, 18, 1, 10]), np.array([3, 3, 3, 2, 1])
    found = S.distinct_segments(data, starts, counts, np.array([0, 0, 0, 1, 1]), 6)
    assert found.tolist() == [2, 2]
    assert S.distinct_segments(data, starts[:0], counts[:0], starts[:0], 6).tolist() == []


def test_edges_of_a_common_passage_are_split(spark, monkeypatch):
    """A passage in every document: what one owner gets for an anchor is bounded, and the result stays."""
    passage = "the passage that each of these documents has somewhere in it, longer than fifty bytes by far"
    rnd = random.Random(4)
    prose = lambda n: "".join(rnd.choices("abcdefgh ijklm", k=n))
    rows = [(i, f"{prose(60)}{passage}{prose(60)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    blocks, _ = S.make_blocks(S.columns_as(docs, id="doc_id", text="text"))
    hot = [np.unpackbits(np.frombuffer(m.hot, np.uint8)).sum() for m in S._marks(blocks, 8, 50, 24, 40).collect()]
    assert sum(hot) > 0
    assert sorted(map(tuple, S.drop_repeated_passages(docs, hot_segments=40).collect()), key=repr) == brute(rows)


def test_marks_come_from_the_merge_scans(spark, monkeypatch):
    """Levels that never look at each other would miss what two batches share."""
    family, keys = S.LevelFamily(), np.arange(10, dtype=np.uint64)
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest: np.full(np.size(v), np.size(a)))
    for block in range(2):
        family.add(S.Level(keys, np.full(10, block, np.int32), np.zeros(10, bool)))
    assert not family.whole().twice.any()
