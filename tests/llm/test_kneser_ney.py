import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textvane.llm import kneser_ney as K
from textvane.llm.language import in_fold


def split(text):
    return (text or "").encode().lower().split() + ["end"]


def brute(rows, held):
    """(doc, held, tokens, known, N, base, score) by dictionaries."""
    count, pairs = Counter(), Counter()
    for doc, text in rows:
        if not held(doc):
            words = split(text)
            count.update(words)
            pairs.update(zip(["start", *words[:-1]], words))
    n, v, distinct = sum(count.values()), len(count), len(pairs)
    before, follows, kinds = Counter(w for _, w in pairs), Counter(), defaultdict(lambda: [0, 0, 0])
    for (a, _), c in pairs.items():
        follows[a] += c
        kinds[a][min(c, 3) - 1] += 1

    def d(values):
        return (0.0, *K.discounts(np.array([sum(1 for x in values if x == k) for k in (1, 2, 3, 4)])))

    high, low = d(list(pairs.values())), d(list(before.values()))
    rest = sum(low[min(x, 3)] for x in before.values()) / distinct if distinct else 1.0

    def lower(w):
        return max(before[w] - low[min(before[w], 3)], 0) / max(1, distinct) + rest / (v + 1)

    def chance(a, w):
        if not follows[a]:
            return lower(w)
        spread = sum(high[k + 1] * kinds[a][k] for k in range(3)) / follows[a]
        return max(pairs[a, w] - high[min(pairs[a, w], 3)], 0) / follows[a] + spread * lower(w)

    out = []
    for doc, text in rows:
        words = split(text)
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        score = sum(math.log10(chance(a, w)) for a, w in zip(["start", *words[:-1]], words))
        out.append((doc, held(doc), len(words), sum(count[w] > 0 for w in words), n, base, score))
    return out


def check(found, want):
    got = sorted(map(tuple, found.collect()), key=lambda r: repr(r[:5]))
    want = sorted(want, key=lambda r: repr((r[0], r[2], r[1], *r[3:5]) if False else r[:5]))
    assert [r[:5] for r in got] == [(r[0], r[1], r[2], r[3], r[4]) for r in want]
    for mine, theirs in zip(got, want):
        assert mine[5:] == pytest.approx(theirs[5:], rel=1e-9, abs=1e-9)


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def test_odd_rows(odd_docs, odd_rows):
    check(K.held_out_scores(odd_docs, in_fold("id", 7, 2)), brute([r[:2] for r in odd_rows], held))


def test_corpus_and_frequent_words(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(K, "TOKENS_AT_ONCE", 2000)
    found = K.held_out_scores(docs.repartition(5), in_fold("id", 7, 2))
    check(found, brute(rows, held))
    apart = found.where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b").first()
    assert apart.s > apart.b


def test_nothing_learnt_and_empty(spark, no_docs):
    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    row = K.scored(docs, K.train(docs.limit(0))).first()
    assert (row.n_tokens, row.n_known, row.base_score, row.score) == (3, 0, 0.0, 0.0)
    assert K.held_out_scores(no_docs, in_fold("id", 7, 2)).count() == 0


def test_tokens(monkeypatch):
    texts = ["", "A\tb\n", " x " * 9, "É é", "ab" * 40, "\n"]
    keys, sizes = K.tokens(texts)
    monkeypatch.setattr(K, "STRETCH", 7)
    again, _ = K.tokens(texts)
    assert np.array_equal(keys, again)
    assert sizes.tolist() == [len(split(t)) for t in texts]
    words = [w for t in texts for w in ("start", *split(t))]
    assert len(set(zip(words, keys.tolist()))) == len(set(words)) == len(set(keys.tolist()))
    assert K.tokens(["Q q Q"])[0][1:4].tolist() == [K.tokens(["q"])[0][1]] * 3


def test_frequent_words_are_dealt_by_pair():
    shards = K.Shards(4, [77])
    second = np.arange(1000, dtype=np.uint64)
    assert len(set(shards.of_pair(np.full(1000, 77, np.uint64), second).tolist())) == 16
    assert len(set(shards.of_pair(np.full(1000, 78, np.uint64), second).tolist())) == 1


def test_counts_beyond_32_bits(tmp_path):
    """Neither messages nor files wrap."""
    small, large = np.array([1, 2, 7]), np.array([1, (1 << 32) + 5, (1 << 40) + 1])
    for values in (small, large, np.empty(0, np.int64)):
        assert K.unpack_counts(K.pack_counts(values)).tolist() == values.tolist()
    K.write_counts(str(tmp_path), "counts-0", small)
    K.write_counts(str(tmp_path), "counts-1", large)
    model = K.Model(str(tmp_path), 2, [], 0, 0, 0, (0, 0, 0), (0, 0, 0), 0.0)
    mapped = K.Mapped(model)
    assert mapped._array("counts", 0).dtype == np.uint32 and mapped._array("counts", 0).tolist() == small.tolist()
    assert mapped._array("counts", 1).tolist() == large.tolist()
    assert mapped._array("counts", 2).size == 0
