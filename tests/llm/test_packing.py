import zlib

import numpy as np
import pytest

from textvane.llm import packing
from textvane.llm.catalog import WORD_VOCABULARY


def reference_pieces(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_VOCABULARY)
    tokenizer.encode_special_tokens = True
    out = []
    for row in rows:
        ids = tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            out.append((row[0], piece, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def check_places(rows, capacity=2048):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pieces_and_places(odd_docs, odd_rows):
    rows = packing.pack_documents(odd_docs, WORD_VOCABULARY).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == reference_pieces(odd_rows)
    assert check_places(rows) == -(-sum(r.length for r in rows) // 2048)


WORDS = ["it's", "we'LL", "'s's", "Ünïcödé", "ǅungla", "ΑΣΣ", "İstanbul", "áb", "x\xa0y", "x\x1cy", "12ab3", "***", "<|endoftext|>", "ﬁ", "ß", "×÷", "世界", "😀!", "d'été"]


def test_words_are_those_of_the_library():
    words = packing.WordTokens(WORD_VOCABULARY)
    for text in [*WORDS, " ".join(WORDS), "\t".join(WORDS) + "\x0b\x0c\r\n"]:
        assert words.encode(text) == words.whole(text), text


def test_empty(no_docs):
    assert packing.pack_documents(no_docs, WORD_VOCABULARY).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_few_bins(seed):
    random = np.random.default_rng(seed)
    lengths = random.integers(1, 100, random.integers(1, 400)).tolist()
    place = packing.evolve(lengths, 100, (seed,), [])
    assert place.size == len(lengths)
    load = np.bincount(place, lengths)
    assert load.max() <= 100 and (load > 0).all()
    greedy = packing.Packing(lengths, 100).best_fit(list(range(len(lengths))))
    assert len(load) <= len(greedy.bins)


def test_crossover_and_mutation_lose_nothing():
    random = np.random.default_rng(1)
    lengths = random.integers(1, 60, 300).tolist()
    one = packing.Packing(lengths, 100).best_fit(list(range(300)))
    two = packing.mutate(one, random)
    for child in (packing.crossover(one, two, random), packing.mutate(two, random)):
        assert sorted(p for b in child.bins for p in b) == list(range(300))
        assert all(sum(lengths[p] for p in b) + left == 100 for b, left in zip(child.bins, child.left))


def hard_mixes(bins):
    """Lengths that fill ``bins`` sequences exactly by threes, and lengths of a quarter to a half of one."""
    random = np.random.default_rng(5)
    triples = []
    for _ in range(bins):
        a = int(random.integers(400, 1024))
        b = int(random.integers(256, (2048 - a) * 2 // 3))
        triples += [a, b, 2048 - a - b]
    return {"triples": triples, "quarters": random.integers(500, 1024, 3 * bins).tolist()}


@pytest.mark.parametrize("name", ["triples", "quarters"])
def test_genes_improve_on_greedy(name):
    """With production parameters, on a whole shard: well below best fit, and each epoch starts from the elite."""
    lengths = hard_mixes(2700)[name]
    fewest = -(-sum(lengths) // 2048)
    greedy = len(packing.Packing(lengths, 2048).best_fit(list(range(len(lengths)))).bins)
    place = packing.evolve(lengths, 2048, (0, 0, 0), [])
    first = int(place.max()) + 1
    second = int(packing.evolve(lengths, 2048, (0, 0, 1), [place]).max()) + 1
    assert np.bincount(place, lengths).max() <= 2048
    assert second <= first <= greedy - (greedy - fewest) // 3


def test_fill_bins_takes_the_best_pair():
    sizes = np.array([1, 2, 5, 9, 20])
    assert packing.best_addition(sizes, 14) == [2, 3]  # 5 + 9
    assert packing.best_addition(sizes, 9) == [3]
    assert packing.best_addition(sizes, 4) == [0, 1]
    whole = packing.Packing([60, 30, 10, 55, 45, 99], 100).fill_bins(list(range(6)))
    assert sorted(whole.left) == [0, 0, 1]


def test_poor_sequences_of_all_shards_meet(spark):
    """Shards of one piece and a bit leave sequences half empty; together they take no more than needed."""
    rows = [(i, 0, 0, 700, i) for i in range(100)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack_pieces(pieces, shard_pieces=4).collect()
    assert sorted(tuple(r)[:5] for r in out) == rows
    alone = packing.pack_pieces(pieces).collect()
    assert check_places(out) <= 60 and check_places(alone) == 50


def test_small_shards_and_hot_document(spark):
    rows = [(7, p, 0, 1 + (p * 37) % 900, p) for p in range(400)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack_pieces(pieces, shard_pieces=50).collect()
    assert sorted(tuple(r)[:5] for r in out) == sorted(rows)
    check_places(out)


def test_plain_words_need_no_pattern(monkeypatch):
    """A word of ASCII letters, with or without a mark behind it, is looked up without being split by patterns."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_VOCABULARY)
    monkeypatch.setattr(packing, "_PLAIN", None)
    monkeypatch.setattr(packing, "_SPLIT", None)
    text = "The thing, of words. Over; " + " ".join(f"Wxyz{mark}" for mark in packing._MARKS.decode())
    expected = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.WordTokens(WORD_VOCABULARY).encode(text) == expected
