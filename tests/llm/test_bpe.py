import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from textvane.llm import bpe
from textvane.llm.catalog import BYTE_RANKS

PATTERN = public_tokenizers.PATTERN
ALPHABET = "ab  \n\t'sre ld0129é世界ñ 　—*#́😀\x1c"


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(BYTE_RANKS, PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.vocabulary.ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 40))) for _ in range(n)]


def test_random_texts(codec, reference):
    for text in [*texts(3000, 1), "a" * 3000, " " * 2000, "=-" * 999, "\n" * 50 + "x"]:
        encoded = codec.encode(text)
        assert ids(encoded) == reference.encode_ordinary(text)
        assert codec.decode(encoded) == text.encode()


def test_table_holds_every_prefix(codec):
    rnd = random.Random(2)
    for _ in range(200):
        piece = bytes(rnd.choices(b"thenig rsa", k=rnd.randint(1, 25)))
        table = bpe.PrefixTable(codec.vocabulary, piece)
        for end in range(1, len(piece) + 1):
            assert table.last[end - 1] == bpe.merge(piece[:end], codec.vocabulary.ranks)[-1]


def test_append_and_replace(codec):
    table = bpe.PrefixTable(codec.vocabulary, b"under")
    table.append(b"standing")
    assert table.encoding() == bpe.PrefixTable(codec.vocabulary, b"understanding").encoding()
    table.replace(5, b"lined")
    assert table.encoding() == bpe.PrefixTable(codec.vocabulary, b"underlined").encoding()


def test_edits_near_and_far(codec, reference):
    rnd = random.Random(3)
    edited, text = bpe.EditedText(codec), ""
    for _ in range(1500):
        at = rnd.randint(0, len(text))
        gone = rnd.randint(0, min(4, len(text) - at))
        new = "".join(rnd.choices(ALPHABET, k=rnd.randint(0, 6)))
        text = text[:at] + new + text[at + gone :]
        edited.edit(at, gone, new)
        if len(text) > 150:
            edited.edit(40, len(text) - 40, "")
            text = text[:40]
        assert ids(edited.encoding()) == reference.encode_ordinary(text)
    edited.append(" and more")
    assert ids(edited.encoding()) == reference.encode_ordinary(text + " and more")


def test_rows(odd_docs, odd_rows, no_docs, reference):
    encoded = bpe.encoded(odd_docs, BYTE_RANKS, PATTERN)
    rows = bpe.decoded(encoded, BYTE_RANKS, PATTERN).collect()
    got = sorted(((r.doc_id, ids(bytes(r.ids)), hashlib.sha256(bytes(r.decoded)).hexdigest()) for r in rows), key=repr)
    want = [(r[0], reference.encode_ordinary(r[1] or ""), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in odd_rows]
    assert got == sorted(want, key=repr)
    assert bpe.encoded(no_docs, BYTE_RANKS, PATTERN).count() == 0


def test_query_columns(spark, tmp_path, odd_docs, odd_rows, reference):
    from textvane.llm.catalog import op10_prefix_table_byte_bpe

    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for row in odd_rows:
        text = row[1] or ""
        found = reference.encode_ordinary(text)
        want.append((row[0], len(found), sha(b"".join(i.to_bytes(4, "little") for i in found)), sha(text.encode())))
    got = op10_prefix_table_byte_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
