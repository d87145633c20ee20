import hashlib
import re

import pytest

from textvane.llm import exact_dedup


def brute(rows):
    texts = [(r[0], r[1] or "") for r in rows]
    groups = {}
    for doc, text in texts:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((doc, text))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(doc, keep, len(members), doc == keep, sha) for doc, _ in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("hash_bits, bucket_keys", [(64, 4096), (2, 4), (64, 2)])
def test_groups(odd_docs, odd_rows, hash_bits, bucket_keys):
    """Few hash bits chain different texts under one key; small buckets split the directory."""
    found = exact_dedup.exact_groups(odd_docs, hash_bits=hash_bits, bucket_keys=bucket_keys)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(odd_rows)


def test_empty(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.drop_exact_copies(no_docs).count() == 0


def test_no_bucket_overflows(spark):
    keys = spark.range(3000).selectExpr("xxhash64(id) as key")
    placed = exact_dedup.build_directory(keys, 100).locate(keys)
    sizes = placed.groupBy("depth", "bucket").count().collect()
    assert max(r["count"] for r in sizes) <= 100 and sum(r["count"] for r in sizes) == 3000


def test_lopsided_keys_split(spark):
    keys = spark.range(1000).selectExpr("id as key").union(spark.range(3).selectExpr("id - 9000000000000000000 as key"))
    placed = exact_dedup.build_directory(keys, 50).locate(keys)
    sizes = placed.groupBy("depth", "bucket").count().collect()
    assert max(r["count"] for r in sizes) <= 50 and max(r["depth"] for r in sizes) > 50


def test_stage_keeps_columns_and_one_of_each(odd_docs, odd_rows):
    kept = exact_dedup.drop_exact_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({r[1] for r in brute(odd_rows)}, key=repr)


def test_stage_keeps_different_texts_under_one_id(spark):
    """Null ids and repeated ids; copies under other ids; longer text, whole repeats and white space."""
    rows = [(None, "A"), (None, "BB"), (7, "A"), (7, "BB"), (7, "CCC"), (7, "CCC"), (7, "C C C"), (None, "D"), (None, "D"), (8, "D "), (9, "only")]
    docs = spark.createDataFrame([(text, doc) for doc, text in rows], "text string, doc_id long").repartition(3)
    kept = exact_dedup.drop_exact_copies(docs)
    want = [(7, "A"), (7, "BB"), (7, "C C C"), (8, "D "), (9, "only")]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == want
    alone = exact_dedup.drop_exact_copies(docs.where("doc_id is null")).collect()
    assert sorted((r.doc_id, r.text) for r in alone) == [(None, "A"), (None, "BB"), (None, "D")]


def test_rows_are_found_through_the_directory(odd_docs, odd_rows, monkeypatch):
    """If a directory sent rows to other buckets than their texts, they would not be found."""
    rows, index, directory = exact_dedup.build_index(exact_dedup.columns_as(odd_docs, id="doc_id", text="text"), bucket_keys=2)
    assert directory.splits or directory.depth
    wrong = exact_dedup.Directory(max(0, directory.depth - 1) if directory.depth else 1)
    monkeypatch.setattr(exact_dedup, "build_index", lambda *a: (rows, index, wrong))
    assert exact_dedup.exact_groups(odd_docs, bucket_keys=2).count() < len(odd_rows)


def test_a_text_for_a_third(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i % 500}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = sorted(map(tuple, exact_dedup.exact_groups(docs, bucket_keys=16).collect()), key=repr)
    assert found == brute(rows)
