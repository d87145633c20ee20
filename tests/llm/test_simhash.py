import random

import numpy as np
import pytest
import xxhash

from textvane.llm import simhash
from textvane.llm.components import components


def slow_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, distance=4):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(ids))]


def test_fingerprint_is_the_definition(spark, odd_rows):
    for row in odd_rows:
        assert simhash.fingerprint(row[1]) == slow_fingerprint(row[1])
    jvm = spark.sql("select xxhash64('the quick brown fox') as h").first().h
    assert simhash.fingerprint("The QUICK\tbrown  fox") == jvm % (1 << 64)


def test_groups(odd_docs, odd_rows):
    found = simhash.near_groups(odd_docs).collect()
    fps = [slow_fingerprint(r[1]) for r in odd_rows]
    want = [(r[0], f"{fp:016x}", c) for r, fp, c in zip(odd_rows, fps, brute_components([r[0] for r in odd_rows], fps))]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_empty(no_docs):
    assert simhash.near_groups(no_docs).count() == 0
    assert simhash.keep_one_per_group(no_docs).columns == no_docs.columns


def clouds(seed, centres=40, size=30):
    rnd = random.Random(seed)
    out = set()
    for _ in range(centres):
        centre = rnd.getrandbits(64)
        for _ in range(size):
            out.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 7))))
    return sorted(out)


@pytest.mark.parametrize("thresholds, block", [((0, 0, 0, 0, 0), 10), ((1, 0, 0, 0), 1000), ((2, 1), 25), ((1, 1, 0), 1000), ((3, 0), 1000), (None, 1000)])
def test_no_link_is_lost(spark, thresholds, block):
    """Every way of allotting thresholds finds what comparing all pairs finds."""
    fps = clouds(3, 10, 10) if thresholds == (3, 0) else clouds(len(thresholds or ()))
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    parts = None
    if thresholds:
        deal = np.array_split(np.random.default_rng(0).permutation(64), len(thresholds))
        parts = [simhash.Part(tuple(map(int, bits)), t) for bits, t in zip(deal, thresholds)]
        assert sum(t + 1 for t in thresholds) == 5
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, parts, block)
    roots = {r.node: r.root for r in components(links).collect()}
    want = brute_components(signed, fps)
    assert [roots.get(x, x) for x in signed] == want


def test_chosen_parts_cover_the_distance():
    for n in (10, 10**5, 10**8, 10**11):
        parts = simhash.choose_parts(n, np.full(64, 0.5), np.eye(64))
        assert sum(p.most + 1 for p in parts) == 5
        bits = [b for p in parts for b in p.bits]
        assert len(bits) == len(set(bits))
    few, many = simhash.choose_parts(10**4, np.full(64, 0.5), np.eye(64)), simhash.choose_parts(10**11, np.full(64, 0.5), np.eye(64))
    assert len(many) < len(few)  # wider parts when there are more fingerprints


def test_components_of_chain_star_and_pair(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(300)] + [(7000, -3), (5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {i: 0 for i in range(51)} | {200 + i: 100 for i in range(300)} | {100: 100, 7000: -3, -3: -3}
    assert found == want


def test_stage_keeps_one_of_each(odd_docs, odd_rows):
    fps = [slow_fingerprint(r[1]) for r in odd_rows]
    comps = brute_components([r[0] for r in odd_rows], fps)
    kept = simhash.keep_one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comps))


def test_stage_keeps_unrelated_texts_under_one_id(spark):
    from conftest import prose

    a, b, c, d = (prose(70 + i) for i in range(4))
    near = a.replace("\n", " ") + "  "  # other bytes, same words
    rows = [(7, a), (7, b), (7, b), (8, near), (None, b), (None, c), (None, c), (None, d)]
    docs = spark.createDataFrame([(text, doc) for doc, text in rows], "text string, doc_id long").repartition(3)
    kept = [(r.doc_id, r.text) for r in simhash.keep_one_per_group(docs).collect()]
    assert sorted(kept, key=repr) == sorted([(7, a), (7, b), (None, c), (None, d)], key=repr)
    turned = docs.withColumn("doc_id", docs.doc_id * -1)
    kept = [(r.doc_id, r.text) for r in simhash.keep_one_per_group(turned).collect()]
    assert sorted(kept, key=repr) == sorted([(-8, near), (-7, b), (None, c), (None, d)], key=repr)
