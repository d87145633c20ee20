import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings, strategies as st

from textvane.llm import periodic_runs as pr
from textvane.llm.catalog import op13_periodic_word_runs


def brute(words, least=24):
    """All maximal stretches by trying every period; smallest periods only."""
    n, seen = len(words), {}
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - start >= max(least, 3 * q):
                seen.setdefault((start, i - start), q)  # a larger period of the same stretch is no smallest one
    runs = sorted((s, length, q) for (s, length), q in seen.items())
    return [r for r in sorted(runs, key=lambda r: (r[0], r[2])) if smallest(words[r[0] : r[0] + r[1]]) == r[2]]


def smallest(stretch):
    return next(q for q in range(1, len(stretch) + 1) if all(stretch[i] == stretch[i - q] for i in range(q, len(stretch))))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def check(text):
    ((runs, rest),) = pr.runs_of([text])
    want = brute(text.split())
    assert runs == want
    assert rest == collapsed(text.split(), want)


@pytest.mark.parametrize("seed", range(60))
def test_random_repeats(seed):
    rnd = random.Random(seed)
    words = []
    for _ in range(rnd.randint(1, 6)):
        words += rnd.choices("abc" if seed % 2 else "abcdefghij", k=rnd.randint(0, 40))
        period = rnd.choices("abcdef"[: rnd.randint(1, 6)], k=rnd.randint(1, 45))
        words += (period * 6)[: rnd.randint(0, 5 * len(period))]
    check(" ".join(words).encode())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=140), st.integers(1, 6))
def test_two_letters(block, times):
    check(" ".join(block * times).encode())


def test_several_documents_do_not_meet():
    texts = [b"a " * 23, b"a " * 24, b"", b"a b " * 12, b"b a " * 12 + b"c", b" \t\n\x0b\x0c\r", b"a " * 5000]
    found = pr.runs_of(texts)
    assert [runs for runs, _ in found] == [[], [(0, 24, 1)], [], [(0, 24, 2)], [(0, 24, 2)], [], [(0, 5000, 1)]]
    assert [rest for _, rest in found][1:] == [b"a", b"", b"a b", b"b a c", b"", b"a"]


def test_only_ascii_blanks_cut():
    assert pr.runs_of(["a b c\x1cd".encode()])[0][1] == "a b c\x1cd".encode()


def test_one_word_text_is_not_quadratic():
    """Half a million equal words, and a long period of many equal words."""
    assert pr.runs_of([b"a " * 500_000])[0][0] == [(0, 500_000, 1)]
    block = b"a " * 5000 + b"b "
    runs, rest = pr.runs_of([block * 4])[0]
    assert (0, 4 * 5001, 5001) in runs and len(runs) == 5
    assert rest == b"a b"


def test_strongest_is_exact():
    big = 10**17
    assert pr.strongest([(0, 3 * big + 1, big), (1, 3 * big + 2, big), (2, 30, 10)]) == (1, 3 * big + 2, big, 3000)
    assert pr.strongest([(5, 24, 2), (3, 36, 3), (3, 24, 2)])[:3] == (3, 24, 2)
    assert pr.strongest([]) is None


def test_odd_rows(spark, odd_docs, odd_rows):
    found = pr.periodic_runs(odd_docs).collect()
    want = sorted(((r[0], tuple(brute((r[1] or "").encode().split())[:3]) if len(r[1] or "") < 50_000 else None) for r in odd_rows), key=repr)
    got = sorted(((r.id, tuple(tuple(x) for x in r.runs[:3]) if len(r.collapsed) < 50_000 else None) for r in found), key=repr)
    assert got == want
    assert all(len(r.collapsed.split()) <= 20_000 for r in found)


def test_empty(spark, no_docs):
    assert pr.periodic_runs(no_docs).collect() == []


def expected(ident, text):
    """The whole contract of the query, one document at a time."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    h = zlib.crc32(str(ident).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (ident, len(runs), *four, sha(listed.encode()), sha(collapsed(words, runs)))


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    rows = []
    for i in range(120):
        period = rnd.choices(["alpha", "beta", "gamma", "ünï", "e"], k=rnd.randint(1, 12))
        words = rnd.choices(["x", "y", "z", "w"], k=rnd.randint(0, 60)) + (period * 9)[: rnd.randint(0, 60)]
        rows.append((i * 7, rnd.choice([" ", "\n", "\t \r"]).join(words)))
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (-5, "a " * 70), (9004, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(map(tuple, op13_periodic_word_runs(spark, str(tmp_path)).collect()), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    assert found == sorted((expected(i, t) for i, t in rows), key=repr)


def test_null_id_is_not_planted(spark, tmp_path):
    spark.createDataFrame([(None, "a b c " * 9)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (row,) = op13_periodic_word_runs(spark, str(tmp_path)).collect()
    assert (row.doc_id, row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (None, 1, 0, 27, 3, 9000)
