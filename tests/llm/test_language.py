import random
import re
import zlib

import numpy as np

from textvane.llm import language


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = language.in_fold("doc_id", 4, 2)
    found = language.predicted(docs, language.learn(docs.where(~held))).where(held).select("doc_id", "lang", "lang_pred").collect()
    assert len(found) > 20 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found)
    assert sum(r.lang == r.lang_pred for r in found) >= 0.9 * len(found)


def test_odd_texts(odd_docs, odd_rows):
    prototypes = language.learn(odd_docs)
    assert list(prototypes) == ["en"]
    found = language.predicted(odd_docs, prototypes)
    assert found.columns == [*odd_docs.columns, "lang_pred", "lang_score"]
    rows = found.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert r.lang_pred == ("en" if letters else "und") and 0 <= r.lang_score <= 1
        assert letters or r.lang_score == 0


def test_nothing_learnt_and_empty(odd_docs, no_docs):
    assert language.learn(no_docs) == {}
    assert {r.lang_pred for r in language.predicted(odd_docs, {}).collect()} == {"und"}
    assert language.keep_known_language(no_docs).columns == no_docs.columns


def test_bundle_is_the_sum_of_bound_letters():
    vectors = language.GramVectors(dimensions=64, held=50)
    text = "The théâtre, the THE zz"
    packed, counts = language.grams(text)
    letters = " the théâtre the the zz "
    total = np.zeros(64)
    for i in range(len(letters) - 2):
        a, b, c = (language.letter_vector(ord(x), 64).astype(int) for x in letters[i : i + 3])
        total += a * np.roll(b, 1) * np.roll(c, 2)
    assert np.array_equal(vectors.bundle(packed, counts), total)
    for i in range(200):  # the store forgets, results stay
        vectors.bundle(*language.grams(chr(1000 + i) * 3))
    assert np.array_equal(vectors.bundle(packed, counts), total)


def test_stage_keeps_documents_with_letters(odd_docs, odd_rows):
    kept = language.keep_known_language(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in odd_rows)


def test_stage_never_decides_by_the_sign_of_noise(spark):
    """Documents of a script that no labelled row has, and a table without labels."""
    import random

    rnd = random.Random(3)
    word = lambda first, n: "".join(chr(first + rnd.randrange(n)) for _ in range(rnd.randint(2, 8)))
    known = [(i, " ".join(word(97, 12) for _ in range(300)), "en") for i in range(20)]
    foreign = [(100 + i, " ".join(word(0x430, 32) for _ in range(300)), None) for i in range(40)]
    docs = spark.createDataFrame([*known, *foreign, (200, "12 34 !", None), (201, None, None)], "doc_id long, text string, lang string")
    ids = lambda kept: sorted(r.doc_id for r in kept.collect())
    letters = [r[0] for r in [*known, *foreign]]
    assert ids(language.keep_known_language(docs)) == letters
    assert ids(language.keep_known_language(docs.where("lang is null"))) == letters[20:]


def test_stage_can_reject_what_is_not_above_noise(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat " * 20, "en"), *((i, "".join(chr(0x4E00 + 7 * i + j) for j in range(60)), None) for i in range(2, 30))], "doc_id long, text string, lang string")
    assert [r.doc_id for r in language.keep_known_language(docs, keep_unsure=False).collect()] == [1]


def test_stage_rejects_long_texts_in_no_language(spark):
    """Random letters of a learnt script go if there are many; few, or of another script, they stay."""
    rnd = random.Random(12)
    noise = lambda n, first, size: "".join(chr(first + rnd.randrange(size)) for _ in range(n))
    prose = "the thing of the hand with that stering onder and that hand"
    rows = [(i, " ".join(rnd.choices(prose.split(), k=80)), "en") for i in range(30)]
    rows += [(100, noise(3000, 97, 26), None), (101, noise(300, 97, 26), None), (102, noise(3000, 0x430, 32), None), (103, noise(3000, 97, 26) + "1 2" * 900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = {r.doc_id for r in language.keep_known_language(docs).collect()}
    assert kept == {*range(30), 101, 102}
    assert language.learnt_scripts(docs) == [0]


def slow_profile(texts):
    """Sum of bound letter vectors over all letter trigrams of the texts, each text by itself."""
    total = np.zeros(language.DIMENSIONS)
    for text in texts:
        shown = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
        shown = re.sub(" +", " ", shown)
        for i in range(len(shown) - 2):
            a, b, c = (language.letter_vector(ord(x), language.DIMENSIONS).astype(int) for x in shown[i : i + 3])
            total += a * np.roll(b, 1) * np.roll(c, 2)
    return total


def test_query_against_a_slow_version(spark, tmp_path):
    """Learning folds, centring, choice and score, document by document."""
    from textvane.llm.catalog import op9_hyperdimensional_language

    rnd = random.Random(8)
    words = {"en": "the thing with hand lish ond".split(), "fr": "avec échment oupa le".split(), "de": "von keit und große".split()}
    rows = [(i, " ".join(rnd.choices(words[lang], k=rnd.randint(0, 9))), lang if i % 5 else None) for i in range(70) for lang in [rnd.choice(list(words))]]
    rows += [(100, None, "en"), (101, "12 34 !!", "fr"), (102, "世界世界", None), (None, "the thing", "en"), (103, "\U0010ffff von", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 4
    learnt = {lang: slow_profile([t for i, t, x in rows if x == lang and fold(i) != 2]) for lang in sorted(words)}
    unit = np.array([v / np.linalg.norm(v) for v in learnt.values()])
    own = unit - unit.mean(axis=0)
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    want = []
    for i, text, _ in rows:
        mine = slow_profile([text])
        if not any(c.isalpha() for c in text or ""):
            want.append((i, fold(i) == 2, "und", 0.0))
            continue
        mine /= np.linalg.norm(mine)
        best = int(np.argmax(own @ (mine - unit.mean(axis=0))))
        want.append((i, fold(i) == 2, list(learnt)[best], round(min(1.0, max(0.0, float(unit[best] @ mine))), 6)))
    found = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in op9_hyperdimensional_language(spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert len({w[2] for w in want}) == 4 and any(w[1] for w in want)


def test_prototypes_do_not_depend_on_the_layout(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    one, many = language.learn(docs.coalesce(1)), language.learn(docs.repartition(7))
    assert one.keys() == many.keys() and all(np.array_equal(one[x], many[x]) for x in one)
