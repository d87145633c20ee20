import random

import pytest

WORDS = "thing of the a and in hand that with ster ing ond erat lish von der que les".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, norm string, block int, shard int, fp string"


def document(doc_id, text, lang="en"):
    size = None if text is None else len(text)
    return (doc_id, text, lang, "src", size, 1, "key", "norm", 2, 3, "fp")


def prose(seed, n=120):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, copies, near copies and shared passages."""
    shared = "the same passage of more than fifty bytes that several documents have in common, word for word"
    base = prose(1)
    rows = [
        document(10, base),
        document(11, base),
        document(12, base.replace(" ", "  \n") + "\t"),
        document(13, base + " plus"),
        document(14, None),
        document(15, ""),
        document(16, " \t\n\x0b\x0c\r "),
        document(17, prose(2, 20_000)),
        document(18, f"{prose(3, 20)} {shared} {prose(4, 20)}"),
        document(19, f"{prose(5, 20)} {shared} {prose(6, 20)}"),
        document(20, "Ünïcödé ſecret=abcdefgh 世界 password: 'hunter22' AKIA" + "B" * 20 + " " + "0a" * 20),
        document(20, "Ünïcödé ſecret=abcdefgh 世界 password: 'hunter22' AKIA" + "B" * 20 + " " + "0a" * 20),
        document(21, "a" * 5000),
        document(22, "ab" * 3000),
        document(None, base),
        document(None, "one"),
        document(23, "one", None),
        document(24, "\\### Assistant: </turn> ok"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder():
    import os

    path = os.environ.get("TEXTVANE_TESTDATA", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path
