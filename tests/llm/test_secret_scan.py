import hashlib
import re

from pyspark.sql import functions as F

from textvane.llm import secret_scan as S


def base_spans(text):
    text = text or ""
    out = []
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


TRICKY = [
    "secret=token:abcdefg",
    "PASSWORD = 'aB+/=-_.9' api_key:\"zzzzzz\" apikey=12345",
    "AKIAAKIA" + "A" * 11 + " AKIA" + "9" * 16,
    "f" * 23 + " " + "f" * 24 + "g" + "0" * 64,
    "é" * 5 + "token:  qwertyui" + "世" + "tokens=abcdefgh",
    "ſecret=abcdefgh toKen=abcdefgh",
]


def test_spans(spark, odd_docs, odd_rows):
    found = S.secret_spans(odd_docs).collect()
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans if s.kind in S.BASE]) for r in found), key=repr)
    assert got == sorted(((r[0], base_spans(r[1])) for r in odd_rows), key=repr)


def test_tricky_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in S.secret_spans(docs).collect()}
    assert found == {i: base_spans(t) for i, t in enumerate(TRICKY)}


def test_empty(no_docs):
    assert S.secret_spans(no_docs).count() == 0
    assert S.redact_secrets(no_docs).columns == no_docs.columns


def test_ledger_scans_only_what_is_new(spark):
    from textvane.llm.common import columns_as

    old = columns_as(spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "none")], "d long, t string"), id="d", text="t")
    rules = S.RULES[:2]
    _, ledger = S.scan_new_blobs(old, None, rules)
    assert ledger.count() == 4  # two blobs, two rules
    new = old.union(spark.createDataFrame([(1, "AKIA" + "Z" * 16)], old.schema))  # another version of document 1
    marked = ledger.withColumn("spans", F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))))
    versions, fresh = S.scan_new_blobs(new, marked, S.RULES[:3])
    assert versions.count() == 4
    blob = hashlib.sha256(("AKIA" + "Z" * 16).encode()).hexdigest()
    assert sorted((r.kind, r.blob == blob) for r in fresh.collect()) == [("access", True), ("assign", True), ("hex", False), ("hex", False), ("hex", True)]


def test_redaction(spark, odd_docs):
    docs = spark.createDataFrame([(i, t, len(t), i) for i, t in enumerate([*TRICKY, "clean text"])], "doc_id long, text string, n_chars long, spans int")
    out = {r.doc_id: r for r in S.redact_secrets(docs).collect()}
    for i, text in enumerate([*TRICKY, "clean text"]):
        cover = [False] * len(text)
        for _, a, b in base_spans(text):
            cover[a:b] = [True] * (b - a)
        left = "".join(c for c, gone in zip(text, cover) if not gone)
        assert out[i].text.replace("[SECRET]", "") == left and out[i].n_chars == len(out[i].text)
        assert ("[SECRET]" in out[i].text) == any(cover)
    assert S.redact_secrets(odd_docs).count() == odd_docs.count()


def test_versions_under_one_id_are_redacted_apart(spark):
    texts = ["token=abcdefgh one", "two password: hunter22 and AKIA" + "Z" * 16, "clean", None]
    rows = [(doc, t, len(t or ""), n) for n, (doc, t) in enumerate([*((7, t) for t in texts), *((None, t) for t in texts), (None, texts[0])])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, n int").repartition(3)
    out = S.redact_secrets(docs).collect()
    safe = {texts[0]: "[SECRET] one", texts[1]: "two [SECRET] and [SECRET]", "clean": "clean", None: None}
    want = [(doc, safe[t], size if safe[t] == t else len(safe[t]), n) for doc, t, size, n in rows]
    assert sorted(map(tuple, out), key=lambda r: r[3]) == want


def test_batches_use_the_ledger(spark, odd_docs, odd_rows, monkeypatch):
    """The same spans in any number of batches; a blob of an earlier batch is not scanned again."""
    scanned = []
    plain = S.scan_new_blobs

    def counted(docs, ledger=None, rules=S.RULES):
        versions, fresh = plain(docs, ledger, rules)
        scanned.append(fresh.count())
        return versions, fresh

    monkeypatch.setattr(S, "scan_new_blobs", counted)
    whole = sorted(map(str, S.secret_spans(odd_docs).collect()))
    distinct = len({r[1] or "" for r in odd_rows})
    assert scanned == [distinct * len(S.RULES)]
    for batches in (1, 2, 5):
        scanned.clear()
        assert sorted(map(str, S.spans_in_batches(odd_docs, batches).collect())) == whole
        assert len(scanned) == batches and sum(scanned) == distinct * len(S.RULES)


def test_a_wrong_ledger_shows(spark):
    """What the ledger says is what is reported: seen pairs are not looked at again."""
    docs = spark.createDataFrame([(i, "token=abcdef") for i in range(20)] + [(50, "x")], "doc_id long, text string")
    blob = hashlib.sha256(b"token=abcdef").hexdigest()
    ledger = spark.createDataFrame([(blob, r.kind, r.version, [(3, 4)] if r.kind == "hex" else []) for r in S.RULES], S.LEDGER)
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in S.secret_spans(docs, ledger=ledger).collect()}
    assert found == {**{i: [("hex", 3, 4)] for i in range(20)}, 50: []}


def test_query_columns_against_brute_force(spark, tmp_path, odd_docs):
    from textvane.llm.catalog import op8_blob_ledger_secrets

    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(TRICKY, 1000)), "doc_id long, text string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc, text in map(tuple, docs.collect()):
        spans = base_spans(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = [sum(k == kind for k, _, _ in spans) for kind in S.BASE]
        want.append((doc, *counts, hashlib.sha256(listed.encode()).hexdigest()))
    found = op8_blob_ledger_secrets(spark, str(tmp_path)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
