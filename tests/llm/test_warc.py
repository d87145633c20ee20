import base64
import gzip
import hashlib
import io
import json
import os
import zlib

import pytest
from pyspark.sql import functions as F

from textvane.llm import warc
from textvane.llm.common import joined_spread

SCHEMA = "page_id long, url string, html string, archive string, number int, target long, id int, payload_key string, _salt int"


def rows_of(*pages):
    return [(*p, "x", 1, 2, 3, "k", 0) for p in pages]


PAGES = [
    (1, "http://a/", "same"), (2, "http://b/ä b\r\nX: y", "same"), (7, None, "same"), (3, "u", ""), (4, "u", None), (5, "u", "alone ünï \r\n\r\n WARC/1.1"),
    (6, "u", "twice"), (6, "u", "twice"), (8, "u", "x" * 3_000_000), (None, "u", "same"), (None, "u", "only null"), (9, "u", "WARC/1.1\r\n\r\n"), (10, "u", "twice"),
]


def wanted(pages, least=0):
    best = {}
    for page, _, html in pages:
        held = best.get(html or "")
        best[html or ""] = page if held is None else held if page is None else max(held, page)
    out = []
    for page, _, html in pages:
        data = (html or "").encode()
        top = best[html or ""]
        repeat = len(data) >= least and top != page
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if repeat else "response", top if repeat else None))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("least", [0, 1, 5])
def test_odd_pages(spark, least):
    pages = spark.createDataFrame(rows_of(*PAGES), SCHEMA).repartition(3)
    assert found(warc.archived_pages(pages, least)) == wanted(PAGES, least)


def test_payloads_come_back(spark):
    pages = spark.createDataFrame(rows_of(*PAGES), SCHEMA)
    back = warc.archived_pages(pages).where("record_type = 'response'").select("payload").distinct().collect()
    assert {bytes(r.payload) for r in back} == {(p[2] or "").encode() for p in PAGES}


def test_no_pages(spark):
    assert warc.archived_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_payload_for_a_third(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 50)
    pages = [(i, f"http://h/{i}", "hot" if i % 3 == 0 else f"page {i % 200}") for i in range(1500)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    assert found(warc.archived_pages(df)) == wanted(pages)


def test_members_and_sidecar(spark, tmp_path):
    """One stream in, one member per record out; every offset cuts at a member; other readers can read the file."""
    pages = spark.createDataFrame(rows_of(*PAGES), SCHEMA).coalesce(1)
    crawl, out = f"file://{tmp_path}/crawl", f"file://{tmp_path}/out"
    records = warc.write_crawl(pages, crawl)
    (name,) = [r.archive for r in records.select("archive").distinct().collect()]
    whole = (tmp_path / "crawl" / name).read_bytes()
    stream = zlib.decompressobj(31)
    text = stream.decompress(whole)
    assert stream.eof and not stream.unused_data and text.count(b"WARC-Record-ID") == len(PAGES)
    (made,) = warc.normalise(records.select("archive").distinct(), crawl, out, warc.revisits(records)).collect()
    data = (tmp_path / "out" / made.archive).read_bytes()
    entries = [json.loads(x) for x in (tmp_path / "out" / made.sidecar).read_text().splitlines()]
    assert made.records == len(entries) == len(PAGES) and made.bytes == len(data)
    assert [e["offset"] for e in entries] == [sum(x["length"] for x in entries[:i]) for i in range(len(entries))]
    for entry in entries:
        member = zlib.decompressobj(31)
        member.decompress(data[entry["offset"] : entry["offset"] + entry["length"]])
        assert member.eof and not member.unused_data
    kinds = [h["WARC-Type"] for h, _ in warc.read_records(io.BytesIO(gzip.decompress(data)))]
    assert kinds == [e["type"] for e in entries] and kinds.count("revisit") == sum(r[3] == "revisit" for r in wanted(PAGES))


@pytest.mark.parametrize("harm", ["cut", "flip", "junk"])
def test_damaged_archives_are_named(spark, tmp_path, harm):
    pages = spark.createDataFrame(rows_of(*PAGES), SCHEMA).coalesce(1)
    records = warc.write_crawl(pages, f"file://{tmp_path}/crawl")
    name = records.first().archive
    path = tmp_path / "crawl" / name
    data = bytearray(path.read_bytes())
    if harm == "cut":
        data = data[: len(data) // 2]
    elif harm == "flip":
        data[len(data) // 2] ^= 255
    else:
        data = bytearray(gzip.compress(b"no record\r\n"))
    path.write_bytes(data)
    with pytest.raises(ValueError, match=name):
        warc.normalise_archive(f"file://{tmp_path}/crawl/{name}", f"file://{tmp_path}/out", name, {})


def test_several_members_are_read_too(tmp_path):
    """An archive that is not one stream is normalised as well."""
    parts = [gzip.compress(warc.response_record(i, None, b"p%d" % i)) for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    archive, sidecar, records, size = warc.normalise_archive(f"{tmp_path}/a.warc.gz", f"{tmp_path}/out", "a", {1: 0})
    assert records == 3 and os.path.getsize(tmp_path / "out" / archive) == size


def test_text_ids(spark):
    pages = spark.createDataFrame([("a>b", "u", "x"), ("ü c", "u", "x"), ("", "u", "y")], "page_id string, url string, html string")
    got = {(r.id, r.record_type, r.refers_to) for r in warc.archived_pages(pages).collect()}
    assert got == {("a>b", "revisit", "ü c"), ("ü c", "response", None), ("", "response", None)}


def test_spread_join(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    mine = joined_spread(rows, groups, "k", "n", F.xxhash64("id")).select("id", "k", "s")
    plain = rows.join(groups, "k").select("id", "k", "s")
    assert mine.count() == 5000 and mine.exceptAll(plain).isEmpty()
