"""The pipeline against a brute-force version of its stages."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_packing import check_places, reference_pieces
from test_secret_scan import base_spans
from test_simhash import brute_components, slow_fingerprint

from textvane.llm import language


@pytest.fixture(scope="module")
def tables(spark, odd_docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").dropDuplicates(["doc_id"])
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


def redacted(text):
    spans, out, at = base_spans(text), [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if b <= at:
            continue
        if a >= at:
            out.append(text[at:a] + "[SECRET]")
        at = b
    return "".join(out) + text[at:]


def test_pipeline(spark, tables):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), doc, text))
    rows = [min(g)[1:] for g in groups.values()]
    comps = brute_components([r[0] for r in rows], [slow_fingerprint(r[1]) for r in rows])
    rows = [(doc, redacted(text)) for (doc, text), c in zip(rows, comps) if doc == c]
    found = corpus_pipeline.run(spark, tables).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == reference_pieces(rows)
    check_places(found)


def test_stages_keep_the_columns(spark, odd_docs, no_docs, tables):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd_docs, tables).columns == odd_docs.columns
        assert stage(spark, no_docs, tables).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, tables).count() == 0


def test_clean_documents_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert language.keep_known_language(docs).count() == docs.where("text rlike '[A-Za-z]'").count()


CLASHING = ["lang_pred", "lang_score", "_id", "_blob", "_spans", "_maybe", "_digest", "_row", "_gone", "_rank", "c0", "c1", "blob", "spans", "digest", "kept", "_place", "_own_blob"]


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES) - 1))
def test_stages_take_clashing_columns(spark, odd_docs, tables, number):
    """Columns named like those the stages add come back untouched."""
    name, stage = corpus_pipeline.STAGES[number]
    mine = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("mark", F.monotonically_increasing_id())
    mine = mine.persist()
    plain = sorted(map(tuple, stage(spark, mine, tables).collect()), key=repr)
    extra = mine.select("*", *[F.concat(F.lit(c), F.col("mark").cast("string")).alias(c) for c in CLASHING])
    found = stage(spark, extra, tables)
    assert found.columns == extra.columns, name
    rows = found.collect()
    assert all(r[c] == f"{c}{r.mark}" for r in rows for c in CLASHING)
    drop = lambda r: tuple(r)[:5]  # noqa: E731  of repeated rows any may stay
    assert sorted(map(drop, rows), key=repr) == sorted(map(drop, plain), key=repr)
