"""Corpus queries with SQL give the same rows on DuckDB; the others run on the given tables."""

import pytest
from oracle import compare, database

from textvane.llm.catalog import CATALOG


@pytest.mark.parametrize("name", [n for n, e in CATALOG.items() if e.sql])
def test_rows_agree(spark, folder, name):
    same, message = compare(spark, database(folder), CATALOG[name].run, CATALOG[name].sql, folder)
    assert same, message


@pytest.mark.parametrize("name", [n for n, e in CATALOG.items() if not e.sql])
def test_runs(spark, folder, name):
    assert CATALOG[name].run(spark, folder).count() > 0


def test_chat_rows_agree_for_odd_roles(spark, tmp_path):
    rows = [(1, 0, "a\\b:c", "x"), (1, 1, "assistant", "### </turn> \\"), (2, 0, None, None), (2, 1, "\\\\", "plain"), (3, 0, "assistant", "a\\b")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations"))
    (file,) = (tmp_path / "conversations").glob("*.parquet")
    file.rename(tmp_path / "conversations.parquet")
    entry = CATALOG["op6_grammar_chat_format"]
    same, message = compare(spark, database(str(tmp_path)), entry.run, entry.sql, str(tmp_path))
    assert same, message
