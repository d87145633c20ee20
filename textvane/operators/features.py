"""Term features: vocabulary, TF-IDF weights, fixed-length token sequences."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textvane.config import MAX_DOCUMENT_SHARE, MAX_SEQUENCE_LENGTH, MAX_VOCABULARY, MIN_DOCUMENT_FREQUENCY, SMALL_TABLE_ROWS
from textvane.scale import small_or_none, spread_out, with_rank
from textvane.session import checkpointed

TERM = r"(?U)\w\w+"  # a run of at least two word characters
SUMMARY_TERMS = 1 << 18  # counters of a task; performance only
CANDIDATES = 4  # terms counted exactly for each one wanted; performance only
TERMS_PER_ROW = 64  # terms of a document that go to Python in one row; performance only
PAD_ID, UNKNOWN_ID, FIRST_ID = 0, 1, 2


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _pairs(words: Column) -> Column:
    """Adjacent word pairs joined by a blank."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    both = F.arrays_zip(F.slice(words, 1, n).alias("x"), F.slice(words, 2, n).alias("y"))
    return F.transform(both, lambda w: F.concat_ws(" ", w["x"], w["y"]))


def with_terms(df: DataFrame, text: str = "text", bigrams: bool = True, name: str = "terms") -> DataFrame:
    """Add the words, and the pairs of adjacent words, of each text."""
    worded = spread_out(df).withColumn("_w", words_of(F.col(text)))
    terms = F.concat("_w", _pairs(F.col("_w"))) if bigrams else F.col("_w")
    return worded.withColumn(name, terms).drop("_w")


def term_rows(df: DataFrame, size: int = TERMS_PER_ROW) -> DataFrame:
    """Rows (kept columns, _at, terms) of at most ``size`` terms, in order, numbered from 0 within a document.

    Arrow batches are limited in rows, so what a Python worker holds does not follow from the documents' lengths.
    """
    kept = [c for c in df.columns if c != "terms"]
    last = F.greatest(F.ceil(F.size("_all") / size).cast("int") - 1, F.lit(0))
    numbered = df.withColumnRenamed("terms", "_all").select(*kept, "_all", F.explode_outer(F.sequence(F.lit(0), last)).alias("_at"))
    return numbered.select(*kept, "_at", F.slice("_all", F.col("_at") * size + 1, size).alias("terms"))


def document_terms(df: DataFrame, order: str = "doc_id", text: str = "text", bigrams: bool = True) -> DataFrame:
    """(id, term) for every occurrence of a term."""
    return with_terms(df.select(order, text), text, bigrams).select(order, F.explode("terms").alias("term"))


def term_counts(df: DataFrame, text: str = "text", bigrams: bool = True) -> DataFrame:
    """(term, df, cf): documents that have the term, and its occurrences.

    Both come from one aggregation on the term, combined before the shuffle; no row per
    (document, term) is ever shuffled.
    """
    terms = with_terms(df.select(text), text, bigrams).select("terms")
    # two explodes of one narrow row: every occurrence, and every distinct term of the document
    marked = terms.select(
        F.explode(
            F.array(
                F.struct(F.col("terms").alias("t"), F.lit(0).cast("long").alias("d")),
                F.struct(F.array_distinct("terms").alias("t"), F.lit(1).cast("long").alias("d")),
            )
        ).alias("x")
    ).select(F.explode("x.t").alias("term"), F.col("x.d").alias("d"))
    return marked.groupBy("term").agg(F.sum("d").alias("df"), F.sum(F.lit(1).cast("long") - F.col("d")).alias("cf"))


def term_summary(df: DataFrame, text: str = "text", size: int = SUMMARY_TERMS) -> DataFrame:
    """(term, n): counts of frequent terms that are too small by at most the n of the row without a term.

    Every task keeps ``size`` counters: when it has more, the next largest count is taken from all and
    what is left of none is dropped (Misra and Gries; such summaries add up, Agarwal and others, PODS
    2012).  So at most ``size`` + 1 rows of a task are shuffled, however many rare terms it met.
    """
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def compact(tables: list[pa.Table], most: int) -> tuple[pa.Table, int]:
        summed = pa.concat_tables(tables).group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"]).select(["term", "n"])
        if summed.num_rows <= most:
            return summed, 0
        counts = summed.column("n").to_numpy()
        less = int(np.partition(counts, counts.size - most - 1)[counts.size - most - 1])
        left = np.flatnonzero(counts > less)
        return pa.table([summed.column("term").take(pa.array(left)), pa.array(counts[left] - less)], schema), less

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, missing = [schema.empty_table()], 0, 0
        for batch in batches:
            found = pc.value_counts(batch.column(0).flatten())
            held.append(pa.table([found.field("values"), found.field("counts")], schema))
            rows += len(found)
            if rows > 2 * size:
                table, less = compact(held, size)
                held, rows, missing = [table], table.num_rows, missing + less
        table, less = compact(held, size)
        yield from table.to_batches(10_000)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([missing + less])], ["term", "n"])

    rows = term_rows(with_terms(df.select(text), text).select("terms")).select("terms")
    found = rows.mapInArrow(summarise, "term string, n long")
    return found.groupBy("term").agg(F.sum("n").alias("n"))


def counts_of(df: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """(term, df, cf) of the given terms; every task sends one row for each it met."""
    known = pa.array(terms, pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, all_ = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        for _, doc, place in _whole_documents(batches, known):
            all_ += np.bincount(place, minlength=len(known))
            cells = np.unique(doc * len(known) + place)
            docs += np.bincount(cells % len(known), minlength=len(known))
        met = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([known.take(pa.array(met)), pa.array(docs[met]), pa.array(all_[met])], ["term", "df", "cf"])

    rows = term_rows(with_terms(df.select(text), text).select("terms")).select(F.lit(None).cast("int").alias("id"), "_at", "terms")
    found = rows.mapInArrow(count, "term string, df long, cf long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _usable(counts: DataFrame, n_documents: Column, max_terms: int, min_df: int, max_share: float) -> DataFrame:
    usable = counts.where((F.col("df") >= min_df) & (F.col("df") <= n_documents * max_share))
    return usable.orderBy(F.col("cf").desc(), "term").limit(max_terms)


def vocabulary(
    df: DataFrame,
    n_documents: Column,
    max_terms: int = MAX_VOCABULARY,
    min_df: int = MIN_DOCUMENT_FREQUENCY,
    max_share: float = MAX_DOCUMENT_SHARE,
    text: str = "text",
    size: int = SUMMARY_TERMS,
) -> DataFrame:
    """The most frequent terms (term, df, cf), rare and near-universal ones left out.

    Mergeable summaries name the candidates, which are then counted exactly.  If a term that is no
    candidate could still belong to the result, every term is counted instead.
    """
    wanted = CANDIDATES * max_terms
    summary = checkpointed(term_summary(df, text, size))
    missing = summary.where("term is null").agg(F.sum("n")).first()[0] or 0
    # one more than the candidates: what no candidate has is at most this often counted
    top = small_or_none(summary.where("term is not null").orderBy(F.col("n").desc(), "term").limit(wanted + 1), wanted + 1)
    if top is None:
        return _usable(term_counts(df, text), n_documents, max_terms, min_df, max_share)
    rows = sorted(top.collect(), key=lambda r: (-r.n, r.term))
    others = missing + (rows[wanted].n if len(rows) > wanted else 0)
    if not rows:
        return _usable(term_counts(df, text), n_documents, max_terms, min_df, max_share)
    found = checkpointed(_usable(counts_of(df, [r.term for r in rows[:wanted]], text), n_documents, max_terms, min_df, max_share))
    last = found.agg(F.count(F.lit(1)).alias("n"), F.min("cf").alias("cf")).first()
    if others and (last.n < max_terms or last.cf <= others):
        return _usable(term_counts(df, text), n_documents, max_terms, min_df, max_share)
    return found


def idf(df: Column, n: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def _row_terms(lists: pa.ListArray, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in ``known``) of every known term of a batch, in order."""
    lengths = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    place = pc.index_in(lists.flatten(), value_set=known).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(lengths.size), lengths)
    hit = ~np.isnan(place) if place.dtype.kind == "f" else np.ones(place.size, bool)
    return rows[hit], place[hit].astype(np.int64)


def _whole_documents(batches: Iterator[pa.RecordBatch], known: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids of documents, document number and place in ``known`` of every known term), never a part of a document.

    The batches have rows (id, _at, terms) as ``term_rows`` makes them; a row with _at 0 begins a document.  Of the one
    that may go on in the next batch only the places are held.
    """
    ids, held = None, np.empty(0, np.int64)
    for batch in batches:
        begins = batch.column(1).to_numpy(zero_copy_only=False) == 0
        row, place = _row_terms(batch.column(2), known)
        new = batch.column(0).filter(pa.array(begins))
        ids = new if ids is None else pa.concat_arrays([ids, new])
        doc = np.concatenate([np.zeros(held.size, np.int64), (np.cumsum(begins) + len(ids) - len(new) - 1)[row]])
        place = np.concatenate([held, place])
        if len(ids) > 1:
            done = doc < len(ids) - 1
            yield ids.slice(0, len(ids) - 1), doc[done], place[done]
            ids, place = ids.slice(len(ids) - 1), place[~done]
        held = place
    if ids is not None and len(ids):
        yield ids, np.zeros(held.size, np.int64), held


def tfidf_weights(df: DataFrame, order: str = "doc_id", text: str = "text", max_terms: int = MAX_VOCABULARY) -> DataFrame:
    """(id, term, weight) with unit length per document.

    The vocabulary has ``max_terms`` rows at most and goes to every task; a document is counted
    and weighed where it is read, so nothing is shuffled after the vocabulary.
    """
    n = df.count()
    rows = vocabulary(df, F.lit(n), max_terms, text=text).select("term", "df").collect()
    known = pa.array([r.term for r in rows], pa.string())
    rarity = np.array([math.log((n + 1.0) / (r.df + 1.0)) + 1.0 for r in rows])
    schema = T.StructType([df.schema[order], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, doc, place in _whole_documents(batches, known):
            cells, tf = np.unique(doc * max(1, len(known)) + place, return_counts=True)
            doc, place = np.divmod(cells, max(1, len(known)))
            weight = tf * rarity[place]
            norm = np.sqrt(np.bincount(doc, weight * weight, len(ids)))
            columns = [ids.take(pa.array(doc)), known.take(pa.array(place)), pa.array(weight / norm[doc])]
            yield pa.RecordBatch.from_arrays(columns, [order, "term", "weight"])

    rows = term_rows(with_terms(df.select(order, text), text).select(order, "terms"))
    return rows.select(order, "_at", "terms").mapInArrow(weigh, schema)


def word_ids(df: DataFrame, text: str = "text", max_terms: int | None = None) -> DataFrame:
    """(term, term_id), numbered from FIRST_ID by frequency; all words, or the ``max_terms`` most frequent."""
    words = spread_out(df.select(text)).select(F.explode(words_of(F.col(text))).alias("term"))
    counts = words.groupBy("term").agg((-F.count(F.lit(1))).alias("_less"))
    if max_terms is not None:
        counts = counts.orderBy("_less", "term").limit(max_terms)
    ranked = with_rank(counts, [], ["_less", "term"])
    return ranked.select("term", (F.col("_rank") + FIRST_ID).cast("int").alias("term_id"))


def token_sequences(
    df: DataFrame,
    ids: DataFrame | None = None,
    max_length: int = MAX_SEQUENCE_LENGTH,
    order: str = "doc_id",
    text: str = "text",
    label: str | None = None,
    max_terms: int | None = None,
) -> DataFrame:
    """Word ids truncated and padded to ``max_length``, with the attention mask.

    A vocabulary of at most ``SMALL_TABLE_ROWS`` words goes to every task; a larger one is joined,
    and a sequence's ``max_length`` ids at most are put together again.
    """
    table = word_ids(df, text, max_terms) if ids is None else ids
    kept = [order, *([label] if label else [])]
    first = spread_out(df.select(*kept, text)).select(*kept, F.slice(words_of(F.col(text)), 1, max_length).alias("w"))
    rows = table.limit(SMALL_TABLE_ROWS + 1).collect()
    if len(rows) <= SMALL_TABLE_ROWS:
        return _looked_up(first, kept, rows, max_length)
    placed = first.select(*kept, F.posexplode_outer("w").alias("at", "term"))
    found = placed.join(table, "term", "left").withColumn(
        "term_id", F.when(F.col("term").isNotNull(), F.coalesce("term_id", F.lit(UNKNOWN_ID)))
    )
    present = F.when(F.col("term_id").isNotNull(), F.struct("at", "term_id"))
    grouped = found.groupBy(*kept).agg(F.array_sort(F.collect_list(present)).alias("s"))
    sequence = F.transform("s", lambda x: x["term_id"])
    missing = F.lit(max_length) - F.size("s")
    return grouped.select(
        *kept,
        F.concat(sequence, F.array_repeat(F.lit(PAD_ID), missing)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("s")), F.array_repeat(F.lit(0), missing)).alias("attention_mask"),
    )


def _looked_up(first: DataFrame, kept: list[str], rows: list, max_length: int) -> DataFrame:
    known = pa.array([r.term for r in rows], pa.string())
    numbers = np.array([r.term_id for r in rows] or [UNKNOWN_ID], np.int32)
    integers = T.ArrayType(T.IntegerType())
    fields = [first.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField("input_ids", integers), T.StructField("attention_mask", integers)])

    def as_lists(values: np.ndarray) -> pa.Array:
        ends = np.arange(values.shape[0] + 1, dtype=np.int32) * values.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(len(kept))
            lengths = np.nan_to_num(pc.list_value_length(words).to_numpy(zero_copy_only=False)).astype(np.int64)
            place = pc.fill_null(pc.index_in(words.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            used = np.arange(max_length) < lengths[:, None]
            ids = np.full(used.shape, PAD_ID, np.int32)
            ids[used] = np.where(place >= 0, numbers[place], UNKNOWN_ID)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], as_lists(ids), as_lists(used.astype(np.int32))],
                [*kept, "input_ids", "attention_mask"],
            )

    return first.mapInArrow(fill, schema)
