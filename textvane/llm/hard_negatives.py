"""Hard negatives by exact scores from Four-Russians tables.

Components are scaled to integers.  A candidate is stored as bit planes in two's complement: for
every bit of its components and every group of eight dimensions one byte.  For a chunk of anchors and
every group the sums of all 256 subsets of the anchors' eight components are tabulated.  A
candidate's byte then looks up what eight dimensions of one bit contribute to all scores of the
chunk, and from the highest plane down the scores are doubled and the look-ups added (the sign plane
is subtracted).  The result is the full integer inner product.

Two passes over the packed candidates: the first scores rows of an anchor's own label and keeps its
``positives`` best, the second scores the others and keeps, for every positive, the first ``negatives``
within the band.  The anchors are a written table in the shared folder; each task reads them chunk by
chunk for every ``BLOCK`` of its candidates, so candidates are never moved and no more than a chunk of
anchors is held.  What leaves a block is a few rows per anchor.  All anchors meet all rows: work grows
with their product.

Rows without id, label or vector, and rows with a null or non-finite component take no part.  Vectors
of different lengths are scored as if the shorter ended in zeros; empty and zero vectors score 0.
Components beyond a long end at its bounds, and sums wrap as a long's do.  A row never is a candidate
of an anchor with its own id; otherwise every row stands for itself, repeated or not, and each row of
a repeated anchor id is an anchor.  Ties go to the smaller id.  Labels are integers (TypeError
otherwise).  Empty tables, and tables without anchors, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyspark.sql import Column, DataFrame, Window, functions as F

from textvane.llm.common import columns_as, stored
from textvane.llm.files import file_system
from textvane.session import scratch_path

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
BAND = (4, 5)  # a negative scores at least four fifths of the positive
BLOCK = 16_384  # candidates scored against one reading of the anchors
CHUNK = 128  # anchors tabulated at once
TILE = 1024  # candidates looked up at once

INTEGERS = ("tinyint", "smallint", "int", "bigint")


def scaled_rows(vectors: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, vector) of the rows that take part, components floored to integers."""
    own = columns_as(vectors, id=id_col, label=label_col, vector=vector_col)
    if own.schema["label"].dataType.simpleString() not in INTEGERS:
        raise TypeError("labels must be integers")
    own = own.where("id is not null and label is not null and vector is not null")
    own = own.select("id", F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    integers = F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return own.where(F.forall("vector", finite)).select("id", "label", integers.alias("vector"))


def shape_of(rows: DataFrame) -> tuple[int, int]:
    """(groups of eight dimensions, bit planes) that hold every row."""
    low, high = F.min(F.array_min("vector")), F.max(F.array_max("vector"))
    size, least, most = rows.agg(F.max(F.size("vector")), low, high).first()
    widest = max(most or 0, -(least or 0) - 1, 0)
    return max(1, -(-(size or 0) // 8)), min(64, widest.bit_length() + 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of longs as rows, ended with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def bit_planes(matrix: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups): byte g of plane p holds bit p of the components 8g to 8g+7."""
    out = np.empty((len(matrix), planes, matrix.shape[1] // 8), np.uint8)
    for p in range(planes):
        out[:, p] = np.packbits((matrix >> p & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def packed(rows: DataFrame, groups: int, planes: int) -> DataFrame:
    """(id, label, bits), written to the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = bit_planes(_matrix(batch.column(2), groups * 8), planes).reshape(batch.num_rows, -1)
            flat = pa.py_buffer(np.ascontiguousarray(bits))
            fixed = pa.Array.from_buffers(pa.binary(bits.shape[1]), batch.num_rows, [None, flat])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fixed.cast(pa.binary())], ["id", "label", "bits"])

    kind = rows.schema["id"].dataType.simpleString()
    return stored(rows.mapInArrow(pack, f"id {kind}, label long, bits binary"), "bit-planes")


def subset_sums(anchors: np.ndarray, dtype) -> np.ndarray:
    """(groups, 256, anchors): for every byte the sum of the components whose bits it has."""
    count, width = anchors.shape
    by_group = anchors.T.reshape(width // 8, 8, count).astype(dtype)
    tables = np.zeros((width // 8, 256, count), dtype)
    for b in range(8):
        tables[:, 1 << b : 2 << b] = tables[:, : 1 << b] + by_group[:, b, None]
    return tables


def score(bits: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(anchors, rows) inner products by look-up, shift and add."""
    rows, planes, groups = bits.shape
    out = np.empty((tables.shape[2], rows), np.int64)
    for a in range(0, rows, TILE):
        tile = bits[a : a + TILE]
        total = np.zeros((len(tile), tables.shape[2]), tables.dtype)
        looked = np.empty_like(total)
        for p in reversed(range(planes)):
            total <<= 1
            for g in range(groups):
                np.take(tables[g], tile[:, p, g], axis=0, out=looked)
                total += looked
            if p == planes - 1:
                np.negative(total, out=total)
        out[:, a : a + TILE] = total.T
    return out


def _narrowest(anchors: np.ndarray, planes: int):
    """32 bits where no partial sum can leave them, else 64."""
    total = float(np.abs(anchors.astype(float)).sum(axis=1).max(initial=0))
    return np.int32 if total * 2.0**planes < 2**30 else np.int64


def first_by_score(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest, ties to the earlier place."""
    places = np.arange(scores.size)
    if scores.size > k:
        bar = np.partition(scores, scores.size - k)[scores.size - k]
        places = np.flatnonzero(scores >= bar)
    return places[np.argsort(-scores[places], kind="stable")[:k]]


def _blocks(batches: Iterator[pa.RecordBatch], planes: int, groups: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, labels, bits) of up to ``most`` candidates, by label and then id."""
    held, rows = [], 0

    def block():
        table = pa.Table.from_batches(held)
        ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
        flat = b"".join(table.column("bits").to_pylist())
        bits = np.frombuffer(flat, np.uint8).reshape(-1, planes, groups)
        order = np.lexsort((ids, labels))
        return ids[order], labels[order], bits[order]

    for batch in batches:
        for at in range(0, batch.num_rows, most):
            held.append(batch.slice(at, most))
            rows += held[-1].num_rows
            if rows >= most:
                yield block()
                held, rows = [], 0
    if rows:
        yield block()


def _chunks(folder: str, most: int) -> Iterator[pa.RecordBatch]:
    system, path = file_system(folder)
    for batch in pyarrow.dataset.dataset(path, filesystem=system, format="parquet").to_batches(batch_size=most):
        if batch.num_rows:
            yield batch


def own_label_best(candidates: DataFrame, anchors: str, groups: int, planes: int, k: int) -> DataFrame:
    """(anchor, score, id): of every block the ``k`` best rows of an anchor's label."""
    block, chunk_rows = BLOCK, CHUNK

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, bits in _blocks(batches, planes, groups, block):
            for chunk in _chunks(anchors, chunk_rows):
                keys, names, wanted = (chunk.column(c).to_numpy() for c in ("anchor", "id", "label"))
                matrix = _matrix(chunk.column("vector"), groups * 8)
                found = []
                for label in np.unique(wanted):
                    a, b = np.searchsorted(labels, [label, label + 1])
                    mine = np.flatnonzero(wanted == label)
                    if a == b:
                        continue
                    tables = subset_sums(matrix[mine], _narrowest(matrix[mine], planes))
                    for at, row in zip(mine.tolist(), score(bits[a:b], tables)):
                        others = np.flatnonzero(ids[a:b] != names[at])
                        top = others[first_by_score(row[others], k)]
                        found.append((np.full(top.size, keys[at]), row[top], ids[a:b][top]))
                if found:
                    arrays = [pa.array(np.concatenate(x)) for x in zip(*found)]
                    yield pa.RecordBatch.from_arrays(arrays, ["anchor", "score", "id"])

    return candidates.mapInArrow(meet, "anchor long, score long, id long")


def other_label_best(
    candidates: DataFrame, anchors: str, groups: int, planes: int, k: int, band: tuple[int, int]
) -> DataFrame:
    """(anchor, bar, score, id): of every block the ``k`` best rows of other labels at or below each bar."""
    times, over = band
    block, chunk_rows = BLOCK, CHUNK

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, bits in _blocks(batches, planes, groups, block):
            by_id = np.argsort(ids, kind="stable")
            ids, labels, bits = ids[by_id], labels[by_id], bits[by_id]
            for chunk in _chunks(anchors, chunk_rows):
                keys, names, wanted = (chunk.column(c).to_numpy() for c in ("anchor", "id", "label"))
                matrix = _matrix(chunk.column("vector"), groups * 8)
                tables = subset_sums(matrix, _narrowest(matrix, planes))
                found = []
                for at, row in enumerate(score(bits, tables)):
                    bars = chunk.column("bars")[at].as_py()
                    lows = [-(-times * bar // over) for bar in bars]  # the least score allowed
                    inside = (row <= max(bars)) & (row >= min(lows)) & (labels != wanted[at]) & (ids != names[at])
                    places = np.flatnonzero(inside)
                    for bar, low in zip(bars, lows):
                        fit = places[(row[places] <= bar) & (row[places] >= low)]
                        top = fit[first_by_score(row[fit], k)]
                        found.append((np.full(top.size, keys[at]), np.full(top.size, bar), row[top], ids[top]))
                arrays = [pa.array(np.concatenate(x)) for x in zip(*found)]
                yield pa.RecordBatch.from_arrays(arrays, ["anchor", "bar", "score", "id"])

    return candidates.mapInArrow(meet, "anchor long, bar long, score long, id long")


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    band: tuple[int, int] = BAND, scale: int = SCALE, id_col: str = "vec_id", label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """For each row where ``is_anchor`` (a column over ``id``) holds and each of its first ``positives``
    rows of the same label: the first ``negatives`` rows of other labels that score at most as high as
    the positive and at least ``band`` of it.

    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    rows = scaled_rows(vectors, scale, id_col, label_col, vector_col)
    rows = rows.withColumn("id", F.col("id").cast("long"))
    groups, planes = shape_of(rows)
    candidates = packed(rows, groups, planes)
    asked = stored(rows.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    first, second = scratch_path(spark, "anchors"), scratch_path(spark, "anchors-with-bars")
    asked.write.parquet(first)
    near = stored(_best(own_label_best(candidates, first, groups, planes, positives), ["anchor"], positives), "positives")
    bars = near.groupBy("anchor").agg(F.array_sort(F.collect_set("score")).alias("bars"))  # at most ``positives``
    asked.join(bars, "anchor").write.parquet(second)
    far = _best(other_label_best(candidates, second, groups, planes, negatives, band), ["anchor", "bar"], negatives)
    named = near.join(asked.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    pairs = named.select("anchor", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("bar"))
    return pairs.join(far, ["anchor", "bar"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("bar").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
