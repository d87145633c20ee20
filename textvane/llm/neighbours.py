"""Nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order.  Each block of vectors has an inverted
file: for every pivot, the vectors that have it among their first ``PREFIX``, with its place.  A
query adds up, over the inverted files of its own pivots, how well the places agree; that orders
all vectors of the block by Spearman's footrule with places beyond the prefix counted as
``PREFIX``.  The best ``SHARE`` of a block is ranked again by the true inner product.

Pivots are at most ``PIVOTS`` distinct vectors among ``PIVOT_ROWS`` rows of least id hash, brought
to unit length; all other figures cover all rows.  Pivot orders tell directions only, and the inner
product also grows with length: among vectors of different lengths the agreement, plus a quarter
of the largest, is weighed by the length.  Equal lengths leave the footrule's order as it is.

The vectors are cut into blocks where they are read and never moved; a block's inverted file is
built once.  The queries are a written table in the shared folder, of which every task reads chunk
after chunk for each of its blocks: all queries meet all blocks, so work grows with their product.

Products are added up in one fixed order, so equal vectors get equal scores, and ties go to the
smaller id.  Vectors that are null, zero, or hold null or non-finite components take no part.  Shorter
vectors count as if they ended in zeros.  Rows that repeat an id are found each; a query never finds
rows of its own id, and of several vectors under a query's id the least is asked for.  Empty tables
give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyspark.sql import Column, DataFrame, Window, functions as F

from textvane.llm.common import columns_as, stored
from textvane.llm.files import file_system
from textvane.session import scratch_path

PIVOTS = 256
PIVOT_ROWS = 2048
PREFIX = 64
SHARE = 0.3
BLOCK = 16_384
CHUNK = 1_024
LEAST_CANDIDATES = 1024


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector) as doubles, without the rows that take no part."""
    own = columns_as(vectors, id=id_col, vector=vector_col).where("id is not null and vector is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    own = own.select("id", F.col("vector").cast("array<double>").alias("vector"))
    own = own.where(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    return own


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows, ended with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def inner_products(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Products with every row, halves added to halves: the same additions whatever rows stand beside."""
    terms = rows * vector
    while terms.shape[1] > 1:
        half = terms.shape[1] // 2
        summed = terms[:, :half] + terms[:, half : 2 * half]
        terms = np.concatenate([summed, terms[:, 2 * half :]], axis=1) if terms.shape[1] % 2 else summed
    return terms[:, 0] if terms.shape[1] else np.zeros(len(rows))


def choose_pivots(vectors: DataFrame, most: int = PIVOTS) -> np.ndarray:
    """Distinct vectors of least id hash."""
    rows = vectors.orderBy(F.xxhash64("id"), "id", "vector").limit(PIVOT_ROWS).select("vector").collect()
    width = max((len(r.vector) for r in rows), default=0)
    ended = (tuple(r.vector) + (0.0,) * (width - len(r.vector)) for r in rows)
    distinct = list(dict.fromkeys(ended))[:most]
    points = np.array(distinct)
    return points / np.linalg.norm(points, axis=1, keepdims=True) if distinct else points


def prefixes(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the pivots nearest in direction, in order, one row per vector."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix]


class InvertedFiles:
    """Postings of one block: for each pivot the vectors' numbers and the pivot's places."""

    def __init__(self, orders: np.ndarray, pivots: int):
        count, self.prefix = orders.shape
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.bounds = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))
        self.vector, self.place = by_pivot // self.prefix, (by_pivot % self.prefix).astype(np.int64)
        self.count = count

    def agreement(self, order: np.ndarray) -> np.ndarray:
        """A constant minus the footrule distance to every vector of the block."""
        total = np.zeros(self.count, np.int64)
        for place, pivot in enumerate(order.tolist()):
            a, b = self.bounds[pivot], self.bounds[pivot + 1]
            total[self.vector[a:b]] += self.prefix - place - np.abs(self.place[a:b] - place)
        return total


class Block:
    """The permutation index of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, share: float, prefix: int, least: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.pivots, self.prefix = ids[order], vectors[order], pivots, prefix
        self.files = InvertedFiles(prefixes(self.vectors, pivots, prefix), len(pivots))
        self.lengths = np.linalg.norm(self.vectors, axis=1)
        self.tried = min(ids.size, max(least, math.ceil(share * ids.size)))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, score) of the ``k`` best found for each query."""
        best = self.prefix * (self.prefix + 1) / 2  # agreement of equal orders
        unit = (1 << 30) / (1.25 * best * max(self.lengths.max(initial=0.0), 1e-300))
        found: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        rank = np.arange(self.ids.size)
        for query, vector, nearest in zip(query_ids.tolist(), queries, prefixes(queries, self.pivots, self.prefix)):
            worth = (self.files.agreement(nearest) + best / 4) * self.lengths * unit
            worth = worth.astype(np.int64) * self.ids.size - rank  # distinct; ties to the smaller id
            chosen = np.sort(np.argpartition(-worth, self.tried - 1)[: self.tried])
            chosen = chosen[self.ids[chosen] != query]
            scores = inner_products(self.vectors[chosen], vector)
            if chosen.size > k:
                bar = np.partition(scores, chosen.size - k)[chosen.size - k]
                keep = scores >= bar
                chosen, scores = chosen[keep], scores[keep]
            top = np.argsort(-scores, kind="stable")[:k]
            found.append((np.full(top.size, query), self.ids[chosen[top]], scores[top]))
        return tuple(np.concatenate(x) for x in zip(*found))


def _blocks(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of up to ``most`` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def block() -> tuple[np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        return table.column("id").to_numpy(), np.concatenate([_matrix(x, width) for x in table.column("vector").chunks])

    for batch in batches:
        for at in range(0, batch.num_rows, most):
            held.append(batch.slice(at, most))
            rows += held[-1].num_rows
            if rows >= most:
                yield block()
                held, rows = [], 0
    if rows:
        yield block()


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    share: float = SHARE, prefix: int = PREFIX, pivots: int = PIVOTS,
) -> DataFrame:
    """The ``k`` nearest rows found for every row where ``is_query`` (a column over ``id``) holds.

    query_id, rank, vec_id, score.  What leaves a block is ``k`` rows per query.  ``share=1.0`` is exact.
    """
    own = stored(usable_vectors(vectors, id_col, vector_col), "vectors")
    width = own.agg(F.max(F.size("vector"))).first()[0] or 0
    points = choose_pivots(own, pivots)
    points = np.pad(points, ((0, 0), (0, width - points.shape[1]))) if len(points) else points
    asked = scratch_path(own.sparkSession, "queries")
    own.where(is_query).groupBy("id").agg(F.min("vector").alias("vector")).write.parquet(asked)

    block, at_once, least = BLOCK, CHUNK, LEAST_CANDIDATES

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(asked)
        for ids, rows in _blocks(batches, width, block):
            searched = Block(ids, rows, points, share, min(prefix, len(points)), least)
            for chunk in pyarrow.dataset.dataset(path, filesystem=system, format="parquet").to_batches(batch_size=at_once):
                found = searched.search(chunk.column("id").to_numpy(), _matrix(chunk.column("vector"), width), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    found = own.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(meet, "query_id long, vec_id long, score double")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
