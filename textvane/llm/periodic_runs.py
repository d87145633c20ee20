"""Periodic runs of words by a sparse diagonal recurrence.

A run of smallest period q is a diagonal at lag q: for every word of it but the first q the word q
earlier is the same.  The recurrence goes over the words in order; an earlier occurrence at lag q
adds one to the match length of diagonal q, and a diagonal that ends long enough emits its run.
All earlier occurrences of a frequent word would make that quadratic, so a word is met together with
its context: at scale m (16, 32, 64, ...) the m words that begin there, and only lags in (m/2, m]
(from 1 at the first scale) are active.  In a run of smallest period q <= m the nearest earlier
occurrence of m words lies exactly q back: at distance d < q a full period would equal itself shifted
by d, and q would not be the smallest.  So one earlier occurrence per word and scale is all that can
extend a diagonal, and equal lags of neighbouring words make up one diagonal.  A run of at least
max(24, 3q) words has such a word at its scale, for m <= 2q or m = 16.

The recurrence runs over arrays of a batch of documents.  Contexts get exact names by doubling (a
context of 2m words is a pair of contexts of m words); only those that occur twice in their document
stay active, which in prose are few from two words on.  Work is n log n per scale at worst, for any text.

A null text has no words, nor has a text of white space.  Very long texts are a batch of their own,
never cut.  A repeated row or id is answered once per row, a null id like any other.  Ties of the
strongest run go to the smaller start, then the smaller period.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textvane.llm.common import columns_as

LEAST_WORDS = 24
LEAST_PERIODS = 3
FIRST_SCALE = 16  # with it all periods up to 16 are found, by runs of at least LEAST_WORDS words
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096


def _repeated(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, names, lags to the previous equal key or 0) of the keys that occur twice; places in order."""
    order = np.argsort(keys, kind="stable")
    ordered, at = keys[order], places[order]
    same = np.zeros(keys.size + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    twice = same[:-1] | same[1:]
    lags = np.zeros(keys.size, np.int64)
    lags[1:] = np.where(same[1:-1], at[1:] - at[:-1], 0)
    names = np.cumsum(~same[:-1])
    kept = at[twice]
    back = np.argsort(kept, kind="stable")
    return kept[back], names[twice][back], lags[twice][back]


def find_runs(words: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) in places of ``words``, which holds documents one after another.

    ``owner`` numbers each word's document, ``ends`` has for each word where its document ends.
    """
    found = [np.empty((0, 3), np.int64)]
    total = words.size
    keys = owner * np.int64(words.max(initial=0) + 1) + words
    places, names, lags = _repeated(keys, np.arange(total))
    m = 1
    while places.size:
        if m >= FIRST_SCALE:
            found.append(_ended(places, lags, m, 0 if m == FIRST_SCALE else m // 2))
        name = np.full(total, -1, np.int64)
        name[places] = names
        begin = places[places + 2 * m <= ends[places]]
        begin = begin[name[begin + m] >= 0]
        places, names, lags = _repeated(name[begin] * np.int64(total + 1) + name[begin + m], begin)
        m *= 2
    return np.concatenate(found)


def _ended(places: np.ndarray, lags: np.ndarray, m: int, above: int) -> np.ndarray:
    """Runs of the diagonals made up of neighbouring words with equal lags in (above, m]."""
    active = (lags > above) & (lags <= m)
    places, lags = places[active], lags[active]
    if not places.size:
        return np.empty((0, 3), np.int64)
    goes_on = np.zeros(places.size + 1, bool)
    goes_on[1:-1] = (places[1:] == places[:-1] + 1) & (lags[1:] == lags[:-1])
    first, last = np.flatnonzero(~goes_on[:-1]), np.flatnonzero(~goes_on[1:])
    period = lags[first]
    start = places[first] - period
    length = places[last] + m - start
    enough = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    return np.stack([start, length, period], axis=1)[enough]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int, int] | None:
    """The run of greatest length / period with that ratio in thousandths."""
    if not runs:
        return None
    start, length, period = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    return start, length, period, 1000 * length // period


def runs_of(texts: list[bytes]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs of each text by start and period, and its words joined without the repeats."""
    number: dict[bytes, int] = {}
    split = [text.split() for text in texts]
    counts = np.array([len(s) for s in split], np.int64)
    flat = np.fromiter((number.setdefault(w, len(number)) for s in split for w in s), np.int64, int(counts.sum()))
    number.clear()
    stops = np.cumsum(counts)
    runs = find_runs(flat, np.repeat(np.arange(counts.size), counts), np.repeat(stops, counts))
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    doc = np.searchsorted(stops, runs[:, 0], "right")
    out = []
    bounds = np.searchsorted(doc, np.arange(counts.size + 1))
    for i, words in enumerate(split):
        mine = runs[bounds[i] : bounds[i + 1]]
        if len(mine):
            mine = mine - np.array([stops[i] - counts[i], 0, 0])
            change = np.zeros(counts[i] + 1, np.int64)
            np.add.at(change, mine[:, 0] + mine[:, 2], 1)
            np.add.at(change, mine[:, 0] + mine[:, 1], -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        out.append(([tuple(r) for r in mine.tolist()], b" ".join(words)))
    return out


def _text_groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, texts) of stretches of a batch with a bounded number of bytes."""
    at, texts, size = 0, [], 0
    for i, value in enumerate(batch.column(1)):
        texts.append(value.as_py() or b"")
        size += len(texts[-1])
        if size >= BATCH_BYTES or len(texts) >= BATCH_ROWS:
            yield at, i + 1, texts
            at, texts, size = i + 1, [], 0
    if texts:
        yield at, batch.num_rows, texts


_RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
_BEST = pa.struct([(n, pa.int64()) for n in ("start", "length", "period", "exponent_milli")])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, runs (start, length and period in words, by start and period), strongest, collapsed text."""
    own = columns_as(docs, id=id_col, text=text_col).select("id", F.col("text").cast("binary").alias("text"))
    kind = own.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [[f.name for f in kind] for kind in (_RUN, _BEST)]
        for batch in batches:
            for a, b, texts in _text_groups(batch):
                found = runs_of(texts)
                runs = [[dict(zip(names[0], r)) for r in runs] for runs, _ in found]
                best = [strongest(r) for r, _ in found]
                best = [None if r is None else dict(zip(names[1], r)) for r in best]
                collapsed = pa.array([text for _, text in found], pa.binary()).cast(pa.string())
                arrays = [batch.column(0).slice(a, b - a), pa.array(runs, pa.list_(_RUN)), pa.array(best, _BEST), collapsed]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "runs", "strongest", "collapsed"])

    three = "start: bigint, length: bigint, period: bigint"
    return own.mapInArrow(
        find, f"id {kind}, runs array<struct<{three}>>, strongest struct<{three}, exponent_milli: bigint>, collapsed string"
    )
