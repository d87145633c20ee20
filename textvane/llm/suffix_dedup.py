"""Removal of long passages that an earlier document already has, with sparse suffix arrays.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in a document with
a smaller id.  Documents are gathered in blocks.  Which suffixes of a block are indexed follows
from the text alone: of every string of ``LENGTH`` bytes, the start of its least hashed
``ANCHOR``-byte substring.  Equal strings have equal anchors, so nothing is missed, and only about
one suffix in fourteen is kept.

1. Each block's anchors, sorted by the hash of what they begin with, are its suffix array; it is
   cut into shards by hash.  A shard's owner takes the arrays as batches into a family of levels:
   a batch is merge-scanned against the levels there are, becomes a level itself, and levels of
   equal size are merged, so sizes grow geometrically.  Anchors found twice go back to their blocks.
2. Around these anchors each block sends its segments (the strings with that anchor, overlapping)
   once each, with the least and largest id that has them.  Owners compare all strings of
   ``LENGTH`` bytes by their bytes and return for each the least id.
3. Each block removes what a smaller id has.

A passage that very many documents share is sent once per block, but the anchors at its edges have
other surroundings in every document.  Each block says how many distinct segments it has for an
anchor; where they add up to more than ``HOT_SEGMENTS``, all strings with that anchor are sent
singly, dealt by their content, so that no owner gathers all surroundings of a frequent passage.

Null and empty texts have 0 bytes.  Rows that repeat an id are not earlier than each other; a null
id counts as the largest.  Matches never cross documents.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from textvane.llm.common import U64, columns_as, mixed, pack, pack_sorted, stored, tasks_for, unpack, unpack_sorted
from textvane.session import scratch_path

LENGTH = 50
ANCHOR = 24
BLOCK_BYTES = 4 << 20
HOT_SEGMENTS = 4096
BATCH_KEYS = 1 << 17
STRIP = 1 << 16
LAST_ID = np.iinfo(np.int64).max

_BYTE = np.random.default_rng(50).integers(0, 1 << 63, 256, np.uint64) * U64(2) + U64(1)
_STEP = 0x9FB21C651E98DF25


# --- strings of a fixed length ----------------------------------------------------


def _joined(rows: np.ndarray, span: int, more: np.ndarray) -> np.ndarray:
    """Hashes over ``span`` bytes continued by the hashes in ``more``."""
    n = more.size - span
    return rows[:n] + U64(pow(_STEP, span, 1 << 64)) * more[span : span + n]


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every ``length`` bytes, built from hashes of powers of two."""
    power, span = _BYTE[data], 1
    total, covered = None, 0
    while True:
        if length & span:
            total = power if total is None else _joined(total, covered, power)
            covered += span
        if covered == length:
            return total[: max(0, data.size - length + 1)]
        power, span = _joined(power, span, power), 2 * span


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    least, span = values, 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    rest = width - span
    return np.minimum(least[: least.size - rest], least[rest:]) if rest else least


def least_anchors(data: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """For every string of ``length`` bytes the least hash of its ``anchor``-byte substrings."""
    count = max(0, data.size - length + 1)
    out = np.empty(count, U64)
    for at in range(0, count, STRIP):
        end = min(count, at + STRIP)
        hashes = mixed(string_hashes(data[at : end + length - 1], anchor))
        out[at:end] = sliding_least(hashes, length - anchor + 1)
    return out


class Runs:
    """Maximal runs of neighbouring strings of one document that have the same anchor hash."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, length: int, anchor: int):
        ends = np.cumsum(sizes)
        least = least_anchors(data, length, anchor)
        # no string begins in the last bytes of a document, so strings of two documents never stand side by side
        step = np.zeros(data.size + 1, np.int8)
        np.add.at(step, np.maximum(ends - sizes, ends - length + 1), 1)
        np.add.at(step, ends, -1)
        valid = np.cumsum(step[: least.size], dtype=np.int8) == 0
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        last = valid.copy()
        last[:-1] &= ~valid[1:] | new[1:]
        self.start = np.flatnonzero(new)
        self.count = np.flatnonzero(last) - self.start + 1
        self.doc = np.searchsorted(ends, self.start, "right").astype(np.int32)
        self.key = mixed(least[self.start])


# --- blocks ------------------------------------------------------------------------

_BLOCK = "block long, ids binary, sizes binary, data binary"


def make_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """(id, text) packed into rows of about ``block_bytes``, in a table bucketed by block number.

    The bucketing lets the later passes meet their messages without moving the text again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, parts, held = [], [], 0

        def block() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in parts], np.int64)
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(parts))
            values = np.array(ids, np.int64)
            return pa.RecordBatch.from_pydict({"block": [number], "ids": [pack(values)], "sizes": [pack(sizes)], "data": [data]})

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = (text.as_py() or "").encode()
                if ids and held + len(text) > block_bytes:
                    yield block()
                    number, ids, parts, held = number + 1, [], [], 0
                ids.append(LAST_ID if doc is None else doc)
                parts.append(text)
                held += len(text)
        if ids:
            yield block()

    spark = docs.sparkSession
    name = f"suffix_blocks_{uuid.uuid4().hex}"
    packed = docs.select("id", "text").mapInArrow(run, _BLOCK)
    writer = packed.write.format("parquet").option("path", scratch_path(spark, "suffix-blocks")).option("compression", "none")
    writer.bucketBy(tasks_for(docs), "block").saveAsTable(name)
    return spark.table(name), name


def open_block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sizes, bytes)"""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8)
    return unpack(row["ids"], np.int64), unpack(row["sizes"], np.int64), data


# --- first pass: the index family ----------------------------------------------------


def shard_cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where sorted keys change their leading bits."""
    edges = np.arange(1 << bits, dtype=U64) << U64(64 - bits)
    return np.append(np.searchsorted(keys, edges), keys.size)


class Level:
    """Sorted anchor keys with the block of each, whether another document has the key, and its segments there."""

    def __init__(self, keys: np.ndarray, blocks: np.ndarray, twice: np.ndarray, segments: np.ndarray | None = None):
        self.keys, self.blocks, self.twice = keys, blocks, twice
        self.segments = np.ones(keys.size, np.int64) if segments is None else segments

    @staticmethod
    def merged(levels: list[Level]) -> Level:
        """One level; equal keys stand together and share the mark."""
        keys = np.concatenate([x.keys for x in levels])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        blocks = np.concatenate([x.blocks for x in levels])[order]
        twice = np.concatenate([x.twice for x in levels])[order]
        return Level(keys, blocks, twice, np.concatenate([x.segments for x in levels])[order])

    def groups(self) -> np.ndarray:
        return np.flatnonzero(np.append(True, self.keys[1:] != self.keys[:-1])) if self.keys.size else np.empty(0, np.int64)


class LevelFamily:
    """Levels of geometric sizes; the newest is last and the smallest."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, batch: Level) -> None:
        """Merge-scan against every level for anchors that are there already, then take it in."""
        starts = batch.groups()
        if not starts.size:
            return
        firsts = batch.keys[starts]
        known = np.zeros(starts.size, bool)
        for level in self.levels:
            at = np.searchsorted(level.keys, firsts)
            hit = at < level.keys.size
            hit[hit] = level.keys[at[hit]] == firsts[hit]
            level.twice[at[hit]] = True
            known |= hit
        counts = np.diff(np.append(starts, batch.keys.size))
        batch.twice[starts] |= known | (counts > 1)
        self.levels.append(batch)
        while len(self.levels) > 1 and self.levels[-2].keys.size <= 2 * self.levels[-1].keys.size:
            self.levels[-2:] = [Level.merged(self.levels[-2:])]

    def whole(self) -> Level:
        return Level.merged(self.levels)


def _row_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` bytes at each start."""
    powers = np.array([pow(_STEP, i, 1 << 64) for i in range(length)], U64)
    out = np.empty(starts.size, U64)
    for at in range(0, starts.size, STRIP // 4):
        rows = data[starts[at : at + STRIP // 4, None] + np.arange(length)]
        out[at : at + len(rows)] = (_BYTE[rows] * powers).sum(axis=1, dtype=U64)
    return mixed(out)


def _rows(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes at each start, one after another."""
    out = np.empty((starts.size, length), np.uint8)
    for at in range(0, starts.size, STRIP // 4):
        out[at : at + STRIP // 4] = data[starts[at : at + STRIP // 4, None] + np.arange(length)]
    return out.ravel()


def distinct_strings(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(one start of each different string, number of each string), compared by bytes."""
    _, first, number = np.unique(_row_hashes(data, starts, length), return_index=True, return_inverse=True)
    heads = starts[first]
    for at in range(0, starts.size, STRIP // 4):
        mine, theirs = starts[at : at + STRIP // 4], heads[number[at : at + STRIP // 4]]
        if not np.array_equal(_rows(data, mine, length), _rows(data, theirs, length)):  # two strings under one hash
            packed = _rows(data, starts, length).view(np.dtype((np.void, length)))
            _, first, number = np.unique(packed, return_index=True, return_inverse=True)
            return starts[first], number
    return heads, number


def distinct_segments(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, groups: np.ndarray, length: int) -> np.ndarray:
    """How many different segments each group has; group numbers ascend, every one from 0 is there."""
    total = np.ones(int(groups.max(initial=-1)) + 1, np.int64)
    several = np.flatnonzero(np.bincount(groups, minlength=total.size)[groups] > 1)
    if several.size:
        starts, counts, groups = starts[several], counts[several], groups[several]
        # a segment has fewer strings than a string has bytes, so its first and last string cover it
        content = _row_hashes(data, starts, length) + U64(3) * _row_hashes(data, starts + counts - 1, length) + counts.astype(U64)
        order = np.lexsort((content, groups))
        groups, content = groups[order], content[order]
        new = np.append(True, (groups[1:] != groups[:-1]) | (content[1:] != content[:-1]))
        found = np.bincount(groups[new], minlength=total.size)
        total = np.maximum(found, 1)
    return total


def _marks(blocks: DataFrame, tasks: int, length: int, anchor: int, hot_segments: int) -> DataFrame:
    """(block, keys, hot): for each block its anchors that two documents have, from every shard.

    What two documents have is told by the family's merge-scans.
    """
    bits = max(1, (4 * tasks - 1).bit_length())

    def suffix_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, sizes, data = open_block(row)
                runs = Runs(data, sizes, length, anchor)
                order = np.argsort(runs.key, kind="stable")
                keys, doc = runs.key[order], runs.doc[order]
                starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else np.empty(0, np.int64)
                last = np.append(starts[1:], keys.size) - 1
                several = doc[starts] != doc[last] if keys.size else np.empty(0, bool)
                group = np.repeat(np.arange(starts.size), np.diff(np.append(starts, keys.size)))
                segments = distinct_segments(data, runs.start[order], runs.count[order], group, length)
                keys = keys[starts]
                cuts = shard_cuts(keys, bits).tolist()
                parts = [(s, a, b) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([s for s, _, _ in parts], pa.int32()),
                        "block": pa.array([row["block"]] * len(parts), pa.int64()),
                        "keys": pa.array([pack_sorted(keys[a:b]) for _, a, b in parts], pa.binary()),
                        "several": pa.array([np.packbits(several[a:b]).tobytes() for _, a, b in parts], pa.binary()),
                        "segments": pa.array([pack(segments[a:b]) if (segments[a:b] > 1).any() else b"" for _, a, b in parts], pa.binary()),
                    }
                )

    def own(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["block", "keys", "several", "segments"]).to_pylist(), key=lambda r: r["block"])
        numbers = [r["block"] for r in rows]
        family, waiting, held = LevelFamily(), [], 0
        for place, row in enumerate(rows):
            keys = unpack_sorted(row["keys"])
            several = np.unpackbits(np.frombuffer(row["several"], np.uint8))[: keys.size].astype(bool)
            segments = unpack(row["segments"], np.int64) if row["segments"] else None
            waiting.append(Level(keys, np.full(keys.size, place, np.int32), several, segments))
            held += keys.size
            if held >= BATCH_KEYS:
                family.add(Level.merged(waiting))
                waiting, held = [], 0
        if waiting:
            family.add(Level.merged(waiting))
        out: dict[str, list] = {"block": [], "keys": [], "hot": []}
        if family.levels:
            level = family.whole()
            starts = level.groups()
            sizes = np.diff(np.append(starts, level.keys.size))
            twice = np.repeat(np.logical_or.reduceat(level.twice, starts), sizes)
            hot = np.repeat(np.add.reduceat(level.segments, starts) > hot_segments, sizes)[twice]
            keys, blocks = level.keys[twice], level.blocks[twice]
            order = np.argsort(blocks, kind="stable")  # keys stay sorted within a block
            keys, blocks, hot = keys[order], blocks[order], hot[order]
            cuts = np.searchsorted(blocks, np.arange(len(numbers) + 1)).tolist()
            for place, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    out["block"].append(numbers[place])
                    out["keys"].append(pack_sorted(keys[a:b]))
                    out["hot"].append(np.packbits(hot[a:b]).tobytes())
        return pa.table({"block": pa.array(out["block"], pa.int64()), "keys": pa.array(out["keys"], pa.binary()), "hot": pa.array(out["hot"], pa.binary())})

    arrays = blocks.mapInArrow(suffix_arrays, "shard int, block long, keys binary, several binary, segments binary")
    return arrays.groupBy("shard").applyInArrow(own, "block long, keys binary, hot binary")


# --- second pass: segments -------------------------------------------------------------


class Segments:
    """The segments of one block around marked anchors, each distinct one once.

    place: (document, start in the block, strings, segment number), in the order of the text.
    """

    def __init__(self, row: dict, marks: list[dict], length: int, anchor: int):
        self.ids, self.sizes, self.data = open_block(row)
        self.parts: list[bytes] = []
        self.least: list[int] = []
        self.most: list[int] = []
        self.place: list[tuple[int, int, int, int]] = []
        #: Documents, places and segment numbers of strings that are sent singly; their segments come last.
        self.hot_doc = self.hot_begin = self.hot_number = np.empty(0, np.int64)
        self.hot_from: int | None = None
        if not marks:
            return
        parts = [unpack_sorted(m["keys"]) for m in marks]
        flags = [np.unpackbits(np.frombuffer(m["hot"], np.uint8)) for m in marks]
        keys = np.concatenate(parts)
        hot = np.concatenate([f[: k.size] for f, k in zip(flags, parts)])
        order = np.argsort(keys)
        keys, hot = keys[order], hot[order].astype(bool)
        runs = Runs(self.data, self.sizes, length, anchor)
        at = np.minimum(np.searchsorted(keys, runs.key), keys.size - 1)
        marked = np.flatnonzero(keys[at] == runs.key)
        raw, ids = self.data.tobytes(), self.ids.tolist()
        numbers: dict[bytes, int] = {}
        is_hot = hot[at[marked]]
        columns = (runs.doc[marked], runs.start[marked], runs.count[marked])
        for doc, begin, strings in zip(*(x[~is_hot].tolist() for x in columns)):
            own = ids[doc]
            part = raw[begin : begin + strings - 1 + length]
            number = numbers.get(part)
            if number is None:
                number = numbers[part] = len(self.parts)
                self.parts.append(part)
                self.least.append(own)
                self.most.append(own)
            else:
                self.least[number] = min(self.least[number], own)
                self.most[number] = max(self.most[number], own)
            self.place.append((doc, begin, strings, number))
        self._take_singly(raw, *(x[is_hot] for x in columns), length)

    def _take_singly(self, raw: bytes, docs: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int) -> None:
        """The strings around hot anchors, each distinct one once; no other segment equals one of them."""
        if not starts.size:
            return
        first = np.cumsum(counts) - counts
        self.hot_begin = np.repeat(starts - first, counts) + np.arange(int(counts.sum()))
        self.hot_doc = np.repeat(docs, counts)
        heads, number = distinct_strings(self.data, self.hot_begin, length)
        own = self.ids[self.hot_doc]
        least, most = np.full(heads.size, LAST_ID), np.full(heads.size, np.iinfo(np.int64).min)
        np.minimum.at(least, number, own)
        np.maximum.at(most, number, own)
        self.hot_from = len(self.parts)
        self.hot_number = number + self.hot_from
        self.parts += [raw[at : at + length] for at in heads.tolist()]
        self.least += least.tolist()
        self.most += most.tolist()

    def shards(self, length: int, anchor: int, bits: int) -> np.ndarray:
        """Owner of each segment: by its anchor, so that equal strings meet; by its content if hot."""
        if not self.parts:
            return np.empty(0, np.int64)
        sizes = np.array([len(x) for x in self.parts])
        data = np.frombuffer(b"".join(self.parts), np.uint8)
        first = _rows(data, np.cumsum(sizes) - sizes, length)
        anchors = mixed(least_anchors(first, length, anchor)[::length])
        contents = mixed(string_hashes(first, length)[::length])
        hot = np.arange(sizes.size) >= (sizes.size if self.hot_from is None else self.hot_from)
        return (np.where(hot, contents, anchors) >> U64(64 - bits)).astype(np.int64)


def least_holders(data: np.ndarray, starts: np.ndarray, holder: np.ndarray, length: int) -> np.ndarray:
    """For the strings at ``starts`` the least ``holder`` among equal strings, compared by bytes."""
    hashes = np.concatenate(
        [string_hashes(data[a : a + STRIP + length - 1], length) for a in range(0, max(1, data.size - length + 1), STRIP)]
    )[starts]
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    group = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    sizes = np.diff(np.append(group, ranked.size))
    heads = np.repeat(starts[order][group], sizes)
    same = np.ones(order.size, bool)
    for at in range(0, order.size, STRIP):
        mine, theirs = starts[order[at : at + STRIP]], heads[at : at + STRIP]
        places = np.arange(length)
        differs = mine != theirs
        some = np.flatnonzero(differs)
        same[at + some] = (data[mine[some, None] + places] == data[theirs[some, None] + places]).all(axis=1)
    if not same.all():  # two strings under one hash: group by the bytes themselves
        packed = np.frombuffer(b"".join(data[s : s + length].tobytes() for s in starts.tolist()), np.dtype((np.void, length)))
        _, number = np.unique(packed, return_inverse=True)
        least = np.full(number.max() + 1, LAST_ID)
        np.minimum.at(least, number, holder)
        return least[number]
    least = np.repeat(np.minimum.reduceat(holder[order], group), sizes)
    out = np.empty(order.size, np.int64)
    out[order] = least
    return out


def _cogrouped(length: int, anchor: int, bits: int):
    schema = pa.schema(
        [("shard", pa.int32()), ("block", pa.int64()), ("parts", pa.binary()), ("sizes", pa.binary()),
         ("least", pa.binary()), ("most", pa.binary()), ("number", pa.binary())]
    )

    def send(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[dict] = []
        for row in left.to_pylist():
            found = Segments(row, right.to_pylist(), length, anchor)
            shard = found.shards(length, anchor, bits)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0)) if order.size else []
            for numbers in np.split(order, cuts[1:]) if order.size else []:
                parts = [found.parts[i] for i in numbers.tolist()]
                out.append(
                    {
                        "shard": int(shard[numbers[0]]),
                        "block": row["block"],
                        "parts": zstandard.ZstdCompressor(level=1).compress(b"".join(parts)),
                        "sizes": pack(np.array([len(x) for x in parts], np.int32)),
                        "least": pack(np.array([found.least[i] for i in numbers.tolist()], np.int64)),
                        "most": pack(np.array([found.most[i] for i in numbers.tolist()], np.int64)),
                        "number": pack(numbers.astype(np.int32)),
                    }
                )
        return pa.Table.from_pylist(out, schema)

    return send


def _answers(length: int):
    schema = pa.schema([("block", pa.int64()), ("number", pa.binary()), ("least", pa.binary())])

    def own(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        raw = [zstandard.ZstdDecompressor().decompress(r["parts"]) for r in rows]
        sizes = [unpack(r["sizes"], np.int32).astype(np.int64) for r in rows]
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.concatenate(sizes)
        begin = np.cumsum(size) - size
        count = size - length + 1  # strings of each segment
        first = np.cumsum(count) - count
        starts = np.repeat(begin - first, count) + np.arange(int(count.sum()))
        least = np.concatenate([unpack(r["least"], np.int64) for r in rows])
        most = np.concatenate([unpack(r["most"], np.int64) for r in rows])
        found = least_holders(data, starts, np.repeat(least, count), length)
        useful = np.minimum.reduceat(found, first) < most  # else nobody loses anything by it
        out, at = [], 0
        for row, mine in zip(rows, sizes):
            wanted = np.flatnonzero(useful[at : at + mine.size])
            if wanted.size:
                values = [found[first[at + i] : first[at + i] + count[at + i]] for i in wanted.tolist()]
                out.append({"block": row["block"], "number": pack(unpack(row["number"], np.int32)[wanted]), "least": pack(np.concatenate(values))})
            at += mine.size
        return pa.Table.from_pylist(out, schema)

    return own


# --- third pass: removal ----------------------------------------------------------------

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def covered(found: Segments, answers: list[dict], length: int) -> np.ndarray:
    """Which bytes of the block go."""
    edges = np.zeros(found.data.size + 1, np.int32)
    if answers:
        least: dict[int, np.ndarray] = {}
        hot_from = len(found.parts) if found.hot_from is None else found.hot_from
        single = np.full(len(found.parts) - hot_from, LAST_ID)
        for row in answers:
            numbers = unpack(row["number"], np.int32)
            values = unpack(row["least"], np.int64)
            hot = numbers >= hot_from  # they come last and have one string each
            cut = values.size - int(hot.sum())
            single[numbers[hot] - hot_from] = values[cut:]
            at = 0
            for number in numbers[~hot].tolist():
                strings = len(found.parts[number]) - length + 1
                least[number] = values[at : at + strings]
                at += strings
        gone = [found.hot_begin[single[found.hot_number - hot_from] < found.ids[found.hot_doc]]]
        for doc, begin, _, number in found.place:
            holders = least.get(number)
            if holders is not None:
                gone.append(begin + np.flatnonzero(holders < found.ids[doc]))
        starts = np.concatenate(gone)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:-1]) > 0


def _removal(length: int, anchor: int, keep_bytes: bool):
    def remove(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names: dict[str, list] = {x: [] for x in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        if keep_bytes:
            names["kept"] = []
        messages = right.to_pylist()
        for row in left.to_pylist():
            marks = [m for m in messages if m["keys"] is not None]
            found = Segments(row, marks, length, anchor)
            gone = covered(found, [m for m in messages if m["number"] is not None], length)
            kept = found.data[~gone].tobytes()
            total = np.append(0, np.cumsum(gone))
            begins = np.append(0, np.cumsum(gone & ~np.append(False, gone[:-1])))
            at, used = 0, 0
            for doc, size in zip(found.ids.tolist(), found.sizes.tolist()):
                removed = int(total[at + size] - total[at])
                spans = int(begins[at + size] - begins[at])
                if removed and at and gone[at] and gone[at - 1]:
                    spans += 1  # its first run follows one at the end of the document before
                rest = kept[used : used + size - removed]
                names["doc_id"].append(None if doc == LAST_ID else doc)
                names["n_bytes"].append(size)
                names["n_removed"].append(removed)
                names["n_spans"].append(spans)
                names["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                if keep_bytes:
                    names["kept"].append(rest)
                at, used = at + size, used + size - removed
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(names.items(), types)})

    return remove


def drop_repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR,
    block_bytes: int = BLOCK_BYTES, hot_segments: int = HOT_SEGMENTS, keep_bytes: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left)."""
    own = columns_as(docs, id=id_col, text=text_col)
    tasks = tasks_for(own)
    bits = max(1, (4 * tasks - 1).bit_length())
    blocks, name = make_blocks(own, block_bytes)
    marks = stored(_marks(blocks, tasks, length, anchor, hot_segments), "suffix-marks")
    by_block = blocks.groupBy("block")
    sent = by_block.cogroup(marks.groupBy("block")).applyInArrow(
        _cogrouped(length, anchor, bits),
        "shard int, block long, parts binary, sizes binary, least binary, most binary, number binary",
    )
    answers = stored(sent.groupBy("shard").applyInArrow(_answers(length), "block long, number binary, least binary"), "suffix-answers")
    messages = marks.select("block", "keys", "hot", F.lit(None).cast("binary").alias("number"), F.lit(None).cast("binary").alias("least"))
    messages = messages.unionByName(answers.select("block", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("hot"), "number", "least"))
    result = by_block.cogroup(messages.groupBy("block")).applyInArrow(
        _removal(length, anchor, keep_bytes), RESULT + (", kept binary" if keep_bytes else "")
    )
    result = stored(result, "suffix-result")
    docs.sparkSession.sql(f"DROP TABLE {name}")  # the name only; the files are in the shared folder
    return result
