"""Text scores by an interpolated modified Kneser-Ney bigram model counted in Spark.

Tokens are words (ASCII lower-cased, cut at ASCII white space) and one end per text; a text's first
token follows a start mark.  A word is known by 56 bits of its hash, a bigram by 64.

Counting: every task counts its bigrams and sends them to the shard of their first word, each once
with its count.  The shard's owner adds up, writes its bigrams as an array sorted by hash with
their counts, and sends per word what the lower order needs (how many words come before it, how
many it is followed by once, twice, more often) to the word's shard, whose owner writes those
arrays.  First words with a large share of all tokens are dealt by both words, so no owner gathers
a frequent word's bigrams.

Scoring: workers map the arrays into memory and look up each batch's distinct bigrams in order.
If the shared folder is not a file system, a worker maps its own copy, which has no name on disk.

    p(w | v) = max(c(vw) - D(c), 0) / c(v) + g(v) p(w),  p(w) = the same over distinct predecessors,
    and at last 1 / (V + 1)

Discounts come from the counts of counts 1 to 4 over all bigrams; where those are missing, half of
each count.  Null and empty texts are one end.  Very long texts are hashed in stretches.  Repeated
rows count each time; a null id belongs to no fold, so it is learnt.  Without training rows every
probability is 1 / (V + 1) = 1.  Empty tables give no rows.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from textvane.llm.common import BLANKS, U64, columns_as, mixed, pack, pack_sorted, stored, tasks_for, text_batches, unpack, unpack_sorted
from textvane.session import scratch_path

WORD_BITS = 56
STRETCH = 1 << 20
TOKENS_AT_ONCE = 3_000_000
END = U64(1)
START = U64(2)

_BYTE = np.random.default_rng(56).integers(0, 1 << 63, 256, np.uint64) * U64(2) + U64(1)
_BYTE[65:91] = _BYTE[97:123]  # ASCII capitals count as their small letters
_STEP = 0x2545F4914F6CDD1D
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_POWERS = np.ones(1, U64)


# --- tokens ------------------------------------------------------------------------


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while _POWERS.size < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * U64(pow(_STEP, _POWERS.size, 1 << 64))])
    return _POWERS


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word."""
    letter = ~_BLANK[data]
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not starts.size:
        return np.empty(0, U64), starts
    sizes = ends - starts
    places = np.flatnonzero(letter)
    first = np.cumsum(sizes) - sizes
    within = np.arange(places.size) - np.repeat(first, sizes)
    values = _BYTE[data[places]] * _powers(int(sizes.max()))[within]
    total = np.add.reduceat(values, first)
    key = mixed(total) >> U64(64 - WORD_BITS)
    return np.maximum(key, U64(3)), starts  # END and START stand apart


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(token keys, tokens per text): for every text START, its words, END; START is not in the sizes."""
    data = np.frombuffer(("\n".join(texts) + "\n").encode(), np.uint8)
    bounds = np.cumsum([len(x.encode()) + 1 for x in texts])
    hashes, places, at = [], [], 0
    while at < data.size:  # stretches end at white space
        end = min(data.size, at + STRETCH)
        while end < data.size and not _BLANK[data[end - 1]]:
            end += 1
        found, starts = _word_hashes(data[at:end])
        hashes.append(found)
        places.append(starts + at)
        at = end
    words = np.concatenate(hashes)
    doc = np.searchsorted(bounds, np.concatenate(places), side="right")
    sizes = np.bincount(doc, minlength=len(texts))
    out = np.empty(words.size + 2 * len(texts), U64)
    out[np.arange(words.size) + 2 * doc + 1] = words
    ends = np.cumsum(sizes + 2)
    out[ends - 1] = END
    out[ends - sizes - 2] = START
    return out, sizes + 1


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, number of the key before, number of the key) of every token but START."""
    real = np.flatnonzero(keys != START)
    words, number = np.unique(keys, return_inverse=True)
    return words, number[real - 1], number[real]


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * U64(0xD6E8FEB86659FD93) + second)


class Shards:
    """Where a bigram and a word are kept."""

    def __init__(self, bits: int, frequent: list[int]):
        self.bits, self.count = bits, 1 << bits
        self.word_bits = max(2, bits - 3)  # words are far fewer; every shard sends to every word shard
        self.frequent = np.array(sorted(frequent), U64)

    def of_pair(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = mixed(first)
        if self.frequent.size:
            at = np.minimum(np.searchsorted(self.frequent, first), self.frequent.size - 1)
            key = np.where(self.frequent[at] == first, pair_hash(second, first), key)
        return (key >> U64(64 - self.bits)).astype(np.int64)

    def of_word(self, word: np.ndarray) -> np.ndarray:
        return (mixed(word + U64(7)) >> U64(64 - self.word_bits)).astype(np.int64)


# --- files -------------------------------------------------------------------------


def _local(folder: str) -> str | None:
    """The folder as a path, if the shared folder is a file system."""
    if folder.startswith("file:"):
        return folder[5:].replace("///", "/", 1) if folder.startswith("file:///") else folder[5:]
    return folder if folder.startswith("/") else None


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """Write whole or not at all; a task that runs again writes the same."""
    local = _local(folder)
    if local is not None:
        os.makedirs(local, exist_ok=True)
        part = f"{local}/.{name}.{uuid.uuid4().hex}"
        values.tofile(part)
        os.replace(part, f"{local}/{name}")
        return
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(values.tobytes())


WIDE = 1 << 32  # counts from here on take 64 bits


def pack_counts(values: np.ndarray) -> bytes:
    """Counts in 32 bits each, or in 64 where one needs them; the first byte says which."""
    kind = np.uint64 if values.max(initial=0) >= WIDE else np.uint32
    return bytes([np.dtype(kind).itemsize]) + pack(np.ascontiguousarray(values, kind))


def unpack_counts(data: bytes) -> np.ndarray:
    return unpack(data[1:], np.uint64 if data[0] == 8 else np.uint32).astype(np.int64)


def write_counts(folder: str, name: str, values: np.ndarray) -> None:
    """A table of counts, under a name of its own if it is wide."""
    wide = values.max(initial=0) >= WIDE
    write_array(folder, f"{name}-wide" if wide else name, values.astype(np.uint64 if wide else np.uint32))


def map_counts(folder: str, name: str) -> np.ndarray:
    narrow = map_array(folder, name, np.uint32)
    return narrow if narrow.size else map_array(folder, f"{name}-wide", np.uint64)


def map_array(folder: str, name: str, dtype) -> np.ndarray:
    """The array mapped into memory; an empty or missing file is an empty array."""
    local = _local(folder)
    if local is not None:
        path = f"{local}/{name}"
        if not os.path.exists(path) or not os.path.getsize(path):
            return np.empty(0, dtype)
        return np.memmap(path, dtype, "r")
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    info = system.get_file_info(f"{path}/{name}")
    if not info.is_file or not info.size:
        return np.empty(0, dtype)
    with tempfile.TemporaryFile() as copy, system.open_input_stream(f"{path}/{name}") as source:
        while data := source.read(1 << 22):
            copy.write(data)
        copy.flush()
        return np.memmap(copy, dtype, "r")


# --- counting ------------------------------------------------------------------------


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (first, second) in order, with counts."""
    words, before, after = numbered(keys)
    pairs = before.astype(U64)
    del before
    pairs <<= U64(32)
    pairs |= after.astype(U64)
    del after
    pairs, counts = np.unique(pairs, return_counts=True)
    return words[(pairs >> U64(32)).astype(np.int64)], words[(pairs & U64(0xFFFFFFFF)).astype(np.int64)], counts


def _packed_words(keys: np.ndarray) -> bytes:
    """Word keys without their empty top byte."""
    planes = keys.view(np.uint8).reshape(-1, 8)[:, : WORD_BITS // 8]
    return zstandard.ZstdCompressor(level=1).compress(planes.T.tobytes())


def _unpacked_words(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(WORD_BITS // 8, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : WORD_BITS // 8] = planes.T
    return out.view(U64).ravel()


def _batched_tokens(batches: Iterator[pa.RecordBatch], most: int = TOKENS_AT_ONCE) -> Iterator[np.ndarray]:
    held, n = [], 0
    for _, texts in text_batches(batches):
        keys, _ = tokens(texts)
        held.append(keys)
        n += keys.size
        if n >= most:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def frequent_words(docs: DataFrame, shards: int) -> list[int]:
    """Words with more than half a shard's share of all tokens; at most 2 x ``shards`` of them.

    Each task names its words above an eighth of a shard's share.  This only decides where bigrams
    are counted, not what is counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in _batched_tokens(batches):
            words, counts = np.unique(keys, return_counts=True)
            large = counts > keys.size / (8 * shards)
            named = np.append(words[large].astype(np.int64), -1)
            totals = np.append(counts[large], keys.size)
            yield pa.RecordBatch.from_arrays([pa.array(named), pa.array(totals.astype(np.int64))], ["word", "n"])

    found = docs.select("id", "text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = stored(found, "frequent-words")
    total = found.where("word = -1").agg(F.sum("n")).first()[0] or 0
    rows = found.where((F.col("word") >= 0) & (F.col("n") > total / (2 * shards))).collect()
    return [r.word for r in rows]


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the figures that hold for all of them."""

    folder: str
    bits: int
    frequent: list[int] = field(repr=False)
    tokens: int
    words: int
    pairs: int
    discounts: tuple[float, float, float]
    lower_discounts: tuple[float, float, float]
    lower_rest: float  # share of the lower order that is spread evenly


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """D for counts 1, 2 and 3 or more, from how many have counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2 or not n3:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(float(k), max(0.0, d)) for k, d in enumerate(raw, 1))


def train(docs: DataFrame) -> Model:
    """Count the bigrams of (id, text) and write the model to the shared folder."""
    shards_wanted = tasks_for(docs)
    bits = max(2, (2 * shards_wanted - 1).bit_length())
    frequent = frequent_words(docs, 1 << bits)
    shards = Shards(bits, frequent)
    folder = scratch_path(docs.sparkSession, "kneser-ney")
    sent = "shard int, firsts binary, runs binary, seconds binary, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in _batched_tokens(batches):
            first, second, counts = _counted(keys)
            shard = shards.of_pair(first, second)
            order = np.argsort(shard.astype(np.uint16) if bits <= 16 else shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards.count + 1)).tolist()
            rows = []
            for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    mine = order[a:b]
                    f = first[mine]
                    begins = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
                    rows.append(
                        {
                            "shard": number,
                            "firsts": pack_sorted(f[begins]),
                            "runs": pack(np.diff(np.append(begins, f.size)).astype(np.uint32)),
                            "seconds": _packed_words(second[mine]),
                            "counts": pack_counts(counts[mine]),
                        }
                    )
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int32()), *((n, pa.binary()) for n in ("firsts", "runs", "seconds", "counts"))]))

    per_word = pa.schema([("shard", pa.int32()), ("words", pa.binary()), ("values", pa.binary()), ("figures", pa.list_(pa.int64()))])
    kind = "shard int, words binary, values binary, figures array<bigint>"

    def own_pairs(table: pa.Table) -> pa.Table:
        number = table.column("shard")[0].as_py()
        rows = table.to_pylist()
        first = np.concatenate([np.repeat(unpack_sorted(r["firsts"]), unpack(r["runs"], np.uint32)) for r in rows])
        second = np.concatenate([_unpacked_words(r["seconds"]) for r in rows])
        counts = np.concatenate([unpack_counts(r["counts"]) for r in rows])
        hashes = pair_hash(first, second)
        order = np.argsort(hashes)
        hashes, first, second, counts = hashes[order], first[order], second[order], counts[order]
        begins = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        counts = np.add.reduceat(counts, begins)
        hashes, first, second = hashes[begins], first[begins], second[begins]
        write_array(folder, f"pairs-{number}", hashes)
        write_counts(folder, f"counts-{number}", counts)
        words, place = np.unique(np.concatenate([first, second]), return_inverse=True)
        before, after = place[: first.size], place[first.size :]
        values = np.zeros((5, words.size), np.int64)  # count, predecessors, followed once, twice, more
        np.add.at(values[0], after, counts)  # whole numbers, however large
        values[1] = np.bincount(after, minlength=words.size)
        for row, some in enumerate((counts == 1, counts == 2, counts > 2), 2):
            values[row] = np.bincount(before[some], minlength=words.size)
        shard = shards.of_word(words)
        out = [{"shard": 0, "figures": [0, counts.size, *[int((counts == k).sum()) for k in (1, 2, 3, 4)]]}]
        for target in np.unique(shard).tolist():
            mine = np.flatnonzero(shard == target)
            out.append({"shard": target, "words": pack_sorted(words[mine]), "values": pack_counts(values[:, mine].ravel())})
        return pa.Table.from_pylist(out, per_word)

    def own_words(table: pa.Table) -> pa.Table:
        number = table.column("shard")[0].as_py()
        rows = table.to_pylist()
        out = [{"shard": number, "figures": r["figures"]} for r in rows if r["words"] is None]
        some = [(unpack_sorted(r["words"]), unpack_counts(r["values"]).reshape(5, -1)) for r in rows if r["words"] is not None]
        if some:
            words = np.concatenate([w for w, _ in some])
            values = np.concatenate([v for _, v in some], axis=1)
            order = np.argsort(words)
            words, values = words[order], values[:, order]
            begins = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            values = np.add.reduceat(values, begins, axis=1)
            words = words[begins]
            write_array(folder, f"words-{number}", words)
            write_array(folder, f"seen-{number}", values[0])
            for name, row in zip(("before", "once", "twice", "more"), values[1:]):
                write_counts(folder, f"{name}-{number}", row)
            before = values[1]
            figures = [1, int(values[0].sum()), int((values[0] > 0).sum()), int(before.sum())]
            figures += [int((before == k).sum()) for k in (1, 2, 3, 4)] + [int((before > 2).sum())]
            out.append({"shard": number, "figures": figures})
        return pa.Table.from_pylist(out, per_word)

    pairs = docs.select("id", "text").mapInArrow(count, sent).groupBy("shard").applyInArrow(own_pairs, kind)
    owned = pairs.groupBy("shard").applyInArrow(own_words, kind).select("figures")
    totals = stored(owned, "kneser-ney-figures").groupBy(F.col("figures")[0].alias("level"))
    sums = {r.level: r for r in totals.agg(*[F.sum(F.get("figures", F.lit(i))).alias(f"f{i}") for i in range(1, 9)]).collect()}
    top = np.array([sums[0][f"f{i}"] for i in range(2, 6)]) if 0 in sums else np.zeros(4)
    low = [sums[1][f"f{i}"] for i in range(1, 9)] if 1 in sums else [0] * 8
    lower = discounts(np.array(low[3:7]))
    rest = (lower[0] * low[3] + lower[1] * low[4] + lower[2] * low[7]) / low[2] if low[2] else 1.0
    return Model(folder, bits, frequent, low[0], low[1], low[2], discounts(top), lower, rest)


# --- scoring -------------------------------------------------------------------------


class Mapped:
    """A model's arrays as one worker sees them."""

    def __init__(self, model: Model):
        self.model, self.shards = model, Shards(model.bits, model.frequent)
        self.arrays: dict[str, np.ndarray] = {}

    def _array(self, name: str, number: int, dtype=None) -> np.ndarray:
        """Without a dtype a table of counts, in 32 or 64 bits."""
        key = f"{name}-{number}"
        if key not in self.arrays:
            folder = self.model.folder
            self.arrays[key] = map_counts(folder, key) if dtype is None else map_array(folder, key, dtype)
        return self.arrays[key]

    def _look_up(self, shard: np.ndarray, keys: np.ndarray, by: str, wanted: dict) -> dict[str, np.ndarray]:
        out = {name: np.zeros(keys.size, np.int64) for name in wanted}
        order = np.lexsort((keys, shard))
        cuts = np.searchsorted(shard[order], np.arange(self.shards.count + 1)).tolist()
        for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
            known = self._array(by, number, U64) if b > a else np.empty(0, U64)
            if known.size:
                mine = order[a:b]
                at = np.minimum(np.searchsorted(known, keys[mine]), known.size - 1)
                hit = known[at] == keys[mine]
                for name, dtype in wanted.items():
                    out[name][mine[hit]] = self._array(name, number, dtype)[at[hit]]
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) per text."""
        model = self.model
        keys, sizes = tokens(texts)
        words, a, b = numbered(keys)
        names = {"seen": np.int64, "before": None, "once": None, "twice": None, "more": None}
        word = self._look_up(self.shards.of_word(words), words, "words", names)
        pairs, which = np.unique((a.astype(U64) << U64(32)) | b.astype(U64), return_inverse=True)
        f, s = words[(pairs >> U64(32)).astype(np.int64)], words[(pairs & U64(0xFFFFFFFF)).astype(np.int64)]
        count = self._look_up(self.shards.of_pair(f, s), pair_hash(f, s), "pairs", {"counts": None})["counts"]
        d, low = np.array([0.0, *model.discounts]), np.array([0.0, *model.lower_discounts])
        even = 1.0 / (model.words + 1)
        before = word["before"]
        lower = np.maximum(before - low[np.minimum(before, 3)], 0.0) / max(1, model.pairs) + model.lower_rest * even
        follows = word["seen"].astype(np.float64)
        starts = np.flatnonzero(words == START)
        if starts.size:  # a start mark is no token: it is followed once in every text
            follows[starts] = self._texts_learnt()
        spread = (d[1] * word["once"] + d[2] * word["twice"] + d[3] * word["more"]) / np.maximum(follows, 1.0)
        fa, sb = (pairs >> U64(32)).astype(np.int64), (pairs & U64(0xFFFFFFFF)).astype(np.int64)
        higher = np.maximum(count - d[np.minimum(count, 3)], 0.0) / np.maximum(follows[fa], 1.0)
        chance = np.where(follows[fa] > 0, higher + spread[fa] * lower[sb], lower[sb])
        seen = word["seen"][b]
        base = np.log10((seen + 1.0) / (model.tokens + model.words + 1.0))
        bounds = np.cumsum(sizes) - sizes
        added = [np.add.reduceat(x, bounds) for x in ((seen > 0).astype(np.int64), base, np.log10(chance)[which])]
        return sizes, *added

    def _texts_learnt(self) -> int:
        end = np.array([END])
        return int(self._look_up(self.shards.of_word(end), end, "words", {"seen": np.int64})["seen"][0])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(id, text) -> (doc_id, n_tokens, n_known, base_score, score)."""
    kind = docs.schema["id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = Mapped(model)
        for ids, texts in text_batches(batches, rows=8192, size=4 << 20):
            n, known, base, score = mapped.score(texts)
            columns = [pa.array(ids, id_type), pa.array(n.astype(np.int64)), pa.array(known), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    schema = f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double"
    return docs.select("id", "text").mapInArrow(run, schema)


def held_out_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows that are not ``held_out`` (a column over ``id``) and score all of them."""
    own = columns_as(docs, id=id_col, text=text_col)
    model = train(own.where(~held_out))
    found = scored(own, model).withColumnRenamed("doc_id", "id").withColumn("held_out", held_out).withColumnRenamed("id", "doc_id")
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
