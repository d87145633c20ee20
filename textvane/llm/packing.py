"""Packing tokenised documents into sequences with a grouping genetic algorithm.

A document is its token ids and an end id.  Only longer ones than a sequence are cut.  Full pieces
are sequences by themselves; the others are dealt to shards of about ``SHARD_PIECES`` pieces.
Every shard is packed by ``ISLANDS`` islands.  An individual is a set of bins.  Crossover injects
the well-filled bins of one parent whole, drops the other parent's bins that hold any of the same
pieces, and best-fits the displaced pieces; mutation empties some of the worst-filled bins and
best-fits their pieces.  Displaced pieces are fitted longest first, either into the fullest bin that
has room, or by filling one bin after another with the best single piece or pair; an island's
population begins with one individual of each kind.  An island goes on until no packing could have
fewer bins, or ``PATIENCE`` generations in a row have brought no better one.  Between epochs the
elite of each island migrates to the next one of its shard.  The best individual of a shard is its
packing.  Bins of all shards that are at most half full are then packed once more, as they are, by
the same algorithm.  All random choices follow the shard and island numbers, so that a task that is
run again gives the same packing.

Null and empty texts are the end id alone.  Very long texts are cut, not dropped.  Rows that
repeat an id are packed each; null ids are kept.  Empty tables give no rows.
"""

from __future__ import annotations

import bisect
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textvane.llm.common import columns_as, stored

CAPACITY = 2048
END_ID = 0
SHARD_PIECES = 8192
ISLANDS = 2
POPULATION = 4
PATIENCE = 12
EPOCHS = 2
CACHED_WORDS = 700_000  # about 120 bytes each, in every Python worker; performance only

#: How the vocabulary's own pre-tokenizer splits a lower-case word of these letters.
_PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


# --- tokens ------------------------------------------------------------------------


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordTokens(dict):
    """Word without white space (bytes) -> its ids as little-endian 32-bit integers, made when first met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.characters = byte_characters()
        self.cores: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def core(self, piece: bytes) -> bytes:
        found = self.cores.get(piece)
        if found is None:
            if len(self.cores) >= CACHED_WORDS:
                self.cores.clear()
            shown = piece.decode() if piece.isascii() else "".join(map(self.characters.__getitem__, piece))
            tokens = self.tokenizer.model.tokenize(shown)
            found = self.cores[piece] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return found

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        if word.isalpha():  # ASCII letters alone
            found = self.core(word.lower())
        elif word[:-1].isalpha() and word[-1] in _MARKS:
            found = self.core(word[:-1].lower()) + self.core(word[-1:])
        else:
            text = word.decode()
            if _PLAIN.fullmatch(text) and unicodedata.is_normalized("NFC", text):
                found = b"".join([self.core(x.encode()) for x in _SPLIT.findall(text.lower())])
            else:
                found = self.whole(text)
        self[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; words are cut at ASCII white space, which no token crosses."""
        return b"".join([self[word] for word in (text or "").encode().split()])


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, text) -> (doc_id, piece, start, length, ids_crc32)."""
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = words.encode(text.as_py()) + end
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(row)
                    numbers.append(number)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("id", "text").mapInArrow(cut, schema)


# --- the genetic algorithm, over the lengths of one shard -----------------------------


class Packing:
    """An individual: bins of piece numbers, and what each bin has left."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.left: list[int] = []

    def copy(self) -> Packing:
        other = Packing(self.lengths, self.capacity)
        other.bins, other.left = [list(b) for b in self.bins], list(self.left)
        return other

    def best_fit(self, pieces: list[int]) -> Packing:
        """Longest first, each into the fullest bin that has room, else into a new one."""
        open_bins = sorted((left, number) for number, left in enumerate(self.left) if left)
        for piece in sorted(pieces, key=lambda p: (-self.lengths[p], p)):
            length = self.lengths[piece]
            at = bisect.bisect_left(open_bins, (length, -1))
            if at < len(open_bins):
                left, number = open_bins.pop(at)
                self.bins[number].append(piece)
            else:
                left, number = self.capacity, len(self.bins)
                self.bins.append([piece])
                self.left.append(left)
            self.left[number] = left - length
            if left > length:
                bisect.insort(open_bins, (left - length, number))
        return self

    def fill_bins(self, pieces: list[int]) -> Packing:
        """Open a bin for the longest piece and add the single piece or pair that fills it best, until none fits.

        What cannot start a bin that gets more than three quarters full goes by ``best_fit``.
        """
        order = sorted(pieces, key=lambda p: (self.lengths[p], p))
        sizes = np.array([self.lengths[p] for p in order], np.int64)
        loose: list[int] = []
        while order:
            members, left = [order.pop()], self.capacity - int(sizes[-1])
            sizes = sizes[:-1]
            while sizes.size and sizes[0] <= left:
                chosen = best_addition(sizes, left)
                for at in sorted(chosen, reverse=True):
                    left -= int(sizes[at])
                    members.append(order.pop(at))
                sizes = np.delete(sizes, chosen)
            if left * 4 <= self.capacity:
                self.bins.append(members)
                self.left.append(left)
            else:
                loose += members
        return self.best_fit(loose)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first; then fuller bins, which leave room in few places."""
        return -len(self.bins), sum(((self.capacity - x) / self.capacity) ** 2 for x in self.left)

    def without(self, gone: set[int]) -> list[int]:
        """Take whole bins out; returns their pieces."""
        freed = [p for number in gone for p in self.bins[number]]
        keep = [number for number in range(len(self.bins)) if number not in gone]
        self.bins = [self.bins[number] for number in keep]
        self.left = [self.left[number] for number in keep]
        return freed

    def assignment(self) -> np.ndarray:
        place = np.empty(len(self.lengths), np.int32)
        for number, pieces in enumerate(self.bins):
            place[pieces] = number
        return place


def best_addition(sizes: np.ndarray, room: int) -> list[int]:
    """Places of the single size or pair of sizes, in ascending order, that fill ``room`` best."""
    one = int(np.searchsorted(sizes, room, "right")) - 1
    best, places = int(sizes[one]), [one]
    if best < room and sizes.size > 1:
        first = np.arange(one + 1)
        second = np.searchsorted(sizes, room - sizes[: one + 1], "right") - 1
        fits = np.flatnonzero(second > first)
        if fits.size:
            sums = sizes[first[fits]] + sizes[second[fits]]
            at = fits[int(np.argmax(sums))]
            if int(sizes[at] + sizes[second[at]]) > best:
                places = [int(at), int(second[at])]
    return places


def from_assignment(lengths: list[int], capacity: int, place: np.ndarray) -> Packing:
    packing = Packing(lengths, capacity)
    packing.bins = [[] for _ in range(int(place.max(initial=-1)) + 1)]
    for piece, number in enumerate(place.tolist()):
        packing.bins[number].append(piece)
    packing.left = [capacity - sum(lengths[p] for p in b) for b in packing.bins]
    return packing


def refitted(packing: Packing, pieces: list[int], random: np.random.Generator) -> Packing:
    """Displaced pieces back in, by one of the two ways."""
    return packing.fill_bins(pieces) if random.random() < 0.5 else packing.best_fit(pieces)


def crossover(giver: Packing, taker: Packing, random: np.random.Generator) -> Packing:
    """Inject well-filled bins of ``giver`` into ``taker``, drop the bins they clash with, refit the rest."""
    filled = [n for n, left in enumerate(giver.left) if left <= giver.capacity // 256]
    share = int(random.integers(2, 9))  # of the filled bins one in two to eight
    chosen = random.permutation(filled)[: max(1, len(filled) // share)].tolist() if filled else []
    injected = {p for n in chosen for p in giver.bins[n]}
    child = taker.copy()
    clash = {n for n, pieces in enumerate(child.bins) if not injected.isdisjoint(pieces)}
    displaced = [p for p in child.without(clash) if p not in injected]
    for n in chosen:
        child.bins.append(list(giver.bins[n]))
        child.left.append(giver.left[n])
    return refitted(child, displaced, random)


def mutate(packing: Packing, random: np.random.Generator) -> Packing:
    """Empty the worst-filled bins and a few others."""
    if not packing.bins:
        return packing
    child = packing.copy()
    order = sorted(range(len(child.bins)), key=lambda n: -child.left[n])
    few = max(1, len(order) // int(random.integers(8, 65)))
    gone = set(order[:few]) | set(random.choice(len(order), few).tolist())
    return refitted(child, child.without(gone), random)


def evolve(
    lengths: list[int], capacity: int, seed: tuple[int, ...], immigrants: list[np.ndarray],
    population: int = POPULATION, patience: int = PATIENCE,
) -> np.ndarray:
    """One epoch of one island; returns its elite as an assignment of pieces to bins."""
    random = np.random.default_rng(seed)
    fewest = -(-sum(lengths) // capacity)
    alive = [from_assignment(lengths, capacity, place) for place in immigrants]
    every = list(range(len(lengths)))
    if not alive:
        alive.append(Packing(lengths, capacity).best_fit(every))
        if len(alive[0].bins) > fewest:
            alive.append(Packing(lengths, capacity).fill_bins(every))
    best = max(alive, key=Packing.fitness)
    while len(alive) < population and len(best.bins) > fewest:
        alive.append(mutate(alive[random.integers(len(alive))], random))
    best, idle = max(alive, key=Packing.fitness), 0
    while len(best.bins) > fewest and idle < patience:  # no packing has fewer than ``fewest``
        first, second = (alive[i] for i in random.choice(len(alive), 2, replace=len(alive) < 2))
        child = mutate(crossover(first, second, random), random)
        alive[min(range(len(alive)), key=lambda i: alive[i].fitness())] = child
        idle = 0 if child.fitness() > best.fitness() else idle + 1
        best = max([best, child], key=Packing.fitness)
    return best.assignment()


# --- islands on Spark -------------------------------------------------------------


def _read(value: bytes | None, dtype) -> np.ndarray:
    return np.frombuffer(value or b"", dtype)


def pack_pieces(
    pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS
) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) plus sequence_id and offset.

    ``capacity`` bounds a sequence, no piece is longer.
    """
    numbered = pieces.withColumn("_row", F.monotonically_increasing_id())
    numbered = stored(numbered, "pieces")  # the numbers must not change when a task is run again
    full = numbered.where(F.col("length") >= capacity)
    short = numbered.where(F.col("length") < capacity)
    shards = max(1, -(-short.count() // shard_pieces))
    short = short.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int"))

    gene = "shard int, island int, lengths binary, elite binary"
    names = ["shard", "island", "lengths", "elite"]

    def found(shard: int, island: int, lengths: bytes, elite: bytes) -> pa.Table:
        arrays = [pa.array([shard], pa.int32()), pa.array([island], pa.int32()), pa.array([lengths]), pa.array([elite], pa.binary())]
        return pa.Table.from_arrays(arrays, names)

    def settle(table: pa.Table) -> pa.Table:
        """A shard's lengths in the order of its rows."""
        order = np.argsort(table.column("_row").to_numpy())
        lengths = table.column("length").to_numpy()[order].astype("<i4")
        return found(table.column("_shard")[0].as_py(), 0, lengths.tobytes(), b"")

    def epoch(number: int):
        def run(table: pa.Table) -> pa.Table:
            shard, island = table.column("shard")[0].as_py(), table.column("island")[0].as_py()
            lengths = table.column("lengths")[0].as_py()
            elites = sorted(x for x in table.column("elite").to_pylist() if x)
            seed = (shard, island, number)
            best = evolve(_read(lengths, "<i4").tolist(), capacity, seed, [_read(x, "<i4") for x in elites])
            return found(shard, island, lengths, best.astype("<i4").tobytes())

        return run

    def place(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Attach the best island's packing to the rows of a shard."""
        order = np.argsort(left.column("_row").to_numpy())
        rows = left.take(pa.array(order))
        lengths = rows.column("length").to_numpy()
        elites = sorted(right.column("elite").to_pylist())
        best = min((_read(x, "<i4") for x in elites), key=lambda x: int(x.max(initial=-1)))
        by_bin = np.argsort(best, kind="stable")
        ends = np.cumsum(lengths[by_bin])
        begins = ends - lengths[by_bin]
        first = np.flatnonzero(np.diff(best[by_bin], prepend=-1))
        base = np.repeat(begins[first], np.diff(np.append(first, by_bin.size)))
        offset = np.empty(by_bin.size, np.int64)
        offset[by_bin] = begins - base
        sequence = best.astype(np.int64) * shards + key[0].as_py()
        poor = np.bincount(best, lengths)[best] * 2 <= capacity
        rows = rows.drop_columns(["_row", "_shard"])
        for name, values in (("sequence_id", sequence), ("offset", offset), ("_poor", poor)):
            rows = rows.append_column(name, pa.array(values))
        return rows

    state = short.groupBy("_shard").applyInArrow(settle, gene)
    state = state.select("shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), "lengths", "elite")
    for number in range(epochs):
        state = state.groupBy("shard", "island").applyInArrow(epoch(number), gene)
        if number < epochs - 1:  # each elite stays at home and also goes to the next island
            next_island = (F.col("island") + 1) % islands
            homes = F.array_distinct(F.array(F.col("island"), next_island))
            state = state.select("shard", F.explode(homes).alias("island"), "lengths", "elite")
    state = stored(state.select(F.col("shard").alias("_shard"), "elite"), "packing-elites")
    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, _poor boolean"
    packed = short.groupBy("_shard").cogroup(state.groupBy("_shard")).applyInArrow(place, schema)
    alone = full.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    if shards == 1:
        return packed.drop("_poor").unionByName(alone)
    packed = stored(packed, "packed")
    return packed.where("not _poor").drop("_poor").unionByName(_together(packed.where("_poor").drop("_poor"), capacity)).unionByName(alone)


def _together(rows: DataFrame, capacity: int) -> DataFrame:
    """Sequences that are at most half full, each kept as it is, packed into fewer."""
    loads = rows.groupBy("sequence_id").agg(F.sum("length").alias("length"))
    zero = F.lit(0).cast("long")
    as_pieces = loads.select(F.col("sequence_id").alias("doc_id"), F.lit(0).alias("piece"), zero.alias("start"), "length", zero.alias("ids_crc32"))
    moved = stored(pack_pieces(as_pieces, capacity), "poor-sequences")
    names = moved.groupBy(F.col("sequence_id").alias("_new")).agg(F.min("doc_id").alias("_name"))  # their old names are free
    placed = moved.join(names, F.col("sequence_id") == F.col("_new"))
    places = placed.select(F.col("doc_id").alias("_old"), "_name", F.col("offset").alias("_base"))
    joined = rows.join(places, F.col("sequence_id") == F.col("_old"))
    own = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    return joined.select(*own, F.col("_name").alias("sequence_id"), (F.col("offset") + F.col("_base")).alias("offset"))


def pack_documents(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(token_pieces(columns_as(docs, id=id_col, text=text_col), vocabulary, capacity), capacity)
