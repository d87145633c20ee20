"""SimHash near-duplicates, found with the generalised pigeonhole principle.

A text's fingerprint has a bit set where more than half of its word shingles' hashes have it.
Fingerprints within ``distance`` bits are linked; a component is everything reachable.

Distinct fingerprints are cut into parts of bits that go together (by their correlation over all
fingerprints).  Part i may differ in t_i bits; if the t_i + 1 sum to ``distance`` + 1, every pair
within the distance agrees in some part up to its t_i.  The number of parts and the t_i (-1: the
part is not used) come from dynamic programming on estimated costs: entries sent plus candidates
compared.  Each fingerprint is posted under the value of each used part and probes the values
within t_i; whatever meets is verified on all bits.  A bucket's links are reduced to a spanning
forest inside its task, so a group of near copies is never expanded into all its pairs; buckets
above ``BLOCK`` entries are met block by block.

Nulls and texts without words have fingerprint zero and are linked like any other.  Repeated rows
share a fingerprint.  Texts are read whole, in pieces.  Empty tables give no rows; rows with a
null id get a component like others, where the null sorts last.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from textvane.llm.common import columns_as, digest_of, joined_spread, keep_rows, stored, tasks_for, text_of, under_plain_names
from textvane.llm.components import components

BITS = 64
SHINGLE = 4
DISTANCE = 4
SEED = 42
BLOCK = 8192
HASHES_AT_ONCE = 1 << 14
#: Cost of one entry that is sent, in fingerprint comparisons.
ENTRY_COST = 400.0


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """SimHash of the word shingles, repeats included; zero if there is no word."""
    found = (text or "").encode().lower().split()  # both act on ASCII only, as bytes do
    if not found:
        return 0
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends + 1 - size).tolist()
    n = max(1, len(found) - words + 1)
    last = ends[min(words, len(found)) - 1 :].tolist()
    hashing = xxhash.xxh64_intdigest
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        some = [hashing(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + HASHES_AT_ONCE)], last[at:])]
        bits = np.unpackbits(np.array(some, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(id, text) -> (id, fp), fp a signed 64-bit integer; further columns follow as they are."""
    more = [c for c in docs.columns if c not in ("id", "text")]
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("id", *more)}
    schema = ", ".join([f"id {kinds['id']}", "fp long", *[f"{c} {kinds[c]}" for c in more]])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), words) for x in batch.column(1)]
            values = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), values, *batch.columns[2:]], ["id", "fp", *more])

    return docs.select("id", "text", *more).mapInArrow(make, schema)


# --- choosing the parts ----------------------------------------------------------


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    most: int  # bits that may differ; -1: not used

    def values(self, fps: np.ndarray) -> np.ndarray:
        value = np.zeros(fps.size, np.uint64)
        for bit in self.bits:
            value = (value << np.uint64(1)) | ((fps >> np.uint64(bit)) & np.uint64(1))
        return value

    def flips(self) -> list[int]:
        """Masks of every change of 1 to ``most`` bits of the part's value."""
        places = range(len(self.bits))
        return [sum(1 << p for p in chosen) for k in range(1, self.most + 1) for chosen in itertools.combinations(places, k)]


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(count, means, correlations) of the bits over all fingerprints; 65 x 64 sums reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones, both = 0, np.zeros(BITS), np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, values.size, 1 << 14):
                some = values[at : at + (1 << 14)]
                bits = ((some[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                n += some.size
                ones += bits.sum(axis=0)
                both += bits.T @ bits
        sums = np.concatenate([[n], ones, both.ravel()])
        yield pa.RecordBatch.from_pydict({"place": np.arange(sums.size), "total": sums})

    sums = fps.select("fp").mapInArrow(add, "place long, total double").groupBy("place").agg(F.sum("total").alias("total"))
    total = np.zeros(1 + BITS + BITS * BITS)
    for row in sums.collect():
        total[row.place] = row.total
    n = max(1.0, total[0])
    mean = total[1 : 1 + BITS] / n
    cov = total[1 + BITS :].reshape(BITS, BITS) / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return int(total[0]), mean, cov / np.outer(spread, spread)


def group_bits(correlations: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to parts of nearly equal width, each bit to the part it correlates with most."""
    strength = np.abs(correlations) - np.eye(BITS)
    room = [BITS // parts + (i < BITS % parts) for i in range(parts)]
    left = list(np.argsort(-strength.sum(axis=1)))
    groups: list[list[int]] = []
    for width in room:
        group = [int(left.pop(0))]
        while len(group) < width:
            nearest = max(left, key=lambda b: strength[b, group].sum())
            left.remove(nearest)
            group.append(int(nearest))
        groups.append(group)
    return groups


def meeting_chances(mean: np.ndarray, correlations: np.ndarray, bits: Sequence[int], most: int) -> list[float]:
    """Estimated chance that two fingerprints differ in at most 0..most bits of a part."""
    chance = np.zeros(most + 2)
    chance[0] = 1.0
    factor = 1.0
    for i, bit in enumerate(bits):
        differ = 2 * mean[bit] * (1 - mean[bit])
        chance[1:] = chance[1:] * (1 - differ) + chance[:-1] * differ
        chance[0] *= 1 - differ
        if i:
            factor *= 1 + max(correlations[bit, b] ** 2 for b in bits[:i])
    return [min(1.0, factor * float(x)) for x in np.cumsum(chance[: most + 1])]


def choose_parts(n: int, mean: np.ndarray, correlations: np.ndarray, distance: int = DISTANCE) -> list[Part]:
    """The cheapest parts and thresholds whose t_i + 1 sum to ``distance`` + 1."""
    best: tuple[float, list[Part]] | None = None
    for parts in range(1, distance + 2):
        groups = group_bits(correlations, parts)
        costs = []
        for bits in groups:
            chances = meeting_chances(mean, correlations, bits, distance)
            sent, row = 1, [0.0]
            for most in range(distance + 1):
                sent += comb(len(bits), most) if most else 0
                row.append(n * sent * ENTRY_COST + n * n * chances[most])
            costs.append(row)  # row[k]: cost of threshold k - 1
        table: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * (distance + 1)
        for row in costs:
            step = []
            for total in range(distance + 2):
                options = [(table[total - k][0] + row[k], [*table[total - k][1], k - 1]) for k in range(total + 1)]
                step.append(min(options, key=lambda o: o[0]))
            table = step
        cost, chosen = table[distance + 1]
        if best is None or cost < best[0]:
            best = cost, [Part(tuple(b), t) for b, t in zip(groups, chosen) if t >= 0]
    return best[1]


# --- probing and verifying -------------------------------------------------------


def _entries(parts: list[Part]):
    """fp -> (key, fp, probe): its postings and probes in every used part."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("probe", pa.bool_())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy()
            for at in range(0, signed.size, 1 << 15):
                some = signed[at : at + (1 << 15)]
                for number, part in enumerate(parts):
                    value = part.values(some.view(np.uint64))
                    for flip in [0, *part.flips()]:
                        key = ((value ^ np.uint64(flip)) * np.uint64(64) + np.uint64(number)).view(np.int64)
                        probe = np.full(some.size, flip != 0)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some), pa.array(probe)], schema=schema)

    return make


class Forest:
    """Union-find over fingerprints of one task; keeps a spanning forest."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def near_pairs(left: np.ndarray, right: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints within the distance, in strips of bounded size."""
    strip = max(1, (1 << 22) // max(1, right.size))
    for at in range(0, left.size, strip):
        apart = np.bitwise_count(left[at : at + strip, None] ^ right[None, :])
        i, j = np.nonzero(apart <= distance)
        yield i + at, j


def _verify(distance: int):
    """Sorted (key, block, fp, probe, own) rows -> (u, v), a spanning forest of each bucket's links."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def bucket(fps: np.ndarray, probe: np.ndarray, forest: Forest, out: list) -> None:
        posts = fps[~probe]
        for left in (posts, fps[probe]):
            for i, j in near_pairs(left.view(np.uint64), posts.view(np.uint64), distance):
                a, b = left[i], posts[j]
                for x, y in zip(a[a != b].tolist(), b[a != b].tolist()):
                    if forest.join(x, y):
                        out.append((x, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, out = Forest(), []
        rest: tuple | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                rest = own if rest is None else [np.concatenate(x) for x in zip(rest, own)]
            if rest is None or rest[0].size == 0:
                continue
            key, part = rest[0], rest[1]
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            bounds = [0, *cuts.tolist()]
            if batch is None:
                bounds.append(key.size)
            for a, b in zip(bounds, bounds[1:]):
                if b - a > 1:
                    bucket(rest[2][a:b], rest[3][a:b], forest, out)
            rest = [x[bounds[-1] :] for x in rest]
            if len(forest.parent) > 1 << 20:
                forest = Forest()  # later links may repeat earlier ones; none is lost
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=schema)
                out = []

    return run


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, parts: list[Part] | None = None, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) with the components of all pairs within ``distance``."""
    if parts is None:
        parts = choose_parts(*bit_statistics(fps), distance)
    entries = fps.select("fp").mapInArrow(_entries(parts), "key long, fp long, probe boolean")
    hot = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    hot = stored(hot.select("key", F.ceil(F.col("n") / block).alias("blocks")), "simhash-hot")
    if hot.isEmpty():
        met = entries.withColumn("block", F.lit(0).cast("long"))
    else:  # every pair of blocks of a large bucket meets once in a part of its own
        wide = entries.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        pairs = F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
            lambda other: F.least(other, F.col("own")) * F.col("blocks") + F.greatest(other, F.col("own")),
        )
        met = wide.withColumn("own", own).withColumn("block", F.explode(pairs)).drop("own", "blocks")
    tasks = tasks_for(fps)
    dealt = met.select("key", "block", "fp", "probe").repartition(tasks, "key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(_verify(distance), "u long, v long")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE,
    distance: int = DISTANCE,
    parts: list[Part] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    rows = stored(fingerprints(columns_as(docs, id=id_col, text=text_col), words), "simhash-rows")
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    rooted = _rooted(distinct.select("fp", "least"), distance, parts)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(smallest, "root").select("fp", "component_id")
    found = stored(found.join(distinct.select("fp", "n"), "fp"), "simhash-components")
    return joined_spread(rows, found, "fp", "n", F.xxhash64("id")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _rooted(distinct: DataFrame, distance: int, parts: list[Part] | None = None) -> DataFrame:
    """(fp, least) -> (fp, least, root), root the same for all fingerprints of a component."""
    roots = components(fingerprint_links(distinct, distance, parts))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    return rooted.select("fp", "least", F.coalesce("root", "fp").alias("root"))


@under_plain_names
def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: of the smallest id there, its least (text digest, fingerprint).

    Decided by component, id and text, so texts of different components all stay, also under one id
    or a null id.
    """
    own = columns_as(docs, id=id_col, text=text_col).withColumn("digest", digest_of(text_of()))
    rows = stored(fingerprints(own), "simhash-rows")
    first = F.struct(F.col("id").isNull().alias("last"), "id", "digest")
    distinct = stored(rows.groupBy("fp").agg(F.min(first).alias("least")), "simhash-distinct")
    chosen = _rooted(distinct, DISTANCE).groupBy("root").agg(F.min(F.struct("least", "fp")).alias("best"))
    chosen = chosen.select("best.fp", "best.least.id", "best.least.digest", F.lit(True).alias("kept"))
    same = rows["id"].eqNullSafe(chosen["id"]) & (rows["digest"] == chosen["digest"]) & (rows["fp"] == chosen["fp"])
    decisions = rows.join(chosen, same, "left").select(rows["id"], rows["digest"], F.coalesce("kept", F.lit(False)).alias("kept"))
    return keep_rows(docs, stored(decisions, "simhash-kept"), id_col, text_col, digest_of(text_of(text_col)))
