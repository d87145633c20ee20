"""Helpers shared by the corpus operators."""

from __future__ import annotations

import functools
import inspect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from textvane.session import scratch_path

#: The white space of every contract: space and \t \n \v \f \r.
BLANKS = b" \t\n\x0b\x0c\r"
U64 = np.uint64
MASK = (1 << 64) - 1


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lost executors re-read it, lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns_as(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns under the operator's own names, so extra columns cannot clash."""
    return df.select(*[F.col(f"`{theirs}`").alias(own) for own, theirs in names.items()])


def under_plain_names(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that gets its table with the columns c0, c1, ..., so names it adds cannot clash with any.

    Arguments named ``*_col`` follow; the result has the names it came with.
    """

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        given = inspect.signature(stage).bind(docs, *args, **kwargs)
        given.apply_defaults()
        place = {name.lower(): i for i, name in reversed(list(enumerate(docs.columns)))}
        for argument, value in given.arguments.items():
            if argument.endswith("_col") and value is not None and value.lower() in place:
                given.arguments[argument] = f"c{place[value.lower()]}"
        given.arguments["docs"] = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        return stage(*given.args, **given.kwargs).toDF(*docs.columns)

    return run


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def tasks_for(df: DataFrame) -> int:
    """As many tasks as the scan has, at least the session's shuffle partitions."""
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(session, df.rdd.getNumPartitions())


#: Bits of the map that goes to every task: 2048 rows of 4 KB, 8 MB, whatever the input.
MAP_BITS = 1 << 26


def marked(df: DataFrame, key: Column, marks: DataFrame) -> DataFrame:
    """``df`` with ``_maybe``: false where the row's ``key`` (a 64-bit hash) is surely not in ``marks``.

    ``marks`` has one column of hashes.  They set bits of a map of fixed size, which is broadcast.
    Very many marks fill it; then more rows are in doubt, and none is judged wrongly.
    """
    place = lambda h: F.pmod(h, F.lit(MAP_BITS)) + 1
    bits = marks.select(place(F.col(marks.columns[0])).alias("h"))
    bits = bits.groupBy(F.bitmap_bucket_number("h").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_bits")
    )
    bits = F.broadcast(stored(bits, "row-map"))
    held = df.withColumn("_place", place(key))
    joined = held.join(bits, F.bitmap_bucket_number("_place") == F.col("_bucket"), "left")
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return joined.withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_place", "_bucket", "_bits")


def digest_of(text: Column) -> Column:
    """SHA-256 of a text as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def keep_rows(docs: DataFrame, decisions: DataFrame, id_col: str, text_col: str, digest: Column) -> DataFrame:
    """Rows of ``docs`` decided for, columns as they were; several under one (id, digest) become one.

    ``decisions`` has a row (id, digest, kept) for every row of ``docs``, alike for equal (id, digest);
    ``digest`` makes it from a row of ``docs``.  Of rows under one kept (id, digest) the longest text
    stays.  A null id is an id like any other.  Only rows that may have to go are moved.
    """
    state = decisions.groupBy("id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    doubt = stored(state.where("not kept or n > 1").select("id", "digest", "kept"), "rows-in-doubt")
    own = [F.col(f"`{id_col}`").alias("_id"), digest.alias("_digest")]
    known = marked(docs.select("*", *own), F.xxhash64("_id", "_digest"), doubt.select(F.xxhash64("id", "digest").alias("h")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    moved = known.where("_maybe")
    row = F.struct(*columns)
    rank = F.struct(F.length(text_of(text_col)), F.xxhash64(text_of(text_col)))
    moved = moved.select("_id", "_digest", row.alias("_row"), rank.alias("_rank"), F.lit(False).alias("_gone"))
    gone = doubt.where("not kept").select(
        F.col("id").alias("_id"), F.col("digest").alias("_digest"),
        F.lit(None).cast(moved.schema["_row"].dataType).alias("_row"),
        F.lit(None).cast(moved.schema["_rank"].dataType).alias("_rank"), F.lit(True).alias("_gone"),
    )
    met = moved.unionByName(gone).groupBy("_id", "_digest").agg(F.max_by("_row", "_rank").alias("_row"), F.max("_gone").alias("_gone"))
    return known.where("not _maybe").select(*columns).unionByName(met.where("not _gone").select("_row.*"))


#: A key with more than one row in so many counts as hot; there are fewer hot keys than this.
HOT_KEYS = 1024


def joined_spread(rows: DataFrame, groups: DataFrame, key: str, count: str, place: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups``, which has one row per ``key`` and in ``count`` how many rows have it.

    A hot key's group row is repeated and its rows are dealt over the repeats by ``place``, a hash that
    tells rows of one key apart, so no task gets more than about one row in ``HOT_KEYS`` from one key.
    The broadcast table has fewer than ``HOT_KEYS`` rows.  ``groups`` is read twice: pass a written table.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    parts = F.ceil(F.col(count) * F.lit(HOT_KEYS) / F.lit(max(total, 1))).cast("int")
    hot = groups.where(F.col(count) * HOT_KEYS > F.lit(total)).select(F.col(key), parts.alias("_parts"))
    salt = F.when(F.col("_parts").isNotNull(), F.pmod(place, F.col("_parts"))).otherwise(0).cast("int")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_parts")
    copies = F.when(F.col(count) * HOT_KEYS > F.lit(total), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    repeated = groups.withColumn("_salt", F.explode(copies))
    return dealt.join(repeated, [key, "_salt"], how).drop("_salt")


# --- sorted 64-bit arrays as bytes ---------------------------------------------


def pack_sorted(values: np.ndarray) -> bytes:
    """A sorted uint64 array as compressed differences, split into byte planes."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    steps = np.ascontiguousarray(planes.reshape(8, -1).T).view(U64).ravel()
    return np.cumsum(steps, dtype=U64)


def pack(values: np.ndarray) -> bytes:
    width = values.dtype.itemsize
    planes = values.view(np.uint8).reshape(-1, width).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values over the word (a bijection)."""
    x = values ^ (values >> U64(31))
    x *= U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


def text_batches(batches: Iterator[pa.RecordBatch], rows: int = 2048, size: int = 16 << 20):
    """(ids, texts) in lists of bounded size from Arrow batches of (id, text)."""
    ids: list = []
    texts: list = []
    held = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            ids.append(doc)
            texts.append(text)
            held += len(text)
            if len(ids) >= rows or held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def bits_needed(n: int) -> int:
    return max(0, math.ceil(math.log2(n))) if n > 1 else 0
