"""Exact deduplication by an extendible-hash index, in DataFrame operations only.

Texts are equal when they are identical without white space.  Every distinct text gets a 64-bit
key.  The directory says for any key which bucket it lies in: the keys that share the bucket's
prefix.  It starts with buckets half full on average; a bucket with more than ``bucket_keys`` keys is
split by one more bit (its slot of the directory doubles) until it fits or has only one key.  Texts
are dealt to the owner of their bucket, which chains those under one key and compares their bytes,
so a collision never merges two texts; every row then looks its text up in its bucket.

Copies are combined before each shuffle, so a text that a third of all rows repeat sends one row
per task, and rows of a hot key are spread when they look it up.  What is shuffled is one copy of
each distinct text per task, needed to compare bytes.

Nulls and empty texts are one group (the text without characters).  Rows that repeat an id count
one by one in ``group_size``.  A null id sorts after all others.  Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from textvane.llm.common import bits_needed, columns_as, digest_of, joined_spread, keep_rows, stored, text_of, under_plain_names

BUCKET_KEYS = 4096


def normalised(text: Column) -> Column:
    """The text without white space (space, tab, line feed, vertical tab, form feed, return)."""
    for blank in (" ", "\t", "\n", "\x0b", "\x0c", "\r"):
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def _key(hash_bits: int) -> Column:
    """The leading ``hash_bits`` bits of the text's hash; fewer than 64 only to force collisions."""
    mask = -1 << (64 - hash_bits)
    return F.xxhash64("norm").bitwiseAND(F.lit(mask))


def _prefix(depth: Column | int) -> Column:
    """The first ``depth`` bits of the key, the rest zero."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    low = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), depth)
    return F.when(depth >= 64, F.col("key")).otherwise(F.col("key").bitwiseAND(F.bitwise_not(low)))


@dataclass
class Directory:
    """Which bucket a key lies in: ``depth`` bits, and one more for every split bucket it falls into.

    ``splits`` holds per level the prefixes of the buckets that were split there, as written tables.
    """

    depth: int
    splits: list[DataFrame] = field(default_factory=list)

    def locate(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``key``) with ``depth`` and ``bucket`` added."""
        placed = rows.withColumn("depth", F.lit(self.depth)).withColumn("bucket", _prefix(F.col("depth")))
        for level, split in enumerate(self.splits):
            marks = split.select("bucket", F.lit(self.depth + level).alias("depth"), F.lit(1).alias("_more"))
            more = F.coalesce("_more", F.lit(0))
            placed = placed.join(marks, ["bucket", "depth"], "left").withColumn("depth", F.col("depth") + more)
            placed = placed.drop("_more").withColumn("bucket", _prefix(F.col("depth")))
        return placed


def build_directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> Directory:
    """Double the directory under overfull buckets until every bucket fits; ``keys`` are distinct.

    Each round looks only at the keys of the buckets split in the round before.
    """
    directory = Directory(bits_needed(max(1, 2 * keys.count() // bucket_keys)))
    crowded = directory.locate(keys)
    while True:
        full = crowded.groupBy("depth", "bucket").agg(F.count(F.lit(1)).alias("n"))
        full = stored(full.where((F.col("n") > bucket_keys) & (F.col("depth") < 64)).select("bucket"), "exact-splits")
        if full.isEmpty():
            return directory
        deeper = F.lit(directory.depth + len(directory.splits) + 1)
        directory.splits.append(full)
        inside = crowded.join(full, "bucket", "left_semi").select("key", deeper.alias("depth"))
        crowded = stored(inside.withColumn("bucket", _prefix(F.col("depth"))), "exact-crowded")


def build_index(docs: DataFrame, hash_bits: int = 64, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, DataFrame, Directory]:
    """(rows, index, directory); the tables are written to the shared folder.

    rows: (id, key).  index: one row per distinct text: bucket, key, keep_id, group_size, text_sha256.
    """
    rows = stored(docs.select("id", _norm()).select("id", _key(hash_bits).alias("key")), "exact-rows")
    directory = build_directory(stored(rows.select("key").distinct(), "exact-keys"), bucket_keys)
    return rows, stored(_heads(directory.locate(_texts(docs, hash_bits))).drop("norm"), "exact-index"), directory


def _heads(texts: DataFrame) -> DataFrame:
    """One row per distinct text, its bytes compared within its bucket and key."""
    met = texts.groupBy("bucket", "key", "norm").agg(
        F.max(F.struct("n", F.bitwise_not("id").alias("inverse"))).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    digest = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
    return met.select("bucket", "key", "norm", F.bitwise_not("best.inverse").alias("keep_id"), "group_size", digest)


def _norm() -> Column:
    return normalised(text_of("text")).alias("norm")


def _texts(docs: DataFrame, hash_bits: int) -> DataFrame:
    columns = docs.select("id", F.length(text_of("text")).alias("n"), _norm())
    return columns.select("id", "n", "norm", _key(hash_bits).alias("key"))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_bits: int = 64,
    bucket_keys: int = BUCKET_KEYS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with most code points stays, then the smallest id.
    """
    own = columns_as(docs, id=id_col, text=text_col)
    rows, index, directory = build_index(own, hash_bits, bucket_keys)
    found = ["keep_id", "group_size", "text_sha256"]
    place = F.xxhash64("id")
    chained = stored(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "exact-chained")
    asked = directory.locate(rows).select("id", "key", _slot())
    if chained.isEmpty():
        return _answers(joined_spread(asked, index.select(_slot(), *found), "slot", "group_size", place))
    alone = index.join(chained, "key", "left_anti").select(_slot(), *found)
    joined = joined_spread(asked, alone, "slot", "group_size", place).select("id", *found)
    # rows under a chained key meet the chain's texts by their bytes
    texts = directory.locate(_texts(own, hash_bits).join(chained, "key", "left_semi"))
    chain = _heads(texts).select("bucket", "key", "norm", *found)
    return _answers(joined.unionByName(texts.join(chain, ["bucket", "key", "norm"]).select("id", *found)))


def _answers(joined: DataFrame) -> DataFrame:
    return joined.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def _slot() -> Column:
    """Bucket and key as one column to join on."""
    return F.struct("bucket", "key").alias("slot")


@under_plain_names
def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the dropped rows: of equal texts one row stays.

    Decided by (id, text without white space), so different texts under one id or a null id all stay.
    """
    found = exact_groups(docs, id_col, text_col)
    decisions = found.select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest"), "kept")
    return keep_rows(docs, stored(decisions, "exact-kept"), id_col, text_col, digest_of(normalised(text_of(text_col))))
