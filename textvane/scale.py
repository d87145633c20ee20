"""Building blocks that stay balanced when one key holds a large part of the rows.

All of them are exact.  A key with few rows goes through one ordinary shuffle on the key;
a key above ``ROWS_PER_SLICE`` rows is range-partitioned on its order columns, ranked, and
cut into slices, so that no task ever holds a whole hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from textvane.config import ROWS_PER_SLICE, SMALL_TABLE_BYTES, SMALL_TABLE_ROWS
from textvane.session import checkpointed

POSITION_BITS = 33  # monotonically_increasing_id: partition number above, row number below


SPLIT_BYTES = 128 << 20  # what one scan task reads by default


def spread_out(df: DataFrame) -> DataFrame:
    """Use all cores for a costly projection of a small input.

    An input estimated at less than one split per core is moved once; a larger one is already
    scanned by enough tasks and is left alone.  Nothing is run to find out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if estimate < cores * SPLIT_BYTES else df


FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def small_or_none(df: DataFrame, max_rows: int = SMALL_TABLE_ROWS, max_bytes: int = SMALL_TABLE_BYTES) -> DataFrame | None:
    """The frame as a local table if it has at most ``max_rows`` rows and ``max_bytes`` bytes, else None.

    Where a column has values of any length, the size is added up before a row comes to the driver.
    """
    if not all(isinstance(f.dataType, FIXED_WIDTH) for f in df.schema.fields):
        width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
        size = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
        if size.n > max_rows or size.b > max_bytes:
            return None
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def lookup_side(df: DataFrame, max_rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """A join side that is broadcast only after its size has been checked."""
    small = small_or_none(df, max_rows)
    return df if small is None else F.broadcast(small)


MAP_BITS = 1 << 26  # of the map that tells which keys may be in a table: 2048 rows of 4 KB, 8 MB, whatever the input


def maybe_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` with ``_maybe``: false where its ``key`` is surely not in ``keys``, a table of that column.

    Hashes of the keys set bits of a map of fixed size, which is broadcast.  Very many keys fill it; then
    more rows are in doubt, and none is judged wrongly.
    """
    place = F.pmod(F.xxhash64(key), F.lit(MAP_BITS)) + 1
    bits = keys.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket"))
    bits = F.broadcast(checkpointed(bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))))
    held = df.withColumn("_place", place)
    joined = held.join(bits, F.bitmap_bucket_number("_place") == F.col("_bucket"), "left")
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return joined.withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_place", "_bucket", "_bits")


def without_keys(df: DataFrame, keys: DataFrame, key: str, max_rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Rows whose ``key`` is not in ``keys``; of wide rows only those are moved whose key may be in it."""
    small = small_or_none(keys.select(key), max_rows)
    if small is not None:
        return df.join(F.broadcast(small), key, "left_anti")
    known = maybe_in(df, keys.select(key), key)
    moved = known.where("_maybe").drop("_maybe").join(keys.select(key), key, "left_anti")
    return known.where("not _maybe").drop("_maybe").unionByName(moved)


def with_likely_keys(df: DataFrame, keys: DataFrame, key: str, max_rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """All rows whose ``key`` is in ``keys``, and some others; no row is moved."""
    small = small_or_none(keys.select(key).distinct(), max_rows)
    if small is not None:
        return df.join(F.broadcast(small), key, "left_semi")
    return maybe_in(df, keys.select(key), key).where("_maybe").drop("_maybe")


def frequent_keys(df: DataFrame, keys: Sequence[str], limit: int = ROWS_PER_SLICE) -> DataFrame | None:
    """Keys with more than ``limit`` rows (at most rows/limit of them); None if there are none."""
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).drop("_n")
    side = lookup_side(hot)
    return None if side.isEmpty() else side


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_rank") -> DataFrame:
    """Zero-based rank of each row within its key, without gathering a key in one task.

    ``keys + order`` must identify a row.  One range shuffle; the carried offsets are one
    row per shuffle partition.
    """
    spark = df.sparkSession
    columns = [*keys, *order]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(
        df.repartitionByRange(partitions, *columns)
        .sortWithinPartitions(*columns)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    slot = F.shiftright("_place", POSITION_BITS)
    sizes = placed.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_slot", (F.sum("_n").over(Window.orderBy("_slot")) - F.col("_n")).alias("_offset")
    )  # one row per shuffle partition
    within = F.col("_place").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    positioned = (
        placed.withColumn("_slot", slot)
        .join(F.broadcast(offsets), "_slot")
        .withColumn("_position", F.col("_offset") + within)
        .drop("_slot", "_offset", "_place")
    )
    if not keys:
        return positioned.withColumnRenamed("_position", name)
    starts = positioned.groupBy(*keys).agg(F.min("_position").alias("_start"))
    side = lookup_side(starts)
    joined = positioned.alias("p").join(side.alias("s"), _alias_key("p", "s", keys))
    return joined.select(
        *[F.col(f"p.{c}") for c in df.columns], (F.col("p._position") - F.col("s._start")).alias(name)
    )


def _alias_key(left: str, right: str, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the right side adds its other columns."""
    if how in ("left_semi", "left_anti"):
        return left.alias("p").join(right.alias("q"), _alias_key("p", "q", keys), how)
    added = [F.col(f"q.{c}") for c in right.columns if c not in keys]
    joined = left.alias("p").join(right.alias("q"), _alias_key("p", "q", keys), how)
    return joined.select(*[F.col(f"p.{c}") for c in left.columns], *added)


def join_keyed(left: DataFrame, right: DataFrame, keys: Sequence[str], limit: int = ROWS_PER_SLICE) -> DataFrame:
    """Left join with a table of one row per key; rows of hot keys meet a checked broadcast of just their keys."""
    cold, hot = split_hot(left, keys, limit)
    if hot is None:
        return join_on(left, right, keys, "left")
    names = hot.select(*keys).distinct()
    few = lookup_side(join_on(right, names, keys, "left_semi"))
    return join_on(cold, right, keys, "left").unionByName(join_on(hot, few, keys, "left"))


def keys_as_text(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys as strings: in pandas a null integer would turn its column into floats that equal nothing."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in keys else F.col(c) for c in df.columns])


def keys_as_were(df: DataFrame, keys: Sequence[str], before: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast(before.schema[c].dataType).alias(c) if c in keys else F.col(c) for c in df.columns])


def split_hot(
    df: DataFrame, keys: Sequence[str], limit: int = ROWS_PER_SLICE
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of keys above ``limit`` or None)."""
    hot = frequent_keys(df, keys, limit)
    if hot is None:
        return df, None
    condition = _alias_key("d", "h", keys)
    left, right = df.alias("d"), hot.alias("h")
    return left.join(right, condition, "left_anti"), left.join(right, condition, "left_semi")


def sliced(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lookback: int = 0,
    limit: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add ``_slice`` and ``_warmup`` so that a window over (keys, _slice) sees what it needs.

    Ordinary keys are slice 0.  A hot key is cut every ``limit`` rows, and the last
    ``lookback`` rows of each slice are repeated at the start of the next one, marked as
    warm-up; drop the marked rows after computing the window.
    """
    if lookback > limit:
        raise ValueError("a slice must be longer than the window looks back")
    cold, hot = split_hot(df, keys, limit)
    cold = cold.withColumn("_slice", F.lit(0).cast("long")).withColumn("_warmup", F.lit(False))
    if hot is None:
        return cold
    ranked = with_rank(hot, keys, order, "_nth")
    own = F.floor(F.col("_nth") / limit)
    copies = F.array(F.struct(own.alias("_slice"), F.lit(False).alias("_warmup")))
    if lookback:
        tail = F.col("_nth") % limit >= limit - lookback
        repeated = F.array(F.struct((own + 1).alias("_slice"), F.lit(True).alias("_warmup")))
        copies = F.when(tail, F.concat(copies, repeated)).otherwise(copies)
    parts = ranked.withColumn("_copy", F.explode(copies)).select(*df.columns, "_copy._slice", "_copy._warmup")
    return cold.unionByName(parts)


def slice_window(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, "_slice").orderBy(*order)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    limit: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Running totals from the start of each key, carried across the slices of hot keys."""
    cut = sliced(df, keys, order, 0, limit)
    return carry_sums(cut, df.columns, keys, order, sums)


def carry_sums(
    cut: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]
) -> DataFrame:
    """Local running sums inside a slice plus the totals of all earlier slices."""
    window = slice_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut
    for name, value in sums.items():
        local = local.withColumn(name, F.sum(value).over(window))
    if not _has_slices(cut):
        return local.select(*columns, *sums)
    totals = cut.where("_slice is not null").groupBy(*keys, "_slice").agg(
        *[F.sum(value).alias(f"_total_{name}") for name, value in sums.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(f"_total_{name}").over(before), F.lit(0)).alias(f"_carry_{name}") for name in sums],
    ).where("_slice > 0")
    joined = local.alias("p").join(
        lookup_side(carried).alias("c"), _alias_key("p", "c", [*keys, "_slice"]), "left"
    )
    return joined.select(
        *[F.col(f"p.{c}") for c in columns],
        *[(F.col(f"p.{n}") + F.coalesce(F.col(f"c._carry_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def _has_slices(cut: DataFrame) -> bool:
    """Whether any hot key was cut (cheap: a plan without hot keys has a constant slice)."""
    return not cut.where("_slice > 0").isEmpty()


def last_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, spread: int = 32
) -> DataFrame:
    """The last ``n`` rows of each key (of the whole frame without keys).

    Two rounds: ``n`` per (key, salt), then ``n`` per key.  A row-number filter is also
    applied before the shuffle, so a hot key sends at most ``n`` rows per task and salt.
    """
    newest = [F.col(c).desc() for c in order]
    if not keys:
        return df.orderBy(*newest).limit(n)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(spread)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*newest)
    second = Window.partitionBy(*keys).orderBy(*newest)
    kept = salted.withColumn("_recent", F.row_number().over(first)).where(F.col("_recent") <= n)
    return (
        kept.drop("_recent", "_salt")
        .withColumn("_recent", F.row_number().over(second))
        .where(F.col("_recent") <= n)
        .drop("_recent")
    )


def rank_cutoffs(
    df: DataFrame, key: str, order: Sequence[str], quotas: DataFrame
) -> DataFrame:
    """The order values of the ``quota``-th row of each key; ``quotas`` has (key, quota)."""
    ranked = with_rank(df.select(key, *order), [key], order)
    side = lookup_side(quotas.select(key, "quota"))
    joined = ranked.alias("r").join(side.alias("q"), _alias_key("r", "q", [key]))
    return joined.where(F.col("r._rank") == F.col("q.quota") - 1).select(
        F.col(f"r.{key}").alias(key), *[F.col(f"r.{c}").alias(f"_last_{c}") for c in order]
    )


def within_cutoff(df: DataFrame, key: str, order: Sequence[str], cutoffs: DataFrame, name: str) -> DataFrame:
    """Mark the rows at or before their key's cutoff; the wide rows are neither moved nor sorted."""
    side = lookup_side(cutoffs)
    joined = df.alias("d").join(side.alias("c"), _alias_key("d", "c", [key]), "left")
    mine = F.struct(*[F.col(f"d.{c}") for c in order])
    last = F.struct(*[F.col(f"c._last_{c}").alias(c) for c in order])
    inside = F.col(f"c._last_{order[0]}").isNotNull() & (mine <= last)
    return joined.select("d.*", F.coalesce(inside, F.lit(False)).alias(name))
