"""Folds over the micro-batches of a log: what is known of each key is a table in the shared folder.

A micro-batch is an ordinary DataFrame, so the batch operators work on it, hot keys cut into slices
included; no task ever holds all rows of a key.  What is carried from one micro-batch to the next,
per key a machine's state or its last few rows, is written in full after each, in one of two
alternating folders.  A micro-batch that is run again reads the state its first run read and
overwrites what that wrote, so every event counts exactly once.

Each key's events have to arrive in order, (ts, event_id).  An event at or before the last one of
its key, or older than ``delay_sec`` before the newest event of all earlier micro-batches, comes too
late: it goes to the table ``late`` and changes nothing.  With an idle time a key that was silent for
longer is forgotten, and its state leaves the table once the log has gone on for idle time and delay.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from textvane.config import ROWS_PER_SLICE
from textvane.operators.replay import STATE_FIELDS, Machine, flagged, replay_from, states_after
from textvane.scale import join_keyed, join_on, last_n, with_rank
from textvane.session import scratch_path

ORDER = ("ts", "event_id")

Sink = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class Folded:
    """The tables of a fold: ``rows``, ``late`` and the last ``state``."""

    spark: SparkSession
    path: str
    rows_schema: T.StructType
    late_schema: T.StructType
    state_schema: T.StructType

    def _parts(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/part=*")

    @property
    def rows(self) -> DataFrame:
        return self._parts("rows", self.rows_schema)

    @property
    def late(self) -> DataFrame:
        return self._parts("late", self.late_schema)

    @property
    def state(self) -> DataFrame:
        """The state after the last micro-batch."""
        schema = T.StructType([*self.state_schema.fields, T.StructField("_batch", T.LongType())])
        both = self.spark.read.schema(schema).parquet(f"{self.path}/state/slot=*")
        newest = both.agg(F.max("_batch")).first()[0]
        return both.where(F.col("_batch").eqNullSafe(F.lit(newest))).drop("_batch")


class Fold:
    """One fold: ``step(batch, state)`` gives (rows, late rows, a function from written rows to the next state)."""

    def __init__(self, spark: SparkSession, path: str, state_schema: T.StructType, step: Callable, sink: Sink | None = None):
        self.spark, self.path, self.state_schema, self.step, self.sink = spark, path, state_schema, step, sink

    def _state_before(self, number: int) -> DataFrame:
        if number == 0:
            return self.spark.createDataFrame([], self.state_schema)
        schema = T.StructType([*self.state_schema.fields, T.StructField("_batch", T.LongType())])
        held = self.spark.read.schema(schema).parquet(f"{self.path}/state/slot={(number - 1) % 2}")
        return held.where(F.col("_batch") == number - 1).drop("_batch")

    def __call__(self, batch: DataFrame, number: int) -> None:
        # the micro-batch belongs to a session of its own; its rows are read several times
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)
        state = self._state_before(number)
        rows, late, after = self.step(held, state)
        place = f"{self.path}/rows/part={number}"
        rows.write.mode("overwrite").parquet(place)
        late.write.mode("overwrite").parquet(f"{self.path}/late/part={number}")
        written = self.spark.read.schema(rows.schema).parquet(place)
        following = after(written).select(*self.state_schema.names).withColumn("_batch", F.lit(number).cast("long"))
        following.write.mode("overwrite").parquet(f"{self.path}/state/slot={number % 2}")
        if self.sink is not None:
            self.sink(written, number)
        held.unpersist()

    def run(self, stream: DataFrame) -> None:
        """Process everything available now; progress lies beside the tables."""
        query = (
            stream.writeStream.foreachBatch(self)
            .option("checkpointLocation", f"{self.path}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def _split_late(
    batch: DataFrame, seen: DataFrame, keys: Sequence[str], delay_sec: float | None, limit: int
) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows); ``seen`` has the place (us, id) of each known key's last event."""
    placed = join_keyed(batch, seen.select(*keys, F.col("us").alias("_seen_us"), F.col("id").alias("_seen_id")), keys, limit)
    us, ident = F.unix_micros("ts"), F.col("event_id")
    late = (us < F.col("_seen_us")) | ((us == F.col("_seen_us")) & (ident <= F.col("_seen_id")))
    if delay_sec is not None:
        newest = seen.agg(F.max("us")).first()[0]
        if newest is not None:
            late = late | (us < F.lit(newest - round(delay_sec * 1e6)))
    late = F.coalesce(late, F.lit(False))
    return placed.where(~late).select(*batch.columns), placed.where(late).select(*batch.columns)


def _still_known(state: DataFrame, idle_sec: float | None, delay_sec: float | None) -> DataFrame:
    """The states of keys that have not been idle for too long."""
    if idle_sec is None:
        return state
    newest = state.agg(F.max("us")).first()[0]
    if newest is None:
        return state
    return state.where(F.col("us") >= F.lit(newest - round((idle_sec + (delay_sec or 0.0)) * 1e6)))


def replayed_stream(
    events: DataFrame,
    machine: Machine,
    flag: Column,
    keys: Sequence[str] = ("key",),
    reset: Column | None = None,
    delay_sec: float | None = None,
    path: str | None = None,
    sink: Sink | None = None,
    limit: int = ROWS_PER_SLICE,
) -> Folded:
    """A state machine over a stream, as ``replay`` runs it over a table (its idle time included).

    Without a delay the states of idle keys leave the table only by the machine's idle time.
    """
    spark = events.sparkSession
    target = path or scratch_path(spark, "stream-fold")
    source = flagged(events, flag, keys, reset)
    fields = [source.schema[k] for k in keys]
    schema = T.StructType([*fields, *T.StructType.fromDDL(STATE_FIELDS).fields])
    idle_sec = machine.idle_us / 1e6 if machine.idle_us else None
    rows_schema: list[T.StructType] = []

    def step(batch: DataFrame, state: DataFrame):
        fresh, late = _split_late(batch, state, keys, delay_sec, limit)
        rows = replay_from(fresh, machine, keys, state, limit)
        rows_schema[:] = [rows.schema]

        def after(written: DataFrame) -> DataFrame:
            moved = states_after(written, keys)
            return _still_known(moved.unionByName(join_on(state, moved, keys, "left_anti")), idle_sec, delay_sec)

        return rows, late, after

    Fold(spark, target, schema, step, sink).run(source)
    none = spark.createDataFrame([], source.schema)
    rows = replay_from(none, machine, keys, None, limit).schema if not rows_schema else rows_schema[0]
    return Folded(spark, target, rows, source.schema, schema)


def windowed_stream(
    events: DataFrame,
    operator: Callable[[DataFrame], DataFrame],
    lookback: int,
    keys: Sequence[str] = ("key",),
    idle_sec: float | None = None,
    delay_sec: float | None = None,
    path: str | None = None,
    sink: Sink | None = None,
    limit: int = ROWS_PER_SLICE,
) -> Folded:
    """An operator whose rows depend on their key's last ``lookback`` events before them.

    ``events`` holds only rows that count for the window; the state is the last ``lookback`` of each
    key.  The operator gives rows with the keys, ts and event_id of the event they belong to.  A key
    that was forgotten starts with an empty window.
    """
    spark = events.sparkSession
    target = path or scratch_path(spark, "stream-fold")
    schemas: list[T.StructType] = []

    def places(tail: DataFrame) -> DataFrame:
        last = F.max(F.struct(F.unix_micros("ts").alias("us"), F.col("event_id").alias("id"))).alias("s")
        return tail.groupBy(*keys).agg(last).select(*keys, "s.us", "s.id")

    def step(batch: DataFrame, state: DataFrame):
        seen = places(state)
        fresh, late = _split_late(batch, seen, keys, delay_sec, limit)
        both = state.unionByName(fresh)
        found = operator(both)
        rows, _ = _split_late(found, seen, keys, None, limit)  # not again those of the carried events
        schemas[:] = [rows.schema]

        def after(written: DataFrame) -> DataFrame:
            tail = last_n(both, keys, ORDER, lookback)
            if idle_sec is None:
                return tail
            known = _still_known(places(tail), idle_sec, delay_sec)
            return join_on(tail, known.select(*keys), keys, "left_semi")

        return rows, late, after

    Fold(spark, target, events.schema, step, sink).run(events)
    rows = schemas[0] if schemas else operator(spark.createDataFrame([], events.schema)).schema
    return Folded(spark, target, rows, events.schema, events.schema)


def batched_stream(
    rows: DataFrame, size: int, order: str = "doc_id", path: str | None = None, sink: Sink | None = None
) -> Folded:
    """(id, batch_id, position) of rows that arrive in the order of a unique id; state is one rank.

    A row at or before the last id of an earlier micro-batch is late.
    """
    if size < 1:
        raise ValueError("a batch holds at least one row")
    spark = rows.sparkSession
    target = path or scratch_path(spark, "stream-fold")
    source = rows.select(order)
    state_schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("last", source.schema[order].dataType)])
    out = T.StructType([source.schema[order], T.StructField("batch_id", T.LongType()), T.StructField("position", T.LongType())])

    def step(batch: DataFrame, state: DataFrame):
        known = state.first()
        n, last = (known.n, known.last) if known else (0, None)
        late = F.lit(False) if last is None else F.coalesce(F.col(order) <= F.lit(last), F.lit(True))
        ranked = with_rank(batch.where(~late), [], [order])
        rank = F.col("_rank") + F.lit(n)
        found = ranked.select(order, F.floor(rank / size).cast("long").alias("batch_id"), (rank % size).cast("long").alias("position"))

        def after(written: DataFrame) -> DataFrame:
            more = written.agg(F.count(F.lit(1)).alias("c"), F.max(order).alias("m"))
            ahead = more.select((F.col("c") + F.lit(n)).alias("n"), F.col("m").alias("last"))
            return ahead if last is None else ahead.select("n", F.coalesce("last", F.lit(last)).alias("last"))

        return found, batch.where(late), after

    Fold(spark, target, state_schema, step, sink).run(source)
    return Folded(spark, target, out, source.schema, state_schema)


# --- windows of event time ---------------------------------------------------------


def windowed_counts(
    events: DataFrame,
    partial: Callable[[DataFrame], DataFrame],
    values: Callable[[DataFrame], DataFrame],
    path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Partial aggregates and counted values of every micro-batch, as two tables to be added up.

    Nothing is kept in memory between micro-batches, no row is late, and what a micro-batch writes
    twice it overwrites.
    """
    spark = events.sparkSession
    target = path or scratch_path(spark, "stream-windows")
    schemas: dict[str, T.StructType] = {}

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)
        for name, made in (("partial", partial(held)), ("values", values(held))):
            schemas[name] = made.schema
            made.write.mode("overwrite").parquet(f"{target}/{name}/part={number}")
        held.unpersist()

    query = (
        events.writeStream.foreachBatch(each)
        .option("checkpointLocation", f"{target}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not schemas:
        none = spark.createDataFrame([], events.schema)
        return partial(none), values(none)
    return tuple(spark.read.schema(schemas[n]).parquet(f"{target}/{n}/part=*") for n in ("partial", "values"))

