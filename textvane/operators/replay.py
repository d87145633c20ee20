"""Replay of per-key state machines over an event log.

A fault detector is a small table of states and flags, plus at most one timed wait.  Rows of
a key must be seen in order, but a hot key must not sit in one task, so its log is cut into
slices and replayed in three steps:

1. every slice, on its own, is followed from *each* state it could be entered in (the
   trajectories soon meet, so this costs little more than one replay);
2. the slice summaries of a key, a few numbers each, are chained to find the state in which
   every slice is really entered;
3. every slice is replayed from that state.

The idea is that of data-parallel finite-state machines (Mytkowicz, Musuvathi and Schulte,
ASPLOS 2014); the timed wait is covered by one trajectory per moment at which it can end.

A reset, and a key's return after more than the idle time, are constant maps: every trajectory
goes on in the start state.

``replay_from`` takes the states that keys were left in and gives the states they are left in, so a
log can be replayed piece by piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textvane.config import ROWS_PER_SLICE
from textvane.scale import join_on, keys_as_text, keys_as_were, lookup_side, sliced

WAITING = -1  # state code of the timed wait
RESET = 2  # flag of an event that takes every state back to the start
NEVER = -(1 << 62)  # time of the last event of a key that had none
FOREVER = 1 << 62


@dataclass(frozen=True)
class Machine:
    """``table[code][flag]`` is the next code; WAITING starts a wait of ``wait_us`` after which
    the machine stands in ``wake``.  While waiting, events are refused.  The flag RESET, and a gap
    of more than ``idle_us`` since the key's last event (0: no limit), lead to state 0."""

    names: tuple[str, ...]
    table: tuple[tuple[int, int], ...]
    wake: int = 0
    wait_us: int = 0
    waiting_name: str = "open"
    idle_us: int = 0

    def name(self, code: int) -> str:
        return self.waiting_name if code == WAITING else self.names[code]

    def forgets(self, last: int, ts: int) -> bool:
        return self.idle_us > 0 and last != NEVER and ts - last > self.idle_us

    def advance(self, code: int, until: int, ts: int, flag: int, last: int = NEVER) -> tuple[bool, int, int]:
        """(accepted, next code, end of wait) for one event; ``last`` is the time of the one before."""
        if flag == RESET:
            return True, 0, 0
        if self.forgets(last, ts):
            code, until = 0, 0
        if code == WAITING:
            if ts < until:
                return False, code, until
            code = self.wake
        code = self.table[code][flag]
        return True, code, (ts + self.wait_us if code == WAITING else until)


def build_machine(
    start: tuple, step: Callable[[tuple, int], tuple | None], wake: tuple | None = None,
    wait_sec: float = 0.0, label: Callable[[tuple], str] = str, waiting_name: str = "open",
) -> Machine:
    """Number the states reachable from ``start`` and ``wake``; ``step`` gives None for the wait."""
    states = [start] if wake is None or wake == start else [start, wake]
    table, i = [], 0
    while i < len(states):
        row = []
        for flag in (0, 1):
            nxt = step(states[i], flag)
            if nxt is not None and nxt not in states:
                states.append(nxt)
            row.append(WAITING if nxt is None else states.index(nxt))
        table.append(tuple(row))
        i += 1
    at = 0 if wake is None else states.index(wake)
    return Machine(tuple(label(s) for s in states), tuple(table), at, round(wait_sec * 1e6), waiting_name)


class SliceTrace:
    """Follows all possible entry states of one slice at once.

    A trajectory is a node; trajectories that reach the same state are merged.  ``moments``
    are the event times at which a wait inherited from an earlier slice may end.
    """

    def __init__(self, machine: Machine):
        self.machine = machine
        self.parent = list(range(len(machine.table)))
        self.live = {code: code for code in range(len(machine.table))}
        self.waits = any(WAITING in row for row in machine.table)
        self.waiting: list[tuple[int, int]] = []
        self.first_waiting = 0
        self.moments: list[int] = []
        self.moment_nodes: list[int] = []
        self.first = self.last = None
        self.settled = False  # no inherited wait is open any more

    def _forget(self) -> None:
        """All trajectories, and every wait that is still open, go on in the start state."""
        nodes = [*self.live.values(), *[node for _, node in self.waiting[self.first_waiting :]]]
        if self.waits and not self.settled:
            node = len(self.parent)
            self.parent.append(node)
            self.moments.append(FOREVER)
            self.moment_nodes.append(node)
            nodes.append(node)
            self.settled = True
        for node in nodes[1:]:
            self.parent[node] = nodes[0]
        self.live, self.waiting, self.first_waiting = {0: nodes[0]}, [], 0

    def _join(self, states: dict[int, int], code: int, node: int) -> None:
        if code in states:
            self.parent[node] = states[code]
        else:
            states[code] = node

    def _root(self, node: int) -> int:
        while self.parent[node] != node:
            self.parent[node] = self.parent[self.parent[node]]
            node = self.parent[node]
        return node

    def feed(self, ts: int, flag: int) -> None:
        m = self.machine
        if flag == RESET or (self.last is not None and m.forgets(self.last, ts)):
            self._forget()
        if flag == RESET:
            self.first = ts if self.first is None else self.first
            self.last = ts
            return
        if self.waits and not self.settled and (self.first is None or (ts > self.last and self.last < self.first + m.wait_us)):
            node = len(self.parent)
            self.parent.append(node)
            self.moments.append(ts)
            self.moment_nodes.append(node)
            self._join(self.live, m.wake, node)
        while self.first_waiting < len(self.waiting) and self.waiting[self.first_waiting][0] <= ts:
            self._join(self.live, m.wake, self.waiting[self.first_waiting][1])
            self.first_waiting += 1
        self.first = ts if self.first is None else self.first
        self.last = ts
        moved: dict[int, int] = {}
        opened = None
        for code, node in self.live.items():
            nxt = m.table[code][flag]
            if nxt != WAITING:
                self._join(moved, nxt, node)
            elif opened is None:
                opened = node
            else:
                self.parent[node] = opened
        if opened is not None:
            self.waiting.append((ts + m.wait_us, opened))
        self.live = moved

    def summary(self) -> dict:
        """Exit (code, until) per entry code, and per range of inherited wait ends."""
        ends = {node: (code, 0) for code, node in self.live.items()}
        ends.update({node: (WAITING, until) for until, node in self.waiting[self.first_waiting :]})
        exits = [ends[self._root(code)] for code in range(len(self.machine.table))]
        upto, after = [], []
        for moment, node in zip(self.moments, self.moment_nodes):
            end = ends[self._root(node)]
            if after and after[-1] == end:
                upto[-1] = moment
            else:
                upto.append(moment)
                after.append(end)
        return {
            "exit_code": [e[0] for e in exits],
            "exit_until": [e[1] for e in exits],
            "wake_upto": upto,
            "wake_code": [e[0] for e in after],
            "wake_until": [e[1] for e in after],
            "first_us": self.first,
            "last_us": self.last,
        }


SUMMARY_FIELDS = (
    "exit_code array<int>, exit_until array<long>, wake_upto array<long>, wake_code array<int>, wake_until array<long>, "
    "first_us long, last_us long"
)
#: What is known of a key between two pieces of its log: state, end of its wait, place of its last event.
STATE_FIELDS = "code int, until long, us long, id long"


def _summaries(hot: DataFrame, keys: Sequence[str], machine: Machine) -> DataFrame:
    names = [*keys, "_slice"]
    fields = [hot.schema[c] for c in names]
    extra = T.StructType.fromDDL(SUMMARY_FIELDS).fields

    def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, current = None, None
        for frame in frames:
            done = []
            for ident, ts, flag in zip(zip(*[frame[c] for c in names]), frame["_us"], frame["_flag"]):
                if ident != group:
                    if current is not None:
                        done.append({**dict(zip(names, group)), **current.summary()})
                    group, current = ident, SliceTrace(machine)
                current.feed(int(ts), int(flag))
            yield pd.DataFrame(done, columns=[*names, *[f.name for f in extra]])
        if current is not None:
            yield pd.DataFrame([{**dict(zip(names, group)), **current.summary()}])

    ordered = hot.repartition(*names).sortWithinPartitions(*names, "_us", "event_id")
    return ordered.select(*names, "_us", "_flag").mapInPandas(trace, T.StructType([*fields, *extra]))


def _entries(summaries: DataFrame, keys: Sequence[str], machine: Machine) -> DataFrame:
    """Chain the summaries of each key: the state in which every slice is entered.

    ``_code``, ``_until`` and ``_last`` of a summary say how its key was left before this log.
    """
    names = [*keys, "_slice"]
    fields = [summaries.schema[c] for c in names]
    out = T.StructType([*fields, *T.StructType.fromDDL("_code int, _until long, _last long").fields])

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, code, until, last = None, 0, 0, NEVER
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                if key != [row[k] for k in keys]:  # keys are text here, so null equals null
                    key = [row[k] for k in keys]
                    code, until, last = int(row["_code"]), int(row["_until"]), int(row["_last"])
                if machine.forgets(last, int(row["first_us"])):
                    code, until = 0, 0
                rows.append((*[row[c] for c in names], code, until, last))
                last = int(row["last_us"])
                if code != WAITING:
                    code, until = int(row["exit_code"][code]), int(row["exit_until"][code])
                else:
                    for upto, c, u in zip(row["wake_upto"], row["wake_code"], row["wake_until"]):
                        if until <= upto:
                            code, until = int(c), int(u)
                            break
            yield pd.DataFrame(rows, columns=[*names, "_code", "_until", "_last"])

    return summaries.repartition(*keys).sortWithinPartitions(*names).mapInPandas(chain, out)


def flagged(events: DataFrame, flag: Column, keys: Sequence[str], reset: Column | None = None) -> DataFrame:
    """What a machine reads of an event: its key, place and flag."""
    value = F.coalesce(flag, F.lit(False)).cast("int")
    if reset is not None:
        value = F.when(F.coalesce(reset, F.lit(False)), F.lit(RESET)).otherwise(value)
    return events.select(*keys, "ts", "event_id", F.unix_micros("ts").alias("_us"), value.alias("_flag"))


def replay(
    events: DataFrame,
    machine: Machine,
    flag: Column,
    keys: Sequence[str] = ("key",),
    limit: int = ROWS_PER_SLICE,
    reset: Column | None = None,
) -> DataFrame:
    """(keys, ts, event_id, state_before, accepted, state_after) of every event.

    ``flag`` is the boolean column the machine reads (such as "this request failed"), ``reset`` marks
    events that take their key's machine back to its start.
    """
    return replay_from(flagged(events, flag, keys, reset), machine, keys, None, limit)


def _entered(start: DataFrame) -> DataFrame:
    """Nothing known: the start state."""
    return start.select(
        "*", F.lit(0).alias("_code"), F.lit(0).cast("long").alias("_until"), F.lit(NEVER).cast("long").alias("_last")
    )


def _with_entry(df: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    joined = join_on(df, known, on, "left")
    return joined.select(
        *df.columns,
        F.coalesce("_code", F.lit(0)).alias("_code"),
        F.coalesce("_until", F.lit(0).cast("long")).alias("_until"),
        F.coalesce("_last", F.lit(NEVER).cast("long")).alias("_last"),
    )


def replay_from(
    base: DataFrame, machine: Machine, keys: Sequence[str], before: DataFrame | None, limit: int = ROWS_PER_SLICE
) -> DataFrame:
    """Replay the ``flagged`` events from the states of ``before`` (keys and STATE_FIELDS), one row per key.

    Adds code_after and until_after, from which ``states_after`` takes the next states.
    """
    cut = keys_as_text(sliced(base, keys, ("_us", "event_id"), 0, limit).drop("_warmup"), keys)
    hot_keys = lookup_side(cut.where("_slice > 0").select(*keys).distinct())
    names = [*keys, "_slice"]
    left = None
    if before is not None:
        left = keys_as_text(before, keys).select(
            *keys, F.col("code").alias("_code"), F.col("until").alias("_until"), F.col("us").alias("_last")
        )
    entries = None
    if not hot_keys.isEmpty():
        traced = _summaries(join_on(cut, hot_keys, keys, "left_semi"), keys, machine)
        known = None if left is None else lookup_side(join_on(left, hot_keys, keys, "left_semi"))
        entries = lookup_side(_entries(_entered(traced) if known is None else _with_entry(traced, known, keys), keys, machine))
    if left is not None:
        cold = left if entries is None else join_on(left, hot_keys, keys, "left_anti")
        cold = cold.select(*keys, F.lit(0).cast("long").alias("_slice"), "_code", "_until", "_last")
        entries = cold if entries is None else entries.unionByName(cold)
    rows = _entered(cut) if entries is None else _with_entry(cut, entries, names)
    return keys_as_were(_walk(rows, keys, machine), keys, base)


def states_after(replayed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, code, until, us, id): how every key of a replayed log was left."""
    us = F.unix_micros("ts")
    state = F.struct("code_after", "until_after", us.alias("us"), F.col("event_id").alias("id"))
    last = replayed.groupBy(*keys).agg(F.max_by(state, F.struct(us, F.col("event_id"))).alias("s"))
    return last.select(*keys, F.col("s.code_after").alias("code"), F.col("s.until_after").alias("until"), "s.us", "s.id")


def _walk(rows: DataFrame, keys: Sequence[str], machine: Machine) -> DataFrame:
    names = [*keys, "_slice"]
    ordered = rows.repartition(*names).sortWithinPartitions(*names, "_us", "event_id")
    kept = [*keys, "ts", "event_id"]
    out = T.StructType(
        [
            *[rows.schema[c] for c in kept],
            T.StructField("state_before", T.StringType()),
            T.StructField("accepted", T.BooleanType()),
            T.StructField("state_after", T.StringType()),
            T.StructField("code_before", T.IntegerType()),
            T.StructField("flag", T.BooleanType()),
            T.StructField("reset", T.BooleanType()),
            T.StructField("code_after", T.IntegerType()),
            T.StructField("until_after", T.LongType()),
        ]
    )

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, code, until, last = None, 0, 0, NEVER
        for frame in frames:
            before, accepted, after, codes, codes_after, waits = [], [], [], [], [], []
            idents = zip(*[frame[c] for c in names])
            for ident, ts, flag, c0, u0, l0 in zip(idents, *[frame[c] for c in ("_us", "_flag", "_code", "_until", "_last")]):
                if ident != group:
                    group, code, until, last = ident, int(c0), int(u0), int(l0)
                before.append(machine.name(code))
                codes.append(code)
                ok, code, until = machine.advance(code, until, int(ts), int(flag), last)
                last = int(ts)
                accepted.append(ok)
                after.append(machine.name(code))
                codes_after.append(code)
                waits.append(until)
            result = frame[kept].copy()
            result["state_before"], result["accepted"] = before, accepted
            result["state_after"], result["code_before"] = after, codes
            result["flag"], result["reset"] = frame["_flag"] == 1, frame["_flag"] == RESET
            result["code_after"], result["until_after"] = codes_after, waits
            yield result

    return ordered.select(*names, "ts", "event_id", "_us", "_flag", "_code", "_until", "_last").mapInPandas(walk, out)
