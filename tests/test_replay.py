"""The slice summaries of the state machines, in plain Python."""

import random
from dataclasses import replace

import pytest

from textvane.config import RecoveryPolicy
from textvane.operators.recovery import batch_sizes_after, breaker_machine, cooldown_machine, spike_machine
from textvane.operators.replay import NEVER, RESET, WAITING, SliceTrace

MACHINES = {
    "breaker": breaker_machine(RecoveryPolicy(failure_threshold=3, recovery_timeout_sec=7e-6)),
    "strict": breaker_machine(RecoveryPolicy(failure_threshold=2, recovery_timeout_sec=20e-6), strict=True),
    "sticky": breaker_machine(RecoveryPolicy(failure_threshold=3, recovery_timeout_sec=0.0), "sticky"),
    "spikes": spike_machine(5),
    "cooldown": cooldown_machine(9e-6),
}


def follow(machine, code, until, events):
    for ts, flag in events:
        _, code, until = machine.advance(code, until, ts, flag)
    return (code, until if code == WAITING else 0)


@pytest.mark.parametrize("name", MACHINES)
def test_summary_equals_replay_from_every_entry(name):
    machine, rng = MACHINES[name], random.Random(3)
    for _ in range(60):
        ts, events = 100, []
        for _ in range(rng.randrange(1, 25)):
            ts += rng.choice([0, 1, 1, 3, 10])
            events.append((ts, rng.randrange(2)))
        trace = SliceTrace(machine)
        for event in events:
            trace.feed(*event)
        s = trace.summary()
        for code in range(len(machine.table)):
            assert (s["exit_code"][code], s["exit_until"][code]) == follow(machine, code, 0, events)
        if any(WAITING in row for row in machine.table):
            for until in range(80, events[0][0] + machine.wait_us + 1):
                inherited = follow(machine, WAITING, until, events)
                got = (WAITING, until)
                for upto, code, end in zip(s["wake_upto"], s["wake_code"], s["wake_until"]):
                    if until <= upto:
                        got = (code, end)
                        break
                assert got == inherited


@pytest.mark.parametrize("name", MACHINES)
def test_summaries_with_resets_and_idle_times(name):
    machine, rng = replace(MACHINES[name], idle_us=6), random.Random(4)

    def walk(code, until, events):
        last = NEVER
        for ts, flag in events:
            _, code, until = machine.advance(code, until, ts, flag, last)
            last = ts
        return (code, until if code == WAITING else 0)

    for _ in range(80):
        ts, events = 100, []
        for _ in range(rng.randrange(1, 20)):
            ts += rng.choice([0, 1, 1, 3, 7])
            events.append((ts, rng.choice([0, 0, 1, 1, 1, RESET])))
        trace = SliceTrace(machine)
        for event in events:
            trace.feed(*event)
        s = trace.summary()
        for code in range(len(machine.table)):
            assert (s["exit_code"][code], s["exit_until"][code]) == walk(code, 0, events)
        if any(WAITING in row for row in machine.table):
            for until in range(80, events[0][0] + machine.wait_us + 1):
                got = (WAITING, until)
                for upto, code, end in zip(s["wake_upto"], s["wake_code"], s["wake_until"]):
                    if until <= upto:
                        got = (code, end)
                        break
                assert got == walk(WAITING, until, events)


def test_half_open_rules():
    policy = RecoveryPolicy(failure_threshold=5, recovery_timeout_sec=1e-6)
    for strict, expected in ((False, "half_open"), (True, "open")):
        machine = breaker_machine(policy, strict=strict)
        code, until = 0, 0
        for ts, bad in [(i, 1) for i in range(5)] + [(10, 0), (11, 1)]:
            ok, code, until = machine.advance(code, until, ts, bad)
        assert ok and machine.name(code) == expected


@pytest.mark.parametrize("threshold", [1, 3, 5, 10])
def test_opens_exactly_at_the_threshold(threshold):
    machine = breaker_machine(RecoveryPolicy(failure_threshold=threshold))
    code, until, states = 0, 0, []
    for i in range(threshold):
        _, code, until = machine.advance(code, until, i, 1)
        states.append(machine.name(code))
    assert states[-1] == "open" and "open" not in states[:-1]


def test_sizes_shrink_to_the_floor():
    assert batch_sizes_after() == [32, 16, 8, 4, 2, 1]
