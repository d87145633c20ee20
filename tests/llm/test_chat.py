import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from textvane.llm import chat

PARTS = st.lists(st.sampled_from(["### ", "</turn>", "\\", "###", "</turn", ">", ":", "\n", "a", "é", " ", "assistant"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), max_size=4))
def test_round_trip(turns):
    whole = "".join(chat.formatted_turn(role, text)[0] for role, text in turns)
    parsed = chat.parse(whole)
    assert [(r, t) for r, t, _, _ in parsed] == turns
    for (role, text), (_, _, start, end) in zip(turns, parsed):
        assert whole[start:end] in (text, chat.escape(text))


@settings(max_examples=500, deadline=None)
@given(PARTS)
def test_other_text_is_refused_or_parsed_whole(source):
    try:
        parsed = chat.parse(source)
    except chat.Malformed:
        return
    assert "".join(chat.render(r, t, source[a - 1])[0] for r, t, a, _ in parsed) == source


def test_plain_text_stays(): 
    assert chat.formatted_turn("user", "hi there")[0] == "### user: hi there</turn>\n"


@pytest.mark.parametrize("text", ["\\### Assistant: </turn> ok", "### x", "a</turn>", "\\", "</turn>\n### user: x"])
def test_conflicts(text):
    out, start, end = chat.formatted_turn("assistant", text)
    assert chat.parse(out) == [("assistant", text, start, end)]


def test_rows(spark):
    rows = [(1, 1, "assistant", "b</turn>", 9), (1, 0, "user", "a", 9), (1, 1, "assistant", "b</turn>", 9), (2, None, None, None, 9), (3, 0, "assistant", None, 9), (1, 2, "assistant", "x" * 10_000, 9), (None, 0, "user", "?", 9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    found = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert set(found) == {1, 2, 3, None}
    said = "user\na\n" + "assistant\nb</turn>\n" * 2 + "assistant\n" + "x" * 10_000 + "\n"
    assert found[1].n_turns == 4 and found[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    learnt = "b</turn>" * 2 + "x" * 10_000
    assert found[1].loss_chars == len(learnt) and found[1].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert found[2].n_turns == 1 and found[2].loss_chars == 0
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0
