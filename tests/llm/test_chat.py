import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trafficlens.llm import chat

BITS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/TURN]", "\\", "<", "[", "/s>", "a", "\n", ""]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "<s>"]), BITS), max_size=5))
def test_round_trip_of_conversations(turns):
    rendered = "".join(chat.format_turn(role, text)[0] for role, text in turns)
    assert [(t.role, t.text) for t in chat.parse(rendered)] == turns


def test_only_conflicts_are_escaped():
    assert chat.format_turn("user", "plain [text] <b>")[0] == "[INST]plain [text] <b>[/INST]"
    assert chat.format_turn("user", "</s>")[0] == "[INST]\\</s>[/INST]"


@pytest.mark.parametrize("text", ["[INST]a", "a", "<s>a[INST]b</s>", "<s>a\\"])
def test_other_texts_are_refused(text):
    with pytest.raises(ValueError):
        chat.parse(text)


def test_query(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "assistant", "é<s>"), (2, 0, None, None), (None, 0, "user", "n"), (None, None, "tool", "m"),
            (3, 0, "user", "x"), (3, 0, "user", "x"), (4, 0, "assistant", "y" * 100_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", chat.F.lit(7))
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.with_probe(table))).collect()}
    expected = {}
    for conv_id, turn, role, text in [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        expected.setdefault(conv_id, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert out.keys() == expected.keys()
    for conv_id, turns in expected.items():
        turns.sort()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        row = out[conv_id]
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert row.formatted_chars == sum(len(chat.format_turn(r, t)[0]) for _, r, t in turns)
    assert chat.read_back(chat.format_turns(table.limit(0))).count() == 0
