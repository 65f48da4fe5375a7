import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelmill.llm import chat

pieces = st.lists(st.one_of(st.sampled_from([*chat.CONTROL, "\\", " ", "<", "[", "/", "s>", "INST]", "<\\s>", "[\\\\INST]"]), st.text(max_size=4)), max_size=8).map("".join)
roles = st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), pieces)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(roles, pieces), max_size=5))
def test_any_conversation_reads_back(turns):
    made = [chat.render_turn(role, text) for role, text in turns]
    rendered = "".join(m[0] for m in made)
    back = list(chat.read_turns(rendered))
    assert [b[:2] for b in back] == turns
    for (role, text), (one, start, n) in zip(turns, made):
        assert chat.unescape(one[start:start + n]) == text


def test_clean_text_is_not_escaped():
    assert chat.render_turn("user", "a < b [x] </p>")[0] == "[INST] a < b [x] </p> [/INST]"
    assert chat.render_turn("assistant", "</s>")[0] == "<s> <\\/s></s>"


@pytest.mark.parametrize("broken", ["x", "[INST] a", "[INST] a [/SYS]", "<s>a</s>", "[INST] a<s> [/INST]", "[/INST]"])
def test_broken_text_is_refused(broken):
    with pytest.raises(chat.Unreadable):
        list(chat.read_turns(broken))


def digest(turns):
    every = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    said = "".join(t for r, t in turns if r == "assistant")
    return len(turns), every, len(said), hashlib.sha256(said.encode()).hexdigest()


def test_conversations_with_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", "hi", 5), (1, 1, "assistant", None, 5), (1, 1, "assistant", "</s>", 5), (2, None, None, "lost", 5), (2, 3, "tool", "[ROLE] x", 5),
            (None, 0, "user", "who", 5), (3, 0, "user", "same", 5), (3, 0, "user", "same", 5)]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i} " * 50, 5) for i in range(500)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered int")
    rendered = chat.render(turns)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(rendered).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        of = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want[conv] = digest([(r[2] or "", r[3] or "") for r in of])
    assert got == want
    whole = {}
    for r in chat.conversations(rendered, at_most=100).orderBy("part").collect():
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.formatted
        for span in r.loss_spans:
            assert r.formatted[span.start - 4:span.start] == "<s> " and r.formatted[span.start + span.chars:].startswith("</s>")
    assert {k: sum(1 for _ in chat.read_turns(v)) for k, v in whole.items()} == {k: v[0] for k, v in want.items()}
    assert chat.digests(chat.render(turns.filter("false"))).count() == 0
