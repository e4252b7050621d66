"""Chat formatting against templates whose layout is known, and exact round trips."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanveil.llm import chat_format as cf

PIECES = ["</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<<SYS>>", "<</SYS>>", "<s>", "\\", "<", "[", "/s>", "|im_end|>", "INST]", "<\\/s>", "[\\\\INST]", "\n", "é", "a b", "\U0001f600", ""]
TEXT = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb", "r\\n", "<s>", ""]), TEXT), max_size=6)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_escaping_is_undone_and_leaves_no_control(text):
    put = cf.MARKED.escape.put(text)
    assert cf.MARKED.escape.undo(put) == text
    assert not any(c in put for c in cf.CONTROLS)


@settings(max_examples=200, deadline=None)
@given(TURNS)
def test_outputs_are_read_back(turns):
    found = cf.locate(turns, cf.MARKED)
    assert found.rewritten_at is None and cf.MARKED.read(found.text) == turns
    assert [cf.MARKED.escape.undo(found.text[a:b]) for _, _, a, b in found.spans] == [t for _, t in turns]
    assert [s[:2] for s in found.spans] == list(zip([0, *(s[1] for s in found.spans)], [s[1] for s in found.spans], strict=False))


def closed(turns):
    return "<s>" + "".join(f"<{r}>{t}</{r}>" for r, t in turns) + "<bot>"


def inst(turns):
    if not turns:
        raise ValueError("no turns")
    return "".join(f"[INST] {t} [/INST]" if r == "user" else f" {t} </s>" for r, t in turns)


def only_last_thoughts(turns):
    return "".join(f"{r}: {t if i == len(turns) - 1 else t.split('|')[-1]}\n" for i, (r, t) in enumerate(turns))


def silent_system(turns):
    return "".join(f"{r}: {t}\n" for r, t in turns if r != "system")


@pytest.mark.parametrize("render", [cf.MARKED, closed, inst])
def test_any_template_is_located(render):
    turns = [("user", "hi"), ("assistant", "<"), ("user", ""), ("assistant", "a </s> b"), ("assistant", "same"), ("assistant", "same"), ("user", "]")]
    found = cf.locate(turns, render)
    assert found.rewritten_at is None and found.text == render(turns)
    assert [found.text[a:b] for _, _, a, b in found.spans] == [cf.MARKED.escape.put(t) if render is cf.MARKED else t for _, t in turns]
    assert all(found.spans[k][1] == found.spans[k + 1][0] for k in range(len(turns) - 1))


def test_rewritten_history_is_told():
    turns = [("user", "q"), ("assistant", "thought|answer"), ("user", "more"), ("assistant", "x|y")]
    found = cf.locate(turns, only_last_thoughts)
    assert (found.rewritten_at, found.spans, found.text) == (2, [], only_last_thoughts(turns))
    assert cf.locate(turns[:2], only_last_thoughts).rewritten_at is None


def test_turns_that_a_template_leaves_out():
    found = cf.locate([("system", "be kind"), ("user", "q")], silent_system)
    assert found.rewritten_at is None and found.spans == [(0, 0, 0, 0), (0, 8, 6, 7)]


@pytest.mark.parametrize("render", [cf.MARKED, closed, only_last_thoughts])
def test_windows_equal_prefixes(render):
    turns = [("user" if k % 2 else "assistant", f"t|{k % 5}" * (k % 3)) for k in range(50)]
    for window in (1, 3, 8):
        assert cf.locate(turns, render, window) == cf._by_prefixes(turns, render)


def test_rewriting_far_from_its_cause_is_told():
    def first_counts(turns):  # the first turn holds the number of tens of turns
        return "".join(f"{r}{len(turns) // 10 if i == 0 else ''}: {t}\n" for i, (r, t) in enumerate(turns))

    turns = [("user", str(k)) for k in range(30)]
    assert cf.locate(turns, first_counts, 4).rewritten_at == cf._by_prefixes(turns, first_counts).rewritten_at == 9


def test_long_conversations_take_linear_time():
    calls = []

    def counted(turns):
        calls.append(len(turns))
        return cf.MARKED(turns)

    turns = [("user", "a"), ("assistant", "b")] * 2000
    found = cf.locate(turns, counted)
    assert len(found.spans) == 4000 and sum(calls) < 4000 * 3 * 2 * cf.WINDOW + 5000


def test_overlapping_controls_are_refused():
    for controls in (("<a", "<<a"), ("<", "[x"), ("<\\a",), ("ab", "ba")):
        with pytest.raises(ValueError):
            cf.Escape(controls)


SCHEMA = "conv_id bigint, turn bigint, role string, text string, spans string, formatted string, n_turns int"


def test_conversations_on_odd_rows(spark):
    rows = [(1, 2, "assistant", "two"), (1, 1, "user", None), (1, None, None, "first"), (1, 2, "assistant", "two"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (2, 0, "user", "z" * 300_000), (2, 1, "assistant", "</s>")]
    df = spark.createDataFrame([(*r, "s", "f", 0) for r in rows], SCHEMA)
    made = cf.format_chats(df)
    got = {r.conv_id: r for r in cf.read_back(made).collect()}
    assert {k: [(t.role, t.text) for t in r.turns] for k, r in got.items()} == {
        1: [("", "first"), ("user", ""), ("assistant", "two"), ("assistant", "two")],
        None: [("user", "x"), ("assistant", "y")],
        2: [("user", "z" * 300_000), ("assistant", "</s>")],
    }
    assert {k: r.loss for k, r in got.items()} == {1: "twotwo", None: "y", 2: "</s>"}
    assert all(r.rewritten_at is None and r.n_turns == len(r.spans) for r in made.collect())
    assert cf.format_chats(df.where("false")).count() == 0 and cf.read_back(cf.format_chats(df.where("false"))).count() == 0


def test_a_rewriting_template_has_no_mask(spark):
    df = spark.createDataFrame([(1, i, r, t, "", "", 0) for i, (r, t) in enumerate([("user", "q"), ("assistant", "a|b"), ("user", "c")])], SCHEMA)
    row = cf.format_chats(df, only_last_thoughts).collect()[0]
    assert (row.rewritten_at, row.spans, row.formatted) == (2, None, "user: q\nassistant: b\nuser: c\n")
