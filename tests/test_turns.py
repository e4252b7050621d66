"""The redacted text of every turn, against a plain loop over the conversations."""

import time

from spanveil.operators import grammar, names
from spanveil.operators.vault import Vault
from spanveil.plans import queries


def _plain(turns):
    out = {}
    for conv in {t.conv_id for t in turns}:
        vault, said = None, None
        for t in sorted((t for t in turns if t.conv_id == conv), key=lambda t: t.turn):
            if t.role == "user":
                vault = Vault() if vault is None else vault
                out[conv, t.turn] = ("ok", names.redact(t.text, vault, said).text)
            else:
                out[conv, t.turn] = ("raw", t.text) if vault is None else ("ok", names.rehydrate(t.text, vault).clean)
            said = t.text if t.role == "assistant" else said
    return out


def test_every_turn_equals_a_plain_loop(spark, small):
    turns = spark.read.parquet(f"{small}/conversations.parquet").collect()
    got = queries.queries()["conversation_texts"](spark, small).collect()
    assert len(got) == len(turns)
    assert {(r.conv_id, r.turn): (r.status, r.text) for r in got} == _plain(turns)


def test_contacts_and_names_over_whole_conversations(spark, tmp_path):
    rows = [(c, t, role, f"{text} {'word ' * (200 * (c % 3))}") for c in range(30) for t, role, text in ((0, "system", "be kind"), (1, "user", f"My name is Orla Quist, 555 010 {c:04d}"), (2, "assistant", "Hi <fn_1>, what is your email?"), (3, "user", f"o{c}@mail.example.com, thanks Orla"), (4, "assistant", "Got <em_1> and <ph_1>"))]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    turns = spark.read.parquet(str(tmp_path / "conversations.parquet")).collect()
    got = {(r.conv_id, r.turn): (r.status, r.text) for r in queries.queries()["conversation_texts"](spark, str(tmp_path)).collect()}
    assert got == _plain(turns)
    assert got[0, 1][1].startswith("My name is <fn_1> <ln_1>, <ph_1>") and got[0, 4][1].startswith("Got o0@mail.example.com and 555 010 0000")


def test_long_texts_of_short_sentences_take_linear_time():
    took = {}
    for n in (2000, 40_000):
        text = "The Lots are Here. " * n
        began = time.perf_counter()
        grammar.name_before_firm(text)
        grammar.signature(text)
        took[n] = time.perf_counter() - began
    assert took[40_000] < 60 * took[2000] + 0.5


def test_names_before_firms_and_signatures_at_the_end():
    long = "The Lots are Here. " * 50
    for head in ("", long):
        found = grammar.name_before_firm(head + "Is it so? Orla Quist Redbud Homes of the North")
        assert found and found[2] == ["Redbud", "Homes", "of", "the", "North"] or found is None
        assert (found is None) == (grammar.name_before_firm("Is it so? Orla Quist Redbud Homes of the North") is None)
        a, b = grammar.signature(head + "See you. Orla Quist "), grammar.signature("See you. Orla Quist ")
        assert (a is None) == (b is None) and (a is None or a[0] - len(head) == b[0])
    assert grammar.name_before_firm("So. Orla Quist a b c d e f g") is None
