"""Walkers over words against small patterns that say the same, and rules that once had no case."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanveil.operators import grammar, names
from spanveil.operators.vault import Vault

PIECES = st.lists(st.sampled_from(["Orla", "Mary-Ann", "O'Quist", "é", "H", "H.", " ", "  ", "\n", ",", ".", "-", "(", ")", "2", "_", "my name is", "this is", "from", "ok", "&", "and", "name", ":", "surname is"]), max_size=9).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_walkers_equal_patterns(text):
    m = re.match(r"\s*(ok)(?!\w)", text)
    assert (grammar.acknowledgement(text) is None) or m
    capitals = re.fullmatch(r"\s*[A-Z][A-Za-z'-]*(\s+[A-Z][A-Za-z'-]*){0,4}[.!?]?\s*", text) is not None
    assert grammar.all_capitalised(text) == capitals
    pairs = [m.span(1) + m.span(2) for m in re.finditer(r"\bthis\s+is\s+([A-Za-z][A-Za-z'-]*)\s+([A-Za-z][A-Za-z'-]*)\s+from\b", text)]
    assert [(*a, *b) for a, b in grammar.this_is_from(text)] == pairs
    shared = [m.span() for m in re.finditer(r"\b[A-Z][A-Za-z'-]*\s+(?:and|&)\s+[A-Za-z][A-Za-z'-]*\s+[A-Z][A-Za-z'-]*\b", text)]
    assert list(grammar.shared_last_name(text)) == shared
    told = re.search(r"\bsurname\s+is\s+([^\W\d_]+(?:['-][^\W\d_]+)*)\b", text)
    assert grammar.told_last_name(text) == (told and told.span(1))


@settings(max_examples=200, deadline=None)
@given(PIECES)
def test_places_are_in_the_text(text):
    places = [p for _, p in grammar.introduced(text)] + [p for _, ps in grammar.keyed_names(text) for p in ps] + [p for _, _, p in grammar.labelled_name(text)]
    places += [p for found in (grammar.two_agents(text), (grammar.alias(text) or ((), (), 0))[:2]) for p in found or () if p]
    assert all(0 <= s < e <= len(text) and text[s:e].strip() == text[s:e] for s, e in places)


@pytest.mark.parametrize(
    "text, previous, expected",
    [
        ("The number is 5550102003 (Bea)", None, "The number is <ph_1> (<fn_1>)"),  # a word in brackets beside a contact
        ("5550102003 (Texas)", None, "<ph_1> (Texas)"),
        ("Do you pay us? Bea Penrose c21", None, "Do you pay us? <fn_1> <ln_1> c21"),  # a name before a firm
        ("Do you pay us? Bea Penrose next week", None, "Do you pay us? Bea Penrose next week"),
        ("Sure, Bea Penrose 5550102003", None, "Sure, <fn_1> <ln_1> <ph_1>"),  # yes, two names and a contact
        ("Sure, my email 5550102003", None, "Sure, my email <ph_1>"),
    ],
)
def test_rules_beside_contacts_and_firms(text, previous, expected):
    assert names.redact(text, Vault(), previous).text == expected


@pytest.mark.parametrize("text, taken", [("Penrosee", True), ("Bea Penrosee", True), ("Bea Penrosee, bp@post.example.org", False), ("Lorne", False), ("Cleo Penrosee", False)])
def test_a_last_name_is_corrected(text, taken):
    """Not where a contact follows: the rule for two names before a contact comes first and gives a new number."""
    vault = Vault()
    names.redact("Bea Penrose", vault, "What is your full name?")
    names.redact(text, vault, "E-mail or phone?")
    assert (vault.values["<ln_1>"] == "Penrosee") == taken


@pytest.mark.parametrize(
    "given_, tokens",
    [
        ({"token_to_value": {"<fn_2>": "B", "<fn_1>": "A"}, "entity_to_tokens": {"fn": ["<fn_2>", "<fn_1>"], "zz": ["<zz_1>"], "ln": "no list"}}, {"fn": ["<fn_2>", "<fn_1>"]}),
        ({"token_to_value": {"<fn_10>": "B", "<fn_9>": "A"}, "profile_entity_to_token": {"10": {"fn": "<fn_10>"}, "9": {"fn": "<fn_9>"}, "1": 3}}, {"fn": ["<fn_9>", "<fn_10>"]}),
        ({"token_to_value": {"<fn_10>": "B", "<fn_9>": "A", "odd": "C"}}, {"fn": ["<fn_9>", "<fn_10>"]}),
        ({"token_to_value": 5, "entity_counters": {"fn": "x"}}, {}),
    ],
)
def test_snapshots_of_any_shape(given_, tokens):
    vault = Vault.restore(given_)
    assert vault.tokens == tokens and vault.counters == {e: max(int(t[4:-1]) for t in ts) for e, ts in tokens.items()}
