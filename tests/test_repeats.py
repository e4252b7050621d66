"""Repeated values by the index against a pattern a value, and in time."""

import random
import re
import time
from re import _casefix

from spanveil import lexicon as lx
from spanveil.operators import names, repeats
from spanveil.operators.vault import TOKEN, Vault


def _plain(case, hide_names):
    for token, stored in sorted(case.vault.values.items(), key=lambda kv: -len(kv[1])):
        entity, value = TOKEN.fullmatch(token)["entity"], stored.strip()
        if not value:
            continue
        patterns = [names._phone_pattern(value) if entity == "ph" else re.escape(value)]
        if entity in lx.NAME_ENTITIES:
            patterns = [] if hide_names else [rf"(?<![A-Za-z]){re.escape(v)}(?![A-Za-z])" for v in names.name_variants(value) if names._repeatable(v, case.terms)]
        for p in patterns:
            for hit in re.finditer(p, case.text, 0 if entity == "ph" else re.IGNORECASE):
                yield names.Span(*hit.span(), entity, hit[0])


def _case(text, vault, terms=()):
    return names.Case(names.Reading(text), names.Prompt(), frozenset(terms), vault)


SYLLABLES = ["Or", "la", "Vey", "Qu", "ist", "Anna", "Ann", "na", "Straße", "ß", "İl", "ı", "Kay", "K", "ſ", "Ωm", "µ", "é", "中", "De Soto", " ", "  ", "-", "'"]


def _value(r, entity):
    if entity == "ph":
        return r.choice(["{}-{}-{}", "({}) {} {}", "+1 {}{}{}", "{}.{}.{}", "٥{}{}{}"]).format(r.randrange(555, 558), f"{r.randrange(3):03}", f"{r.randrange(9):04}")[: r.choice([30, 30, 9])]
    if entity == "em":
        return f"{r.choice('abK')}{r.randrange(5)}@{r.choice(['x.co', 'mail.org'])}"
    return "".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 4)))


def _text(r, vault):
    parts = []
    for _ in range(r.randrange(12)):
        stored = r.choice(list(vault.values.values()) or ["x"])
        parts.append(r.choice([stored, stored.upper(), stored.lower(), "".join(stored.split()), repeats.digits(stored), r.choice(SYLLABLES), " and ", ", ", "1"]))
    return r.choice(["", " "]).join(parts)


def test_index_equals_a_pattern_a_value():
    hits = 0
    for seed in range(300):
        r = random.Random(seed)
        vault = Vault()
        for _ in range(40):
            for _ in range(r.randrange(4)):
                entity = r.choice(lx.ENTITIES)
                value = _value(r, entity)
                if value.strip():
                    vault.assign(entity, value, replace_latest=entity in lx.NAME_ENTITIES and r.random() < 0.2)
            if r.random() < 0.05:
                vault = Vault.restore(vault.snapshot()) if r.random() < 0.7 else vault
            if r.random() < 0.02:
                vault.clear()
            case = _case(_text(r, vault), vault, ["anna"])
            hide = r.random() < 0.1
            got, want = list(names.repeats(case, hide)), list(_plain(case, hide))
            assert got == want
            hits += len(got)
    assert hits > 5000


def test_folding_joins_all_that_patterns_join():
    same = lambda a, b: repeats.fold(chr(a)) == repeats.fold(chr(b))
    assert all(same(a, b) for a, more in _casefix._EXTRA_CASES.items() for b in more)
    assert all(same(c, ord(chr(c).lower())) for c in range(0x110000) if len(chr(c).lower()) == 1)


def test_time_does_not_grow_with_the_vault():
    text = " ".join(["we met and spoke of the garden, then"] * 20)
    took = {}
    for n in (500, 20_000):
        vault = Vault()
        for i in range(n):
            vault.assign("fn", f"Qx{i}zet")
            vault.assign("ph", f"555-{i // 10_000:03}-{i % 10_000:04}")
        case = _case(text + " Qx7zet 555 000 0007", vault)
        assert {s.value for s in names.repeats(case, False)} == {"Qx7zet", "555 000 0007"}
        began = time.perf_counter()
        for _ in range(50):
            list(names.repeats(case, False))
        took[n] = time.perf_counter() - began
    assert took[20_000] < 4 * took[500] + 0.05


def test_values_one_by_one_are_built_few_times():
    vault, built = Vault(), time.perf_counter()
    for i in range(5000):
        vault.assign("fn", f"Name{i}x")
        list(names.repeats(_case(f"so Name{i}x", vault), False))
    assert time.perf_counter() - built < 10
