import pytest

from spanveil.operators.vault import Vault


def test_reuse_profiles_and_replacement():
    v = Vault()
    assert [v.assign("fn", x) for x in ("Orla", "Tam", "orla ")] == ["<fn_1>", "<fn_2>", "<fn_1>"]
    assert v.next_profile() == 2 and v.assign("fn", "Jem") == "<fn_3>"
    assert v.of_profile(2) == {"fn": "<fn_2>"} and v.token_of("fn", 3) == "<fn_3>" and v.token_of("ln") is None
    assert v.assign("ln", "Frew") == v.assign("ln", "Free", replace_latest=True) == "<ln_1>"
    assert v.values["<ln_1>"] == "Free"


@pytest.mark.parametrize("entity, value", [("zz", "x"), ("fn", "")])
def test_bad_assignments(entity, value):
    with pytest.raises(ValueError):
        Vault().assign(entity, value)


def test_recovery_from_old_snapshots():
    by_number = {"token_to_value": {"<fn_1>": "Orla", "<fn_2>": "Tam"}, "profile_entity_to_token": {"2": {"fn": "<fn_2>"}, "1": {"fn": "<fn_1>"}}}
    v = Vault.restore(by_number)
    assert v.latest("fn") == "<fn_2>" and v.counters == {"fn": 2} and v.assign("fn", "tam") == "<fn_2>"
    w = Vault.restore({"token_to_value": {"<em_3>": "o@mail.example.com", "odd": "x"}, "entity_counters": {"zz": 1, "em": "x"}})
    assert w.assign("em", "p@mail.example.com") == "<em_4>"
    w.clear()
    assert w.snapshot()["token_to_value"] == {}
