"""Dates under every spelling, widths, values that can't be inverted, and long texts."""

import re
import time
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanveil.llm import pii

KEY = pii.derive_key("k")


def _new(text: str) -> str:
    return pii.pseudonymise(text, KEY)[0]


@settings(max_examples=300, deadline=None)
@given(st.dates(min_value=date(1900, 1, 1), max_value=date(2099, 12, 31)))
def test_a_date_is_linked_under_every_spelling(day):
    y, m, d = day.year, day.month, day.day
    spelled = {f"{y}-{m:02d}-{d:02d}": "ymd", f"{y}/{m:02d}/{d:02d}": "ymd", f"{d:02d}.{m:02d}.{y}": "dmy", f"{d}.{m}.{y}": "dmy", f"{m:02d}/{d:02d}/{y}": "mdy", f"{m}/{d}/{y}": "mdy"}
    if d > 12:
        spelled |= {f"{d:02d}/{m:02d}/{y}": "dmy", f"{d}/{m}/{y}": "dmy"}
    found = set()
    for text, order in spelled.items():
        new = _new(text)
        assert [len(x) for x in re.split(r"[-/.]", new)] == [len(x) for x in re.split(r"[-/.]", text)]
        parts = dict(zip(order, map(int, re.split(r"[-/.]", new)), strict=True))
        found.add((parts["y"], parts["m"], parts["d"]))
        assert pii.pseudonymise(new, KEY, inverse=True)[0] == text
    assert len(found) == 1


@pytest.mark.parametrize("check", ["00", "01", "99"])
def test_ibans_that_could_not_be_inverted_are_none(check):
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    body = next(b for i in range(10**5) if number((b := f"WEST{i:014d}") + "GB" + check) % 97 == 1)
    assert not [k for k in pii.pseudonymise(f"GB{check}{body}", KEY)[1] if k[0] == "iban"]


def test_addresses_side_by_side():
    found = [(s, e) for s, e, k in pii.find("a@b.com.x@y.org; @no.host z@ q@r.de") if k.name == "email"]
    assert found == [(0, 7), (7, 15), (29, 35)]


def test_long_texts_take_linear_time():
    start = time.process_time()
    for text in ("a" * 500_000 + "@", "a@" * 200_000, "@" + "a." * 200_000, "1" * 500_000, "1.1" * 200_000, "AA00 " * 100_000, "+1 " * 200_000, "12/" * 200_000):
        _new(text)
    assert time.process_time() - start < 20


def test_pseudonym_edges(spark):
    rows = [(1, None, "r"), (2, "", "r"), (3, "8.8.8.8 w", "r"), (3, "8.8.8.8 w", "r")]
    got = pii.pseudonyms(spark.createDataFrame(rows, "doc_id int, text string, row string"), "k").collect()
    assert sorted((r.row.doc_id, r.got.n_values) for r in got) == [(1, 0), (2, 0), (3, 1), (3, 1)] and len({r.got.text for r in got if r.row.doc_id == 3}) == 1
    assert pii.replace_text(spark.createDataFrame([], "doc_id int, text string, n_chars int"), "k").count() == 0
