"""Contacts in native columns against the plain detectors, and in time."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spanveil import lexicon as lx
from spanveil.functions import spans, text
from spanveil.operators import tokens

MAIL, PHONE = re.compile(lx.EMAIL, re.IGNORECASE), re.compile(lx.PHONE)

#: Spaces, digits, marks and letters of several scripts, and what contacts are made of.
ALPHABET = ["555", "010", "2003", "1", "5", "٥٥٥", "٠١٠", "٢٠٠٣", "५५५", " ", " ", " ", " ", "　", "\x1c", "\x1f", "\x85", "​", "\n", "-", ".", "+", "(", ")", "(555)", "@", "a@b.co", "ſ@K.ıo", "x", "é", "é", "²", "Ⅷ", "_", "中", "\U0001f600", "\U0001d7d3" * 3, "co", ".org", "%", "555 010 2003", "tel:"]


def _plain(t):
    found = [(m.start(), m.end(), e) for p, e in ((MAIL, "em"), (PHONE, "ph")) for m in p.finditer(t)]
    out, at = [], 0
    for s, e, kind in sorted(found, key=lambda x: (x[0], x[0] - x[1])):
        if s >= at:
            out.append((s, e, kind, t[s:e]))
            at = e
    return out


def _texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(14))) for _ in range(n)]


def test_native_contacts_equal_the_detectors(spark):
    odd = ["call 555 010 2003 now", "call ٥٥٥٠١٠٢٠٠٣ now", "a@b.co 555 010　2003", "555\x1c010\x1f2003", "é5550102003", "²5550102003", "é5550102003", "5550102003́"]
    texts = odd + _texts(6000, 7)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4).select("i", spans.contact_spans(F.col("t")).alias("s")).collect()
    got = {r.i: [tuple(s) for s in r.s] for r in rows}
    assert [i for i, t in enumerate(texts) if got[i] != _plain(t)] == []
    assert all(len(got[i]) == (2 if "@" in odd[i] else 1) for i in range(4)) and sum(map(len, got.values())) > 500


def test_the_filter_drops_no_number(spark):
    texts = _texts(6000, 11)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    lost = rows.where(F.col("t").rlike(text.PHONE) & ~F.col("t").rlike(text.PHONE_END))
    assert lost.count() == 0 and rows.where(F.col("t").rlike(text.PHONE)).count() > 300


def _resolved(own):
    out, at = [], 0
    for i, (s, e, kind, _) in sorted(enumerate(own), key=lambda x: (x[1][0], x[1][2] == "name", x[1][0] - x[1][1], x[0])):
        if s >= at:
            out.append(own[i])
            at = e
    return out


def test_resolution_equals_a_plain_scan(spark):
    r = random.Random(3)
    cases = []
    for k in range(1500):
        wide = r.choice([5, 40, 200])
        cases.append((k, [(s := r.randrange(-2, wide), s + r.randrange(0, 12), r.choice(["em", "ph", "name"]), str(j)) for j in range(r.randrange(30))]))
    df = spark.createDataFrame(cases, f"k int, s {spans.SPANS}").repartition(4)
    got = {row.k: [tuple(s) for s in row.s] for row in df.select("k", spans.resolve(F.col("s")).alias("s")).collect()}
    assert all(got[k] == _resolved(own) for k, own in cases)


def test_splicing_over_pieces(spark):
    n = spans.PIECE
    whole = "".join(chr(97 + i % 26) if i % 7 else "\U0001f600" for i in range(3 * n + 5))
    cases = [[], [(0, 1)], [(0, len(whole))], [(n - 1, n)], [(n, n + 1)], [(n - 2, n + 2), (n + 2, 2 * n)], [(5, 9), (9, 9), (2 * n, 3 * n + 1), (3 * n + 4, 3 * n + 5)]]
    rows = [(i, whole if i else "", [(s, e, f"<{s}>") for s, e in c]) for i, c in enumerate(cases)]
    got = spark.createDataFrame(rows, "i int, t string, p array<struct<start:int,end:int,token:string>>").select("i", spans.splice(F.col("t"), F.col("p")).alias("x")).collect()

    def plain(t, pieces):
        out, at = "", 0
        for s, e, token in pieces:
            out, at = out + t[at:s] + token, e
        return out + t[at:]

    assert {r.i: r.x for r in got} == {i: plain(t, p) for i, t, p in rows}


@pytest.mark.parametrize("unit", ["é ab{}@mail.example.com, ", "+1 555 010 {:04d}; "])
def test_a_text_of_many_contacts_takes_nearly_linear_time(spark, unit):
    took = {}
    for n in (500, 10_000, 100_000):
        t = "".join(unit.format(i % 10_000) for i in range(n))
        df = spark.createDataFrame([("s", 1, t)], "scope string, seq int, t string")
        began = time.perf_counter()
        row = df.select(F.size(spans.contact_spans(F.col("t"))).alias("n")).first()
        took[n] = time.perf_counter() - began
        assert row.n == n
    assert took[100_000] < 25 * took[10_000] + 3


def test_a_text_of_many_contacts_is_redacted(spark):
    n = 20_000
    t = "".join(f"to u{i}@mail.example.com " for i in range(n))
    began = time.perf_counter()
    got = tokens.redact_contacts(spark.createDataFrame([("s", 1, t)], "scope string, seq int, t string"), "scope", "seq", "t").first()
    assert got.n == n and got.redacted == "".join(f"to <em_{i + 1}> " for i in range(n)) and time.perf_counter() - began < 60
