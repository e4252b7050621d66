"""Selectors over VARIANT nodes against the plain walk."""

import json
import random

import pytest

from spanveil.operators import allowlist, selectors

CHOICES = [[("$", "both")], [("**.name", "values")], [("plans[1].name", "both"), ("city", "keys")], [("plans[*].tags", "values")], [("**[0]", "both")], [("*.*", "keys"), ("**", "values")], [("['a b'].x", "both")], [("gone", "both")]]


def _payload(r, depth):
    if depth == 0 or r.random() < 0.25:
        return r.choice(["a", "", "é b", 1, 2.5, True, None, "name"])
    if r.random() < 0.4:
        return [_payload(r, depth - 1) for _ in range(r.randrange(4))]
    return {k: _payload(r, depth - 1) for k in r.sample(["name", "plans", "tags", "city", "a b", "x", "$"], r.randrange(5))}


@pytest.mark.parametrize("wanted", CHOICES, ids=str)
def test_terms_equal_the_walk(spark, wanted):
    r = random.Random(8)
    payloads = [json.dumps(_payload(r, 5)) for _ in range(60)] + [None, "", "[1", "null", '"s"', "3", json.dumps({"plans": [{"name": "u"}, {"name": "v", "tags": ["w"]}], "city": {"q": 1}})]
    rows = spark.createDataFrame(list(enumerate(payloads)), "i int, p string").repartition(3)
    got = selectors.term_rows(rows.selectExpr("i as row", "p as node"), ["row"], "node", wanted)
    want = {(i, t) for i, p in enumerate(payloads) for t in _plain(p, wanted)}
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()


def _plain(p, wanted):
    try:
        return allowlist.collect_terms(json.loads(p), wanted) if p else []
    except ValueError:
        return []


def test_deep_payloads_are_walked_to_the_end(spark):
    deep = "x"
    for k in range(60):
        deep = {f"k{k}": deep} if k % 2 else [deep]
    got = selectors.term_rows(spark.createDataFrame([(1, json.dumps(deep))], "i int, p string"), ["i"], "p", [("$", "both")]).collect()
    assert {x.term for x in got} == {"x", *(f"k{k}" for k in range(1, 60, 2))}


def test_no_selectors_no_rows_and_bad_ones(spark):
    rows = spark.createDataFrame([(1, '{"a": "b"}')], "i int, p string")
    assert selectors.term_rows(rows, ["i"], "p", []).count() == 0
    assert selectors.term_rows(rows.where("false"), ["i"], "p", [("**", "both")]).count() == 0
    for bad in ([("", "both")], [("$", "all")]):
        with pytest.raises(ValueError):
            selectors.term_rows(rows, ["i"], "p", bad)
