"""Many automata against one and a plain version, with one pass at a time; edge cases."""

from spanveil.llm import decontamination

from . import brute

ITEMS = [("a", "one two three four five six seven eight nine ten eleven twelve"), ("b", "Seven eight, nine TEN"), (None, "no id at all"), ("c", "..."), ("d", None), ("b", "uno dos")]
TEXTS = [None, "", "uno dos", "x one two three four five six seven eight nine ten eleven y", "seven eight nine ten no id at all", "k " * 50_000 + "uno dos", "uno dos"]


def _tables(spark):
    docs = spark.createDataFrame([(i, t, "r", "g", "c") for i, t in enumerate(TEXTS)], "doc_id int, text string, row string, got string, clean string")
    return docs.unionByName(docs.where("doc_id = 2")), spark.createDataFrame(ITEMS, "item_id string, text string")


def test_many_automata_equal_one(spark):
    docs, items = _tables(spark)
    want = sorted((i, *brute.benchmark_hits(t, ITEMS)) for i, t in [*enumerate(TEXTS), (2, TEXTS[2])])
    for max_words in (1, 12, 100_000):
        found = decontamination.find_benchmark_spans(docs, items, max_words=max_words)
        assert sorted((r.row.doc_id, r.got.n_words, r.got.n_hit, list(r.got["items"])) for r in found.collect()) == want
        kept = decontamination.decontaminate(docs, items)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 5]
    assert len(list(decontamination.automata(items, max_words=1))) == 4


def test_passes_are_apart(spark):
    """No stage runs more than one automaton."""
    docs, items = _tables(spark)
    found = decontamination.find_benchmark_spans(docs, items, max_words=1)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_empty_tables(spark):
    docs, items = _tables(spark)
    assert decontamination.decontaminate(docs.limit(0), items).count() == 0
    assert {r.got.n_hit for r in decontamination.find_benchmark_spans(docs, items.limit(0)).collect()} == {0}
