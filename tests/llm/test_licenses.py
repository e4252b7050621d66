"""Edge cases of the license scan."""

from spanveil.llm import licenses

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "w " * 100_000 + MIT), (None, MIT), (4, "MIT License\nmit license"), (4, "MIT License\nmit license"), (4, "other"), (5, "is hereby permission granted " * 3)]
    docs = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], "doc_id int, text string, _id string, told int, template string, label string")
    got = licenses.scan_licenses(docs)
    found = {(r.doc_id, r.n_words): (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got.collect()}
    none, mit = (0, None, None, "", ""), (0, None, None, "", "mit")
    assert found == {(1, 0): none, (2, 0): none, (3, 100_029): mit, (None, 29): mit, (4, 4): (2, 0, 2, "mit", "mit"), (4, 1): none, (5, 12): none}
    assert got.count() == len(rows)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
