"""Rows with repeated, textual or missing ids in the Jaccard join, and tables of few or very long texts."""

from spanveil.llm import jaccard


def test_rows_are_told_apart_by_id_and_text(spark):
    """Repeated ids with other texts are rows of their own, ids may be text, those without one stay, and any column name is left alone."""
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"x{i}" for i in range(40))
    rows = [("2", a, 1), ("1", a, 2), ("1", b, 3), ("1", b, 4), (None, a, 5), (None, "", 6), ("3", None, 7), ("3", None, 8), (None, "lone one", 9)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _id int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or "", r.text or "") for r in kept.collect())
    assert got == sorted([("1", a), ("1", b), ("", a), ("", ""), ("3", ""), ("3", ""), ("", "lone one")])
    parts = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.ngram_jaccard_components(docs).collect()}
    assert parts == {("2", 36): "1", ("1", 36): "1", (None, 36): None, (None, 0): None, ("3", 0): "3", (None, 1): None}


def test_components_of_nothing_and_of_very_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.ngram_jaccard_components(empty).count() == 0
    long = " ".join(f"w{i % 9973}x{i // 7}" for i in range(60_000))
    near = " ".join(long.split()[:59_000])
    rows = [(3, long), (1, near), (2, long.upper()), (4, "w0x0 w1x0"), (5, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), k=3, num=90, den=100).collect()}
    assert got == {3: (59_998, 1), 1: (58_998, 1), 2: (59_998, 1), 4: (1, 4), 5: (0, 5)}


def test_pairs_of_a_heavy_column_are_made_only_within_reach(spark, tmp_path):
    """Of 60 classes that share a heavy column, two share all their first columns; the join itself gives no other pair."""
    n, p, heavy = 10, 3, 7
    first = {v: [1000 + v, 2000 + v, heavy] for v in range(60)}
    first[59] = first[58]
    posts = [(t, v, n, v, at, t == heavy) for v, ts in first.items() for at, t in enumerate(ts)]
    posts = spark.createDataFrame(posts, "token bigint, v bigint, n bigint, comp bigint, at int, heavy boolean")
    homes = spark.createDataFrame([(v, v, [heavy]) for v in first], "v bigint, home bigint, tokens array<bigint>")
    op = jaccard._Join(None, None, 5, 4, 5)
    op.heads, op.n_heads = spark.createDataFrame([(v, n, p, 9) for v in first], "v bigint, n bigint, p bigint, last bigint"), len(first)
    pairs = op.crossing(posts, homes)
    assert [tuple(r) for r in pairs.collect()] == [(58, 59)]
    joins = [x for x in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and "array_min" in x]
    assert len(joins) == 1 and joins[0].count("array_intersect") >= 2 and ".last" in joins[0]
