"""Batches against a plain version, and rows that are alike in all."""

from collections import Counter, defaultdict

from spanveil.llm import packing

from . import brute


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, text string, told string, row string, bucket string")


def test_batches_equal_plain_ones(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 40)) or None, "t", "r", "b") for i in range(200)]
    lengths = {i: brute.text_counts(t)[0] for i, t, *_ in rows}
    bounds = packing.optimal_buckets(Counter(lengths.values()), 4)
    by_bucket = defaultdict(list)
    for i in sorted(lengths):
        by_bucket[next(b for b, x in enumerate(bounds) if lengths[i] <= x)].append(i)
    want = set()
    for b, ids in by_bucket.items():
        fits = max(1, 100 // max(1, bounds[b]))
        want |= {(i, lengths[i], b, bounds[b], n // fits, n % fits) for n, i in enumerate(ids)}
    assert {tuple(r) for r in packing.pack(_docs(spark, rows), buckets=4, budget=100).collect()} == want


def test_equal_rows_are_dealt_out(spark):
    """A third of all rows are one row, another third have no id; no slot is given twice and shards stay small."""
    rows = [(None, "same text", "t", "r", "b")] * 300 + [(None, f"w {i}", "t", "r", "b") for i in range(300)] + [(i, "x " * (i % 9), "t", "r", "b") for i in range(300)]
    got = packing.pack(_docs(spark, rows).repartition(5), buckets=3, budget=20, rows_per_shard=50).collect()
    assert len(got) == 900 and len({(r.bucket, r.batch, r.slot) for r in got}) == 900
    for bucket in {r.bucket for r in got}:
        own = [r for r in got if r.bucket == bucket]
        fits = max(1, 20 // max(1, own[0].bucket_length))
        assert sorted(r.batch * fits + r.slot for r in own) == list(range(len(own)))


def test_packing_edges(spark):
    assert packing.pack(_docs(spark, [])).count() == 0
    (r,) = packing.pack(_docs(spark, [(1, "w " * 300_000, "t", "r", "b")]), budget=10).collect()
    assert (r.n_tokens, r.bucket_length, r.batch, r.slot) == (300_000, 300_000, 0, 0)
