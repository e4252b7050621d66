"""Numbers of tokens dealt over ranges against one window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanveil.operators import tokens


def _values(spark, n):
    """One scope with a third of all values, many small ones, and one of null."""
    i = F.col("id")
    scope = F.when(i % 3 == 0, F.lit("hot")).when(i % 97 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), i % 500))
    return spark.range(n).select(scope.alias("scope"), F.when(i % 2 == 0, "em").otherwise("ph").alias("entity"), F.when(i % 11 > 0, F.xxhash64("id") % 5000).alias("seq"), (i % 7).cast("int").alias("start"), F.concat(F.lit("v"), i).alias("norm"))


@pytest.mark.parametrize("large", [0, 1000, 10**9])
def test_ranges_number_as_one_window_does(spark, large):
    rows = _values(spark, 60_000)
    order = ["seq", "start", "norm"]
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("scope", "entity").orderBy(*order)))
    got = tokens.ranked(rows, ["scope", "entity"], order, "n", large)
    assert got.schema["n"].dataType == want.schema["n"].dataType and got.columns == want.columns
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_a_hot_scope_is_dealt_over_many_tasks(spark, monkeypatch):
    seen = []
    own = tokens.settled
    monkeypatch.setattr(tokens, "settled", lambda df: (seen.append(out := own(df)), out)[1])
    rows = spark.range(1_000_000).select(F.lit("one").alias("scope"), F.lit("em").alias("entity"), F.xxhash64("id").alias("seq"))
    got = tokens.ranked(rows, ["scope", "entity"], ["seq"], "n", 100_000)
    placed = next(df for df in seen if "_at" in df.columns)
    sizes = sorted(r["count"] for r in placed.groupBy(F.shiftright("_at", 33)).count().collect())
    assert len(sizes) >= 20 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert got.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (1, 1_000_000, 1_000_000)
    wrong = got.select("seq", "n", F.lag("seq").over(Window.orderBy("n")).alias("before")).where("before >= seq")
    assert wrong.count() == 0


def test_no_values(spark):
    rows = _values(spark, 10).where("false")
    assert tokens.ranked(rows, ["scope", "entity"], ["seq"], "n", 0).count() == 0
