"""Packing into optimal length buckets.

Every document in a bucket is padded to the bucket's longest length. Dynamic
programming over the global length histogram picks the boundaries with the least
padding in all; inside a bucket documents form batches of at most a token
budget. The histogram has a row for each distinct length: at most
sqrt(2 * all tokens), which is what the driver holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Tokens are words: maximal runs of characters other than ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


def word_count(text: str | Column = "text") -> Column:
    """Number of words, 0 for a null text."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.size(F.filter(F.split(t, SPACES), lambda w: w != "")).cast("bigint")


def optimal_buckets(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least total padding; the last is the greatest length.

    cost(i, j] = L_j * (documents in it) - (their tokens), so each layer of the
    recurrence is a lower envelope of lines that a pointer walks once: the whole
    takes buckets * lengths steps. Of equally good splits the one with the
    shortest earlier buckets wins.
    """
    lengths = sorted(histogram)
    n = len(lengths)
    if not n:
        return []
    docs, tokens = [0], [0]
    for x in lengths:
        docs.append(docs[-1] + histogram[x])
        tokens.append(tokens[-1] + histogram[x] * x)
    best = [0] + [lengths[j - 1] * docs[j] - tokens[j] for j in range(1, n + 1)]
    choice = [[0] * (n + 1)]
    for _ in range(1, min(buckets, n)):
        new, cut = [0] * (n + 1), [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # slope, height, split
        at = 0
        for j in range(1, n + 1):
            i = j - 1
            m, b = -docs[i], best[i] + tokens[i]
            while len(hull) >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - m) > (b - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                hull.pop()
            hull.append((m, b, i))
            at = min(at, len(hull) - 1)
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            new[j] = hull[at][0] * x + hull[at][1] + x * docs[j] - tokens[j]
            cut[j] = hull[at][2]
        best = new
        choice.append(cut)
    out, j = [], n
    for cut in reversed(choice):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = cut[j]
    return out[::-1]


def total_padding(histogram: dict[int, int], bounds: list[int]) -> int:
    """Padding of a histogram under given upper lengths."""
    return sum(c * (next(b for b in bounds if b >= x) - x) for x, c in histogram.items())


def pack(docs: DataFrame, buckets: int = 16, budget: int = 8192, rows_per_shard: int = 100_000) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_length, batch, slot): each document's place.

    A batch of bucket length L holds max(1, budget // L) documents, so its padded
    size keeps the budget unless a single document exceeds it. Documents go to
    batches in order of (shard, doc_id), batches are numbered from 0 in each
    bucket. Bucket numbers rise with the length. Null and empty texts have
    length 0 and pack with the shortest; null ids come first in their shard;
    repeated rows each take a slot; an empty table gives an empty one.

    Texts are read once: lengths and hashes are written. Numbering is done in
    shards of a bucket, by a hash of id and text, whose sizes are summed up
    first, so that no bucket meets in one task. A shard that equal rows make
    large is dealt into parts by the order in which rows were written.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    told = F.xxhash64(F.col("doc_id"), F.col("text").cast("string"))
    sized = scratch.save(docs.select("doc_id", word_count(F.col("text").cast("string")).alias("n_tokens"), told.alias("told")).withColumn("row", F.monotonically_increasing_id()))
    counts = {r["n_tokens"]: r["n"] for r in sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = optimal_buckets(counts, buckets)
    shards = max(1, -(-sum(counts.values()) // rows_per_shard))
    table, cases = F.create_map(*(F.lit(x) for i, b in enumerate(bounds or [0]) for x in (i, b))), F.lit(0)
    for i, b in enumerate(bounds[:-1]):
        cases = F.when(F.col("n_tokens") > b, i + 1).otherwise(cases) if i else F.when(F.col("n_tokens") > b, 1).otherwise(0)
    placed = sized.select("*", cases.cast("int").alias("bucket"), F.pmod("told", F.lit(shards)).cast("int").alias("shard"))
    sizes = placed.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("m"))
    large = sizes.where(F.col("m") > 2 * rows_per_shard).select("bucket", "shard", F.ceil(F.col("m") / rows_per_shard).alias("parts"))
    if large.limit(1).count():
        part = F.coalesce(F.pmod(F.xxhash64("row"), "parts").cast("int"), F.lit(0))
        placed = placed.join(F.broadcast(large), ["bucket", "shard"], "left").withColumn("part", part)  # one for 2 * rows_per_shard rows at most
        key = ["bucket", "shard", "part"]
        sizes = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
    else:
        key = ["bucket", "shard"]
    before = sizes.select(*key, (F.sum("m").over(Window.partitionBy("bucket").orderBy(*key[1:])) - F.col("m")).alias("before"))
    slot = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "n_tokens", "told")) - 1
    ranked = placed.withColumn("at", slot).join(before, key).withColumn("at", F.col("at") + F.col("before"))
    length = table[F.col("bucket")].cast("bigint")
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(length, F.lit(1)))).cast("bigint")
    return ranked.select("doc_id", "n_tokens", "bucket", length.alias("bucket_length"), F.floor(F.col("at") / fits).cast("bigint").alias("batch"), (F.col("at") % fits).cast("int").alias("slot"))
