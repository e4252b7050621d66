"""Embedding whitening by a tiled covariance.

Vectors become whole numbers, so counts, sums and deviations are exact. The
covariance matrix is cut into tiles, pairs of blocks of dimensions. Rows are cut
into row-blocks; each leaves a column block, centred, for every block of
dimensions. Column blocks of a row-block meet in a join, each pair of them is a
tile's share, multiplied where it arises; shares are summed per tile, first
within tasks, then in two shuffles. The driver assembles the d x d matrix and
takes its eigenvectors: it holds the square of the dimension, whatever the
number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, bounded_batches

#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT = 1024, 100_000
#: An entry of 1024 * c beyond this has no whole number of its own in a long.
LARGEST = 2.0**62
#: Dimensions of a column block, and the rows of a row-block.
TILE, ROWS = 32, 4096
#: Shares of a tile are summed by so many tasks, and these by one.
SALTS = 16
#: An eigenvalue of this share of the greatest, for each dimension, is one of rounding.
ROUNDING = 4e-16


def whole_vectors(vectors: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """(row, x array<long>): rows whose vector has whole numbers, all of the most frequent length (of equally frequent ones the longest).

    Null vectors, and those with null, non-finite or too large entries, are left
    out, as are vectors without entries. Entries are taken as doubles.
    """
    c = F.col(f"`{vector}`").cast("array<double>")
    fits = F.forall(c, lambda v: F.coalesce(F.abs(v * SCALE) < LARGEST, F.lit(False)))  # false for infinities, and for NaN, which sorts above all numbers
    row = F.struct(*(F.col(f"`{k}`") for k in keep)) if keep else F.struct(F.lit(0).alias("_"))
    return vectors.where(c.isNotNull() & (F.size(c) > 0) & fits).select(row.alias("row"), F.transform(c, lambda v: F.floor(v * SCALE).cast("bigint") + SHIFT).alias("x"))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """The rows of a list column of equal lengths, without a copy."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def moments(rows: DataFrame, d: int) -> tuple[int, list[int], list[int], list[int]]:
    """(n, sums, least, greatest) of each dimension of ``x``, exact: a row a task and dimension is summed as decimals."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, least, most = 0, [0] * d, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), np.int64)
            n += len(x)
            high, low = (x >> 31).sum(0), (x & 0x7FFFFFFF).sum(0)  # neither half overflows within a batch
            total = [t + (int(h) << 31) + int(v) for t, h, v in zip(total, high, low, strict=True)]
            least = x.min(0) if least is None else np.minimum(least, x.min(0))
            most = x.max(0) if most is None else np.maximum(most, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(t) for t in total]), pa.array(least), pa.array(most)], ["k", "n", "s", "least", "most"])

    told = rows.select("x").mapInArrow(of_task, "k int, n bigint, s string, least bigint, most bigint")
    got = sorted(told.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("least").alias("least"), F.max("most").alias("most")).collect())  # a row a dimension
    return (got[0]["n"] if got else 0), [int(r["s"]) for r in got], [r["least"] for r in got], [r["most"] for r in got]


def covariance(rows: DataFrame, values: str, whole: np.ndarray, rest: np.ndarray, n: int, kind: type = np.float64, tile: int = TILE, block: int = ROWS) -> np.ndarray:
    """The covariance (divisor n) of an array column around ``whole + rest``, tile by tile.

    Column blocks travel as value - whole in the type ``kind``, so whole numbers
    as narrow ones, and are fully centred where they are multiplied.
    """
    d = len(whole)
    cuts = list(range(0, d, tile))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def blocks(x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{task}/{number}"] * len(cuts)), pa.array(range(len(cuts)), pa.int32()), pa.array([np.ascontiguousarray(x[:, c : c + tile]).tobytes() for c in cuts], pa.binary())],
                ["rows", "dims", "data"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((_matrix(batch.column(values), whole.dtype) - whole).astype(kind))
            size += len(held[-1])
            while size >= block:
                joined = np.concatenate(held)
                yield blocks(joined[:block])
                number, held, size = number + 1, [joined[block:]], size - block
        if size:
            yield blocks(np.concatenate(held))

    def centred(data: bytes, dims: int) -> np.ndarray:
        own = rest[cuts[dims] : cuts[dims] + tile]
        return np.frombuffer(data, kind).reshape(-1, len(own)) - own

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, a, b in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "a", "b")), strict=True):
                part = centred(a, i).T @ centred(b, j)
                total[i, j] = total[i, j] + part if (i, j) in total else part
        yield from out(total, TaskContext.get().partitionId() % SALTS)

    def out(total: dict[tuple[int, int], np.ndarray], salt: int) -> Iterator[pa.RecordBatch]:
        for (i, j), m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([salt], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["i", "j", "salt", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, m in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "m")), strict=True):
                part = np.frombuffer(m).reshape(min(tile, d - cuts[i]), -1)
                total[i, j] = total[i, j] + part if (i, j) in total else part
        yield from out(total, 0)

    share = "i int, j int, salt int, m binary"
    cells = rows.select(values).mapInArrow(cut, "rows string, dims int, data binary")
    left, right = cells.select("rows", F.col("dims").alias("i"), F.col("data").alias("a")), cells.select("rows", F.col("dims").alias("j"), F.col("data").alias("b"))
    pairs = left.join(right, "rows").where("i <= j").select("i", "j", "a", "b")  # tiles of a row-block
    tiles = len(cuts) * (len(cuts) + 1) // 2
    parts = min(tiles * SALTS, 200)
    summed = pairs.mapInArrow(shares, share).repartition(parts, "i", "j", "salt").mapInArrow(add, share).repartition(min(tiles, 200), "i", "j").mapInArrow(add, share)
    out_matrix = np.zeros((d, d))
    for r in summed.toLocalIterator():  # a row a tile
        m = np.frombuffer(r["m"]).reshape(min(tile, d - cuts[r["i"]]), -1)
        a, b = cuts[r["i"]], cuts[r["j"]]
        out_matrix[a : a + m.shape[0], b : b + m.shape[1]] = m
        out_matrix[b : b + m.shape[1], a : a + m.shape[0]] = m.T
    return out_matrix / max(n, 1)


def means(rows: DataFrame, values: str, k: int, n: int) -> np.ndarray:
    """The means of an array column of ``k`` doubles over ``n`` rows."""
    got = rows.select(*(F.sum(F.get(values, F.lit(i))).alias(f"s{i}") for i in range(k))).collect()[0]
    return np.array([got[i] / n for i in range(k)])


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of the ``k`` greatest, each vector's largest entry positive."""
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:k]
    u = u[:, order].T
    signs = np.sign(u[np.arange(len(u)), np.abs(u).argmax(1)])
    return e[order], u * signs[:, None]


def whiten(vectors: DataFrame, vector: str = "embedding", keep: list[str] | None = None, k: int = 8, tile: int = TILE, block: int = ROWS) -> DataFrame:
    """(row, component, n, deviation, whitened, explained, identity_error): up to ``k`` rows for each vector that remains.

    ``row`` is a struct of the kept columns, of any names. ``deviation`` is the
    exact sum over the dimensions of (n * x - sum)^2, null where that is beyond a
    long. A component whose eigenvalue is nothing but rounding (more components
    than independent dimensions, equal vectors, one vector) has explained 0.0 and
    whitened null, and is left out of ``identity_error``, which is 0.0 if none is
    left. Repeated rows count each; an empty table, or one without usable
    vectors, gives none. See ``whole_vectors`` for which vectors are left out.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "whitening")
    keep = vectors.columns if keep is None else keep
    rows = scratch.save(whole_vectors(vectors, vector, keep))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    kept = T.StructType([rows.schema["row"]])
    schema = T.StructType([*kept, *T._parse_datatype_string("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")])
    if not lengths:
        return spark.createDataFrame([], schema)
    d = lengths[0]["d"]
    rows = rows.where(F.size("x") == d)
    n, sums, least, most = moments(rows, d)
    whole = np.array([s // n for s in sums], np.int64)  # x - whole part of the mean is exact
    rest = np.array([(s % n) / n for s in sums])
    mean = whole + rest
    far = max(max(b - int(w), int(w) - a) for a, b, w in zip(least, most, whole, strict=True))
    kind = next(t for t in (np.int16, np.int32, np.int64) if far <= np.iinfo(t).max)
    v = covariance(rows, "x", whole, rest, n, kind, tile, block)
    e, u = components(v, min(k, d))
    real = e > ROUNDING * d * max(float(np.abs(v).max()), float(np.abs(mean).max()) ** 2 * ROUNDING)
    scale = np.where(real, 1 / np.sqrt(np.where(real, e, 1)), 0.0)
    trace = float(np.trace(v))
    explained = np.where(real, e / trace if trace > 0 else 0.0, 0.0)
    widest = [max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(least, most, sums, strict=True)]
    small = sum(w * w for w in widest) < 2**63 and max(abs(v) for v in [*least, *most]) * n < 2**63 and max(map(abs, sums)) < 2**63
    project = (u * scale[:, None]).T

    def per_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), np.int64) if batch.num_rows else np.zeros((0, d), np.int64)
            w = ((x - whole) - rest) @ project
            if small:
                y = x * n - np.array(sums, np.int64)
                deviation = pa.array((y * y).sum(1), pa.int64())
            else:
                exact = [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
                deviation = pa.array([t if t < 2**63 else None for t in exact], pa.int64())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), deviation, flat], ["row", "deviation", "w"])

    done = rows.mapInArrow(per_row, T.StructType([*kept, *T._parse_datatype_string("deviation bigint, w array<double>")]))
    error = 0.0
    if real.any():
        own = int(real.sum())
        identity = covariance(done, "w", np.zeros(len(e)), means(done, "w", len(e), n), n, tile=tile, block=block)[:own, :own]  # eigenvalues fall, so the real ones come first
        error = float(np.abs(identity - np.eye(own)).max())
    told = F.array(*(F.struct(F.lit(i + 1).alias("component"), F.lit(bool(real[i])).alias("real"), F.lit(float(explained[i])).alias("explained")) for i in range(len(e))))
    each = done.select("row", "deviation", "w", F.explode(told).alias("c"))
    return each.select(
        "row",
        F.col("c.component").alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        F.when(F.col("c.real"), F.get("w", F.col("c.component") - 1)).alias("whitened"),
        F.col("c.explained").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
