"""What a row needs from the rows before it: previous assistant message, sessions, evictions, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil.operators.folds import fold


def previous_assistant(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Adds ``previous``: the last assistant text strictly before each turn, null without one."""
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("previous", F.last(F.when(F.col(role) == "assistant", F.col(text)), ignorenulls=True).over(before))


def generations(accesses: DataFrame, key: str, ts: str, order: str, ttl_seconds: int = 3600) -> DataFrame:
    """Adds ``generation`` from 1: a new one begins where a key was idle for longer than the TTL."""
    w = Window.partitionBy(key).orderBy(ts, order)
    idle = F.col(ts) > F.lag(ts).over(w) + F.make_dt_interval(secs=F.lit(ttl_seconds))
    return accesses.withColumn("_new", F.coalesce(idle.cast("int"), F.lit(1))).withColumn("generation", F.sum("_new").over(w)).drop("_new")


def profile_index(accesses: DataFrame, keys: list[str], order: list[str], new_user: str) -> DataFrame:
    """Adds ``profile``: 1 and one more for each new user up to the row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return accesses.withColumn("profile", 1 + F.sum(F.coalesce(F.col(new_user), F.lit(False)).cast("int")).over(w))


def lru_evictions(accesses: DataFrame, key: str, ts: str, order: str, capacity: int = 15, ttl_seconds: int = 3600, blocks_per_ttl: int = 12) -> DataFrame:
    """(order, key, ts, evicted): whether a key fell out of a cache of ``capacity`` keys since its last access.

    It did if at least ``capacity`` other keys came in between, that is, if it is
    not among the ``capacity`` keys accessed last. Time is cut into blocks. Each
    block's own last keys, at most ``capacity``, tell in one fold over the blocks
    which keys were last before each; from there the blocks are walked through in
    parallel, in time linear in their rows. A key's first access and one after
    the TTL are not evictions.
    """
    width = ttl_seconds * 1_000_000 / blocks_per_ttl
    mine = Window.partitionBy("k").orderBy("t", "o")
    rows = accesses.select(F.col(order).alias("o"), F.col(key).alias("k"), F.col(ts).cast("timestamp").alias("t"))
    rows = rows.withColumns({"block": F.floor(F.unix_micros("t") / width), "live": F.coalesce(F.unix_micros("t") - F.unix_micros(F.lag("t").over(mine)) <= ttl_seconds * 1_000_000, F.lit(False))})
    lasts = rows.groupBy("block", "k").agg(F.max(F.struct("t", "o")).alias("at"))
    late = lasts.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy(F.col("at").desc()))).where(F.col("rank") <= capacity)
    own = late.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "k"))), lambda x: x["k"]).alias("own")).withColumn("all", F.lit(0))  # ``capacity`` keys
    kind = rows.select("block", F.array("k").alias("before")).schema

    def carry(recent: list, row: dict) -> list[dict]:
        out = [{"block": row["block"], "before": list(recent)}]
        recent[:] = (row["own"] + [k for k in recent if k not in row["own"]])[:capacity]
        return out

    before = fold(own, ["all"], [F.col("block")], list, carry, kind)  # a row for each block

    def walk(state: dict, row: dict) -> list[dict]:
        recent = state.setdefault("recent", list(row["before"]))
        out = [{order: row["o"], key: row["k"], ts: row["t"], "evicted": row["live"] and row["k"] not in recent}]
        recent[:] = ([row["k"], *(k for k in recent if k != row["k"])])[:capacity]
        return out

    result = rows.select(F.col("o").alias(order), F.col("k").alias(key), F.col("t").alias(ts), F.col("live").alias("evicted")).schema
    return fold(rows.join(before, "block"), ["block"], [F.col("t"), F.col("o")], dict, walk, result)


def most_recent(accesses: DataFrame, key: str, ts: str, n: int = 15) -> DataFrame:
    """The ``n`` keys accessed last: (key, last_access). One row a key is ranked."""
    return accesses.groupBy(key).agg(F.max(ts).alias("last_access")).orderBy(F.desc("last_access"), key).limit(n)
