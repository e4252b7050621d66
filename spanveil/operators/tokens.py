"""Vaults as tables: numbering, replacing and restoring contacts without Python.

E-mail addresses and phone numbers never replace an earlier value, so the order
of first appearance alone gives their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions.spans import contact_spans, splice
from spanveil.functions.text import normalise
from spanveil.shared import settled


def _norm(entity: Column, value: Column) -> Column:
    return F.when(entity == "ph", normalise("ph", value)).when(entity == "em", normalise("em", value)).otherwise(normalise("fn", value))


def contact_mentions(docs: DataFrame, scope: str, seq: str, text: str) -> DataFrame:
    """(scope, seq, start, end, entity, value, norm), a row for each contact."""
    spans = docs.select(F.col(scope).alias("scope"), F.col(seq).alias("seq"), F.explode(contact_spans(F.col(text))).alias("s"))
    return spans.select("scope", "seq", "s.*").withColumn("norm", _norm(F.col("entity"), F.col("value")))


#: Distinct values of one entity of one scope, up to which one task numbers them.
LARGE = 100_000


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str, large: int = LARGE) -> DataFrame:
    """``rows`` with ``name``, their number from 1 in their group's order (null keys are equal).

    Equal to a window's row number. The rows of groups of more than ``large`` are
    dealt by ranges of (group, order) over tasks and sorted there; a row's number
    is its place in its range plus what the ranges before it hold of the group.
    Rows are written once to the shared folder, and groups and ranges counted; a
    range is a part of a group, so no task gets a whole group.
    """
    rows = settled(rows)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > large)
    found = sizes.agg(F.sum("_size").alias("n")).first()["n"]
    window = Window.partitionBy(*keys).orderBy(*order)
    if not found:
        return rows.withColumn(name, F.row_number().over(window))
    groups = settled(sizes.select(*(F.col(k).alias(f"_{k}") for k in keys)))  # each has more than ``large`` of the rows
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    few = rows.join(groups, same, "left_anti").withColumn(name, F.row_number().over(window))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-found // max(large // 2, 1000)))
    ranges = rows.join(groups, same, "left_semi").repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = settled(ranges.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    starts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")  # a row for each range that a group lies in
    offsets = starts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_of"), (before - F.col("_first") + 1).alias("_shift"))
    many = placed.join(offsets, [*same, F.col("_part") == F.col("_of")]).select(*rows.columns, (F.col("_at") + F.col("_shift")).cast("int").alias(name))
    return few.unionByName(many)


def vault_table(mentions: DataFrame, large: int = LARGE) -> DataFrame:
    """(scope, entity, norm, n, token, value, first_seq): distinct values numbered by first appearance in their scope.

    Mentions are reduced to distinct values, with a map-side part, before the
    numbering sees them; see ``ranked`` for scopes that hold many.
    """
    first = mentions.groupBy("scope", "entity", "norm").agg(F.min(F.struct("seq", "start", "value")).alias("f")).select("scope", "entity", "norm", F.col("f.seq").alias("first_seq"), F.col("f.start").alias("_start"), F.col("f.value").alias("value"))
    numbered = ranked(first, ["scope", "entity"], ["first_seq", "_start", "norm"], "n", large)
    return numbered.select("scope", "entity", "norm", "n", F.format_string("<%s_%d>", "entity", "n").alias("token"), "value", "first_seq")


def _row_key(text: str) -> Column:
    """Equal for rows that are equal in all; so what is made for a row finds it again whatever its keys are."""
    return F.sha2(F.to_json(F.struct("scope", "seq", F.col(text).alias("text"))), 256)


def redact_contacts(docs: DataFrame, scope: str, seq: str, text: str) -> DataFrame:
    """(scope, seq, redacted, n): each row with its contacts replaced by their tokens.

    Only rows that hold a contact are shuffled; the others pass by. Rows may
    share their scope and seq, and either may be null: rows without a scope share
    one vault. A null text stays null.
    """
    spans = docs.select(F.col(scope).alias("scope"), F.col(seq).alias("seq"), F.col(text).alias("text"), contact_spans(F.col(text)).alias("spans"))
    plain = spans.where(F.size("spans") == 0).select("scope", "seq", F.col("text").alias("redacted"), F.lit(0).alias("n"))
    some = spans.where(F.size("spans") > 0).withColumn("row", _row_key("text"))
    mentions = some.select("row", "scope", "seq", F.explode("spans").alias("s")).select("row", "scope", "seq", "s.*").withColumn("norm", _norm(F.col("entity"), F.col("value")))
    vaults = vault_table(mentions).select(F.col("scope").alias("of"), F.col("entity").alias("kind"), F.col("norm").alias("same"), "token")
    tokens = mentions.join(vaults, F.col("scope").eqNullSafe(F.col("of")) & (F.col("entity") == F.col("kind")) & (F.col("norm") == F.col("same")))
    pieces = tokens.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end", "token"))).alias("pieces"))  # a row's spans
    done = some.join(pieces, "row").select("scope", "seq", splice(F.col("text"), F.col("pieces")).alias("redacted"), F.size("pieces").alias("n"))
    return done.unionByName(plain)


def counters(vaults: DataFrame) -> DataFrame:
    """(scope, entity, n, latest_token, latest_value)."""
    return vaults.groupBy("scope", "entity").agg(F.max("n").alias("n"), F.max_by("token", "n").alias("latest_token"), F.max_by("value", "n").alias("latest_value"))


def vault_maps(vaults: DataFrame) -> DataFrame:
    """(scope, vault map<token, value>), for joins with replies; one scope's values."""
    return vaults.groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("vault"))


def profiles(vaults: DataFrame) -> DataFrame:
    """(scope, n, tokens map<entity, token>): tokens by their number."""
    return vaults.groupBy("scope", "n").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", "token")))).alias("tokens"))


def snapshots(vaults: DataFrame) -> DataFrame:
    """(scope, snapshot): each vault as JSON, of the form that ``Vault.snapshot`` has. A scope's values make one row."""
    by_entity = vaults.groupBy("scope", "entity").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("n", "token", "value"))).alias("own"))
    whole = by_entity.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("entity", "n", "own"))).alias("e"))
    numbered = profiles(vaults).groupBy(F.col("scope").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("n").cast("string"), "tokens"))).alias("by_number"))
    every = F.flatten(F.transform("e", lambda e: F.transform(e["own"], lambda o: F.struct(o["token"], o["value"]))))
    return whole.join(numbered, F.col("scope").eqNullSafe(F.col("of"))).select(
        "scope",
        F.to_json(
            F.struct(
                F.lit(1).alias("current_profile"),
                F.map_from_entries(every).alias("token_to_value"),
                F.map_from_entries(F.transform("e", lambda e: F.struct(e["entity"], F.transform(e["own"], lambda o: o["token"])))).alias("entity_to_tokens"),
                F.map_from_entries(F.transform("e", lambda e: F.struct(e["entity"], e["n"]))).alias("entity_counters"),
                F.col("by_number").alias("profile_entity_to_token"),
            )
        ).alias("snapshot"),
    )


SNAPSHOT = "current_profile int, token_to_value map<string,string>, entity_to_tokens map<string,array<string>>, entity_counters map<string,int>"


def restore(snaps: DataFrame) -> DataFrame:
    """(scope, entity, n, token, value) from snapshots."""
    s = snaps.select("scope", F.from_json("snapshot", SNAPSHOT).alias("s"))
    t = s.select("scope", F.explode("s.token_to_value").alias("token", "value"))
    number = F.regexp_extract("token", r"^<([a-z0-9]+)_(\d+)>$", 2).cast("int")
    return t.select("scope", F.regexp_extract("token", r"^<([a-z0-9]+)_(\d+)>$", 1).alias("entity"), number.alias("n"), "token", "value")


def rehydrate(replies: DataFrame, vaults: DataFrame, scope: str, seq: str, text: str) -> DataFrame:
    """(scope, seq, clean): each known token replaced by its value.

    A reply meets only the vault rows of tokens that it holds, however large its
    scope's vault is. Replies may share their scope and seq, and either may be
    null.
    """
    from spanveil.functions.placeholders import substitute

    tokens = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"<[a-z0-9]+_\d+>"), F.lit(0)))
    rows = replies.select(F.col(scope).alias("scope"), F.col(seq).alias("seq"), F.col(text).alias("text"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))
    some = rows.where(F.size("tokens") > 0).withColumn("row", _row_key("text"))
    known = vaults.select(F.col("scope").alias("of"), F.col("token").alias("held"), "value")
    wanted = some.select("row", "scope", F.explode("tokens").alias("token")).join(known, F.col("scope").eqNullSafe(F.col("of")) & (F.col("token") == F.col("held")))
    maps = wanted.groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("token", "value"))).alias("vault"))  # a reply's tokens
    done = some.join(maps, "row", "left").select("scope", "seq", F.when(F.col("vault").isNull(), F.col("text")).otherwise(substitute(F.col("text"), F.col("vault"))).alias("clean"))
    return done.unionByName(rows.where(F.size("tokens") == 0).select("scope", "seq", F.col("text").alias("clean")))


def value_at(mentions: DataFrame, asks: DataFrame, scope: str, seq: str, entity: str) -> DataFrame:
    """``asks`` (scope, seq, entity, ...) with token and value: the newest token of the entity that its scope had strictly before that seq, null without one.

    Tokens of an entity only ever grow in number, so the newest is the one with
    the greatest number among those first seen before. Mentions and asks are
    merged in one window, sorted by seq; no row meets another.
    """
    vault = vault_table(mentions)
    seen = vault.select(F.col("scope").alias("_scope"), F.col("entity").alias("_entity"), F.col("first_seq").alias("_seq"), F.lit(1).alias("_late"), F.struct("n", "token", "value").alias("_had"), F.lit(None).cast(asks.select(F.struct("*").alias("a")).schema["a"].dataType).alias("_ask"))
    asked = asks.select(F.col(scope).alias("_scope"), F.col(entity).alias("_entity"), F.col(seq).alias("_seq"), F.lit(0).alias("_late"), F.lit(None).cast(seen.schema["_had"].dataType).alias("_had"), F.struct("*").alias("_ask"))
    order = Window.partitionBy("_scope", "_entity").orderBy("_seq", "_late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = seen.unionByName(asked).withColumn("_newest", F.max("_had").over(order)).where(F.col("_ask").isNotNull())
    return both.select("_ask.*", F.col("_newest.token").alias("token"), F.col("_newest.value").alias("value"))
