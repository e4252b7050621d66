"""Repair and substitution of placeholders, as Column expressions over map<token, value> vaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil import lexicon as lx


def _alias(c: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in lx.PLACEHOLDER_ALIASES.items() for x in kv))[c]


def latest(vault: Column, entity: Column | str) -> Column:
    """The token with the highest number of an entity, null if there is none."""
    entity = F.lit(entity) if isinstance(entity, str) else entity
    own = F.filter(F.map_keys(vault), lambda t: F.regexp_extract(t, r"^<([a-z0-9]+)_\d+>$", 1) == entity)
    by_number = F.array_max(F.transform(own, lambda t: F.struct(F.regexp_extract(t, r"_(\d+)>", 1).try_cast("int").alias("n"), t.alias("t"))))
    return by_number["t"]


def repair(text: Column, vault: Column) -> Column:
    """Malformed placeholders become the tokens that they mean, where the vault has them."""
    pattern = "<([^<>]+)>"
    contents = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    has = lambda t: F.coalesce(F.map_contains_key(vault, t), F.lit(False))

    def fixed(content: Column) -> Column:
        raw, original = F.lower(F.trim(content)), F.concat(F.lit("<"), content, F.lit(">"))
        compact = F.regexp_replace(F.regexp_extract(raw, r"^(?:fn|mn1|mn2|ln|em|ph)\d+$", 0), r"^(fn|mn1|mn2|ln|em|ph)(\d+)$", "<$1_$2>")
        alias = _alias(F.nullif(F.regexp_extract(raw, r"^([a-z_\-]+)_?\d+$", 1), F.lit("")))
        numbered = F.concat(F.lit("<"), alias, F.lit("_"), F.regexp_extract(raw, r"(\d+)$", 1), F.lit(">"))
        first, last = latest(vault, "fn"), latest(vault, "ln")
        whole = F.when(first.isNotNull() & last.isNotNull(), F.concat_ws(" ", first, last)).otherwise(F.coalesce(first, original))
        return (
            F.when(has(original), original)
            .when(has(compact), compact)
            .when(numbered.isNotNull() & has(numbered), numbered)
            .when(raw.isin(*lx.WHOLE_NAME_ALIASES), whole)
            .otherwise(F.coalesce(latest(vault, _alias(raw)), original))
        )

    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(gaps, F.transform(contents, fixed), lambda g, t: F.concat(g, F.coalesce(t, F.lit(""))))
    return F.array_join(parts, "")


def substitute(text: Column, vault: Column) -> Column:
    """Each token replaced by its value, the longest tokens first."""
    order = F.array_sort(F.transform(F.map_entries(vault), lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("t"), e["value"].alias("v"))))
    return F.aggregate(order, text, lambda acc, e: F.replace(acc, e["t"], e["v"]))
