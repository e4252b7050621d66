"""Allowlists of terms that aren't names: extraction from JSON, refresh, and merging into messages."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.functions.text import allowlist_file, content_hash, phrase

INCLUDES = ("values", "keys", "both")


# ---- selectors over JSON ----
def selector_steps(selector: str) -> list[str | int]:
    """A path as steps: names, list indexes, * for children, ** for a node and all below.

    ``$`` and dots may lead; ``[n]``, ``[*]``, ``[]`` and ``['name']`` are steps too.
    """
    path = selector.strip()
    if not path:
        raise ValueError("a selector must not be empty")
    path = path.removeprefix("$").lstrip(".")
    steps: list[str | int] = []
    while path:
        if path[0] == ".":
            path = path[1:]
        elif path[0] == "[":
            inside, closed, path = path[1:].partition("]")
            if not closed:
                raise ValueError(f"selector {selector!r} has no closing bracket")
            inside = inside.strip()
            steps.append("*" if inside in ("", "*") else int(inside) if inside.isdigit() else inside.strip("'\""))
        else:
            end = min((i for i in (path.find("."), path.find("[")) if i >= 0), default=len(path))
            name, path = path[:end].strip(), path[end:]
            if name:
                steps.append(name)
    return steps


def _children(node: Any) -> list[Any]:
    return list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else []


def _below(node: Any) -> Iterator[Any]:
    """The node and all nodes below; without recursion, so depth is no limit."""
    todo = [node]
    while todo:
        top = todo.pop()
        yield top
        todo += reversed(_children(top))


def select_nodes(payload: Any, selector: str) -> list[Any]:
    nodes = [payload]
    for step in selector_steps(selector):
        if step == "**":
            nodes = [x for n in nodes for x in _below(n)]
        elif step == "*":
            nodes = [x for n in nodes for x in _children(n)]
        elif isinstance(step, int):
            nodes = [n[step] for n in nodes if isinstance(n, list) and step < len(n)]
        else:
            nodes = [n[step] for n in nodes if isinstance(n, dict) and step in n]
    return nodes


def collect_terms(payload: Any, selectors: list[tuple[str, str]]) -> list[str]:
    """Strings below what each (selector, include) picks: values, keys or both."""
    out: list[str] = []
    for selector, include in selectors:
        include = include.lower()
        if include not in INCLUDES:
            raise ValueError(f"include must be one of {INCLUDES}")
        for node in select_nodes(payload, selector):
            every = list(_below(node))
            if include != "keys":
                out += [x for x in every if isinstance(x, str)]
            if include != "values":
                out += [k for x in every if isinstance(x, dict) for k in x]
    return out


def all_terms(payload: Any) -> list[str]:
    """Every string key and value, sorted."""
    return sorted(set(collect_terms(payload, [("$", "both")])))


def name_terms(payload: Any) -> list[str]:
    """Every string under a key ``name``, sorted."""
    return sorted({x["name"] for x in _below(payload) if isinstance(x, dict) and isinstance(x.get("name"), str)})


def json_terms(payload: Column, selectors: list[tuple[str, str]]) -> Column:
    """array<string> of the terms in a JSON column; broken or null JSON has none."""
    for selector, include in selectors:
        selector_steps(selector)
        if include.lower() not in INCLUDES:
            raise ValueError(f"include must be one of {INCLUDES}")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def terms(payloads: pd.Series) -> pd.Series:
        def of(raw: str | None) -> list[str]:
            try:
                return collect_terms(json.loads(raw), selectors) if raw else []
            except ValueError:
                return []

        return payloads.map(of)

    return terms(payload)


def register_json_terms(spark: SparkSession, name: str = "explode_json_terms") -> None:
    """A table function for SQL: explode_json_terms(payload, selector, include) gives rows of ``term``."""

    @F.udtf(returnType="term string")
    class ExplodeJsonTerms:
        def eval(self, payload: str, selector: str, include: str):
            try:
                found = collect_terms(json.loads(payload), [(selector, include)]) if payload else []
            except json.JSONDecodeError:
                found = []
            for t in found:
                yield (t,)

    spark.udtf.register(name, ExplodeJsonTerms)


# ---- lists ----
def normalised_terms(terms: Column) -> Column:
    """Distinct phrases, sorted by code point; blank ones go."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), phrase), lambda t: t != "")))


def refresh(existing: DataFrame, incoming: DataFrame, max_terms: int = 50_000) -> DataFrame:
    """The allowlist rows after a refresh, with ``changed``.

    ``incoming``: (client_id, assistant_id, source_version, terms, updated_at_epoch).
    A list whose hash is as before keeps its row; too many terms are an error.
    """
    new = incoming.select("client_id", "assistant_id", "source_version", "updated_at_epoch", normalised_terms(F.col("terms")).alias("terms"))
    new = new.withColumn("terms", F.when(F.size("terms") > max_terms, F.raise_error(F.format_string("%d terms exceed max_terms", F.size("terms")))).otherwise(F.col("terms")))
    new = new.withColumn("content_hash", content_hash(F.col("terms")))
    old = existing.select(*(F.col(c).alias(f"old_{c}") for c in ("client_id", "assistant_id", "source_version", "updated_at_epoch", "terms", "content_hash")))
    both = new.join(old, (F.col("client_id") == F.col("old_client_id")) & (F.col("assistant_id") == F.col("old_assistant_id")), "left")
    changed = ~F.col("content_hash").eqNullSafe(F.col("old_content_hash"))
    kept = {c: F.when(changed, F.col(c)).otherwise(F.col(f"old_{c}")) for c in ("source_version", "updated_at_epoch", "terms")}
    return both.select(
        "client_id",
        "assistant_id",
        *(v.alias(c) for c, v in kept.items()),
        "content_hash",
        F.size("terms").alias("term_count"),
        allowlist_file(F.col("client_id"), F.col("assistant_id")).alias("cache_file"),
        changed.alias("changed"),
    )


def merge(messages: DataFrame, lists: DataFrame, own: str = "non_name_allowlist", broadcast_rows: int = 10_000) -> DataFrame:
    """Adds ``terms``: a message's own terms with its client's and assistant's list.

    With a list the union is sorted, without one the own terms stay as they are.
    Lists are broadcast while there are at most ``broadcast_rows`` of them.
    """
    slim = lists.select("client_id", "assistant_id", F.col("terms").alias("_listed"))
    few = slim.limit(broadcast_rows + 1).count() <= broadcast_rows
    both = messages.join(F.broadcast(slim) if few else slim, ["client_id", "assistant_id"], "left")
    mine = F.coalesce(F.col(own), F.array().cast("array<string>"))
    some = F.size(F.coalesce("_listed", F.array().cast("array<string>"))) > 0
    return both.withColumn("terms", F.when(some, F.array_sort(F.array_union("_listed", mine))).otherwise(mine)).drop("_listed")
