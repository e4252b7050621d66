"""Terms of JSON payloads by selectors, as joins over VARIANT nodes: no Python sees a payload.

Selected nodes are rows. A step explodes each node into its children and keeps
those that the step means; ``**`` adds all levels below, one after the other,
until a level is empty, so depth is no limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.operators.allowlist import INCLUDES, selector_steps
from spanveil.shared import settled


def _children(nodes: DataFrame) -> DataFrame:
    """(row, key, pos, node) of the children of nodes: ``key`` is null in lists."""
    each = nodes.sparkSession.tvf.variant_explode(F.col("node").outer()).toDF("pos", "key", "child")  # no rows of what is neither an object nor a list
    return nodes.select("row", "node").lateralJoin(each).select("row", "key", "pos", F.col("child").alias("node"))


def _below(nodes: DataFrame) -> DataFrame:
    """(row, key, node) of all nodes below; each level is written once, and read for the next."""
    levels, level = [], nodes
    while True:
        level = settled(_children(level).select("row", "key", "node"))
        if level.isEmpty():
            break
        levels.append(level)
    out = level  # empty
    for x in levels:
        out = out.unionByName(x)
    return out


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """(row, node): the nodes that a selector picks of (row, node); see ``allowlist.select_nodes``."""
    for step in selector_steps(selector):
        if step == "**":
            nodes = nodes.unionByName(_below(nodes).select("row", "node"))
        else:
            child = F.lit(True) if step == "*" else (F.col("key").isNull() & (F.col("pos") == step)) if isinstance(step, int) else F.col("key") == step
            nodes = _children(nodes).where(child).select("row", "node")
    return nodes


def term_rows(rows: DataFrame, keys: list[str], payload: str, selectors: list[tuple[str, str]]) -> DataFrame:
    """(*keys, term): the distinct strings that each (selector, include) finds in a row's JSON: values, keys or both, at the nodes it picks and below.

    Rows of equal keys are one. Null and broken payloads have no terms, nor have
    those in which an object has a key twice. Empty strings are terms.
    """
    for selector, include in selectors:
        selector_steps(selector)
        if include.lower() not in INCLUDES:
            raise ValueError(f"include must be one of {INCLUDES}")
    row = F.struct(*(F.col(f"`{k}`") for k in keys))
    parsed = rows.select(row.alias("row"), F.try_parse_json(F.col(f"`{payload}`")).alias("node")).where("node is not null")
    out: DataFrame | None = None
    for selector, include in selectors:
        picked = settled(select(parsed, selector))
        below = _below(picked)
        found = []
        if include.lower() != "keys":
            every = picked.unionByName(below.select("row", "node"))
            found.append(every.where(_is_string("node")).select("row", F.variant_get("node", "$", "string").alias("term")))
        if include.lower() != "values":
            found.append(below.where("key is not null").select("row", F.col("key").alias("term")))
        for x in found:
            out = x if out is None else out.unionByName(x)
    if out is None:
        out = parsed.where("false").select("row", F.lit(None).cast("string").alias("term"))
    return out.distinct().select("row.*", "term")


def _is_string(node: str) -> Column:
    return F.schema_of_variant(node) == "STRING"
