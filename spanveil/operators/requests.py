"""Requests as rows: defaults, validation, failure policy and what a reply may expose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assistant_or_default(client: Column, assistant: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(assistant), F.lit("")), F.concat(client, F.lit("_chat_001")))


def _length(name: str, least: int, most: int, needed: bool = True) -> Column:
    n = F.char_length(name)
    bad = ~n.between(least, most)
    return F.when(F.coalesce(bad, F.lit(needed)), F.lit(f"{name}: length"))


def scope_errors() -> list[Column]:
    return [
        _length("thread_id", 8, 256),
        F.when(F.coalesce(~F.col("thread_id").rlike("^thread_."), F.lit(True)), F.lit("thread_id: pattern")),
        *(_length(c, 1, 128) for c in ("session_id", "visitor_id", "client_id")),
        F.when(F.char_length(assistant_or_default(F.col("client_id"), F.col("assistant_id"))) > 128, F.lit("assistant_id: length")),
    ]


def validate(requests: DataFrame) -> DataFrame:
    """Adds assistant_id with its default and ``errors``; a good row has none."""
    mode = F.when(~F.coalesce(F.col("failure_mode"), F.lit("closed")).isin("closed", "open"), F.lit("failure_mode: value"))
    message = F.when(F.coalesce(F.char_length("message") < 1, F.lit(True)), F.lit("message: length"))
    errors = F.array_compact(F.array(*scope_errors(), message, mode))
    return requests.withColumn("errors", errors).withColumn("assistant_id", assistant_or_default(F.col("client_id"), F.col("assistant_id")))


def validate_refresh(requests: DataFrame) -> DataFrame:
    """Adds ``errors`` for allowlist refreshes: terms, or a payload with selectors, must be there."""
    terms = F.size(F.coalesce("terms", F.array().cast("array<string>"))) > 0
    picked = F.col("payload").isNotNull() & (F.size(F.coalesce("selectors", F.array().cast("array<struct<selector:string,include:string>>"))) > 0)
    wrong = F.exists("selectors", lambda s: ~F.char_length(s["selector"]).between(1, 256) | ~s["include"].isin("values", "keys", "both"))
    return requests.withColumn("errors", F.array_compact(F.array(_length("client_id", 1, 128), F.when(~(terms | picked), F.lit("terms or payload with selectors")), F.when(wrong, F.lit("selectors: value")))))


def fails_closed(mode: Column, default: Column) -> Column:
    return F.when(mode == "open", False).when(mode == "closed", True).otherwise(default)


def outcome(result: Column, raw: Column, failed: Column, closed: Column) -> Column:
    """The result; if it failed, null where failures are closed and the raw text where they are open."""
    return F.when(~failed, result).when(closed, F.lit(None)).otherwise(raw)


def exposed(replacements: Column, asked: Column, allowed: Column) -> Column:
    """Raw values leave only if both the request asks and the server allows."""
    return F.when(asked & allowed, replacements)
