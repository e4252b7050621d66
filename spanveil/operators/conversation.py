"""Whole conversations: an ordered fold of messages over the vault of their scope.

Token numbers depend on all earlier messages of a scope, so a scope is the unit
of work: one shuffle by scope, then scopes stream by in order of time, vault in,
vault out.
Contacts alone don't need this; see ``operators.tokens``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.operators import names
from spanveil.operators.folds import fold
from spanveil.operators.vault import Vault

SCOPE = ("client_id", "assistant_id", "visitor_id", "session_id", "thread_id")
MESSAGES = "seq bigint, op string, ts double, message string, previous string, terms array<string>, new_user boolean, closed boolean"
VAULTS = "snapshot string, last_access double"
RESULTS = "seq bigint, op string, status string, text string, repaired string, was_repaired boolean, profile int, replacements map<string,string>, generation int"


class Session:
    """The life of one scope: vaults come and go with idle time and explicit ends.

    ``step`` takes one operation. "in" redacts, "out" restores, "end" drops the
    vault. A vault idle for longer than the TTL is gone, with its stored copy.
    A failure raises where failures are closed, and passes the raw text on with
    profile 1 where they are open.
    """

    def __init__(self, ttl: float = 3600.0, vault: Vault | None = None, last: float | None = None, generation: int = 0, models: names.Detectors = names.Detectors()):
        self.ttl, self.vault, self.last, self.generation, self.models = max(60.0, ttl), vault, last, generation, models

    def stored(self, snapshot: str, last: float | None) -> None:
        """Go on with a stored vault."""
        self.vault, self.last = Vault.restore(json.loads(snapshot)), last

    def result(self, row: dict) -> dict:
        """``step`` for one row of messages, with the row's seq and op."""
        got = self.step(row["op"], float("nan") if row["ts"] is None else row["ts"], row["message"], row["previous"], row["terms"] or (), bool(row["new_user"]), row["closed"] is None or bool(row["closed"]))
        return {"seq": row["seq"], "op": row["op"]} | got

    def vault_row(self) -> dict:
        """What a store keeps of the scope."""
        kept = self.vault is not None
        return {"op": "vault", "status": "kept" if kept else "gone", "generation": self.generation, "snapshot": json.dumps(self.vault.snapshot()) if kept else None, "last_access": self.last if kept else None}

    def _expire(self, now: float) -> None:
        if self.vault is not None and self.last is not None and now - self.last > self.ttl:
            self.vault = None

    def step(self, op: str, now: float, message: str | None, previous: str | None = None, terms=(), new_user: bool = False, closed: bool = True) -> dict:
        self._expire(now)
        out = {"status": "ok", "text": None, "repaired": None, "was_repaired": None, "profile": None, "replacements": None}
        if op == "end":
            out["status"] = "ended" if self.vault is not None else "missing"
            self.vault = None
        elif op == "out":
            if self.vault is None:
                out |= {"status": "error", "text": None} if closed else {"status": "raw", "text": message, "repaired": message, "was_repaired": False}
            else:
                r = names.rehydrate(message or "", self.vault)
                out |= {"text": r.clean, "repaired": r.repaired, "was_repaired": r.was_repaired, "profile": self.vault.profile}
                self.last = now
        else:
            if self.vault is None:
                self.vault, self.generation = Vault(), self.generation + 1
            if new_user:
                self.vault.next_profile()
            self.last = now
            try:
                r = names.redact(message or "", self.vault, previous, names.terms_of(terms), self.models)
                out |= {"text": r.text, "profile": r.profile, "replacements": r.replacements}
            except Exception:
                out |= {"status": "error"} if closed else {"status": "raw", "text": message, "profile": 1, "replacements": {}}
        return out | {"generation": self.generation}


def process(messages: DataFrame, scope: tuple[str, ...] = SCOPE, ttl_seconds: int = 3600, models: Callable[[], names.Detectors] | None = None, stored: DataFrame | None = None, with_snapshots: bool = False) -> DataFrame:
    """One result row for each message row, plus the scope columns.

    ``messages`` has the scope columns and seq, op (in, out or end), ts (epoch
    seconds), message, previous, terms, new_user, closed. ``stored`` may have
    (scope columns, snapshot, last_access) of earlier vaults, each of which comes
    before the messages of its scope. ``models`` makes the optional detectors,
    once a worker. Messages without a time come last in their scope.
    ``with_snapshots`` adds a row for each scope, of op "vault", whose snapshot
    and last_access are what a store keeps; both are null if the vault is gone.
    """
    keys, fields = list(scope), [f.split()[0] for f in MESSAGES.split(", ")]
    schema = T.StructType([messages.schema[k] for k in keys] + list(T._parse_datatype_string(RESULTS + (f", {VAULTS}" if with_snapshots else ""))))
    rows = messages.select(*keys, *fields).withColumn("_old", F.lit(False))
    if stored is not None:
        nulls = (F.lit(None).cast(messages.schema[f].dataType).alias(f) for f in fields if f not in ("ts", "message"))
        rows = rows.unionByName(stored.select(*keys, F.col("last_access").cast("double").alias("ts"), F.col("snapshot").alias("message"), *nulls, F.lit(True).alias("_old")))

    def step(session: Session, row: dict) -> Iterator[dict]:
        if row["_old"]:
            session.stored(row["message"], row["ts"])
        else:
            yield {k: row[k] for k in keys} | session.result(row)

    order = [F.col("_old").desc(), F.col("ts").asc_nulls_last(), F.col("seq")]
    finish = (lambda session, scope: (scope | session.vault_row(),)) if with_snapshots else None
    return fold(rows, keys, order, lambda: Session(ttl_seconds, models=_models(models)), step, schema, finish)


_made: dict[bytes, names.Detectors] = {}


def _models(make: Callable[[], names.Detectors] | None) -> names.Detectors:
    """Models of this worker, made at first use. What can't be made raises here; see ``operators.models`` for what may be left out."""
    if make is None:
        return names.Detectors()
    key = hashlib.sha256(cloudpickle.dumps(make)).digest()  # a worker serves many jobs, and each task unpickles its own copy
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _each(of, *columns) -> list:
    """``of`` of each row of a batch. Rows that are equal are worked out once: the rules take long, and messages repeat."""
    done: dict[tuple, object] = {}
    out = []
    for row in zip(*columns, strict=True):
        key = tuple(v if v is None or isinstance(v, str) else tuple(v) for v in row)
        if key not in done:
            done[key] = of(*row)
        out.append(done[key])
    return out


def redact_udf(texts: F.Column, previous: F.Column, terms: F.Column) -> F.Column:
    """Redaction of single messages, each with a vault of its own: struct<text, replacements>."""

    def of(x, y, z):
        got = names.redact(x or "", Vault(), y, names.terms_of(z if z is not None else ()))
        return got.text, json.dumps(got.replacements)

    @F.pandas_udf("struct<text: string, replacements: string>")
    def one(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for t, p, a in batches:
            yield pd.DataFrame(_each(of, t, p, a), columns=["text", "replacements"])

    return one(texts, previous, terms)


def spans_udf(texts: F.Column, previous: F.Column, terms: F.Column) -> F.Column:
    """Resolved spans of single messages: array<struct<start, end, entity, value>>."""

    @F.pandas_udf("array<struct<start: int, end: int, entity: string, value: string>>")
    def found(t: pd.Series, p: pd.Series, a: pd.Series) -> pd.Series:
        def of(x, y, z):
            spans = names.resolve(names.detect(x or "", None, y, names.terms_of(z if z is not None else ())))
            return [{"start": s.start, "end": s.end, "entity": s.entity, "value": s.value} for s in spans]

        return pd.Series(_each(of, t, p, a))

    return found(texts, previous, terms)


def similar_udf(a: F.Column, b: F.Column) -> F.Column:
    """Whether two name tokens are alike (ratio of matching blocks of 0.75)."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_each(lambda i, j: names.similar(i or "", j or ""), x, y))

    return alike(a, b)


def near_term_udf(text: F.Column, terms: F.Column) -> F.Column:
    """Whether a phrase is nearly one of the terms."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(_each(lambda i, j: names.like_a_term(names.phrase(i or ""), names.terms_of(j if j is not None else ())), x, t))

    return near(text, terms)
