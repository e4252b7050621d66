"""Sessions as a stream: keyed state holds each scope's vault until it has been idle for the TTL.

The fold is that of the batch operator. State is one JSON snapshot a scope; a
processing-time timer, set anew at each access, drops the vault and tells so, and
a scope's generation is kept for longer, as in batch. The RocksDB state store is
needed. A cap on live scopes over all keys has no place in keyed state: see
``operators.context.lru_evictions`` for it in batch.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanveil.config import Settings
from spanveil.functions.crypto import scope_key
from spanveil.operators import names
from spanveil.operators.conversation import RESULTS, SCOPE, VAULTS, Session, _models
from spanveil.shipping import ship
from spanveil.sources.commits import CommitLog
from spanveil.sources.stores import StoreError, VaultStore, change

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "snapshot string, last double, generation int"
FIELDS = [f.split()[0] for f in f"{RESULTS}, {VAULTS}".split(", ")]
#: A scope that has no vault is forgotten after so many seconds: a month.
FORGET_SECONDS = 30 * 24 * 3600


def _frame(rows: list[dict]) -> pd.DataFrame:
    columns = [*SCOPE, *FIELDS]
    return pd.DataFrame([[r.get(c) for c in columns] for r in rows], columns=columns, dtype=object)


class ScopeProcessor(StatefulProcessor):
    def __init__(self, ttl_seconds: int, models: Callable[[], names.Detectors] | None = None, forget_seconds: int = FORGET_SECONDS):
        self.ttl, self.models, self.forget = max(60, ttl_seconds), models, forget_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("vault", STATE)

    def _wake_in(self, seconds: int, timerValues) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + seconds * 1000)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.state.update((row["snapshot"], float(row["last_access"]), 0))
        self._wake_in(self.ttl, timerValues)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session = Session(self.ttl, models=_models(self.models))
        if self.state.exists():
            snapshot, last, session.generation = self.state.get()
            if snapshot:
                session.stored(snapshot, last)
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        scope = dict(zip(SCOPE, key, strict=True))
        out = [scope | session.result(r | {"terms": [] if r["terms"] is None else list(r["terms"])}) for r in batch.to_dict("records")]
        kept = session.vault_row()
        out.append(scope | kept)
        self.state.update((kept["snapshot"], float(session.last or 0), int(session.generation)))
        self._wake_in(self.ttl if kept["snapshot"] else self.forget, timerValues)
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists() and self.state.get()[0]:
            _, last, generation = self.state.get()
            self.state.update((None, last, generation))
            self._wake_in(self.forget, timerValues)
            out.append(dict(zip(SCOPE, key, strict=True)) | {"op": "vault", "status": "expired", "generation": generation})
        else:
            self.state.clear()
        yield _frame(out)

    def close(self) -> None:
        pass


def process_stream(messages: DataFrame, ttl_seconds: int = 3600, models: Callable[[], names.Detectors] | None = None, stored: DataFrame | None = None, with_snapshots: bool = False) -> DataFrame:
    """A stream of results for a stream of messages, columns as in ``operators.conversation.process``.

    ``stored`` (scope columns, snapshot, last_access) are vaults to start from.
    ``with_snapshots`` keeps the rows of op "vault", which tell after each
    micro-batch, and on expiry, what a store keeps of a scope.
    """
    spark = messages.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = T.StructType([messages.schema[k] for k in SCOPE] + list(T._parse_datatype_string(f"{RESULTS}, {VAULTS}")))
    start = None if stored is None else stored.groupBy(*SCOPE)
    out = messages.groupBy(*SCOPE).transformWithStateInPandas(ScopeProcessor(ttl_seconds, models), schema, "append", "processingTime", start)
    return out if with_snapshots else out.where("op <> 'vault'").drop("snapshot", "last_access")


@dataclass
class Health:
    """What became of the writes: the failures so far, and whether the last one failed."""

    failures: list[tuple[int, str]] = field(default_factory=list)
    failed: bool = False

    def require(self, settings: Settings) -> None:
        """Raise if the store has failed and the settings say that this blocks."""
        if self.failed and settings.persistence_block_on_error:
            raise StoreError(f"the store has failed: {self.failures[-1][1]}")


def store_changes(batch: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(rows to save, keys to delete) of results with snapshots: the last word on each scope counts."""
    told = batch.where("op = 'vault'").withColumn("scope_key", scope_key(*(F.col(c) for c in SCOPE)))
    last = told.groupBy("scope_key").agg(F.max_by(F.struct("snapshot", "last_access"), F.struct("generation", F.coalesce("last_access", F.lit(float("inf"))))).alias("v"))
    expires = F.date_format(F.timestamp_seconds(F.col("v.last_access") + settings.vault_ttl_seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = last.where("v.snapshot is not null").select("scope_key", "v.snapshot", expires.alias("expires_at"), F.lit(settings.persistence_key_version).alias("key_version"))
    return rows, last.where("v.snapshot is null").select("scope_key")


class ResultSink:
    """Micro-batches as Parquet under ``path``, each committed once by its writer and number."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path, CommitLog(spark, path)

    def add(self, batch: DataFrame, batch_id: int, writer: str = "") -> bool:
        """Write and commit a batch; False if it was committed before."""
        name = f"{hashlib.sha256(writer.encode()).hexdigest()[:16]}-{batch_id:020d}"
        if name in self.log.names():
            return False
        data = f"data/{name}-{uuid.uuid4().hex}"
        batch.write.parquet(f"{self.path}/{data}")
        return self.log.commit(name, {"data": data, "schema": batch.schema.jsonValue()})

    def read(self) -> DataFrame | None:
        """The rows of all committed batches; None without any."""
        found = [self.log.read(n) for n in self.log.names()]
        return self.spark.read.schema(T.StructType.fromJson(found[-1]["schema"])).parquet(*(f"{self.path}/{f['data']}" for f in found)) if found else None


def write_behind(results: DataFrame, store: VaultStore, settings: Settings, checkpoint: str, health: Health | None = None, then: Callable[[DataFrame, int], None] | None = None, out: ResultSink | None = None, **trigger):
    """Start a query that keeps ``store`` as the results (with snapshots) tell, and hands each micro-batch on to ``out`` and ``then``.

    The checkpoint takes the place of a queue. A micro-batch is evaluated once,
    then saved, then handed on. After a failure between these steps the next
    start takes it up again: the store and ``out`` know the number of a batch that
    they have committed, and skip it; ``then`` is called again. A failed write is
    recorded in ``health``; where failures block, the query stops there and
    nothing is handed on. ``trigger`` is that of the query.
    """
    health = Health() if health is None else health

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            batch.count()  # a batch that all others skip must still bring the state forward
            try:
                change(store, *store_changes(batch, settings), checkpoint, batch_id)
                health.failed = False
            except Exception as e:
                health.failures.append((batch_id, str(e)))
                health.failed = True
            health.require(settings)
            shown = batch.where("op <> 'vault'")
            if out is not None:
                out.add(shown, batch_id, checkpoint)
            if then is not None:
                then(shown, batch_id)
        finally:
            batch.unpersist()

    writer = results.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(**trigger) if trigger else writer).start()


def health(spark: SparkSession) -> list[dict]:
    """Progress of the running queries, one dict each."""
    return [{"name": q.name, "active": q.isActive, "failed": q.exception() is not None, "rows": (q.lastProgress or {}).get("numInputRows", 0)} for q in spark.streams.active]
