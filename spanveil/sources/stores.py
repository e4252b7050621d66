"""Where vault snapshots live between sessions.

A store is a keyed table: scope_key, the scope's parts, key_version, expires_at
(ISO), payload, updated_at. Snapshots are sealed with a key of their own scope.
Upserts replace a key's row; Spark's plain tables have no merge, so new versions
of the parts concerned are written beside the old ones, and a numbered commit
makes them the store's.
"""

from __future__ import annotations

import importlib
import time
import uuid
from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.config import Settings
from spanveil.functions.crypto import cipher_key, decrypt, encrypt
from spanveil.functions.text import expired
from spanveil.shared import settled
from spanveil.sources.commits import CommitLog

ROW = "scope_key string, key_version string, expires_at string, payload struct<alg:string,nonce_hex:string,ciphertext_hex:string>, updated_at timestamp"


class StoreError(RuntimeError):
    """A store can't be built or reached."""


class VaultStore(Protocol):
    """Snapshots in and out by scope_key, as DataFrames.

    A store may also have ``apply(rows, gone, writer, batch)``, which saves and
    deletes at once and knows the batches that it has taken.
    """

    def load(self, keys: DataFrame) -> DataFrame: ...

    def save(self, rows: DataFrame) -> None: ...

    def delete(self, keys: DataFrame) -> None: ...


def change(store: VaultStore, rows: DataFrame, gone: DataFrame, writer: str = "", batch: int | None = None) -> None:
    """Save and delete, in one step where the store can."""
    if hasattr(store, "apply"):
        store.apply(rows, gone, writer, batch)
    else:
        store.save(rows)
        store.delete(gone)


def upsert(old: DataFrame, new: DataFrame, key: str = "scope_key") -> DataFrame:
    """The old rows without the new keys, and the new rows."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def unexpired(rows: DataFrame, now: F.Column | None = None) -> DataFrame:
    """Rows whose time has not come; an unreadable time never comes."""
    return rows.where(~expired(F.col("expires_at"), F.current_timestamp() if now is None else now))


class MemoryStore:
    """Rows for as long as the session lives. Expiry is not looked at on load.

    Each change is evaluated once, into the shared folder, so the rows don't hang
    on the plans that they came from.
    """

    def __init__(self, spark: SparkSession):
        self.rows = spark.createDataFrame([], "scope_key string, snapshot string, expires_at string, key_version string")
        self._applied: dict[str, int] = {}

    def load(self, keys: DataFrame) -> DataFrame:
        return self.rows.join(keys.select("scope_key").distinct(), "scope_key", "left_semi")

    def save(self, rows: DataFrame) -> None:
        self.apply(rows, rows.select("scope_key").limit(0))

    def delete(self, keys: DataFrame) -> None:
        self.rows = settled(self.rows.join(keys.select("scope_key"), "scope_key", "left_anti"))

    def apply(self, rows: DataFrame, gone: DataFrame, writer: str = "", batch: int | None = None) -> bool:
        """As in ``TableStore``."""
        if batch is not None and self._applied.get(writer, -1) >= batch:
            return False
        new = settled(rows.select(self.rows.columns))
        self.rows = settled(upsert(self.rows.join(gone.select("scope_key"), "scope_key", "left_anti"), new))
        if batch is not None:
            self._applied[writer] = batch
        return True


#: A table store's rows are dealt into so many parts by a hash of their key.
PARTS = 64
#: Versions that a table store's log keeps for readers.
KEPT = 20


class TableStore:
    """Sealed rows as Parquet under ``path``, in parts by a hash of the key.

    A version of the store is a commit that names the folder of every part. A
    change is written first, merged with the rows of the parts that it touches
    into new folders, and committed under the next number. If another writer was
    faster, a change of other parts is committed on top of the new version as it
    is; otherwise its parts are merged again. What was written without a commit
    is never read.
    """

    def __init__(self, spark: SparkSession, path: str, master_key: str, parts: int = PARTS):
        if not path or not master_key:
            raise StoreError("a table store needs a path and a master key")
        self.spark, self.path, self.master, self.parts = spark, path, F.lit(master_key), parts
        self.log = CommitLog(spark, path)

    def _part(self) -> F.Column:
        return F.pmod(F.xxhash64("scope_key"), F.lit(self.parts)).cast("int")

    def version(self) -> tuple[int, dict]:
        """The latest version's number, and its parts' folders and the batches that its writers have applied."""
        names = self.log.names()
        while names:
            try:
                return int(names[-1]), self.log.read(names[-1])
            except Exception:  # another writer has tidied up meanwhile
                again = self.log.names()
                if again == names:
                    raise
                names = again
        return 0, {"parts": {}, "applied": {}}

    def rows(self, parts: Iterable[int] | None = None) -> DataFrame:
        """Sealed rows of the latest version, of some parts."""
        return self._rows(self.version()[1]["parts"], parts)

    def _rows(self, folders: dict[str, str], parts: Iterable[int] | None = None) -> DataFrame:
        wanted = folders if parts is None else {str(n) for n in parts} & folders.keys()
        paths = sorted(f"{self.path}/{folders[n]}" for n in wanted)
        return self.spark.read.schema(ROW).parquet(*paths) if paths else self.spark.createDataFrame([], ROW)

    def _write(self, rows: DataFrame) -> tuple[str, dict[str, str]]:
        """Write rows with a column ``part``: (folder, folder of each part that has rows)."""
        name = f"data/{uuid.uuid4().hex}"
        rows.repartition("part").write.partitionBy("part").parquet(f"{self.path}/{name}")
        where = self.log._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        found = (s.getPath().getName() for s in self.log._fs.listStatus(where))
        return name, {f.partition("=")[2]: f"{name}/{f}" for f in found if f.startswith("part=")}

    def apply(self, rows: DataFrame, gone: DataFrame, writer: str = "", batch: int | None = None) -> bool:
        """Save rows (scope_key, snapshot, expires_at, key_version; one a key) and delete keys in one version.

        ``batch`` is the number of a writer's batch, and rises: one that was
        applied before is not applied again, and False is returned. Both plans
        are evaluated once.
        """
        done = lambda state: batch is not None and state["applied"].get(writer, -1) >= batch
        number, state = self.version()
        if done(state):
            return False
        sealed = rows.select(
            "scope_key",
            "key_version",
            "expires_at",
            encrypt(F.col("snapshot"), cipher_key(F.col("key_version"), F.col("scope_key"), self.master)).alias("payload"),
            F.current_timestamp().alias("updated_at"),
        )
        change, touched = self._write(sealed.unionByName(gone.select("scope_key"), allowMissingColumns=True).withColumn("part", self._part()))
        given = self.spark.read.schema(ROW).parquet(*(f"{self.path}/{f}" for f in touched.values())) if touched else self.spark.createDataFrame([], ROW)
        while True:
            base = {n: state["parts"].get(n) for n in touched}
            old = self._rows(state["parts"], touched)
            merged = old.join(given.select("scope_key"), "scope_key", "left_anti").unionByName(given.where("payload is not null"))
            new = self._write(merged.withColumn("part", self._part()))[1] if touched else {}
            while all(state["parts"].get(n) == f for n, f in base.items()):
                folders = {n: f for n, f in state["parts"].items() if n not in touched} | new
                applied = state["applied"] | ({} if batch is None else {writer: batch})
                if self.log.commit(f"{number + 1:020d}", {"parts": folders, "applied": applied}):
                    self.log._fs.delete(self.log._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{change}"), True)
                    return True
                number, state = self.version()
                if done(state):
                    return False

    def load(self, keys: DataFrame) -> DataFrame:
        """(scope_key, snapshot, key_version) of unexpired rows; only the needed columns and the keys' parts are read."""
        own = keys.select("scope_key").distinct()
        parts = [r["part"] for r in own.select(self._part().alias("part")).distinct().collect()]  # at most ``parts``
        found = unexpired(self.rows(parts)).join(own, "scope_key", "left_semi")
        return found.select("scope_key", decrypt(F.col("payload"), cipher_key(F.col("key_version"), F.col("scope_key"), self.master)).alias("snapshot"), "key_version")

    def save(self, rows: DataFrame) -> None:
        """Rows of (scope_key, snapshot, expires_at, key_version)."""
        self.apply(rows, rows.select("scope_key").where("false"))

    def delete(self, keys: DataFrame) -> None:
        self.apply(self.spark.createDataFrame([], "scope_key string, snapshot string, expires_at string, key_version string"), keys.select("scope_key").distinct())

    def vacuum(self, kept: int = KEPT, hours: float = 24) -> int:
        """Remove all but the last ``kept`` versions, and folders older than ``hours`` that none of these names; the number of folders removed.

        No writer or reader may take longer than that.
        """
        names = self.log.names()
        for name in names[:-kept]:
            self.log.remove(name)
        used = {f.rpartition("/")[0] for name in names[-kept:] for f in self.log.read(name)["parts"].values()}
        data = self.log._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        before, removed = time.time() * 1000 - hours * 3_600_000, 0
        for s in self.log._fs.listStatus(data) if self.log._fs.exists(data) else ():
            if f"data/{s.getPath().getName()}" not in used and s.getModificationTime() <= before:
                removed += self.log._fs.delete(s.getPath(), True)
        return removed


def build_store(spark: SparkSession, settings: Settings, external: object | None = None) -> tuple[VaultStore | None, str]:
    """(store, mode) for none, internal (memory or table) or external (given, or module:callable)."""
    mode = settings.persistence_mode
    if mode == "none":
        if settings.require_persistence:
            raise StoreError("persistence is required, but its mode is none")
        return None, mode
    if mode == "internal":
        if settings.internal_store == "memory":
            return MemoryStore(spark), "internal:memory"
        if settings.internal_store == "table":
            return TableStore(spark, settings.store_path, settings.persistence_master_key), "internal:table"
        raise StoreError(f"no internal store {settings.internal_store!r}")
    if mode != "external":
        raise StoreError(f"no persistence mode {mode!r}")
    store = external
    if store is None:
        module, colon, name = settings.external_store_factory.partition(":")
        if not colon:
            raise StoreError("an external store needs an object or module:callable")
        try:
            make = getattr(importlib.import_module(module), name)
        except (ImportError, AttributeError) as e:
            raise StoreError(str(e)) from e
        store = make(settings) if make.__code__.co_argcount else make()
    if not all(callable(getattr(store, m, None)) for m in ("load", "save", "delete")):
        raise StoreError("a store needs load, save and delete")
    return store, mode
