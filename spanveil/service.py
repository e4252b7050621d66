"""Requests in, results out, as the settings say: validation, allowlists, models, stored vaults, failure policy and exposure."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.config import Settings
from spanveil.functions.crypto import key_status, scope_key
from spanveil.operators import allowlist, context, conversation, requests
from spanveil.operators.models import ModelPlan
from spanveil.operators.names import phrase
from spanveil.shared import settled
from spanveil.sources.allowlists import AllowlistFiles
from spanveil.sources.stores import build_store, change
from spanveil.streaming.session import Health, store_changes


def configured_terms(settings: Settings) -> list[str]:
    """Terms of the settings and of their JSON file; a file that can't be read gives a warning and no terms."""
    terms = list(settings.non_name_terms)
    if settings.non_name_terms_json_path:
        try:
            terms += allowlist.all_terms(json.loads(Path(settings.non_name_terms_json_path).read_text(encoding="utf-8")))
        except (OSError, ValueError) as e:
            warnings.warn(f"no terms from {settings.non_name_terms_json_path}: {e}", stacklevel=2)
    return sorted({p for t in terms if (p := phrase(t))})


@dataclass
class Service:
    """A batch service; ``streaming.session`` has the parts of a continuous one."""

    spark: SparkSession
    settings: Settings = Settings()
    contact_model: Callable | None = None
    name_model: Callable | None = None
    external_store: object | None = None

    def __post_init__(self) -> None:
        s = self.settings
        self.store, self.mode = build_store(self.spark, s, self.external_store)
        self.lists = AllowlistFiles(self.spark, s.allowlist_path, s.allowlist_max_terms) if s.allowlist_enabled and s.allowlist_path else None
        self.models = ModelPlan(s, self.contact_model, self.name_model)
        self.terms = configured_terms(s)
        self.health = Health()

    def key_status(self, given: Column) -> Column:
        """200, 401 or 503 for a request's key."""
        s = self.settings
        return key_status(given, F.lit(s.require_api_key), F.lit(s.api_key), F.lit(s.api_key_sha256))

    def process(self, incoming: DataFrame) -> DataFrame:
        """Results of requests (``sources.messages.REQUEST``): those of ``conversation.process``, and errors.

        Invalid requests have status "invalid" and their errors, and touch no
        vault. Vaults are loaded from the store and saved to it; a failure to
        save is in ``health``, and blocks the next call if the settings say so.
        """
        self.health.require(self.settings)
        s, scope = self.settings, list(conversation.SCOPE)
        checked = requests.validate(incoming)
        good = checked.where(F.size("errors") == 0)
        if self.lists is not None:
            good = allowlist.merge(good, self.lists.read())
        else:
            good = good.withColumn("terms", F.coalesce("non_name_allowlist", F.array().cast("array<string>")))
        own = F.array(*(F.lit(t) for t in self.terms)).cast("array<string>")
        closed = requests.fails_closed(F.col("failure_mode"), F.lit(s.fail_closed_default))
        rows = good.select(*scope, "seq", F.coalesce("op", F.lit("in")).alias("op"), "ts", "message", F.col("previous_assistant_message").alias("previous"), F.array_union("terms", own).alias("terms"), "new_user", closed.alias("closed"))
        stored = None
        if self.store is not None:
            keys = good.select(*scope).distinct().withColumn("scope_key", scope_key(*(F.col(c) for c in scope)))
            stored = keys.join(self.store.load(keys.select("scope_key")), "scope_key").select(*scope, "snapshot", F.lit(None).cast("double").alias("last_access"))
        results = conversation.process(rows, ttl_seconds=s.vault_ttl_seconds, models=self.models, stored=stored, with_snapshots=self.store is not None)
        if self.store is not None:
            results = settled(results)  # the store and the caller see the same evaluation
            self._keep(results)
            results = results.where("op <> 'vault'").drop("snapshot", "last_access")
        asked = good.select(*scope, "seq", F.coalesce("include_replacements", F.lit(False)).alias("_asked"))
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}")) for c in [*scope, "seq"]]
        shown = requests.exposed(F.col("r.replacements"), F.col("a._asked"), F.lit(s.allow_raw_replacements))
        joined = results.alias("r").join(asked.distinct().groupBy(*scope, "seq").agg(F.max("_asked").alias("_asked")).alias("a"), same, "left")
        out = joined.select(*(F.col(f"r.{c}") for c in results.columns if c != "replacements"), shown.alias("replacements"), F.array().cast("array<string>").alias("errors"))
        bad = checked.where(F.size("errors") > 0).select(*scope, "seq", F.coalesce("op", F.lit("in")).alias("op"), F.lit("invalid").alias("status"), "errors")
        return out.unionByName(bad, allowMissingColumns=True)

    def _keep(self, results: DataFrame) -> None:
        try:
            change(self.store, *store_changes(results, self.settings))
            self.health.failed = False
        except Exception as e:
            self.health.failures.append((len(self.health.failures), str(e)))
            self.health.failed = True

    def evict(self, accesses: DataFrame, key: str, ts: str) -> DataFrame:
        """The keys beyond the ``max_active_scopes`` accessed last; their stored vaults are deleted."""
        kept = context.most_recent(accesses, key, ts, self.settings.max_active_scopes).select(F.col(key).alias("_kept"))
        gone = accesses.select(key).distinct().join(F.broadcast(kept), F.col(key) == F.col("_kept"), "left_anti")  # max_active_scopes rows
        if self.store is not None:
            self.store.delete(gone.select(F.col(key).alias("scope_key")))
        return gone
