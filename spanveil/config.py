"""Settings, read once on the driver; executors get them as plain values."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from spanveil.lexicon import MODEL_LABELS

TRUE = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Settings:
    api_key: str = ""
    api_key_sha256: str = ""
    require_api_key: bool = True
    fail_closed_default: bool = True
    allow_raw_replacements: bool = False
    use_contact_model: bool = True
    require_contact_model: bool = False
    use_name_model: bool = True
    require_name_model: bool = False
    name_model: str = ""
    name_model_threshold: float = 0.75
    name_model_labels: tuple[str, ...] = MODEL_LABELS
    non_name_terms: tuple[str, ...] = ()
    non_name_terms_json_path: str = ""
    vault_ttl_seconds: int = 3600
    max_active_scopes: int = 15
    persistence_mode: str = "none"
    persistence_key_version: str = "v1"
    require_persistence: bool = False
    persistence_block_on_error: bool = True
    persistence_master_key: str = ""
    internal_store: str = "table"
    store_path: str = ""
    external_store_factory: str = ""
    allowlist_enabled: bool = True
    allowlist_path: str = ""
    allowlist_max_terms: int = 50_000

    # Clamps: the least value a number may take.
    LEAST = {"vault_ttl_seconds": 60, "max_active_scopes": 1, "allowlist_max_terms": 100}


def parse(value: str | None, default):
    """``value`` as the type of ``default``; the default if it is missing or can't be read."""
    if value is None:
        return default
    if isinstance(default, bool):
        return value.strip().lower() in TRUE
    if isinstance(default, (int, float)):
        try:
            return type(default)(value)
        except ValueError:
            return default
    if isinstance(default, tuple):
        return tuple(p.strip() for p in value.split(",") if p.strip()) or default
    return value.strip() or default


def load(env: Mapping[str, str] | None = None, prefix: str = "SPANVEIL_") -> Settings:
    """Settings from variables such as SPANVEIL_VAULT_TTL_SECONDS."""
    env = os.environ if env is None else env
    given = {}
    for name, f in Settings.__dataclass_fields__.items():
        value = parse(env.get(prefix + name.upper()), f.default)
        given[name] = max(Settings.LEAST[name], value) if name in Settings.LEAST else value
    return Settings(**given)
