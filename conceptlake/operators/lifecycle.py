"""Bundle lifecycle and configuration: copy-on-write functions over the tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, functions as F

from conceptlake.catalog import Catalog
from conceptlake.errors import InvalidParameter, NotFound


def known(bundles: DataFrame, bundle_id: int) -> DataFrame:
    """``bundles`` if the bundle is one of them; an unknown id is an error, not a change of nothing."""
    if bundles.where(F.col("bundle_id") == bundle_id).limit(1).isEmpty():
        raise NotFound(f"no bundle {bundle_id}")
    return bundles


def set_enabled(bundles: DataFrame, bundle_id: int, enabled: bool) -> DataFrame:
    return known(bundles, bundle_id).withColumn("enabled", F.when(F.col("bundle_id") == bundle_id, F.lit(enabled)).otherwise(F.col("enabled")))


def retire(bundles: DataFrame, bundle_id: int, at: str) -> DataFrame:
    """Idempotent: a retired bundle keeps its first date."""
    hit = (F.col("bundle_id") == bundle_id) & F.col("retired_at").isNull()
    return known(bundles, bundle_id).withColumn("retired_at", F.when(hit, F.lit(at).cast("timestamp")).otherwise(F.col("retired_at")))


def unretire(bundles: DataFrame, bundle_id: int) -> DataFrame:
    return known(bundles, bundle_id).withColumn("retired_at", F.when(F.col("bundle_id") != bundle_id, F.col("retired_at")))


def unregister(tables: dict[str, DataFrame], bundle_id: int) -> dict[str, DataFrame]:
    """All tables without the bundle's rows; relationships of others that point to it are unresolved."""
    known(tables["bundles"], bundle_id)
    out = {}
    for name, t in tables.items():
        own = next((c for c in ("bundle_id", "source_bundle_id") if c in t.columns), None)
        out[name] = t if own is None else t.where(F.col(own) != bundle_id)
        if {"target_bundle_id", "unresolved"} <= set(t.columns):
            out[name] = out[name].withColumn("unresolved", F.col("unresolved") | F.col("target_bundle_id").eqNullSafe(F.lit(bundle_id)))
    return out


def purgeable(bundles: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Retired bundles older than the grace period."""
    return bundles.where(F.col("retired_at") < F.expr(f"timestamp'{now}' - interval {int(days)} days")).select("bundle_id")


#: What some settings may be.
CHOICES = {"search_backend": ("native", "bm25"), "okf_version_policy": ("warn", "reject"), "bm25_provider": ("auto", "pg_search", "pg_textsearch"), "default_text_search_config": ("pg_catalog.english", "pg_catalog.simple")}


@dataclass(frozen=True)
class Config:
    """Policy keys with their defaults."""

    allowed_roots: tuple = ()
    default_text_search_config: str = "pg_catalog.english"
    default_strict: bool = True
    sync_log_retention_days: int = 30
    default_exclude: tuple = ()
    store_source: bool = False
    search_backend: str = "native"
    notify_channel: str = ""
    okf_version_policy: str = "warn"
    embedding_dim: int = 1536
    track_history: bool = False
    history_retention_days: int = 0
    bm25_provider: str = "auto"
    require_tenant: bool = False
    change_event_retention_days: int = 30
    embedding_model: str = ""
    embedding_contract: str = ""

    def set(self, key: str, value) -> Config:
        kinds = {f.name: type(f.default) for f in fields(self)}
        if key not in kinds:
            raise InvalidParameter(f"no setting {key!r}")
        value = tuple(value) if kinds[key] is tuple and isinstance(value, list) else value
        if type(value) is not kinds[key] or (kinds[key] is int and value < 0) or (kinds[key] is tuple and not all(isinstance(x, str) for x in value)):
            raise InvalidParameter(f"{key} must be a {kinds[key].__name__}, not {value!r}")
        if key in CHOICES and value not in CHOICES[key]:
            raise InvalidParameter(f"{key} must be one of {CHOICES[key]}, not {value!r}")
        if key == "embedding_dim" and not 1 <= value <= 16000:
            raise InvalidParameter("embedding_dim must be from 1 to 16000")
        if key == "notify_channel" and not re.fullmatch(r"([A-Za-z_][A-Za-z0-9_]{0,62})?", value):
            raise InvalidParameter("notify_channel must be an identifier of at most 63 characters, or empty")
        return replace(self, **{key: value})

    def reset(self, key: str | None = None) -> Config:
        return Config() if key is None else self.set(key, getattr(Config(), key, None))

    def apply(self, catalog: Catalog) -> Catalog:
        """The catalog as operators read it under these settings."""
        return replace(catalog, require_tenant=self.require_tenant, search_backend=self.search_backend, text_config=self.default_text_search_config.removeprefix("pg_catalog."))


def embedding_changed(before: Config, after: Config) -> bool:
    """Whether a change of settings makes all embeddings' bundles stale."""
    return any(getattr(before, k) != getattr(after, k) for k in ("embedding_dim", "embedding_model", "embedding_contract"))


def stale_embeddings(catalog: Catalog, before: Config, after: Config) -> DataFrame:
    """(bundle_id) of the bundles to mark stale, with reason embedding_contract_changed: those that have embeddings."""
    rows = catalog.table("concept_embedding").select("bundle_id").distinct()
    return rows if embedding_changed(before, after) else rows.where(F.lit(False))
