"""The catalog: named tables behind one accessor that applies tenancy."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from conceptlake.errors import InvalidParameter

#: Tables whose rows belong to no tenant.
SHARED = frozenset({"config"})


@dataclass
class Catalog:
    """Tables by name. With ``tenant`` set only its rows can be read; ``require_tenant`` forbids reading without one.

    ``text_config`` is the text search configuration (``english``: stems without stop words, or ``simple``) and
    ``search_backend`` the ranking that ``ranked_search`` asks for (``native`` or ``bm25``).
    """

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    tenant: str | None = None
    require_tenant: bool = False
    text_config: str = "english"
    search_backend: str = "native"

    def table(self, name: str) -> DataFrame:
        """The only way to a table: rows of other tenants are never seen.

        Every table belongs to tenants but those of ``SHARED``: by its tenant_id, or by its bundle. One that has neither
        can't be read by a tenant, or where a tenant is required.
        """
        if name not in self.tables:
            raise InvalidParameter(f"no table {name!r}")
        df = self.tables[name]
        if name in SHARED or (self.tenant is None and not self.require_tenant):
            return df
        bundle = next((c for c in ("bundle_id", "source_bundle_id") if c in df.columns), None)
        if "tenant_id" not in df.columns and (bundle is None or name == "bundles"):
            raise InvalidParameter(f"table {name!r} has no tenant")
        if self.tenant is None:
            return df.where(F.lit(False))
        if "tenant_id" in df.columns:
            return df.where(F.col("tenant_id") == self.tenant)
        own = self.tables["bundles"].where(F.col("tenant_id") == self.tenant).select(F.col("bundle_id").alias(bundle))
        return df.join(own, bundle, "left_semi")

    def active_bundles(self) -> DataFrame:
        """Bundles that readers see: enabled and not retired."""
        return self.table("bundles").where(active())

    def for_tenant(self, tenant: str | None, require: bool = False) -> Catalog:
        return replace(self, tenant=tenant, require_tenant=require)

    def of_active(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` (with bundle_id) whose bundle is active. Bundles are few against their rows; Spark broadcasts
        them while they are under its own size threshold, and joins by shuffle beyond."""
        return df.join(self.active_bundles().select("bundle_id"), "bundle_id", "left_semi")


def active() -> Column:
    return F.col("enabled") & F.col("retired_at").isNull()
