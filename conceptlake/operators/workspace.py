"""Workspace reads: one concept, ranked selections, lock files against the live catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from conceptlake.catalog import Catalog
from conceptlake.operators.search import filtered

KEY = ["bundle_id", "concept_id"]


def get_concept(catalog: Catalog, concept_id: str, bundle_id: int | None = None) -> DataFrame:
    """A concept's page: its fields with provenance, links in and out counted."""
    rows = catalog.of_active(catalog.table("concepts")).where(F.col("concept_id") == concept_id)
    rows = rows if bundle_id is None else rows.where(F.col("bundle_id") == bundle_id)
    links = catalog.table("links")
    out = links.where(F.col("source_id") == concept_id).agg(F.count(F.lit(1)).alias("links_out"))
    back = links.where((F.col("target_id") == concept_id) & F.col("resolved")).agg(F.count(F.lit(1)).alias("links_in"))
    prov = catalog.table("concept_provenance").select(*KEY, "status", "trust_tier")
    return rows.join(prov, KEY, "left").crossJoin(out).crossJoin(back).select(*KEY, "path", "type", "title", "status", "trust_tier", "links_out", "links_in")  # the counts are one row each


def select(catalog: Catalog, picks: list[str], *, tiers: list[str] | None = None, limit: int = 50, **filters) -> DataFrame:
    """Picks first, in their order, then concepts under the filters of trusted tiers; each once at its first place."""
    spark = catalog.spark
    live = catalog.of_active(catalog.table("concepts"))
    named = spark.createDataFrame([(p, i) for i, p in enumerate(picks)], "concept_id string, place long")
    chosen = live.join(F.broadcast(named), "concept_id").select(*KEY, "place")
    rest = filtered(catalog, **filters).select(*KEY)
    if tiers:
        rest = rest.join(catalog.table("concept_provenance").where(F.col("trust_tier").isin(tiers)).select(*KEY), KEY, "left_semi")
    every = chosen.unionByName(rest.withColumn("place", F.lit(len(picks)).cast("long")))
    return every.groupBy(*KEY).agg(F.min("place").alias("place")).orderBy("place", *KEY).limit(limit)


def check_lock(lock: DataFrame, catalog: Catalog) -> DataFrame:
    """State of each pinned (bundle_id, concept_id, file_hash): current, stale, retired or unknown."""
    live = catalog.table("concepts").select(*KEY, F.col("file_hash").alias("__now"))
    homes = catalog.table("bundles").select("bundle_id", (F.col("enabled") & F.col("retired_at").isNull()).alias("__on"))
    state = F.when(F.col("__now").isNull(), "unknown").when(~F.col("__on"), "retired").when(F.col("__now") == F.col("file_hash"), "current").otherwise("stale")
    return lock.join(live, KEY, "left").join(homes, "bundle_id", "left").select(*KEY, state.alias("state"))
