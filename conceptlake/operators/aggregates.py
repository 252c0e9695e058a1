"""Aggregations, listings and digests over the catalog."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from conceptlake.catalog import Catalog
from conceptlake.errors import bounded

KEY = ["bundle_id", "concept_id"]


def duplicate_concepts(catalog: Catalog, bundle_id: int | None = None, min_group: int = 2) -> DataFrame:
    """(file_hash, n, members) of contents held more than once; every bundle counts, enabled or not.

    Groups are counted first (with map-side sums); only members of groups that qualify are gathered. A group of very many
    copies is a long array by contract: callers that can't hold it should read ``duplicate_members``.
    """
    members = duplicate_members(catalog, bundle_id, min_group)
    return members.groupBy("file_hash").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bundle_id", "concept_id"))), lambda s: F.concat_ws(":", s["bundle_id"], s["concept_id"])), ",").alias("members"))


def duplicate_members(catalog: Catalog, bundle_id: int | None = None, min_group: int = 2) -> DataFrame:
    """(file_hash, bundle_id, concept_id) of all members of duplicate groups."""
    bounded("min_group", min_group, 1)
    rows = catalog.table("concepts").select("file_hash", *KEY)
    big = rows.groupBy("file_hash").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("bundle_id") == F.lit(bundle_id)) if bundle_id is not None else F.lit(True)).alias("touches"))
    return rows.join(big.where((F.col("n") >= min_group) & F.col("touches")).select("file_hash"), "file_hash", "left_semi")


def catalog_stats(catalog: Catalog, now_s: int) -> DataFrame:
    """Per bundle, retired ones too: concepts, links, resolved links, age of the last sync, stale after 24 hours."""
    concepts = catalog.table("concepts").groupBy("bundle_id").agg(F.count(F.lit(1)).alias("concepts"))
    links = catalog.table("links").groupBy("bundle_id").agg(F.count(F.lit(1)).alias("links"), F.count_if("resolved").alias("resolved_links"))
    age = F.lit(now_s) - F.unix_seconds("last_synced_at")
    return catalog.table("bundles").join(concepts, "bundle_id", "left").join(links, "bundle_id", "left").select("bundle_id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("concepts", "links", "resolved_links")], age.alias("sync_age_s"), (age > 86400).alias("is_stale"))


def health(catalog: Catalog, tables: tuple[str, ...] = ("bundles", "concepts", "links")) -> DataFrame:
    """One row: counts of tables, the search configuration and backend, and whether settings are known values, as JSON."""
    counted = [catalog.table(t).agg(F.count(F.lit(1)).alias(t)) for t in tables]
    row = reduce(lambda a, b: a.crossJoin(b), counted)  # single rows
    known = catalog.search_backend in ("native", "bm25") and catalog.text_config in ("english", "simple")
    return row.select(F.to_json(F.struct(*tables, F.lit(catalog.search_backend).alias("backend"), F.lit(catalog.text_config).alias("text_config"), F.lit(known).alias("config_ok"))).alias("health"))


def types(catalog: Catalog) -> DataFrame:
    return catalog.of_active(catalog.table("concepts")).select("type").distinct()


def type_groups(catalog: Catalog, groups: dict[str, str]) -> DataFrame:
    """Concepts of each group of types; unknown types are 'other'."""
    group = F.coalesce(*[F.when(F.col("type") == t, g) for t, g in groups.items()], F.lit("other"))
    return catalog.table("concepts").groupBy(group.alias("type_group")).agg(F.count(F.lit(1)).alias("n"))


def merge_facets(*facets: DataFrame) -> DataFrame:
    """Counts per value over several facet results."""
    every = facets[0]
    for f in facets[1:]:
        every = every.unionByName(f)
    return every.groupBy("value").agg(F.sum("n").alias("n"))


def latest_verification(catalog: Catalog) -> DataFrame:
    """The newest verification of each concept (ties: the smallest ordinal)."""
    newest = F.max_by(F.struct("verified_by", "verified_at_s", "ordinal"), F.struct("verified_at_s", -F.col("ordinal"))).alias("v")
    return catalog.table("concept_verification").groupBy(*KEY).agg(newest).select(*KEY, "v.verified_by", "v.verified_at_s", "v.ordinal")


def review_queue(catalog: Catalog, limit: int = 50) -> DataFrame:
    """Concepts with provenance, those never verified first, then by oldest verification."""
    prov = catalog.of_active(catalog.table("concept_provenance")).where("trust_tier <> 'human-reviewed'")
    latest = latest_verification(catalog).select(*KEY, "verified_at_s")
    return prov.join(latest, KEY, "left").select(*KEY, "status", "trust_tier", "verified_at_s").orderBy(F.col("verified_at_s").asc_nulls_first(), *KEY).limit(limit)


def produced_by(catalog: Catalog, producer: str) -> DataFrame:
    return catalog.table("concept_provenance").where(F.col("generated_by") == producer).select(*KEY, "status", "trust_tier")


def verified_by(catalog: Catalog, who: str) -> DataFrame:
    return latest_verification(catalog).where(F.col("verified_by") == who)


def stale_concepts(catalog: Catalog, as_of_s: int, bundle_id: int | None = None) -> DataFrame:
    """Concepts whose stale_after lies before ``as_of_s``; no look at whether the bundle is active."""
    rows = catalog.table("concept_provenance").where(F.col("stale_after_s") < as_of_s)
    rows = rows if bundle_id is None else rows.where(F.col("bundle_id") == bundle_id)
    return rows.select(*KEY, "stale_after_s", "status").orderBy("stale_after_s", *KEY)


def browse(catalog: Catalog, after_bundle: int | None = None, after_concept: str | None = None, limit: int = 20) -> DataFrame:
    """A page in ascending (bundle_id, concept_id) behind the given row."""
    rows = catalog.of_active(catalog.table("concepts"))
    if after_bundle is not None:
        rows = rows.where((F.col("bundle_id") > after_bundle) | ((F.col("bundle_id") == after_bundle) & (F.col("concept_id") > after_concept)))
    return rows.select(*KEY, "path", "type").orderBy(*KEY).limit(limit)


def bundle_tree(catalog: Catalog) -> DataFrame:
    """Concepts of each bundle and folder."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return catalog.table("concepts").groupBy("bundle_id", folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


def admin_bundles(catalog: Catalog) -> DataFrame:
    state = F.when(F.col("retired_at").isNotNull(), "retired").when(~F.col("enabled"), "disabled").otherwise("active")
    return catalog.table("bundles").select("bundle_id", "name", "file_count", state.alias("state"), "tenant_id")


def page_with_total(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows with the number of all rows: the total is an aggregate joined on, not a one-task window."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))


def digest(rows: DataFrame, group: str, order: str | list[str], line: Column, head: Column | None = None, *, between: str = "", as_bytes: Callable[[Any], bytes] = str.encode, count: Column | None = None) -> DataFrame:
    """(group, digest, n): SHA-256 over ``head`` and the group's lines in order, ``between`` between them; n is the sum of
    ``count``, else the number of rows. A line that is null adds nothing, a head that is null gives no digest.

    A task streams its groups' sorted lines through the hash, so a group of any size takes constant memory; as one hash
    asks, a group is in one task. Rows are dealt by a hash of the group: by the group itself, a join on it below would stand
    for this exchange, and AQE, which doesn't know what ``mapInArrow`` asks for, could then split or read it locally.
    """
    head = F.lit("") if head is None else head
    kind = rows.schema[group].dataType
    by = [f"o{i}" for i in range(len([order] if isinstance(order, str) else order))]
    orders = [F.col(c).alias(o) for c, o in zip([order] if isinstance(order, str) else order, by, strict=True)]
    lines = rows.select(F.col(group).alias("g"), *orders, line.alias("line"), head.alias("head"), (F.lit(1) if count is None else count).cast("long").alias("n"))
    lines = lines.repartition(F.xxhash64("g")).sortWithinPartitions("g", *by)
    schema = T.StructType([T.StructField(group, kind), T.StructField("digest", T.StringType()), T.StructField("n", T.LongType())])
    gap = between.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n, begun, opened = None, None, 0, False, False
        out: list[tuple] = []
        for batch in batches:
            for g, text, first, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not opened or g != now:
                    if opened:
                        out.append((now, state and state.hexdigest(), n))
                    now, state, n, begun, opened = g, None if first is None else hashlib.sha256(first.encode()), 0, False, True
                n += more
                if state is not None and text is not None:
                    state.update((gap if begun else b"") + as_bytes(text))
                    begun = True
        if opened:
            out.append((now, state and state.hexdigest(), n))
        if out:
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (to_arrow_type(kind), pa.string(), pa.int64()), strict=True)], names=[group, "digest", "n"])

    return lines.select("g", "line", "head", "n").mapInArrow(run, schema)


def sync_hash(catalog: Catalog) -> DataFrame:
    """Per bundle: the hash of its files, each path NUL file hash LF in path order; reserved files don't count."""
    files = catalog.table("concepts").where(~F.element_at(F.split("path", "/"), -1).isin("index.md", "log.md"))
    return digest(files, "bundle_id", "path", F.concat("path", F.lit("\0"), "file_hash", F.lit("\n"))).drop("n")


def capped_changes(changes: DataFrame, cap: int = 256) -> DataFrame:
    """Per event and kind: how many changes, the first ``cap`` ids, whether there were more.

    Ids beyond the cap are dropped by contract, before they are shuffled; the count is of all.
    """
    counts = changes.groupBy("batch", "kind").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("batch", "kind").orderBy("concept_id")
    first = changes.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap).groupBy("batch", "kind").agg(F.array_sort(F.collect_list("concept_id")).alias("ids"))
    return counts.join(first, ["batch", "kind"]).select("batch", "kind", "n", "ids", (F.col("n") > cap).alias("truncated"))


def fleet_counts(catalog: Catalog) -> DataFrame:
    """Concepts per tenant and whether their bundle is active."""
    marks = catalog.table("bundles").select("bundle_id", (F.col("enabled") & F.col("retired_at").isNull()).alias("is_active"))
    return catalog.table("concepts").join(marks, "bundle_id").groupBy("tenant_id", "is_active").agg(F.count(F.lit(1)).alias("n"))


def pending_embeddings(catalog: Catalog, contract: str, dim: int, model: str | None = None) -> DataFrame:
    """Concepts whose embedding is missing, of another contract, model or dimension, or of other bytes, with the reason."""
    rows = catalog.table("concept_embedding")
    col = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    have = rows.select(*KEY, "contract", F.size("embedding").alias("dim"), col("model").alias("model"), col("source_file_hash").alias("made_from"), F.lit(True).alias("has"))
    reason = F.when(F.col("has").isNull(), "missing").when(~F.col("contract").eqNullSafe(F.lit(contract)), "contract").when(F.col("dim") != dim, "dim")
    if model is not None:
        reason = reason.when(~F.col("model").eqNullSafe(F.lit(model)), "model")
    reason = reason.when(F.col("made_from").isNotNull() & (F.col("made_from") != F.col("file_hash")), "file")
    return catalog.of_active(catalog.table("concepts")).select(*KEY, "file_hash").join(have, KEY, "left").select(*KEY, reason.alias("reason")).where("reason IS NOT NULL")


def embedding_input(concepts: DataFrame, max_chars: int = 8000) -> DataFrame:
    """Title, description and body, blank lines between, cut to ``max_chars``."""
    return concepts.select(*KEY, F.left(F.concat_ws("\n\n", "title", "description", "body_text"), F.lit(max_chars)).alias("input"))
