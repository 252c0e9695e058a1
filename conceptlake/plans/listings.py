"""Aggregations, listings, digests and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from conceptlake.operators import aggregates as agg, lifecycle
from conceptlake.plans.register import KEY, NOW_S, query

_GROUPS = "SELECT file_hash, count(*) AS n, string_agg(bundle_id || ':' || concept_id, ',' ORDER BY bundle_id, concept_id) AS members FROM concepts GROUP BY file_hash HAVING count(*) >= 2"
query("duplicate_concepts", _GROUPS, lambda c: agg.duplicate_concepts(c))
query("duplicates_of_bundle", f"{_GROUPS} AND bool_or(bundle_id = 2)", lambda c: agg.duplicate_concepts(c, bundle_id=2))
query(
    "catalog_stats",
    f"""SELECT b.bundle_id, name, coalesce(c.n, 0) AS concepts, coalesce(l.n, 0) AS links, coalesce(l.r, 0) AS resolved_links, {NOW_S} - synced_s AS sync_age_s, {NOW_S} - synced_s > 86400 AS is_stale
FROM bundles b LEFT JOIN (SELECT bundle_id, count(*) AS n FROM concepts GROUP BY 1) c USING (bundle_id)
LEFT JOIN (SELECT bundle_id, count(*) AS n, count(*) FILTER (resolved) AS r FROM links GROUP BY 1) l USING (bundle_id)""",
    lambda c: agg.catalog_stats(c, NOW_S),
)
query(
    "health",
    """SELECT '{"bundles":' || (SELECT count(*) FROM bundles) || ',"concepts":' || (SELECT count(*) FROM concepts) || ',"links":' || (SELECT count(*) FROM links)
  || ',"backend":"native","text_config":"simple","config_ok":true}' AS health""",
    lambda c: agg.health(c),
)
query("types", "SELECT DISTINCT type FROM seen", agg.types)
query(
    "type_groups",
    "SELECT CASE type WHEN 'en' THEN 'germanic' WHEN 'de' THEN 'germanic' WHEN 'fr' THEN 'romance' ELSE 'other' END AS type_group, count(*) AS n FROM concepts GROUP BY 1",
    lambda c: agg.type_groups(c, {"en": "germanic", "de": "germanic", "fr": "romance"}),
)
_LATEST = "(SELECT DISTINCT ON (bundle_id, concept_id) bundle_id, concept_id, verified_by, verified_at_s, ordinal FROM verif ORDER BY bundle_id, concept_id, verified_at_s DESC, ordinal)"
query("latest_verification", f"SELECT * FROM {_LATEST}", agg.latest_verification)
query(
    "review_queue",
    f"""SELECT bundle_id, concept_id, status, trust_tier, verified_at_s FROM (SELECT * FROM prov SEMI JOIN active USING (bundle_id)) p LEFT JOIN {_LATEST} v USING (bundle_id, concept_id)
WHERE trust_tier <> 'human-reviewed' ORDER BY verified_at_s NULLS FIRST, bundle_id, concept_id LIMIT 50""",
    agg.review_queue,
)
query("produced_by", "SELECT bundle_id, concept_id, status, trust_tier FROM prov WHERE generated_by = 'agent:3'", lambda c: agg.produced_by(c, "agent:3"))
query("verified_by", f"SELECT * FROM {_LATEST} WHERE verified_by = 'human:2'", lambda c: agg.verified_by(c, "human:2"))
query("stale_concepts", "SELECT bundle_id, concept_id, stale_after_s, status FROM prov WHERE stale_after_s < 1710000000", lambda c: agg.stale_concepts(c, 1710000000))
query("browse_page", "SELECT bundle_id, concept_id, path, type FROM seen WHERE (bundle_id, concept_id) > (4, 'doc/503') ORDER BY 1, 2 LIMIT 30", lambda c: agg.browse(c, 4, "doc/503", 30))
query("bundle_tree", "SELECT bundle_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n, min(path) AS first_path FROM concepts GROUP BY 1, 2", agg.bundle_tree)
query(
    "admin_bundles",
    "SELECT bundle_id, name, file_count, CASE WHEN retired_at IS NOT NULL THEN 'retired' WHEN NOT enabled THEN 'disabled' ELSE 'active' END AS state, tenant_id FROM bundles",
    agg.admin_bundles,
)
query(
    "page_with_total",
    "SELECT bundle_id, name, file_count, count(*) OVER () AS total FROM bundles ORDER BY file_count DESC, bundle_id LIMIT 7",
    lambda c: agg.page_with_total(c.table("bundles").select("bundle_id", "name", "file_count"), [F.col("file_count").desc(), "bundle_id"], 7),
)
query("sync_hash", "SELECT bundle_id, sha256(string_agg(path || chr(0) || file_hash || chr(10), '' ORDER BY path)) AS digest FROM concepts GROUP BY bundle_id", agg.sync_hash)
query("fleet_counts", "SELECT c.tenant_id, b.enabled AND b.retired_at IS NULL AS is_active, count(*) AS n FROM concepts c JOIN bundles b USING (bundle_id) GROUP BY ALL", agg.fleet_counts)
query(
    "pending_embeddings",
    """SELECT bundle_id, seen.concept_id, CASE WHEN e.contract IS NULL THEN 'missing' WHEN e.contract <> 'v1' THEN 'contract' ELSE 'dim' END AS reason
FROM seen LEFT JOIN emb e USING (bundle_id, concept_id) WHERE e.contract IS NULL OR e.contract <> 'v1' OR len(e.embedding) <> 64""",
    lambda c: agg.pending_embeddings(c, "v1", 64, "m1"),
)
query(
    "embedding_input",
    "SELECT bundle_id, concept_id, sha256(left(title || chr(10) || chr(10) || description || chr(10) || chr(10) || body_text, 8000)) AS input_sha FROM concepts",
    lambda c: agg.embedding_input(c.table("concepts")).select(*KEY, F.sha2("input", 256).alias("input_sha")),
)
query(
    "capped_changes",
    """SELECT batch, kind, max(n) AS n, string_agg(id, ',' ORDER BY id) AS ids, max(n) > 16 AS truncated FROM (
  SELECT concept_id AS batch, change_kind AS kind, title || event_id AS id, row_number() OVER (PARTITION BY concept_id, change_kind ORDER BY title || event_id) AS r,
    count(*) OVER (PARTITION BY concept_id, change_kind) AS n FROM changes) WHERE r <= 16 GROUP BY batch, kind""",
    lambda c: agg.capped_changes(c.table("changes").select(F.col("concept_id").alias("batch"), F.col("change_kind").alias("kind"), F.concat("title", "event_id").alias("concept_id")), 16).withColumn("ids", F.array_join("ids", ",")),
)
query("tenant_view", "SELECT bundle_id, count(*) AS n FROM concepts WHERE tenant_id = 't1' GROUP BY 1", lambda c: c.for_tenant("t1").table("concepts").groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n")))
query("tenant_required", "SELECT count(*) AS n FROM concepts WHERE false", lambda c: c.for_tenant(None, require=True).table("concepts").agg(F.count(F.lit(1)).alias("n")))
query(
    "tenant_by_bundle",
    "SELECT relation_type, count(*) AS n FROM rels SEMI JOIN (SELECT * FROM bundles WHERE tenant_id = 't1') b ON sb = b.bundle_id GROUP BY 1",
    lambda c: c.for_tenant("t1").table("relationships").groupBy("relation_type").agg(F.count(F.lit(1)).alias("n")),
)
query(
    "purgeable_bundles", "SELECT bundle_id FROM bundles WHERE retired_at < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 7 DAY", lambda c: lifecycle.purgeable(c.table("bundles"), "2024-02-01 00:00:00"),
)
