"""Delivery of changes, packages, provenance, embeddings and workspaces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from conceptlake.catalog import Catalog
from conceptlake.operators import aggregates as agg, embeddings, packages, provenance, workspace
from conceptlake.plans.register import AT_US, KEY, query
from conceptlake.session import scratch_dir
from conceptlake.sources import bundle
from conceptlake.sources.testdata import read
from conceptlake.streaming import outbox


def waiting(c: Catalog) -> DataFrame:
    claimed = F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 200).alias("claimed_until")
    return c.table("changes").select("event_id", F.col("title").alias("operation"), "concept_id", "at_us", (F.col("event_id") % 3 == 0).alias("acked"), claimed, F.lit(None).cast("string").alias("claimed_by"), (F.col("event_id") % 4).cast("int").alias("attempts"))


query(
    "outbox_claim",
    """SELECT event_id, title AS operation, (event_id % 4)::INT + 1 AS attempts FROM changes
WHERE event_id % 3 <> 0 AND (event_id % 5 <> 0 OR event_id % 200 <= 100) ORDER BY event_id LIMIT 500""",
    lambda c: outbox.claim(waiting(c), "me", 100, limit=500)[0].select("event_id", "operation", "attempts"),
)
query(
    "outbox_pending",
    "SELECT title AS operation, count(*) AS n, min(event_id) AS oldest FROM changes WHERE event_id % 3 <> 0 GROUP BY 1",
    lambda c: outbox.pending(waiting(c)).groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("oldest")),
)
query("outbox_prune", f"SELECT count(*) AS kept FROM changes WHERE NOT (event_id % 3 = 0 AND at_us < {AT_US})", lambda c: outbox.prune(waiting(c), AT_US).agg(F.count(F.lit(1)).alias("kept")))


def stream_latest(c: Catalog, d: str) -> DataFrame:
    """Events written to an outbox, read as a stream by micro-batches, folded to each concept's newest event."""
    base = f"{scratch_dir(c.spark)}/outbox-{uuid.uuid4().hex}"
    at = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) AS at_us"
    events = read(c.spark, d, "events").selectExpr("event_id", "user_id AS bundle_id", "event_type AS operation", "concat('user/', user_id) AS concept_id", at, "cast(null AS string) AS causation")
    for part in range(2):
        outbox.append(events.where(F.col("event_id") % 2 == part), f"{base}/events")

    def handle(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("bundle_id", "concept_id").agg(F.max_by(F.struct("event_id", "operation"), "event_id").alias("e"))
        newest.write.mode("overwrite").parquet(f"{base}/seen/batch={number}")  # the same number overwrites itself

    outbox.deliver(outbox.read_stream(c.spark, f"{base}/events", 1), handle, f"{base}/checkpoint").awaitTermination()
    order = Window.partitionBy("bundle_id", "concept_id").orderBy(F.col("e.event_id").desc())
    seen = c.spark.read.parquet(f"{base}/seen").withColumn("r", F.row_number().over(order))
    return seen.where("r = 1").select("bundle_id", "concept_id", "e.event_id", "e.operation")


query("stream_latest", "SELECT user_id AS bundle_id, 'user/' || user_id AS concept_id, max(event_id) AS event_id, max_by(event_type, event_id) AS operation FROM events GROUP BY ALL", stream_latest)

# --- packages: a file for each document, every 50th a manifest, its neighbours beside or below it

_FILE = """CASE WHEN doc_id % 50 = 0 THEN '/SKILL.md' WHEN doc_id % 50 = 5 THEN '/index.md' WHEN doc_id % 10 = 1 THEN concat('/scripts/run', doc_id, '.py') WHEN doc_id % 10 = 2 THEN concat('/scripts/sub/go', doc_id, '.sh')
  WHEN doc_id % 10 = 3 THEN concat('/references/r', doc_id, '.md') WHEN doc_id % 10 = 4 THEN concat('/assets/a', doc_id, '.png') WHEN doc_id % 10 = 7 THEN concat('/x', doc_id, '.bin')
  WHEN doc_id % 10 > 7 THEN concat('/scripts', doc_id, '.md') ELSE concat('/notes/n', doc_id, '.md') END"""


def files(c: Catalog) -> DataFrame:
    return c.table("concepts").selectExpr(f"concat('pkg/', doc_id div 50, {_FILE}) AS path", "file_hash", "doc_id", "cast(body_text AS binary) AS content")


def classified(c: Catalog) -> DataFrame:
    return packages.classify(files(c).drop("content"))


KINDS = f"""(SELECT 'pkg/' || (doc_id // 50) || {_FILE} AS path, file_hash, doc_id, body_text, 'pkg/' || (doc_id // 50) AS package,
  CASE WHEN doc_id % 10 IN (1, 2, 3, 4) THEN 'resource' WHEN doc_id % 50 = 5 THEN 'reserved' WHEN doc_id % 50 = 0 THEN 'manifest' WHEN doc_id % 10 = 7 THEN 'ignored' ELSE 'document' END AS kind,
  CASE doc_id % 10 WHEN 1 THEN 'script' WHEN 2 THEN 'script' WHEN 3 THEN 'reference' WHEN 4 THEN 'asset' END AS role, CASE doc_id % 10 WHEN 1 THEN 'python' WHEN 2 THEN 'shell' END AS language,
  CASE doc_id % 10 WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN 'application/octet-stream' WHEN 4 THEN 'image/png' WHEN 7 THEN 'application/octet-stream' ELSE 'text/markdown' END AS media_type FROM concepts)"""
query(
    "package_classify", f"SELECT path, package, kind, coalesce(role, '-') AS role, coalesce(language, '-') AS language, media_type FROM {KINDS}",
    lambda c: classified(c).fillna("-", ["role", "language"]),
)
query(
    "package_membership", f"SELECT package, path, CASE role WHEN 'reference' THEN 'REFERENCES' ELSE 'USES' END AS relation FROM {KINDS} WHERE kind = 'resource'",
    lambda c: packages.membership(classified(c)),
)
query(
    "package_hash",
    f"""SELECT package, sha256('package:v1' || chr(10) || '1' || chr(10) || '1' || chr(10) || max(file_hash) FILTER (kind = 'manifest') || chr(10)
  || coalesce(string_agg(role || chr(0) || substr(path, length(package) + 2) || chr(0) || file_hash || chr(10), '' ORDER BY path) FILTER (kind = 'resource'), '')) AS package_hash, count(*) AS files
FROM {KINDS} WHERE kind IN ('resource', 'manifest') GROUP BY package""",
    lambda c: packages.package_hash(classified(c), files(c).select("path", "file_hash")),
)


def visible(c: Catalog) -> DataFrame:
    """Every sixth file is private, manifests of odd packages internal, the other manifests public."""
    said = files(c).selectExpr("path", "CASE WHEN doc_id % 100 = 50 THEN 'internal' WHEN doc_id % 6 = 1 THEN 'private' WHEN doc_id % 50 = 0 THEN 'public' END AS visibility")
    return packages.propagate_visibility(classified(c), said.where("visibility IS NOT NULL"))


query(
    "package_visibility",
    f"SELECT path, package, CASE WHEN doc_id % 6 = 1 THEN 'private' WHEN doc_id // 50 % 2 = 1 THEN 'internal' WHEN doc_id // 50 * 50 % 6 = 1 THEN 'private' ELSE 'public' END AS visibility FROM {KINDS} WHERE kind = 'resource'",
    visible,
)
query(
    "package_skill",
    f"""SELECT package, '[' || string_agg('{{"path":"' || path || '","role":"' || role || '","media_type":"' || media_type || '"}}', ',' ORDER BY path) || ']' AS resources
FROM {KINDS} WHERE kind = 'resource' AND package = 'pkg/1' GROUP BY package""",
    lambda c: packages.get_skill(classified(c), "pkg/1"),
)
_BYTES = f"strlen(body_text) AS byte_size, sha256(body_text) AS sha256 FROM {KINDS}"
query("package_script", f"SELECT path, package, language, {_BYTES} WHERE path = 'pkg/1/scripts/run51.py'", lambda c: packages.get_script(classified(c), files(c), "pkg/1/scripts/run51.py").drop("content"))
query("package_reference", f"SELECT path, package, media_type, {_BYTES} WHERE path = 'pkg/1/references/r53.md'", lambda c: packages.get_reference(classified(c), files(c), "pkg/1/references/r53.md", False).drop("content"))

# --- provenance

_VERIFIED = {
    0: "[]", 1: '[{"by":"bot","at":"2024-01-01"}]', 2: '[{"by":"bot"},{"by":"human:a","at":"2024-01-02T00:00:60Z"}]', 3: '{"by":"human:b","at":"2024-01-03"}', 4: '[{"at":"2024-01-01"},{"by":" "},{"by":"bot"}]',
}


def fronts(c: Catalog) -> DataFrame:
    stale = "concat('2024-0', doc_id % 9 + 1, '-1', doc_id % 10, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'T05:06:07Z' WHEN 2 THEN ' 10:30+02:00' ELSE 'T99:00' END)"
    verified = "CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _VERIFIED.items()) + " END"
    made = f"""concat('{{"status":"', CASE WHEN doc_id % 2 = 0 THEN 'stable' ELSE 'draft' END, '","stale_after":"', {stale}, '","generated":{{"by":"agent:', doc_id % 5, '","at":"2023-12-31"}},"verified":', {verified}, '}}')"""
    return c.table("concepts").selectExpr("bundle_id", "concept_id", f"{made} AS front")


query(
    "provenance_projection",
    """SELECT bundle_id, concept_id, 'agent:' || (doc_id % 5) AS generated_by, 1703980800 AS generated_at_s, CASE WHEN doc_id % 2 = 0 THEN 'stable' ELSE 'draft' END AS status,
  coalesce(epoch(make_date(2024, CAST(doc_id % 9 + 1 AS INT), CAST(10 + doc_id % 10 AS INT)))::BIGINT + CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 18367 WHEN 2 THEN 30600 END, -1) AS stale_after_s,
  CASE doc_id % 5 WHEN 0 THEN 'unverified' WHEN 1 THEN 'machine-confirmed' WHEN 4 THEN 'machine-confirmed' ELSE 'human-reviewed' END AS trust_tier FROM concepts""",
    lambda c: provenance.project(fronts(c), KEY)["concept_provenance"].select(*KEY, "generated_by", "generated_at_s", "status", F.coalesce("stale_after_s", F.lit(-1)).alias("stale_after_s"), "trust_tier"),
)
query(
    "provenance_verifications",
    """SELECT bundle_id, concept_id, ordinal, verified_by, verified_at_s FROM concepts JOIN (VALUES (1, 0, 'bot', 1704067200), (2, 0, 'bot', -1), (2, 1, 'human:a', 1704153660), (3, 0, 'human:b', 1704240000),
  (4, 2, 'bot', -1)) v(k, ordinal, verified_by, verified_at_s) ON doc_id % 5 = k""",
    lambda c: provenance.project(fronts(c), KEY)["concept_verification"].withColumn("verified_at_s", F.coalesce("verified_at_s", F.lit(-1))),
)
_LINE = r"trim(regexp_replace(l[i], '^\s*(#+\s*|[-*+]\s+)', ''))"
query(
    "bundle_log",
    f"""SELECT doc_id, i - 1 AS at, -1 AS logged_at_s, {_LINE} AS entry
FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE {_LINE} <> ''""",
    lambda c, d: provenance.log_entries(read(c.spark, d, "documents"), ["doc_id"]).withColumn("logged_at_s", F.coalesce("logged_at_s", F.lit(-1))),
)

# --- links by path or id: targets named by path, by id, by both, outside, or gone

_TARGET = "concat('doc/', (doc_id * 7 + 3) % 1200)"


def resolved(c: Catalog) -> DataFrame:
    """Concepts of every fourth document have a path of their own; each document links to one other."""
    concepts = c.table("concepts").selectExpr("1L AS bundle_id", "concept_id", "CASE WHEN doc_id % 4 = 0 THEN concat('moved/', doc_id, '.md') ELSE path END AS path")
    links = c.table("concepts").selectExpr("1L AS bundle_id", "concept_id AS source_id", f"{_TARGET} AS target_id", "CASE WHEN (doc_id * 7 + 3) % 8 = 0 THEN concat('moved/', (doc_id * 7 + 3) % 1200 + 4, '.md') ELSE 'none.md' END AS target_path", "doc_id % 9 = 0 AS is_external")
    return bundle.resolve_links(links, concepts).select("source_id", F.coalesce("target_id", F.lit("-")).alias("target_id"), "resolved")


query(
    "resolve_links",
    """SELECT source_id, CASE WHEN r THEN coalesce(pc, ic) ELSE '-' END AS target_id, r AS resolved FROM (
  SELECT l.source_id, p.concept_id AS pc, i.concept_id AS ic, NOT l.ext AND (p.concept_id IS NOT NULL OR i.concept_id IS NOT NULL) AS r FROM
  (SELECT concept_id AS source_id, 'doc/' || ((doc_id * 7 + 3) % 1200) AS target_id, CASE WHEN (doc_id * 7 + 3) % 8 = 0 THEN 'moved/' || ((doc_id * 7 + 3) % 1200 + 4) || '.md' ELSE 'none.md' END AS target_path, doc_id % 9 = 0 AS ext FROM concepts) l
  LEFT JOIN (SELECT concept_id, CASE WHEN doc_id % 4 = 0 THEN 'moved/' || doc_id || '.md' ELSE path END AS path FROM concepts) p ON l.target_path = p.path LEFT JOIN concepts i ON l.target_id = i.concept_id
)""",
    resolved,
)

# --- workspaces and embeddings

query(
    "get_concept",
    """SELECT bundle_id, concept_id, path, type, title, coalesce(status, '-') AS status, coalesce(trust_tier, '-') AS trust_tier, (SELECT count(*) FROM links WHERE source_id = 'doc/24') AS links_out,
  (SELECT count(*) FROM links WHERE target_id = 'doc/24' AND resolved) AS links_in FROM seen LEFT JOIN (SELECT bundle_id, concept_id, status, trust_tier FROM prov) p USING (bundle_id, concept_id) WHERE concept_id = 'doc/24'""",
    lambda c: workspace.get_concept(c, "doc/24").fillna("-", ["status", "trust_tier"]),
)
query(
    "workspace_select",
    """SELECT bundle_id, concept_id, min(place) AS place FROM (
  SELECT bundle_id, concept_id, p - 1 AS place FROM seen JOIN (SELECT unnest(['doc/42', 'doc/1', 'doc/88']) AS concept_id, unnest([1, 2, 3]) AS p) USING (concept_id)
  UNION ALL SELECT s.bundle_id, s.concept_id, 3 FROM seen s SEMI JOIN (SELECT * FROM prov WHERE trust_tier = 'human-reviewed') p USING (bundle_id, concept_id) WHERE type = 'de') GROUP BY 1, 2 ORDER BY 3, 1, 2 LIMIT 50""",
    lambda c: workspace.select(c, ["doc/42", "doc/1", "doc/88"], tiers=["human-reviewed"], concept_type="de"),
)
query(
    "plugin_freshness",
    """SELECT c.bundle_id, CASE WHEN doc_id % 6 = 0 THEN 'gone/' || doc_id ELSE concept_id END AS concept_id,
  CASE WHEN doc_id % 6 = 0 THEN 'unknown' WHEN NOT (enabled AND retired_at IS NULL) THEN 'retired' WHEN doc_id % 4 = 1 THEN 'stale' ELSE 'current' END AS state FROM concepts c JOIN bundles b USING (bundle_id)""",
    lambda c: workspace.check_lock(c.table("concepts").selectExpr("bundle_id", "CASE WHEN doc_id % 6 = 0 THEN concat('gone/', doc_id) ELSE concept_id END AS concept_id", "CASE WHEN doc_id % 4 = 1 THEN 'old' ELSE file_hash END AS file_hash"), c),
)


def written(c: Catalog) -> DataFrame:
    """Every third concept's vector is offered; those whose id a four divides were made from other bytes and are refused."""
    old = c.table("concepts").where("doc_id % 2 = 0").selectExpr("bundle_id", "concept_id", "'old' AS model", "file_hash AS source_file_hash")
    new = c.table("concepts").where("doc_id % 3 = 0").selectExpr("bundle_id", "concept_id", "'new' AS model", "CASE WHEN doc_id % 4 = 0 THEN 'other' ELSE file_hash END AS source_file_hash")
    return embeddings.store(old, new, c.table("concepts")).select(*KEY, "model")


query(
    "embedding_store",
    "SELECT bundle_id, concept_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 0 THEN 'new' ELSE 'old' END AS model FROM concepts WHERE doc_id % 2 = 0 OR (doc_id % 3 = 0 AND doc_id % 4 <> 0)",
    written,
)


def embedded(c: Catalog) -> DataFrame:
    """Pending concepts rendered and embedded."""
    todo = agg.pending_embeddings(c, "v1", 64).select(*KEY)
    made = embeddings.embed(agg.embedding_input(c.table("concepts").join(todo, KEY, "left_semi")), 256)
    return made.select(*KEY, "dim", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm"))


query(
    "embedding_pipeline",
    """SELECT bundle_id, seen.concept_id, 256 AS dim, 1.0::DOUBLE AS norm FROM seen LEFT JOIN emb e USING (bundle_id, concept_id)
WHERE e.contract IS NULL OR e.contract <> 'v1' OR len(e.embedding) <> 64""",
    embedded,
)
