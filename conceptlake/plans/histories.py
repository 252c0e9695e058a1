"""History, freshness, dependencies and audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from conceptlake.catalog import Catalog
from conceptlake.operators import freshness, search, temporal
from conceptlake.plans import oracle as o
from conceptlake.plans.register import AT_US, KEY, query
from conceptlake.sources import wiki
from conceptlake.sources.testdata import read
from conceptlake.streaming import outbox

# An open end is shown as -1.
_SHOWN = "concept_id, version, valid_from, coalesce(valid_to, -1) AS valid_to, change_kind, title"
query("scd2_versions", f"SELECT {_SHOWN} FROM versions", lambda c: temporal.versions(c.table("changes")).fillna(-1, ["valid_to"]))
query(
    "concept_history",
    f"SELECT {_SHOWN} FROM versions WHERE concept_id = 'user/3' ORDER BY version DESC LIMIT 25",
    lambda c: temporal.concept_history(temporal.versions(c.table("changes")), "user/3", 25).fillna(-1, ["valid_to"]),
)
query(
    "concept_as_of",
    f"""SELECT concept_id, max(version) AS version, max_by(valid_from, version) AS valid_from, max_by(title, version) AS title
FROM versions WHERE valid_from <= {AT_US} AND (valid_to IS NULL OR valid_to > {AT_US}) GROUP BY 1""",
    lambda c: temporal.concept_as_of(temporal.versions(c.table("changes")), AT_US),
)
query(
    "history_prune",
    f"SELECT concept_id, count(*) AS kept FROM versions WHERE valid_to IS NULL OR valid_to >= {AT_US} - 86400000000 GROUP BY 1",
    lambda c: temporal.prune(temporal.versions(c.table("changes")), 86400000000, AT_US).groupBy("concept_id").agg(F.count(F.lit(1)).alias("kept")),
)


def synced(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """What was stored (all but every fifth) and what a scan finds (all but every third; some bytes, ids and owners are new)."""
    stored = c.table("concepts").where("doc_id % 5 <> 0").selectExpr("doc_id", "path", "file_hash", "concept_id", "CASE WHEN doc_id % 7 = 1 THEN 'pkg/a' END AS owner", "doc_id % 8 <> 2 AS projected")
    changed = "CASE WHEN doc_id % 4 = 0 THEN sha2(file_hash, 256) ELSE file_hash END AS file_hash"
    found = c.table("concepts").where("doc_id % 3 <> 0").selectExpr("doc_id", "path", changed, "CASE WHEN doc_id % 11 = 0 THEN path ELSE concept_id END AS concept_id", "CASE WHEN doc_id % 14 = 1 THEN 'pkg/b' WHEN doc_id % 7 = 1 THEN 'pkg/a' END AS owner")
    return stored, found


SYNC_SQL = """(SELECT coalesce(a.path, b.path) AS path, was, i, a.concept_id AS id_was, b.concept_id AS id_is, CASE WHEN was IS NULL THEN 'added' WHEN i IS NULL THEN 'removed'
  WHEN was = i AND a.concept_id = b.concept_id AND a.owner IS NOT DISTINCT FROM b.owner AND projected THEN 'unchanged' ELSE 'updated' END AS change FROM
  (SELECT path, file_hash AS was, concept_id, CASE WHEN doc_id % 7 = 1 THEN 'pkg/a' END AS owner, doc_id % 8 <> 2 AS projected FROM concepts WHERE doc_id % 5 <> 0) a FULL JOIN
  (SELECT path, CASE WHEN doc_id % 4 = 0 THEN sha256(file_hash) ELSE file_hash END AS i, CASE WHEN doc_id % 11 = 0 THEN path ELSE concept_id END AS concept_id,
    CASE WHEN doc_id % 14 = 1 THEN 'pkg/b' WHEN doc_id % 7 = 1 THEN 'pkg/a' END AS owner FROM concepts WHERE doc_id % 3 <> 0) b ON a.path = b.path)"""
query("sync_diff", f"SELECT path, change, was AS before_hash, i AS after_hash FROM {SYNC_SQL}", lambda c: temporal.sync_diff(*synced(c)))


def event(c: Catalog) -> DataFrame:
    context = outbox.Context.of({"operation": "put_document", "causation_key": "k1", "producer": "writer"})
    return outbox.sync_event(temporal.sync_diff(*synced(c)), 9, 2, AT_US, context)


_COUNTS = [f"count(*) FILTER (change {x})" for x in ("= 'added'", "= 'updated'", "= 'removed'", "<> 'removed'")]
query(
    "sync_event",
    f"""SELECT CAST(9 AS BIGINT) AS event_id, CAST(2 AS BIGINT) AS bundle_id, 'put_document' AS operation, CAST({AT_US} AS BIGINT) AS at_us, 'k1' AS causation, 'writer' AS producer,
  {_COUNTS[0]} AS added, {_COUNTS[1]} AS updated, {_COUNTS[2]} AS removed, {_COUNTS[3]} AS total FROM {SYNC_SQL}""",
    lambda c: event(c).select("event_id", "bundle_id", "operation", "at_us", "causation", "producer", "added", "updated", "removed", "total"),
)
query(
    "change_notification",
    f"""SELECT 'catalog' AS channel, '{{"bundle_id":2,"op":"put_document","added":' || {_COUNTS[0]} || ',"updated":' || {_COUNTS[1]} || ',"removed":' || {_COUNTS[2]} || ',"total":' || {_COUNTS[3]} || ',"event_id":9}}' AS payload
FROM {SYNC_SQL}""",
    lambda c: outbox.notifications(event(c), "catalog"),
)


def wiki_changes(c: Catalog, sf_dir: str) -> DataFrame:
    """The pages at hand against a checkpoint that has the documents' ids and bytes."""
    table = lambda name, key, text, version: read(c.spark, sf_dir, name).select(F.col(key).cast("string").alias("page_id"), wiki.path_of(F.col(key).cast("string")).alias("path"), F.lit(version).cast("long").alias("version"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("file_hash"))
    now, before = wiki.snapshot(table("pages", "page_id", "html", 2)), wiki.snapshot(table("documents", "doc_id", "text", 1))
    wiki.check(now, before)
    return wiki.changes(now, before)


query(
    "wiki_changes",
    """WITH now AS (SELECT page_id, sha256(coalesce(html, '')) AS h FROM pages), was AS (SELECT doc_id AS page_id, sha256(coalesce(text, '')) AS g FROM documents)
SELECT CAST(page_id AS VARCHAR) AS page_id, 'pages/' || page_id || '.md' AS path, CASE WHEN g IS NULL THEN 'added' WHEN h IS NULL THEN 'removed' WHEN g = h THEN 'unchanged' ELSE 'updated' END AS change
FROM now FULL JOIN was USING (page_id)""",
    wiki_changes,
)


def manifest(c: Catalog) -> DataFrame:
    stored, found = synced(c)
    ids = stored.select("path", F.col("concept_id").alias("id_was")).join(found.select("path", F.col("concept_id").alias("id_is")), "path", "full_outer")
    return temporal.change_manifest(temporal.sync_diff(stored, found), ids).fillna("-", ["before_hash", "after_hash"])


query(
    "change_manifest",
    f"""SELECT path, kind, concept_id, coalesce(before_hash, '-') AS before_hash, coalesce(after_hash, '-') AS after_hash FROM (
  SELECT path, change AS kind, CASE WHEN change = 'removed' THEN id_was ELSE id_is END AS concept_id, was AS before_hash, i AS after_hash FROM {SYNC_SQL} WHERE change <> 'unchanged' AND (change <> 'updated' OR id_was = id_is)
  UNION ALL SELECT path, 'removed', id_was, was, NULL FROM {SYNC_SQL} WHERE change = 'updated' AND id_was <> id_is
  UNION ALL SELECT path, 'added', id_is, NULL, i FROM {SYNC_SQL} WHERE change = 'updated' AND id_was <> id_is)""",
    manifest,
)
_DIFF = "CASE {} % 3 WHEN 0 THEN 'removed' WHEN 1 THEN 'updated' ELSE 'unchanged' END"
query(
    "scd2_apply_sync",
    f"""{o.CATALOG},
diff AS (SELECT DISTINCT concept_id, {_DIFF.format('CAST(substr(concept_id, 6) AS BIGINT)')} AS change FROM changes)
SELECT concept_id, max(version) AS version, count(*) AS n, count(valid_to) AS closed FROM (
  SELECT concept_id, version, CASE WHEN change <> 'unchanged' AND valid_to IS NULL THEN 9 ELSE valid_to END AS valid_to FROM versions JOIN diff USING (concept_id)
  UNION ALL SELECT concept_id, max(version) + 1, CASE WHEN any_value(change) = 'removed' THEN 9 END FROM versions JOIN diff USING (concept_id) WHERE change <> 'unchanged' GROUP BY concept_id
) GROUP BY concept_id""",
    lambda c: temporal.apply_sync(temporal.versions(c.table("changes")), c.table("changes").select("concept_id").distinct().selectExpr("concept_id", f"{_DIFF.format('cast(substr(concept_id, 6) AS bigint)')} AS change", "'x' AS title"), 9)
    .groupBy("concept_id").agg(F.max("version").alias("version"), F.count(F.lit(1)).alias("n"), F.count("valid_to").alias("closed")),
)


def newest(c: Catalog, rows: int, **equal) -> DataFrame:
    return temporal.list_log(c.table("changes"), [F.col("at_us").desc(), F.col("event_id").desc()], rows, **equal).select("event_id", "at_us", "concept_id", "title")


_LOG = "SELECT event_id, at_us, concept_id, title FROM changes WHERE {} ORDER BY at_us DESC, event_id DESC LIMIT {}"
query("sync_log", _LOG.format("title = 'click'", 100), lambda c: newest(c, 100, title="click"))
query("sync_changes", _LOG.format("change_kind = 'removed'", 1000), lambda c: newest(c, 1000, change_kind="removed"))
query("access_log", _LOG.format("concept_id = 'user/5'", 40), lambda c: newest(c, 40, concept_id="user/5"))

# --- freshness

query(
    "effective_freshness",
    "SELECT scope, state, count(*) AS n FROM (SELECT 'bundle' AS scope, state FROM fb UNION ALL SELECT 'concept', state FROM fc UNION ALL SELECT 'path', state FROM fp) GROUP BY ALL",
    lambda c: freshness.effective(c.table("bundle_freshness"), c.table("concept_freshness"), c.table("path_freshness")).groupBy("scope", "state").agg(F.count(F.lit(1)).alias("n")),
)
query(
    "freshness_overlay", f"SELECT x.bundle_id, x.concept_id, {o.FRESH} AS freshness FROM concepts x {o.FRESH_JOIN}",
    lambda c: search.freshness_of(c, c.table("concepts").select(*KEY, "path")).select(*KEY, "freshness"),
)
_STATE = "CASE event_id % 7 WHEN 0 THEN 'fresh' WHEN 1 THEN 'reconciling' WHEN 2 THEN CASE WHEN event_id % 97 = 2 THEN 'retired' ELSE 'blocked' END ELSE 'stale' END AS state"
query(
    "freshness_states",
    f"""SELECT key, max_by(state, run) AS state, max_by(reasons, run) AS reasons, max_by(since, run) AS since FROM (
  SELECT key, run, any_value(state) AS state, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, min(seq) AS since FROM (
    SELECT *, sum(turn) OVER (PARTITION BY key ORDER BY seq) AS run FROM (
      SELECT *, CASE WHEN lag(state) OVER w IS NOT DISTINCT FROM state THEN 0 ELSE 1 END AS turn FROM (
        SELECT *, coalesce(bool_or(state = 'retired') OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS past
        FROM (SELECT user_id AS key, event_id AS seq, {_STATE}, event_type AS reason FROM events)
      ) WHERE NOT past WINDOW w AS (PARTITION BY key ORDER BY seq))) GROUP BY key, run) GROUP BY key""",
    lambda c, d: freshness.folded_states(read(c.spark, d, "events").selectExpr("user_id AS key", "event_id AS seq", _STATE, "event_type AS reason")),
)


def reported(c: Catalog, d: str) -> DataFrame:
    """Bundles' states after all concepts with a state of their own were reported as stale, each for its state."""
    states = c.table("bundle_freshness").selectExpr("bundle_id", "'bundle' AS scope_kind", "'' AS scope_key", "CASE WHEN bundle_id % 5 = 0 THEN 'retired' ELSE state END AS state", "array('old') AS reasons", "CASE WHEN state <> 'fresh' THEN 7L END AS stale_since", "bundle_id AS epoch")
    targets = c.table("concept_freshness").selectExpr("bundle_id", "'bundle' AS scope_kind", "'' AS scope_key", "state AS reason")
    marked = freshness.mark(states, targets, "stale", 50)
    return marked.select("bundle_id", "state", F.array_join("reasons", ",").alias("reasons"), F.coalesce("stale_since", F.lit(-1)).alias("stale_since"), "epoch")


query(
    "mark_stale",
    """SELECT bundle_id, CASE WHEN hit THEN 'stale' ELSE state END AS state, CASE WHEN NOT hit THEN 'old' WHEN state = 'stale' THEN array_to_string(list_sort(list_distinct(r || ['old'])), ',') ELSE array_to_string(r, ',') END AS reasons,
  coalesce(was, CASE WHEN hit THEN 50 ELSE -1 END) AS stale_since, bundle_id + CASE WHEN hit THEN 1 ELSE 0 END AS epoch FROM (
  SELECT fb.bundle_id, CASE WHEN fb.bundle_id % 5 = 0 THEN 'retired' ELSE state END AS state, CASE WHEN state <> 'fresh' THEN 7 END AS was, r, r IS NOT NULL AND fb.bundle_id % 5 <> 0 AS hit
  FROM fb LEFT JOIN (SELECT bundle_id, list_sort(list_distinct(list(state))) AS r FROM fc GROUP BY 1) n ON fb.bundle_id = n.bundle_id)""",
    reported,
)

# --- dependencies: one for each part, on the concepts of a bundle

_SELECTOR = "CASE p_size % 4 WHEN 0 THEN 'bundle' WHEN 1 THEN 'concept' WHEN 2 THEN 'path' ELSE 'path_prefix' END"


def part_dependencies(c: Catalog, d: str) -> DataFrame:
    key = "CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN concat('doc/', p_partkey) WHEN 2 THEN concat('doc/', p_partkey, '.md') ELSE concat('doc/', p_partkey % 9 + 1) END"
    return read(c.spark, d, "part").selectExpr(
        "p_partkey AS dep_id", "p_partkey % 20 + 1 AS source_bundle_id", f"{_SELECTOR} AS selector", f"{key} AS selector_key", "p_partkey % 6 AS target_bundle_id", "'bundle' AS target_scope_kind",
        "cast(null AS string) AS target_scope_key", "p_partkey % 5 AS watermark", "p_partkey % 11 <> 0 AS enabled", "concat('k', p_partkey % 3) AS causation_key",
    )


query(
    "evaluate_dependencies",
    f"""SELECT dep_id, target_bundle_id, newest AS watermark_now, count(g) AS n FROM (
  SELECT p_partkey AS dep_id, p_partkey % 20 + 1 AS source, {_SELECTOR} AS selector, CASE p_size % 4 WHEN 1 THEN 'doc/' || p_partkey WHEN 2 THEN 'doc/' || p_partkey || '.md' ELSE 'doc/' || (p_partkey % 9 + 1) END AS k,
    p_partkey % 6 AS target_bundle_id, p_partkey % 5 AS watermark, 'k' || (p_partkey % 3) AS own FROM part WHERE p_partkey % 11 <> 0) d
JOIN (SELECT bundle_id, max(doc_id % 6) AS newest FROM concepts GROUP BY 1) m ON d.source = m.bundle_id
LEFT JOIN (SELECT bundle_id, concept_id, path, doc_id % 6 AS g, CASE WHEN doc_id % 2 = 0 THEN 'k' || (doc_id % 3) END AS caus FROM concepts) c
  ON d.source = c.bundle_id AND g > watermark AND caus IS DISTINCT FROM own AND CASE selector WHEN 'bundle' THEN true WHEN 'concept' THEN k = concept_id WHEN 'path' THEN k = path ELSE starts_with(path, k) END
WHERE newest > watermark GROUP BY ALL""",
    lambda c, d: freshness.evaluate(part_dependencies(c, d), c.table("concepts").selectExpr("bundle_id", "concept_id", "path", "doc_id % 6 AS generation", "CASE WHEN doc_id % 2 = 0 THEN concat('k', doc_id % 3) END AS causation")),
)
query(
    "departing_dependents",
    "SELECT DISTINCT p_partkey % 6 AS bundle_id, 'bundle' AS scope_kind, '' AS scope_key, 'dependency_source_changed' AS reason FROM part WHERE p_partkey % 20 = 12 AND p_partkey % 11 <> 0",
    lambda c, d: freshness.departing_dependents(part_dependencies(c, d).where("source_bundle_id > 6"), 13),
)
