"""Traversals, relationships and their publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from conceptlake.catalog import Catalog
from conceptlake.operators import graph, relationships as rel
from conceptlake.plans import oracle as o
from conceptlake.plans.register import query
from conceptlake.sources.testdata import read

#: The first concept of the active bundles, and its bundle's links.
SEED = "(SELECT min(doc_id) FROM seen)"
HOME = f"(SELECT * FROM links WHERE resolved AND source_id <> target_id AND bundle_id = (SELECT bundle_id FROM seen WHERE doc_id = {SEED}))"


def seed(c: Catalog) -> str:
    return "doc/" + str(c.of_active(c.table("concepts")).agg(F.min("doc_id")).first()[0])


query(
    "concept_neighbors",
    f"""SELECT c.bundle_id, seed AS source_id, node AS neighbor_id, hops, title
FROM {o.walk_sql(HOME, f"SELECT 'doc/' || {SEED} AS seed", 3)} JOIN concepts c ON node = concept_id""",
    lambda c: graph.concept_neighbors(c, seed(c), 3).drop("path"),
)
query(
    "neighbors_of_many",
    f"SELECT seed AS source_id, node, hops FROM {o.walk_sql('edges', 'SELECT concept_id AS seed FROM concepts', 2)}",
    lambda c: graph.neighbors(c.table("links").where("resolved"), c.table("concepts").select(F.col("concept_id").alias("seed")), 2).drop("path"),
)
_OUT = "(SELECT source_id, target_id FROM current_rels UNION SELECT target_id, source_id FROM current_rels WHERE direction = 'undirected')"
_IN = "(SELECT target_id AS source_id, source_id AS target_id FROM current_rels UNION SELECT source_id, target_id FROM current_rels WHERE direction = 'undirected')"
_BOTH = "(SELECT source_id, target_id FROM current_rels UNION SELECT target_id, source_id FROM current_rels)"


def typed_sql(edges: str, start: str, hops: int) -> str:
    return f"""SELECT CAST(split_part(node, ' ', 1) AS BIGINT) AS bundle_id, split_part(node, ' ', 2) AS concept_id, hops
FROM {o.walk_sql(f"(SELECT * FROM {edges} WHERE source_id <> target_id)", f"SELECT '{start}' AS seed", hops)} ORDER BY hops, 1, 2 LIMIT 500"""


query("relationship_neighbors_outbound", typed_sql(_OUT, "2 c/1", 2), lambda c: graph.relationship_neighbors(c, 2, "c/1", 2, "outbound"))
query("relationship_neighbors_inbound", typed_sql(_IN, "2 s/1", 2), lambda c: graph.relationship_neighbors(c, 2, "s/1", 2, "inbound"))
query("relationship_neighbors_both", typed_sql(_BOTH, "14 o/33", 2), lambda c: graph.relationship_neighbors(c, 14, "o/33", 2, "both"))
_SEEDS = "SELECT unnest(['doc/3', 'doc/10']) AS seed"
_CLOSURE = f"(SELECT node AS concept_id, min(hops) AS hops FROM (SELECT node, hops FROM {o.walk_sql('edges', _SEEDS, 3)} UNION ALL SELECT unnest(['doc/3', 'doc/10']), 0) GROUP BY 1 ORDER BY 2, 1 LIMIT 500)"
query("closure", f"SELECT * FROM {_CLOSURE}", lambda c: graph.closure(c.table("links").where("resolved"), ["doc/3", "doc/10"], 3))
query(
    "closure_gaps",
    f"SELECT source_id, ordinal, target_id AS target_path FROM links WHERE NOT resolved AND source_id IN (SELECT concept_id FROM {_CLOSURE})",
    lambda c: graph.closure_gaps(c.table("links"), graph.closure(c.table("links").where("resolved"), ["doc/3", "doc/10"], 3)),
)
_ENDS = "(SELECT source_id AS node FROM links UNION ALL SELECT target_id FROM links)"
query(
    "top_nodes",
    f"SELECT node, count(*) AS degree, (SELECT count(DISTINCT node) FROM {_ENDS}) AS total FROM {_ENDS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    lambda c: graph.top_nodes(c.table("links")),
)
_EGO = f"(SELECT 'doc/' || {SEED} AS node, 0 AS hops UNION ALL SELECT node, hops FROM {o.walk_sql(HOME, f"SELECT 'doc/' || {SEED} AS seed", 2)})"
query(
    "ego_nodes",
    f"""SELECT node AS concept_id, hops, (SELECT count(*) FROM (SELECT unnest([source_id, target_id]) AS x FROM links WHERE resolved AND bundle_id = (SELECT bundle_id FROM seen WHERE doc_id = {SEED})) WHERE x = node) AS degree
FROM {_EGO}""",
    lambda c: graph.ego(c, seed(c), 2)[0],
)
query(
    "ego_edges",
    f"""SELECT source_id, target_id, count(*) AS n, string_agg(DISTINCT link_kind, ',' ORDER BY link_kind) AS kinds FROM links
WHERE resolved AND source_id IN (SELECT node FROM {_EGO}) AND target_id IN (SELECT node FROM {_EGO}) GROUP BY 1, 2""",
    lambda c: graph.ego(c, seed(c), 2)[1],
)
_TOP = f"(SELECT node FROM {_ENDS} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 200)"
query(
    "catalog_graph",
    f"""SELECT source_id, target_id, count(*) AS n, string_agg(DISTINCT link_kind, ',' ORDER BY link_kind) AS kinds FROM links
WHERE resolved AND source_id IN {_TOP} AND target_id IN {_TOP} GROUP BY 1, 2""",
    lambda c: graph.edges_among(c.table("links").where("resolved"), graph.top_nodes(c.table("links"), 200).select(F.col("node").alias("concept_id"))),
)
query(
    "relationship_rollup",
    """SELECT relation_type, count(*) AS sources, sum(n)::BIGINT AS edges, max(n) AS most, bool_and(d) AS directed
FROM (SELECT sb, source, relation_type, count(*) AS n, bool_and(direction = 'directed') AS d FROM rels GROUP BY ALL) GROUP BY 1""",
    lambda c: graph.relationship_rollup(c.table("relationships")),
)
query(
    "backlinks", "SELECT source_id, ordinal, link_kind, title FROM links LEFT JOIN concepts ON source_id = concept_id WHERE target_id = 'doc/10' AND resolved",
    lambda c: graph.backlinks(c.table("links"), c.table("concepts"), "doc/10"),
)
query(
    "outlinks", "SELECT target_id, ordinal, link_kind, resolved, title FROM links LEFT JOIN concepts ON target_id = concept_id WHERE source_id = 'doc/10'",
    lambda c: graph.outlinks(c.table("links"), c.table("concepts"), "doc/10"),
)
query("unresolved_links", "SELECT bundle_id, source_id, ordinal, target_id FROM links WHERE NOT resolved", lambda c: graph.unresolved(c.table("links")))


def invalidated(c: Catalog, d: str) -> DataFrame:
    roots = [r[0] for r in read(c.spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50).select("o_orderkey").collect()]
    return graph.transitive_invalidation(c.table("dependencies"), roots, "k3")[0]


query(
    "transitive_invalidation",
    """SELECT node AS target_bundle_id, min(hops) AS hops FROM (
  WITH RECURSIVE walk AS (SELECT o_orderkey AS node, 0 AS hops FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)
    UNION SELECT d.target, w.hops + 1 FROM walk w JOIN (SELECT o_orderkey AS source, o_orderkey // 2 AS target FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_custkey % 5 <> 3) d ON w.node = d.source)
  SELECT * FROM walk) GROUP BY node HAVING min(hops) > 0""",
    invalidated,
)

# --- publication


def parties(c: Catalog, d: str) -> DataFrame:
    """Customers, orders and suppliers as concepts; every ninth supplier is missing."""
    named = lambda t, k, p: read(c.spark, d, t).select((F.col(k) % 20 + 1).cast("long").alias("bundle_id"), F.concat(F.lit(p), k).alias("concept_id"))
    return named("customer", "c_custkey", "c/").unionByName(named("orders", "o_orderkey", "o/")).unionByName(named("supplier", "s_suppkey", "s/").where("NOT endswith(concept_id, '9')"))


query(
    "activate_staged",
    """SELECT o_orderkey AS publication_id, 't' || (o_custkey % 3) AS tenant_id, 'p' || (o_custkey % 50) AS producer, o_orderkey % 97 AS publication_generation,
  CASE WHEN row_number() OVER (PARTITION BY o_custkey % 3, o_custkey % 50 ORDER BY o_orderkey % 97 DESC, o_orderkey) = 1 THEN 'active' ELSE 'superseded' END AS state FROM orders""",
    lambda c, d: rel.activate(read(c.spark, d, "orders").selectExpr("o_orderkey AS publication_id", "concat('t', o_custkey % 3) AS tenant_id", "concat('p', o_custkey % 50) AS producer", "o_orderkey % 97 AS publication_generation")),
)
query(
    "resolve_relationships",
    """SELECT relation_type, count(*) AS n, count(*) FILTER (k.concept_id IS NULL) AS unresolved FROM rels LEFT JOIN (
  SELECT c_custkey % 20 + 1 AS bundle_id, 'c/' || c_custkey AS concept_id FROM customer UNION ALL SELECT o_orderkey % 20 + 1, 'o/' || o_orderkey FROM orders
  UNION ALL SELECT s_suppkey % 20 + 1, 's/' || s_suppkey FROM supplier WHERE s_suppkey % 10 <> 9) k ON tb = k.bundle_id AND target = k.concept_id GROUP BY 1""",
    lambda c, d: rel.resolve(c.table("relationships"), parties(c, d)).groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("unresolved").alias("unresolved")),
)
query(
    "current_relationships",
    "SELECT relation_type, count(*) AS n FROM rels SEMI JOIN active ON sb = bundle_id WHERE publication_id < 4 GROUP BY 1",
    lambda c: graph.current_relationships(c).groupBy("relation_type").agg(F.count(F.lit(1)).alias("n")),
)
query(
    "validate_relationships",
    "SELECT count(*) AS n, count(*) FILTER (relation_type = 'geo:same_nation') AS malformed, count(*) - count(DISTINCT (source, relation_type, direction, target)) AS repeated FROM rels",
    lambda c: rel.check(c.table("relationships").withColumn("confidence", F.when(F.col("relation_type") == "geo:same_nation", 1.5).otherwise(F.col("confidence")))),
)
query(
    "relationship_set_hash",
    """SELECT publication_id, sha256(string_agg(h, chr(10) ORDER BY h)) AS relationship_set_hash, count(*) AS n FROM (SELECT publication_id::BIGINT AS publication_id,
  sha256(source || chr(31) || relation_type || chr(31) || direction || chr(31) || tb || chr(31) || target || chr(31) || '' || chr(31) || '0.5') AS h FROM rels) GROUP BY 1""",
    lambda c: rel.set_hashes(c.table("relationships").withColumn("row_hash", rel.row_hash())),
)
