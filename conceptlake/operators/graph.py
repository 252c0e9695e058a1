"""Bounded traversal by levels: each hop is one join of the frontier with the edges.

From one seed, a small frontier is a list on the driver that is pushed to the edges' scan as a filter; beyond ``SMALL`` rows,
and for many seeds, frontiers are tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from conceptlake.catalog import Catalog
from conceptlake.errors import Ambiguous, InvalidParameter, NotFound, bounded
from conceptlake.session import cut

MAX_HOPS, MAX_RESULTS, CLOSURE = 5, 10_000, 500
#: Rows of a step that the driver may hold.
SMALL = 2000
KEY = ["bundle_id", "concept_id"]


def neighbors(edges: DataFrame, seeds: DataFrame, max_hops: int = 2, cap: int | None = MAX_HOPS) -> DataFrame:
    """(source_id, node, hops, path) of every node reachable from each seed within ``max_hops``; never the seed.

    ``edges`` (source_id, target_id) are read once for each hop. A node is found at its least hop, over the smallest
    source of the frontier. ``seeds`` (seed) may be many: all are walked at once, each with its own visited set. Ids may be
    structs. Without ``cap`` the walk goes on to the last node.
    """
    bounded("max_hops", max_hops, 1)
    edges = edges.where("source_id <> target_id").select("source_id", "target_id").distinct()
    frontier = seeds.select("seed", F.col("seed").alias("node"), F.array("seed").alias("path"))
    visited = [frontier.select("seed", "node")]
    found: list[DataFrame] = []
    for hop in range(1, (max_hops if cap is None else min(max_hops, cap)) + 1):
        steps = frontier.join(edges, frontier["node"] == edges["source_id"]).select("seed", "source_id", F.col("target_id").alias("node"), "path")
        best = steps.groupBy("seed", "node").agg(F.min_by(F.struct("source_id", "path"), "source_id").alias("by"))
        seen = reduce(lambda a, b: a.unionByName(b), visited)
        frontier = cut(best.join(seen, ["seed", "node"], "left_anti").select("seed", "node", F.concat("by.path", F.array("node")).alias("path")))
        found.append(frontier.withColumn("hops", F.lit(hop)))
        visited.append(frontier.select("seed", "node"))
        if frontier.isEmpty():
            break
    return reduce(lambda a, b: a.unionByName(b), found).select(F.col("seed").alias("source_id"), "node", "hops", "path")


def walk(edges: DataFrame, seed, kind: T.DataType, max_hops: int, most: int | None = None) -> DataFrame:
    """``neighbors`` of one seed: small steps are filters, a large one sends the walk to tables.

    ``most``: no further hop is begun once so many nodes are found; all of the last hop are there.
    """
    spark, struct = edges.sparkSession, isinstance(kind, T.StructType)
    literal = (lambda x: F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(x, kind, strict=True)])) if struct else (lambda x: F.lit(x))
    plain = (lambda x: tuple(x)) if struct else (lambda x: x)
    paths, level, hops = {seed: [seed]}, [seed], {}
    for hop in range(1, max_hops + 1):
        steps = edges.where(F.col("source_id").isin([literal(x) for x in level])).select("source_id", "target_id").distinct().limit(SMALL + 1).collect()
        if len(steps) > SMALL:
            start = spark.createDataFrame([(seed,)], T.StructType([T.StructField("seed", kind)]))
            return neighbors(edges, start, max_hops, cap=None)
        new = []
        for source, target in sorted((plain(r[0]), plain(r[1])) for r in steps):
            if target not in paths:
                paths[target], hops[target] = [*paths[source], target], hop
                new.append(target)
        level = new
        if not level or (most is not None and len(hops) >= most):
            break
    schema = T.StructType([T.StructField("source_id", kind), T.StructField("node", kind), T.StructField("hops", T.IntegerType()), T.StructField("path", T.ArrayType(kind))])
    return spark.createDataFrame([(seed, n, h, paths[n]) for n, h in hops.items()], schema)


def home_of(catalog: Catalog, concept_id: str, bundle_id: int | None) -> int:
    """The active bundle that has a concept; without ``bundle_id`` it must be the only one."""
    at = catalog.of_active(catalog.table("concepts").where(F.col("concept_id") == concept_id).select("bundle_id"))
    if bundle_id is not None:
        at = at.where(F.col("bundle_id") == bundle_id)
    found = at.distinct().limit(2).collect()
    if not found:
        raise NotFound(f"no concept {concept_id!r} in an active bundle")
    if len(found) > 1:
        raise Ambiguous(f"concept {concept_id!r} is in more than one active bundle")
    return found[0][0]


def concept_neighbors(catalog: Catalog, concept_id: str, max_hops: int = 2, bundle_id: int | None = None, cap: int = MAX_HOPS) -> DataFrame:
    """(bundle_id, source_id, neighbor_id, hops, path, title) over the resolved internal links of the concept's bundle;
    nodes without a concept are dropped."""
    bounded("max_hops", max_hops, 1)
    home = home_of(catalog, concept_id, bundle_id)
    edges = catalog.table("links").where((F.col("bundle_id") == home) & F.col("resolved") & ~F.col("is_external") & (F.col("source_id") != F.col("target_id")))
    walked = walk(edges, concept_id, T.StringType(), min(max_hops, cap))
    titles = catalog.table("concepts").where(F.col("bundle_id") == home).select(F.col("concept_id").alias("node"), "title")
    return walked.join(titles, "node").select(F.lit(home).alias("bundle_id"), "source_id", F.col("node").alias("neighbor_id"), "hops", "path", "title")


def end(side: str) -> Column:
    return F.struct(F.col(f"{side}_bundle_id").alias("bundle_id"), F.col(f"{side}_concept_id").alias("concept_id"))


def current_relationships(catalog: Catalog) -> DataFrame:
    """Relationships of active publications whose source bundle is active."""
    rows = catalog.table("relationships")
    if "relationship_publications" in catalog.tables:
        live = catalog.table("relationship_publications").where("state = 'active'").select("publication_id")
        rows = rows.join(live, "publication_id", "left_semi")
    active = catalog.active_bundles().select(F.col("bundle_id").alias("source_bundle_id"))
    return rows.join(active, "source_bundle_id", "left_semi")


def typed_edges(relationships: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """Edges to walk (source_id, target_id: structs of bundle and concept): outbound, inbound or both; undirected
    relationships go both ways in any case, unresolved ones nowhere."""
    if direction not in ("outbound", "inbound", "both"):
        raise InvalidParameter(f"direction must be outbound, inbound or both, not {direction!r}")
    rows = relationships.where(~F.col("unresolved") & F.col("target_concept_id").isNotNull())
    rows = rows.where(F.col("relation_type").isin(types)) if types else rows
    out = rows.select(end("source").alias("source_id"), end("target").alias("target_id"), "direction")
    back = rows.select(end("target").alias("source_id"), end("source").alias("target_id"), "direction")
    if direction == "outbound":
        back = back.where("direction = 'undirected'")
    if direction == "inbound":
        out = out.where("direction = 'undirected'")
    return out.unionByName(back).select("source_id", "target_id")


def relationship_neighbors(catalog: Catalog, start_bundle_id: int, start_concept_id: str, max_hops: int = 2, direction: str = "outbound", types: list[str] | None = None, max_results: int = 500, cap: int = MAX_HOPS) -> DataFrame:
    """Typed traversal over bundles, nearest first, at most ``max_results``: (bundle_id, concept_id, hops)."""
    bounded("max_results", max_results, 1, MAX_RESULTS)
    bounded("max_hops", max_hops, 1)
    edges = typed_edges(current_relationships(catalog), direction, types).where("source_id <> target_id")
    kind = edges.schema["source_id"].dataType
    walked = walk(edges, (start_bundle_id, start_concept_id), kind, min(max_hops, cap), max_results)
    return walked.select("node.bundle_id", "node.concept_id", "hops").orderBy("hops", *KEY).limit(max_results)


def closure(edges: DataFrame, seeds: list[str], max_hops: int = 2, limit: int = CLOSURE) -> DataFrame:
    """(concept_id, hops) of the seeds (0) and all they reach, at the least hop over all seeds."""
    bounded("max_hops", max_hops, 1, 8)
    spark = edges.sparkSession
    start = spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "seed string")
    walked = neighbors(edges, start, max_hops, cap=8).select("node", "hops")
    every = walked.unionByName(start.select(F.col("seed").alias("node"), F.lit(0).alias("hops")))
    return every.groupBy(F.col("node").alias("concept_id")).agg(F.min("hops").alias("hops")).orderBy("hops", "concept_id").limit(limit)


def closure_gaps(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The unresolved internal links of a closure's concepts: (source_id, ordinal, target_path)."""
    gaps = links.where(~F.col("resolved") & ~F.col("is_external"))
    path = "target_path" if "target_path" in links.columns else "target_id"
    return gaps.join(nodes.select(F.col("concept_id").alias("source_id")), "source_id", "left_semi").select("source_id", "ordinal", F.col(path).alias("target_path"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): both ends of every edge, summed before the shuffle."""
    ends = edges.select(F.col("source_id").alias("node")).unionByName(edges.select(F.col("target_id").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def top_nodes(edges: DataFrame, limit: int = 20) -> DataFrame:
    """The nodes of highest degree with the total number of nodes."""
    all_degrees = degrees(edges)
    total = all_degrees.agg(F.count(F.lit(1)).alias("total"))
    return all_degrees.orderBy(F.col("degree").desc(), "node").limit(limit).crossJoin(F.broadcast(total))


def ego(catalog: Catalog, concept_id: str, max_hops: int = 1, bundle_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with hops and degree, edges among them) around a concept of one bundle."""
    home = home_of(catalog, concept_id, bundle_id)
    edges = catalog.table("links").where((F.col("bundle_id") == home) & F.col("resolved") & ~F.col("is_external"))
    nodes = closure(edges, [concept_id], max_hops)
    counted = nodes.join(degrees(edges).withColumnRenamed("node", "concept_id"), "concept_id", "left").select("concept_id", "hops", F.coalesce("degree", F.lit(0)).alias("degree"))
    return counted, edges_among(edges, nodes)


def edges_among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are among ``nodes``, rolled up: (source_id, target_id, n, kinds)."""
    names = nodes.select("concept_id")
    inner = edges.join(names, edges["source_id"] == names["concept_id"], "left_semi")
    inner = inner.join(names, inner["target_id"] == names["concept_id"], "left_semi")
    return inner.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("link_kind")), ",").alias("kinds"))


def relationship_rollup(relationships: DataFrame) -> DataFrame:
    """Two levels: edges of each source and type, then the sources of each type."""
    one = relationships.groupBy("source_bundle_id", "source_concept_id", "relation_type").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("direction") == "directed").alias("directed"))
    return one.groupBy("relation_type").agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("edges"), F.max("n").alias("most"), F.bool_and("directed").alias("directed"))


def backlinks(links: DataFrame, concepts: DataFrame, concept_id: str) -> DataFrame:
    rows = links.where((F.col("target_id") == concept_id) & F.col("resolved"))
    return rows.join(concepts.select(F.col("concept_id").alias("source_id"), "title"), "source_id", "left").select("source_id", "ordinal", "link_kind", "title").orderBy("source_id", "ordinal")


def outlinks(links: DataFrame, concepts: DataFrame, concept_id: str) -> DataFrame:
    rows = links.where(F.col("source_id") == concept_id)
    return rows.join(concepts.select(F.col("concept_id").alias("target_id"), "title"), "target_id", "left").select("target_id", "ordinal", "link_kind", "resolved", "title").orderBy("ordinal")


def unresolved(links: DataFrame) -> DataFrame:
    return links.where(~F.col("resolved") & ~F.col("is_external")).select("bundle_id", "source_id", "ordinal", "target_id")


def transitive_invalidation(dependencies: DataFrame, changed: list[int], causation: str | None = None, cap: int = 1024) -> tuple[DataFrame, bool]:
    """Bundles that depend on a changed one, directly or by way of others, and whether the walk was cut.

    ``dependencies`` (source_bundle_id, target_bundle_id, target_scope_kind, causation_key, enabled): enabled ones of bundle
    scope are walked to the end; one whose causation key is ``causation`` isn't. Once ``cap`` bundles are known, the
    changed ones included, or a step has more edges than are left up to it, the walk can't be exhaustive: then every
    bundle with such a dependency on anything is named, with hops null beyond what was walked.
    """
    spark = dependencies.sparkSession
    live = dependencies.where(F.col("enabled") & (F.col("target_scope_kind") == "bundle"))
    open_ = live if causation is None else live.where(~F.col("causation_key").eqNullSafe(F.lit(causation)))
    known, level, hop, over = dict.fromkeys(changed, 0), list(changed), 0, len(changed) >= cap
    while level and not over:
        hop += 1
        # A level has under `cap` bundles; of its edges, as many targets matter as there is room for, and one more.
        targets = open_.where(F.col("source_bundle_id").isin(level)).select("target_bundle_id").distinct().where(~F.col("target_bundle_id").isin(list(known)))
        found = sorted(r[0] for r in targets.limit(cap - len(known) + 1).collect())
        over = len(known) + len(found) >= cap
        level = found[: cap - len(known)]
        known.update(dict.fromkeys(level, hop))
    hit = spark.createDataFrame([(b, h) for b, h in known.items() if h], "target_bundle_id long, hops int")
    if not over:
        return hit, False
    blanket = live.select("target_bundle_id").distinct().where(~F.col("target_bundle_id").isin(list(known)))
    return hit.unionByName(blanket.withColumn("hops", F.lit(None).cast("int"))), True
