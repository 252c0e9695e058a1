"""Freshness states, dependency evaluation and publication fences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row, Window, functions as F

from conceptlake.errors import Duplicate, InvalidParameter, NotFound, bounded
from conceptlake.operators.graph import transitive_invalidation

STATES = ("fresh", "stale", "reconciling", "blocked", "retired")


def effective(bundle: DataFrame, concept: DataFrame, path: DataFrame) -> DataFrame:
    """One view of all scopes: (bundle_id, scope, scope_key, state)."""
    return bundle.select("bundle_id", F.lit("bundle").alias("scope"), F.lit("").alias("scope_key"), "state").unionByName(concept.select("bundle_id", F.lit("concept").alias("scope"), F.col("concept_id").alias("scope_key"), "state")).unionByName(path.select("bundle_id", F.lit("path").alias("scope"), F.col("path").alias("scope_key"), "state"))


def folded_states(reports: DataFrame) -> DataFrame:
    """State of each key after a log of reports (key, seq, state, reason): the set of reasons of the run in which the
    state has lasted, and since when; retired is final.

    A run is what lies between changes of state; it is found with two windows over a key's reports.
    """
    order = Window.partitionBy("key").orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    live = reports.withColumn("over", F.coalesce(F.max(F.col("state") == "retired").over(so_far), F.lit(False))).where("NOT over")
    live = live.withColumn("turn", F.when(F.lag("state").over(order).eqNullSafe(F.col("state")), 0).otherwise(1))
    live = live.withColumn("run", F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = live.groupBy("key", "run").agg(F.first("state").alias("state"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.min("seq").alias("since"))
    return runs.groupBy("key").agg(F.max_by(F.struct("state", "reasons", "since"), "run").alias("s")).select("key", "s.state", "s.reasons", "s.since")


SELECTORS = ("bundle", "concept", "path", "path_prefix")
DEPENDENCY = """dep_id long, producer string, source_bundle_id long, selector string, selector_key string, target_bundle_id long, target_scope_kind string,
target_scope_key string, causation_key string, watermark long, enabled boolean"""
FENCE = """tenant_id string, producer string, bundle_id long, target_generation long, fencing_token long, expected_catalog_generation long, manifest_hash string,
state string, issued_at long, expires_at long"""


def bundle_row(bundles: DataFrame, bundle_id: int) -> Row:
    found = bundles.where(F.col("bundle_id") == bundle_id).limit(1).collect()
    if not found:
        raise NotFound(f"no bundle {bundle_id}")
    return found[0]


# --- dependencies: copy-on-write functions over a table of DEPENDENCY's columns


def register(dependencies: DataFrame, bundles: DataFrame, producer: str, source_bundle_id: int, selector: str, target_bundle_id: int, selector_key: str = "", target_scope_kind: str = "bundle", target_scope_key: str | None = None, causation_key: str | None = None) -> tuple[DataFrame, int]:
    """(table, dep_id) with a new dependency, whose watermark is the source's generation now; the same one again is an error."""
    if not producer or selector not in SELECTORS or (selector == "bundle") != (selector_key == ""):
        raise InvalidParameter("a dependency has a producer, and a selector of bundle, or of concept, path or path_prefix with a key")
    if target_scope_kind not in ("bundle", "concept", "path", "group") or (target_scope_kind == "bundle") != (target_scope_key is None):
        raise InvalidParameter("a target is a bundle, or a concept, path or group with a key")
    baseline = bundle_row(bundles, source_bundle_id)["catalog_generation"]
    bundle_row(bundles, target_bundle_id)
    new = {"producer": producer, "source_bundle_id": source_bundle_id, "selector": selector, "selector_key": selector_key, "target_bundle_id": target_bundle_id, "target_scope_kind": target_scope_kind, "target_scope_key": target_scope_key}
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.lit(v)) for k, v in new.items()])
    taken, last = dependencies.agg(F.count_if(same), F.max("dep_id")).first()
    if taken:
        raise Duplicate("the dependency is registered")
    row = {**new, "dep_id": (last or 0) + 1, "causation_key": causation_key, "watermark": baseline, "enabled": True}
    added = dependencies.sparkSession.createDataFrame([row], DEPENDENCY)
    return dependencies.unionByName(added), row["dep_id"]


def _there(dependencies: DataFrame, dep_id: int) -> None:
    if dependencies.where(F.col("dep_id") == dep_id).limit(1).isEmpty():
        raise NotFound(f"no dependency {dep_id}")


def disable(dependencies: DataFrame, dep_id: int) -> DataFrame:
    _there(dependencies, dep_id)
    return dependencies.withColumn("enabled", F.col("enabled") & (F.col("dep_id") != dep_id))


def remove(dependencies: DataFrame, dep_id: int) -> DataFrame:
    _there(dependencies, dep_id)
    return dependencies.where(F.col("dep_id") != dep_id)


def list_dependencies(dependencies: DataFrame, max_rows: int = 100) -> DataFrame:
    bounded("max_rows", max_rows, 0)
    return dependencies.orderBy("dep_id").limit(max_rows)


def evaluate(dependencies: DataFrame, changes: DataFrame) -> DataFrame:
    """(dep_id, target_bundle_id, watermark_now, n): the enabled dependencies whose source has changed beyond their
    watermark, and how many changes each selects.

    ``changes`` (bundle_id, concept_id, path, generation, causation). The watermark goes to the source's newest generation
    whatever is selected; a change that the dependency's own reconciliation has caused (its causation key) counts for
    nothing. Changes are summed by what selectors look at before they are joined, and prefixes are equi-joined: a path is
    cut to the lengths that prefixes have, so a bundle with many changes meets few dependencies.
    """
    live = dependencies.where("enabled")
    per_bundle = changes.groupBy("bundle_id", "generation", "causation").agg(F.count(F.lit(1)).alias("n"))
    newest = per_bundle.groupBy(F.col("bundle_id").alias("source_bundle_id")).agg(F.max("generation").alias("watermark_now"))
    advanced = live.join(newest, "source_bundle_id").where("watermark_now > watermark").select("dep_id", "target_bundle_id", "watermark_now")

    def selected(selector: str, summed: DataFrame, key: str | None) -> DataFrame:
        deps = live.where(F.col("selector") == selector).select("dep_id", F.col("source_bundle_id").alias("bundle_id"), F.col("selector_key").alias("key"), "watermark", "causation_key")
        joined = deps.drop("key").join(summed, "bundle_id") if key is None else deps.join(summed.withColumnRenamed(key, "key"), ["bundle_id", "key"])
        news = joined.where((F.col("generation") > F.col("watermark")) & ~(F.col("causation").isNotNull() & F.col("causation").eqNullSafe(F.col("causation_key"))))
        return news.select("dep_id", "n")

    by = lambda key: changes.groupBy("bundle_id", key, "generation", "causation").agg(F.count(F.lit(1)).alias("n"))
    lengths = [r[0] for r in live.where("selector = 'path_prefix'").select(F.length("selector_key")).distinct().collect()]  # a path's length bounds them
    cuts = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)]).cast("array<string>")
    prefixes = by("path").withColumn("prefix", F.explode(F.array_compact(cuts))).groupBy("bundle_id", "prefix", "generation", "causation").agg(F.sum("n").alias("n"))
    hits = selected("bundle", per_bundle, None).unionByName(selected("concept", by("concept_id"), "concept_id")).unionByName(selected("path", by("path"), "path")).unionByName(selected("path_prefix", prefixes, "prefix"))
    fired = hits.groupBy("dep_id").agg(F.sum("n").alias("n"))
    return advanced.join(fired, "dep_id", "left").select("dep_id", "target_bundle_id", "watermark_now", F.coalesce("n", F.lit(0)).alias("n"))


def evaluate_event(dependencies: DataFrame, changes: DataFrame, source_bundle_id: int, generation: int, *, causation: str | None = None, is_state_change: bool = False, truncated: bool = False, cap: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(table with watermarks advanced, what goes stale) for one change event of a bundle.

    What goes stale is (bundle_id, scope_kind, scope_key, reason). Where it isn't known what has changed (a change of state,
    a list that was cut), other selectors than bundle can't be looked at: then the source is stale itself, and the targets
    of all its dependencies are. Bundles that go stale send on what depends on them.
    """
    ours = (F.col("source_bundle_id") == source_bundle_id) & F.col("enabled") & (F.col("watermark") < generation)
    after = dependencies.withColumn("watermark", F.when(ours, F.lit(generation).cast("long")).otherwise(F.col("watermark")))
    caused = F.lit(False) if causation is None else F.col("causation_key").eqNullSafe(F.lit(causation))
    mine = dependencies.where(ours & ~caused)
    event = changes.select(F.lit(source_bundle_id).cast("long").alias("bundle_id"), "concept_id", "path", F.lit(generation).cast("long").alias("generation"), F.lit(None).cast("string").alias("causation"))
    unknown = is_state_change or truncated
    hit = mine.select("dep_id") if unknown else evaluate(mine, event).where("n > 0").select("dep_id").unionByName(mine.where("selector = 'bundle'").select("dep_id")).distinct()
    targets = mine.join(hit, "dep_id", "left_semi").select(F.col("target_bundle_id").alias("bundle_id"), F.col("target_scope_kind").alias("scope_kind"), F.coalesce("target_scope_key", F.lit("")).alias("scope_key"), F.lit("dependency_source_changed").alias("reason"))
    stale = targets.unionByName(_sent_on(dependencies, targets, causation, cap))
    if unknown:
        blind = mine.where("selector <> 'bundle'").select(F.lit(source_bundle_id).cast("long").alias("bundle_id"), F.lit("bundle").alias("scope_kind"), F.lit("").alias("scope_key"), F.lit("scope_unknown").alias("reason"))
        stale = stale.unionByName(blind)
    return after, stale.distinct()


def _sent_on(dependencies: DataFrame, targets: DataFrame, causation: str | None, cap: int) -> DataFrame:
    """What depends on the bundles among ``targets``, at bundle scope."""
    roots = [r[0] for r in targets.where("scope_kind = 'bundle'").select("bundle_id").distinct().limit(cap).collect()]
    further, _ = transitive_invalidation(dependencies, roots, causation, cap)
    return further.select(F.col("target_bundle_id").alias("bundle_id"), F.lit("bundle").alias("scope_kind"), F.lit("").alias("scope_key"), F.lit("dependency_source_changed").alias("reason"))


def departing_dependents(dependencies: DataFrame, source_bundle_id: int, cap: int = 1024) -> DataFrame:
    """What goes stale when a bundle is unregistered: the targets of its enabled dependencies, and what depends on them."""
    mine = dependencies.where((F.col("source_bundle_id") == source_bundle_id) & F.col("enabled"))
    targets = mine.select(F.col("target_bundle_id").alias("bundle_id"), F.col("target_scope_kind").alias("scope_kind"), F.coalesce("target_scope_key", F.lit("")).alias("scope_key"), F.lit("dependency_source_changed").alias("reason"))
    return targets.unionByName(_sent_on(dependencies, targets, None, cap)).distinct()


# --- states: a table (bundle_id, scope_kind, scope_key, state, reasons, stale_since, epoch)

STATE = "bundle_id long, scope_kind string, scope_key string, state string, reasons array<string>, stale_since long, epoch long"


def mark(states: DataFrame, targets: DataFrame, state: str, at: int, reasons: list[str] | None = None) -> DataFrame:
    """``states`` after reports on ``targets`` (bundle_id, scope_kind, scope_key, and reason if they have their own).

    Reasons merge while a state lasts and are replaced when it changes; without any it is producer_reported. stale_since is
    kept until the scope is fresh; retired stays; every report counts in the epoch. Scopes without a row get one.
    """
    if state not in STATES:
        raise InvalidParameter(f"no state {state!r}")
    key = ["bundle_id", "scope_kind", "scope_key"]
    given = F.array(*[F.lit(r) for r in reasons or ["producer_reported"]])
    own = F.array_sort(F.collect_set("reason")) if "reason" in targets.columns else F.array_sort(F.first(given))
    reported = targets.groupBy(*key).agg(own.alias("__new"))
    joined = states.join(reported, key, "full_outer")
    hit = F.col("__new").isNotNull() & ~(F.coalesce("state", F.lit("")) == "retired")
    lasts = F.col("state").eqNullSafe(F.lit(state))
    merged = F.array_sort(F.array_distinct(F.concat(F.coalesce("reasons", F.array().cast("array<string>")), "__new")))
    now_reasons = F.array().cast("array<string>") if state == "fresh" else F.when(lasts, merged).otherwise(F.col("__new"))
    since = F.lit(None).cast("long") if state == "fresh" else F.coalesce("stale_since", F.lit(at).cast("long"))
    pick = lambda new, old: F.when(hit, new).otherwise(F.col(old)).alias(old)
    return joined.select(*key, pick(F.lit(state), "state"), pick(now_reasons, "reasons"), pick(since, "stale_since"), pick(F.coalesce("epoch", F.lit(0).cast("long")) + 1, "epoch"))


def clear_scope(states: DataFrame, bundle_id: int, scope_kind: str, scope_key: str) -> DataFrame:
    """Without a scope's row; a bundle's own can't be cleared."""
    if scope_kind == "bundle":
        raise InvalidParameter("a bundle's state is marked, not cleared")
    return states.where(~((F.col("bundle_id") == bundle_id) & (F.col("scope_kind") == scope_kind) & (F.col("scope_key") == scope_key)))


def mark_fresh(freshness: DataFrame, bundles: DataFrame, bundle_id: int, expected_generation: int, claimed_epoch: int, observed: str | None = None, manifest_hash: str | None = None) -> tuple[DataFrame, bool]:
    """(table, whether it was taken): compare and set of a bundle's row to fresh.

    ``freshness`` (bundle_id, state, reasons, stale_since, observed_generation, materialized_generation, invalidation_epoch,
    claimed_epoch, coverage_missing_since, manifest_hash). Taken only if the row isn't retired, the source is what the
    caller saw, the catalog is at the expected generation and the row not beyond it, neither epoch has passed the
    claimed one, and relationship coverage is whole, by its time and by the reasons.
    """
    at = bundle_row(bundles, bundle_id)["catalog_generation"]
    good = (
        (F.col("bundle_id") == bundle_id) & (F.col("state") != "retired") & F.col("observed_generation").eqNullSafe(F.lit(observed)) & F.lit(at == expected_generation)
        & F.coalesce(F.col("materialized_generation") <= expected_generation, F.lit(True)) & (F.col("invalidation_epoch") <= claimed_epoch) & (F.col("claimed_epoch") <= claimed_epoch)
        & F.col("coverage_missing_since").isNull() & ~F.array_contains("reasons", "relationship_coverage_missing")
    )
    taken = not freshness.where(good).limit(1).isEmpty()
    new = {"state": F.lit("fresh"), "reasons": F.array().cast("array<string>"), "stale_since": F.lit(None).cast("long"), "materialized_generation": F.lit(expected_generation).cast("long"), "manifest_hash": F.coalesce(F.lit(manifest_hash), "manifest_hash")}
    return (freshness.select(*[F.when(good, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in freshness.columns]) if taken else freshness), taken


# --- publication fences: a table of FENCE's columns


def issue_fence(fences: DataFrame, bundles: DataFrame, bundle_id: int, producer: str, target_generation: int, expected_generation: int, now: int, lease_s: int = 300, manifest_hash: str | None = None) -> tuple[DataFrame, int]:
    """(table, token): a producer's slot for a bundle, with the next token. A newer attempt takes over from an older one;
    target generations only grow, and the catalog must be where the caller has seen it."""
    bounded("lease_s", lease_s, 1, 86_400)
    bounded("target_generation", target_generation, 1)
    if not producer:
        raise InvalidParameter("a fence has a producer")
    bundle = bundle_row(bundles, bundle_id)
    if bundle["catalog_generation"] != expected_generation:
        raise InvalidParameter(f"the catalog is at generation {bundle['catalog_generation']}, not {expected_generation}")
    slot = (F.col("tenant_id") == bundle["tenant_id"]) & (F.col("producer") == producer) & (F.col("bundle_id") == bundle_id)
    held = fences.where(slot).limit(1).collect()
    if held and target_generation <= held[0]["target_generation"]:
        raise InvalidParameter("target generations only grow")
    token = held[0]["fencing_token"] + 1 if held else 1
    row = (bundle["tenant_id"], producer, bundle_id, target_generation, token, expected_generation, manifest_hash, "issued", now, now + lease_s)
    return fences.where(~slot).unionByName(fences.sparkSession.createDataFrame([row], FENCE)), token


def live_fence(fences: DataFrame, bundle_id: int, producer: str, token: int, now: int) -> Row:
    """The fence that a token holds; one that was taken over, released or has run out is an error."""
    found = fences.where((F.col("bundle_id") == bundle_id) & (F.col("producer") == producer) & (F.col("fencing_token") == token) & (F.col("state") == "issued") & (F.col("expires_at") > now)).limit(1).collect()
    if not found:
        raise InvalidParameter("the token holds no fence")
    return found[0]


def release_fence(fences: DataFrame, bundle_id: int, producer: str, token: int, now: int) -> DataFrame:
    live_fence(fences, bundle_id, producer, token, now)
    mine = (F.col("bundle_id") == bundle_id) & (F.col("producer") == producer) & (F.col("fencing_token") == token)
    return fences.withColumn("state", F.when(mine, "released").otherwise(F.col("state")))
