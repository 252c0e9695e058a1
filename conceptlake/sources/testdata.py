"""Catalog tables derived from the driver's parquet tables, by fixed rules.

The SQL twin of these rules is ``plans.oracle.CATALOG``; both engines see the same catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from conceptlake.catalog import Catalog


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> F.Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def bundle_id() -> F.Column:
    return (F.substring("source", 4, 20).cast("long") + 1).alias("bundle_id")


def tenant(bundle: str = "bundle_id") -> F.Column:
    return F.concat(F.lit("t"), (F.col(bundle) % 3).cast("string"))


def bundles(docs: DataFrame) -> DataFrame:
    named = docs.select("source", bundle_id()).groupBy("source", "bundle_id").agg(F.count(F.lit(1)).alias("file_count"))
    retired = F.when(F.col("bundle_id") % 11 == 0, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    synced = F.timestamp_seconds(F.lit(1704067200) + F.col("bundle_id") * 7200)
    return named.select("bundle_id", F.col("source").alias("name"), F.concat(F.lit("/bundles/"), "source").alias("path"), "file_count", (F.col("bundle_id") % 7 != 0).alias("enabled"), retired.alias("retired_at"), synced.alias("last_synced_at"), (F.col("bundle_id") * 3 % 5).alias("catalog_generation"), tenant().alias("tenant_id"))


def concepts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    marks = labels.select("doc_id", "quality", "toxic")
    tags = F.array_compact(F.array("lang", F.when(F.col("quality") == 1, "curated").when(F.col("quality") == 0, "rough"), F.when(F.col("toxic") == 1, "toxic")))
    return docs.select("doc_id", "text", "lang", bundle_id()).join(marks, "doc_id", "left").select(
        "bundle_id", F.concat(F.lit("doc/"), "doc_id").alias("concept_id"), F.concat(F.lit("doc/"), "doc_id", F.lit(".md")).alias("path"), F.col("lang").alias("type"),
        F.substring_index("text", "\n", 1).alias("title"), F.concat(F.lit("language "), "lang").alias("description"), F.when(F.col("doc_id") % 10 != 9, tags).alias("tags"),
        F.col("text").alias("body_text"), F.sha2("text", 256).alias("file_hash"), "doc_id", tenant().alias("tenant_id"),
    )


def provenance(docs: DataFrame, labels: DataFrame) -> DataFrame:
    tier = F.when(F.col("toxic") == 1, "unverified").when(F.col("quality") == 1, "human-reviewed").otherwise("machine-confirmed")
    return docs.select("doc_id", bundle_id()).join(labels.select("doc_id", "quality", "toxic"), "doc_id").select(
        "bundle_id", F.concat(F.lit("doc/"), "doc_id").alias("concept_id"), F.when(F.col("quality") == 1, "stable").otherwise("draft").alias("status"), tier.alias("trust_tier"),
        F.concat(F.lit("agent:"), (F.col("doc_id") % 5).cast("string")).alias("generated_by"), (F.lit(1704067200) + F.col("doc_id") % 400 * 86400).alias("stale_after_s"), "doc_id", tenant().alias("tenant_id"),
    )


def verifications(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Up to three verifications of each labelled concept."""
    rows = provenance(docs, labels).select("bundle_id", "concept_id", "doc_id", "tenant_id", F.explode(F.expr("sequence(0, cast(doc_id % 3 as int))")).alias("ordinal"))
    who = F.when((F.col("doc_id") + F.col("ordinal")) % 2 == 0, F.concat(F.lit("human:"), (F.col("doc_id") % 7).cast("string"))).otherwise("bot:check")
    return rows.select("bundle_id", "concept_id", "ordinal", who.alias("verified_by"), (F.lit(1704067200) + (F.col("doc_id") * 31 + F.col("ordinal") * 17) % 1000 * 3600).alias("verified_at_s"), "tenant_id")


def links(docs: DataFrame) -> DataFrame:
    """Three links from each document to others of its bundle, by arithmetic over their places; those beyond the last are
    unresolved."""
    at = docs.select("doc_id", bundle_id()).withColumn("i", F.row_number().over(Window.partitionBy("bundle_id").orderBy("doc_id")) - 1)
    size = docs.select(bundle_id()).groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n"))
    rows = at.join(size, "bundle_id").select("doc_id", "bundle_id", "i", "n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("ordinal"))
    rows = rows.withColumn("t", F.expr("(i * (2 * ordinal + 1) + ordinal) % (n + n div 10 + 1)"))
    there = at.select("bundle_id", F.col("i").alias("t"), F.col("doc_id").alias("to"))
    target = F.coalesce(F.concat(F.lit("doc/"), "to"), F.concat(F.lit("gone/"), "bundle_id", F.lit("/"), "t"))
    return rows.join(there, ["bundle_id", "t"], "left").select(
        "bundle_id", F.concat(F.lit("doc/"), "doc_id").alias("source_id"), target.alias("target_id"), "ordinal", F.col("to").isNotNull().alias("resolved"), F.lit(False).alias("is_external"),
        F.when(F.col("ordinal") == 3, "reference").otherwise("inline").alias("link_kind"), tenant().alias("tenant_id"),
    )


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges between bundles: customers placed orders (every 13th unresolved), orders supplied by suppliers, customers
    of one nation (undirected); and a superseded publication of orders."""
    orders, customer, lines = (read(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    home = lambda c: (F.col(c) % 20 + 1).cast("long")

    def rows(df: DataFrame, number: int, kind: str, source: str, s: str, target: str, t: str, direction: str = "directed", unresolved: Column | None = None) -> DataFrame:
        return df.select(
            F.lit(number).cast("long").alias("publication_id"), home(source).alias("source_bundle_id"), F.concat(F.lit(s), source).alias("source_concept_id"), F.lit(kind).alias("relation_type"), F.lit(direction).alias("direction"),
            home(target).alias("target_bundle_id"), F.concat(F.lit(t), target).alias("target_concept_id"), F.lit(None).cast("string").alias("external_target"), F.lit(0.5).alias("confidence"),
            (F.lit(False) if unresolved is None else unresolved).alias("unresolved"),
        )

    first = customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("first"))
    placed = rows(orders, 1, "sales:placed", "o_custkey", "c/", "o_orderkey", "o/", unresolved=F.col("o_orderkey") % 13 == 0)
    supplied = rows(lines.select("l_orderkey", "l_suppkey").distinct(), 2, "sales:supplied_by", "l_orderkey", "o/", "l_suppkey", "s/")
    same = rows(first.join(customer, "c_nationkey").where("c_custkey <> first"), 3, "geo:same_nation", "first", "c/", "c_custkey", "c/", "undirected")
    old = rows(orders, 4, "sales:asked_for", "o_custkey", "c/", "o_orderkey", "o/")
    return placed.unionByName(supplied).unionByName(same).unionByName(old)


def publications(spark: SparkSession) -> DataFrame:
    """Publications 1 to 3 are active, 4 is superseded."""
    return spark.range(1, 5).select(F.col("id").alias("publication_id"), F.lit("t0").alias("tenant_id"), F.when(F.col("id") < 4, "active").otherwise("superseded").alias("state"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector i belongs to document i; every fifth has an old contract. Vectors without a document are left out."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), bundle_id())
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").join(docs, "vec_id")
    return rows.select("bundle_id", F.concat(F.lit("doc/"), "vec_id").alias("concept_id"), "vec_id", "embedding", F.size("embedding").alias("dim"), F.lit("m1").alias("model"), F.when(F.col("vec_id") % 5 == 4, "v0").otherwise("v1").alias("contract"), tenant().alias("tenant_id"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log of concepts user/<id>: event type gives the change, purchases remove."""
    kind = F.when(F.col("event_type") == "purchase", "removed").otherwise("updated")
    return read(spark, sf_dir, "events").select(F.concat(F.lit("user/"), "user_id").alias("concept_id"), micros("ts").alias("at_us"), "event_id", kind.alias("change_kind"), F.col("event_type").alias("title"))


def freshness(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bundle, concept, path) freshness states: every third bundle isn't fresh; concept 13 of 17, path 5 of 19 have a row."""
    state = F.when(F.col("bundle_id") % 3 != 0, "fresh").when(F.col("bundle_id") % 2 == 0, "stale").otherwise("reconciling")
    bundle = docs.select(bundle_id()).distinct().select("bundle_id", state.alias("state"))
    concept = docs.where("doc_id % 17 = 13").select(bundle_id(), F.concat(F.lit("doc/"), "doc_id").alias("concept_id"), F.when(F.col("doc_id") % 2 == 0, "blocked").otherwise("fresh").alias("state"))
    path = docs.where("doc_id % 19 = 5").select(bundle_id(), F.concat(F.lit("doc/"), "doc_id", F.lit(".md")).alias("path"), F.lit("stale").alias("state"))
    return bundle, concept, path


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of bundles: what order n / 2 is for, depends on order n."""
    scope = F.when(F.col("o_orderkey") % 7 == 0, "concept").otherwise("bundle")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_bundle_id"), F.expr("o_orderkey div 2").alias("target_bundle_id"), scope.alias("target_scope_kind"), F.concat(F.lit("k"), F.col("o_custkey") % 5).alias("causation_key"), (F.col("o_orderkey") % 11 != 0).alias("enabled"))


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    bundle_state, concept_state, path_state = freshness(docs)
    return Catalog(spark, {
        "bundles": bundles(docs), "concepts": concepts(docs, labels), "concept_provenance": provenance(docs, labels), "concept_verification": verifications(docs, labels), "links": links(docs),
        "relationships": relationships(spark, sf_dir), "relationship_publications": publications(spark), "concept_embedding": embeddings(spark, sf_dir), "changes": history(spark, sf_dir),
        "bundle_freshness": bundle_state, "concept_freshness": concept_state, "path_freshness": path_state, "dependencies": dependencies(spark, sf_dir),
    }, text_config="simple")
