"""History: SCD-2 versions, point-in-time reads, pruning, audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from conceptlake.errors import bounded


def versions(changes: DataFrame) -> DataFrame:
    """SCD-2 rows from a change log (concept_id, at_us, event_id, change_kind, title).

    Versions count from 1 by time; each ends where the next begins. A removal is a version of no width, so that no
    point in time finds it, and it ends the version before. One window over a concept's changes.
    """
    order = Window.partitionBy("concept_id").orderBy("at_us", "event_id")
    rows = changes.withColumn("version", F.row_number().over(order).cast("long")).withColumn("next", F.lead("at_us").over(order))
    ends = F.when(F.col("change_kind") == "removed", F.col("at_us")).otherwise(F.col("next"))
    return rows.select("concept_id", "version", F.col("at_us").alias("valid_from"), ends.alias("valid_to"), "change_kind", "title")


def concept_history(history: DataFrame, concept_id: str, max_rows: int = 100) -> DataFrame:
    bounded("max_rows", max_rows, 0)
    return history.where(F.col("concept_id") == concept_id).orderBy(F.col("version").desc()).limit(max_rows)


def concept_as_of(history: DataFrame, at_us: int, concept_id: str | None = None) -> DataFrame:
    """The version of each concept that holds at an instant (from inclusive, to exclusive)."""
    rows = history if concept_id is None else history.where(F.col("concept_id") == concept_id)
    live = rows.where((F.col("valid_from") <= at_us) & (F.col("valid_to").isNull() | (F.col("valid_to") > at_us)))
    newest = F.max_by(F.struct("version", "valid_from", "title"), "version").alias("v")
    return live.groupBy("concept_id").agg(newest).select("concept_id", "v.version", "v.valid_from", "v.title")


def prune(history: DataFrame, older_than_us: int, now_us: int) -> DataFrame:
    """Without closed versions older than the retention; 0 keeps all."""
    if older_than_us == 0:
        return history
    return history.where(F.col("valid_to").isNull() | (F.col("valid_to") >= now_us - older_than_us))


def apply_sync(history: DataFrame, diff: DataFrame, at_us: int) -> DataFrame:
    """History after one sync: ``diff`` (concept_id, change, title), change of added, updated, removed, unchanged."""
    moved = diff.where("change <> 'unchanged'")
    last = history.groupBy("concept_id").agg(F.max("version").alias("last"))
    closed = history.join(moved.select("concept_id", F.lit(True).alias("__m")), "concept_id", "left")
    closed = closed.withColumn("valid_to", F.when(F.col("__m") & F.col("valid_to").isNull(), F.lit(at_us)).otherwise(F.col("valid_to"))).select(*history.columns)
    new = moved.join(last, "concept_id", "left").select("concept_id", (F.coalesce("last", F.lit(0)) + 1).alias("version"), F.lit(at_us).alias("valid_from"), F.when(F.col("change") == "removed", F.lit(at_us)).alias("valid_to"), F.col("change").alias("change_kind"), "title")
    return closed.unionByName(new)


def sync_diff(stored: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, change, before_hash, after_hash) between what is stored and what a scan found.

    Both have path and file_hash, and may have concept_id (the id that a path has), owner (the package that a resource
    belongs to) and projected (whether a manifest has its package's row). The same bytes are unchanged only under the
    same id and owner, and if nothing is still to be projected.
    """
    known = [c for c in ("concept_id", "owner") if c in stored.columns and c in snapshot.columns]
    a = stored.select("path", F.col("file_hash").alias("was"), *[F.col(c).alias(f"was_{c}") for c in known], *(["projected"] if "projected" in stored.columns else []))
    b = snapshot.select("path", F.col("file_hash").alias("is"), *[F.col(c).alias(f"is_{c}") for c in known])
    same = F.col("was") == F.col("is")
    for c in known:
        same = same & F.col(f"was_{c}").eqNullSafe(F.col(f"is_{c}"))
    if "projected" in stored.columns:
        same = same & F.coalesce("projected", F.lit(True))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(same, "unchanged").otherwise("updated")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"), F.col("was").alias("before_hash"), F.col("is").alias("after_hash"))


def change_manifest(diff: DataFrame, ids: DataFrame) -> DataFrame:
    """Per changed concept its id, kind and hashes. ``ids`` (path, id_was, id_is): a path whose id has changed is removed
    under the old one, with the hash before, and added under the new one, with the hash after."""
    moved = diff.where("change <> 'unchanged'").join(ids, "path", "left")
    again = (F.col("change") == "updated") & F.col("id_was").isNotNull() & ~F.col("id_was").eqNullSafe(F.col("id_is"))
    none = F.lit(None).cast("string")
    row = lambda kind, name, before, after: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), name.alias("concept_id"), before.alias("before_hash"), after.alias("after_hash"))
    was, is_ = F.coalesce("id_was", "path"), F.coalesce("id_is", "id_was", "path")
    two = F.array(row("removed", was, F.col("before_hash"), none), row("added", is_, none, F.col("after_hash")))
    one = F.array(row(F.col("change"), F.when(F.col("change") == "removed", was).otherwise(is_), F.col("before_hash"), F.when(F.col("change") != "removed", F.col("after_hash"))))
    return moved.select("path", F.explode(F.when(again, two).otherwise(one)).alias("c")).select("path", "c.kind", "c.concept_id", "c.before_hash", "c.after_hash")


def list_log(log: DataFrame, order: list, max_rows: int = 100, **equal) -> DataFrame:
    """Newest rows of an audit log under equality filters that are given."""
    bounded("max_rows", max_rows, 0)
    for column, value in equal.items():
        if value is not None:
            log = log.where(F.col(column) == value)
    return log.orderBy(*order).limit(max_rows)
