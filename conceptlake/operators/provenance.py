"""Provenance of concepts, from their frontmatter's JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SCHEMA = """generated struct<by:string,at:string>, verified string, status string, stale_after string,
usage_window struct<`from`:string,`to`:string>,
sources array<struct<id:string,resource:string,title:string,author:string,usage_count:bigint,last_modified:string,usage_window:struct<`from`:string,`to`:string>>>"""
ISO = r"^\s*(\d{4})-(\d{2})-(\d{2})(?:[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?)?\s*([Zz]|[+-]\d{2}(?::?\d{2})?)?\s*$"


def iso_seconds(text: Column) -> Column:
    """Seconds since 1970 of an ISO-8601 date or time; no zone means UTC; what is no date is null.

    Second 60 is taken as the next minute's first.
    """
    part = lambda i, default="0": F.coalesce(F.nullif(F.regexp_extract(text, ISO, i), F.lit("")), F.lit(default))
    day = F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd")
    zone = F.regexp_replace(part(7, "Z"), ":", "")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    offset = F.when(F.upper(zone) == "Z", 0).otherwise(sign * (F.substring(zone, 2, 2).cast("int") * 3600 + F.coalesce(F.nullif(F.substring(zone, 4, 2), F.lit("")).cast("int"), F.lit(0)) * 60))
    h, m, s = part(4).cast("int"), part(5).cast("int"), part(6).cast("int")
    good = text.rlike(ISO) & (h < 24) & (m < 60) & (s <= 60)
    return F.when(good, F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + h * 3600 + m * 60 + s - offset)


def verifications(front: Column) -> Column:
    """array<struct<ordinal, by, at>>: entries of ``verified`` that name who, a single mapping being a list of one."""
    one = "struct<by:string,at:string>"
    alone = F.when(F.trim(front).startswith("{"), F.array(F.from_json(front, one)))
    every = F.coalesce(alone, F.from_json(front, f"array<{one}>"), F.array().cast(f"array<{one}>"))
    placed = F.transform(every, lambda v, i: F.struct(i.alias("ordinal"), F.trim(v["by"]).alias("by"), v["at"].alias("at")))
    return F.filter(placed, lambda v: v["by"].isNotNull() & (v["by"] != ""))


def tier_of(verified: Column) -> Column:
    human = F.exists(verified, lambda v: v["by"].startswith("human:"))
    return F.when(human, "human-reviewed").when(F.size(verified) == 0, "unverified").otherwise("machine-confirmed")


def project(fronts: DataFrame, keys: list[str], json_col: str = "front") -> dict[str, DataFrame]:
    """Provenance, verification and source tables of concepts (``keys`` and their frontmatter as JSON)."""
    rows = fronts.select(*keys, F.from_json(json_col, SCHEMA).alias("f")).withColumn("v", verifications(F.col("f.verified")))
    main = rows.select(
        *keys, F.col("f.generated.by").alias("generated_by"), iso_seconds(F.col("f.generated.at")).alias("generated_at_s"), F.col("f.status").alias("status"), iso_seconds(F.col("f.stale_after")).alias("stale_after_s"),
        iso_seconds(F.col("f.usage_window.from")).alias("usage_from_s"), iso_seconds(F.col("f.usage_window.to")).alias("usage_to_s"), tier_of(F.col("v")).alias("trust_tier"),
    )
    checks = rows.select(*keys, F.explode("v").alias("v")).select(*keys, "v.ordinal", F.col("v.by").alias("verified_by"), iso_seconds(F.col("v.at")).alias("verified_at_s"))
    sources = rows.select(*keys, F.posexplode("f.sources").alias("ordinal", "s")).select(*keys, "ordinal", F.col("s.id").alias("source_id"), "s.resource", "s.title", "s.author", "s.usage_count", iso_seconds(F.col("s.last_modified")).alias("last_modified_s"), iso_seconds(F.col("s.usage_window.from")).alias("usage_from_s"), iso_seconds(F.col("s.usage_window.to")).alias("usage_to_s"))
    return {"concept_provenance": main, "concept_verification": checks, "concept_provenance_source": sources}


def log_entries(logs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Entries of reserved logs (``keys`` and text): marks removed, with the time at their beginning."""
    line = F.trim(F.regexp_replace("line", r"^\s*(#+\s*|[-*+]\s+)", ""))
    rows = logs.select(*keys, F.posexplode(F.split(text_col, r"\r?\n")).alias("at", "line")).select(*keys, "at", line.alias("entry")).where("entry <> ''")
    stamp = F.regexp_extract("entry", r"^(\d{4}-\d{2}-\d{2}(?:[Tt ]\d{2}:\d{2}(?::\d{2})?(?:[Zz]|[+-]\d{2}:?\d{2})?)?)", 1)
    return rows.select(*keys, "at", iso_seconds(stamp).alias("logged_at_s"), "entry")
