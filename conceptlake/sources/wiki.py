"""A wiki space as a source: pages as Markdown files, a checkpoint of what was taken, and what has changed since.

A snapshot is a table (page_id, path, version, file_hash). After a successful import it is kept as a checkpoint, with the
identity it belongs to (source, bundle, tenant); the next import is compared with it. A checkpoint of another identity, or
with newer versions than the pages at hand have, is refused: the wiki was asked for the wrong space, or for an old state.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from conceptlake.errors import InvalidParameter
from conceptlake.sources.bundle import html_to_markdown


@dataclass(frozen=True)
class Identity:
    source: str
    bundle: str
    tenant: str

    def __post_init__(self) -> None:
        for name, value in asdict(self).items():
            if not isinstance(value, str) or not value.strip() or "\0" in value:
                raise InvalidParameter(f"{name} must be a text that isn't blank")


def path_of(page_id: Column) -> Column:
    return F.concat(F.lit("pages/"), page_id, F.lit(".md"))


def documents(pages: DataFrame) -> DataFrame:
    """(page_id, path, version, content, file_hash) of pages (page_id, version, title, html); ``content`` is Markdown."""

    def convert(title: pd.Series, html: pd.Series) -> pd.Series:
        return pd.Series([html_to_markdown(t or "", h or "").encode() for t, h in zip(title, html, strict=True)])

    body = F.pandas_udf(convert, "binary")
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("version").cast("long").alias("version"), body("title", "html").alias("content"))
    return rows.select("page_id", path_of(F.col("page_id")).alias("path"), "version", "content", F.sha2("content", 256).alias("file_hash"))


def snapshot(docs: DataFrame) -> DataFrame:
    """What a checkpoint keeps of documents. No documents, a repeated id, one that isn't a number, and a page without a
    version are errors; all are found by one aggregation."""
    bad = ~F.coalesce(F.col("page_id").rlike("^[0-9]+$") & (F.col("version") > 0), F.lit(False))
    per_page = docs.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max(bad).alias("bad"))
    seen = per_page.agg(F.count(F.lit(1)).alias("pages"), F.max("n").alias("n"), F.max("bad").alias("bad")).first()
    if not seen["pages"]:
        raise InvalidParameter("the space has no pages")
    if seen["bad"]:
        raise InvalidParameter("a page's id isn't a number, or it has no version")
    if seen["n"] > 1:
        raise InvalidParameter("a page is given twice")
    return docs.select("page_id", "path", "version", "file_hash")


def changes(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """(page_id, path, change) between two snapshots: added, updated, removed or unchanged. One full outer join."""
    if before is None:
        return now.select("page_id", "path", F.lit("added").alias("change"))
    a = before.select("page_id", F.col("version").alias("__was"), F.col("file_hash").alias("__old"))
    both = now.join(a, "page_id", "full_outer")
    kind = F.when(F.col("__was").isNull(), "added").when(F.col("version").isNull(), "removed").when(F.col("file_hash") == F.col("__old"), "unchanged").otherwise("updated")
    return both.select("page_id", path_of(F.col("page_id")).alias("path"), kind.alias("change"))


def check(now: DataFrame, before: DataFrame) -> None:
    """An error if a page is older than the checkpoint has it."""
    older = now.alias("n").join(before.alias("b"), "page_id").where("n.version < b.version")
    if not older.isEmpty():
        raise InvalidParameter("a page's version is below the checkpoint's")


def removed_ids(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """(page_id) of the pages that the checkpoint has and the wiki hasn't any more."""
    return now.select("page_id").where(F.lit(False)) if before is None else before.select("page_id").join(now.select("page_id"), "page_id", "left_anti")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The checkpoints that were written to their end, the newest last."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(s.getPath().getParent().toString() for s in found or [])


def write_checkpoint(now: DataFrame, path: str, identity: Identity) -> str:
    """Keep a snapshot; one that fails half-way leaves the last one in force. One writer at a time."""
    last = _folders(now.sparkSession, path)
    at = f"{path.rstrip('/')}/{int(last[-1].rpartition('/')[2]) + 1 if last else 1:012d}"
    labelled = now.select(*[F.lit(v).alias(f"__{k}") for k, v in asdict(identity).items()], "page_id", "path", "version", "file_hash")
    labelled.write.mode("overwrite").parquet(at)
    return at


def read_checkpoint(spark: SparkSession, path: str, identity: Identity) -> DataFrame | None:
    """The last snapshot, or None before the first import."""
    found = _folders(spark, path)
    if not found:
        return None
    rows = spark.read.parquet(found[-1])
    foreign = F.lit(False)
    for k, v in asdict(identity).items():
        foreign = foreign | ~F.col(f"__{k}").eqNullSafe(F.lit(v))
    if not rows.where(foreign).isEmpty():
        raise InvalidParameter("the checkpoint is of another source, bundle or tenant")
    return rows.select("page_id", "path", "version", "file_hash")
