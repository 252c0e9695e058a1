"""Bundle scans and ingest: directories or in-memory files to catalog tables, and Parquet and file sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from conceptlake.errors import InvalidParameter, NotFound
from conceptlake.operators import provenance

PARSED = """path string, concept_id string, type string, title string, declared_id string, description string, tags array<string>,
resource string, metadata map<string,string>, body_text string, file_hash string, trust_tier string, front string,
links array<struct<ordinal:int,link_kind:string,target:string,link_text:string,is_external:boolean,target_path:string>>, error string"""


def scan(spark: SparkSession, root: str, glob: str = "*.md", exclude: list[str] | None = None, max_file_bytes: int = 1 << 20, max_files: int = 100_000, max_bundle_bytes: int = 1 << 30) -> DataFrame:
    """(path, content) of a bundle's files; files too large, too many, or too much together are errors.

    ``exclude`` are patterns of paths below the root (``*`` and ``?`` stay in a folder, ``**`` doesn't).
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    whole = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    rows = rows.withColumn("path", F.substring(whole, F.length(F.lit("/" + base.lstrip("/"))) + 1, 1 << 20))
    for pattern in exclude or []:
        rows = rows.where(~F.col("path").rlike(glob_regex(pattern)))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("largest"), F.sum("length").alias("bytes")).first()
    if seen["n"] > max_files or (seen["largest"] or 0) > max_file_bytes or (seen["bytes"] or 0) > max_bundle_bytes:
        raise InvalidParameter(f"{seen['n']} files of {seen['bytes']} bytes, the largest of {seen['largest']}")
    return rows.select("path", "content")


def glob_regex(pattern: str) -> str:
    import re

    parts = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(x) or re.escape(x) for x in re.split(r"(\*\*|\*|\?)", pattern)) + "$"


def from_memory(spark: SparkSession, paths: list[str], contents: list[bytes]) -> DataFrame:
    if len(paths) != len(contents) or any(p is None or c is None for p, c in zip(paths, contents, strict=False)):
        raise InvalidParameter("paths and contents must be of one length and without nulls")
    return spark.createDataFrame([(p, bytearray(c)) for p, c in zip(paths, contents, strict=True)], "path string, content binary")


def from_object_store(spark: SparkSession, url: str, **limits) -> DataFrame:
    """Any store that Spark's file systems reach (s3a://, gs://, hdfs://)."""
    return scan(spark, url, **limits)


def parse(files: DataFrame) -> DataFrame:
    """Each file's concept, or an error column that says what is wrong; reserved files are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from conceptlake.sources import markdown, normalize

        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    clean = normalize.path(path)
                    if normalize.is_reserved(clean):
                        continue
                    c = markdown.parse(clean, bytes(content))
                    out.append((c.path, c.concept_id, c.type, c.title, c.declared_id, c.description, c.tags, c.resource, c.metadata, c.text, c.file_hash, c.trust_tier, c.front, c.links, None))
                except InvalidParameter as e:
                    out.append((path, *[None] * 13, str(e)))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in ("path", "concept_id", "type", "title", "declared_id", "description", "tags", "resource", "metadata", "body_text", "file_hash", "trust_tier", "front", "links", "error")])

    return files.select("path", "content").mapInPandas(run, PARSED)


def project(parsed: DataFrame, bundle_id: int, strict: bool = True) -> dict[str, DataFrame]:
    """Catalog tables of one bundle. Strict: any malformed file or repeated id is an error; else they are skipped."""
    if strict:
        bad = parsed.where("error IS NOT NULL").select("error").limit(1).collect()
        if bad:
            raise InvalidParameter(bad[0][0])
        if not parsed.groupBy("concept_id").count().where("count > 1").isEmpty():
            raise InvalidParameter("an id is given twice")
    good = parsed.where("error IS NULL").withColumn("bundle_id", F.lit(bundle_id).cast("long"))
    concepts = good.select("bundle_id", "concept_id", "path", "type", "title", "description", "tags", "resource", "body_text", "file_hash")
    metadata = good.select("bundle_id", "concept_id", F.explode("metadata").alias("key", "value"))
    raw = good.select("bundle_id", F.col("concept_id").alias("source_id"), F.explode("links").alias("l")).select("bundle_id", "source_id", "l.*")
    links = resolve_links(raw, concepts)
    return {"concepts": concepts, "concept_metadata": metadata, "links": links, **provenance.project(good, ["bundle_id", "concept_id"])}


def resolve_links(links: DataFrame, concepts: DataFrame) -> DataFrame:
    """``links`` (bundle_id, target_path, is_external, and target_id if they have one) with target_id and resolved.

    A concept at the target's path gives its id, whatever the link says (a file that became a package's keeps its ending
    in its id); else the id that the link has, or its path's without .md, if there is such a concept. Two equi-joins
    within the bundle. It is as good for links that were resolved before: what has gone is unresolved again.
    """
    by_path = concepts.select("bundle_id", F.col("path").alias("target_path"), F.col("concept_id").alias("__at"))
    by_id = concepts.select("bundle_id", F.col("concept_id").alias("__id"), F.lit(True).alias("__there"))
    said = F.col("target_id") if "target_id" in links.columns else F.lit(None).cast("string")
    rows = links.withColumn("__said", F.when(~F.col("is_external"), F.coalesce(said, F.regexp_replace("target_path", r"\.md$", ""))))
    rows = rows.join(by_path, ["bundle_id", "target_path"], "left").withColumn("__id", F.coalesce("__at", "__said"))
    rows = rows.join(by_id, ["bundle_id", "__id"], "left")
    there = F.coalesce("__there", F.lit(False)) & ~F.col("is_external")
    return rows.withColumn("target_id", F.when(there, F.col("__id"))).withColumn("resolved", there).drop("__said", "__at", "__id", "__there")


def concept_source(files: DataFrame, concepts: DataFrame, bundle_id: int, concept_id: str) -> bytes:
    """The stored bytes of a concept's file; that there is no concept and that no bytes are stored are told apart."""
    at = concepts.where((F.col("bundle_id") == bundle_id) & (F.col("concept_id") == concept_id)).select("path")
    found = at.limit(1).join(files.where(F.col("bundle_id") == bundle_id).select("path", "content"), "path", "left").collect()
    if not found:
        raise NotFound(f"no concept {concept_id!r} in bundle {bundle_id}")
    if found[0]["content"] is None:
        raise NotFound(f"no source is stored for concept {concept_id!r}")
    return bytes(found[0]["content"])


def export_parquet(tables: dict[str, DataFrame], destination: str) -> dict[str, str]:
    """Each table as zstd Parquet in a folder of its own, in as many files as its size asks."""
    out = {}
    for name, df in tables.items():
        out[name] = f"{destination.rstrip('/')}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(out[name])
    return out


def export_sources(files: DataFrame, destination: str) -> DataFrame:
    """Write each file's bytes under a local or mounted folder after checking its hash: (path, n_bytes, sha256)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        from pathlib import Path

        from conceptlake.sources import normalize

        for batch in batches:
            out = []
            for path, content, want in zip(batch["path"], batch["content"], batch["file_hash"], strict=True):
                data = bytes(content)
                digest = hashlib.sha256(data).hexdigest()
                if want is not None and digest != want:
                    raise InvalidParameter(f"{path}: its bytes have changed")
                to = Path(destination, normalize.path(path))
                to.parent.mkdir(parents=True, exist_ok=True)
                to.write_bytes(data)
                out.append((path, len(data), digest))
            yield pd.DataFrame(out, columns=["path", "n_bytes", "sha256"])

    return files.select("path", "content", "file_hash").mapInPandas(run, "path string, n_bytes long, sha256 string")


def html_to_markdown(title: str, html: str, kind: str = "page") -> str:
    """A wiki page's storage HTML as a Markdown concept."""
    import re
    from html import unescape

    text = re.sub(r"(?is)<(script|style)\b.*?</\1>", "", html)
    text = re.sub(r"(?is)<h([1-6])[^>]*>(.*?)</h\1>", lambda m: "\n\n" + "#" * int(m[1]) + " " + m[2] + "\n\n", text)
    text = re.sub(r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', lambda m: f"[{m[2]}]({m[1]})", text)
    text = re.sub(r"(?is)<li[^>]*>", "\n- ", text)
    text = re.sub(r"(?is)</?(p|div|ul|ol|br|tr|table)\b[^>]*>", "\n\n", text)
    text = unescape(re.sub(r"(?s)<[^>]+>", "", text))
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in text.splitlines())).strip()
    return f"---\ntype: {json.dumps(kind)}\ntitle: {json.dumps(title, ensure_ascii=False)}\n---\n{body}\n"
