"""Agent packages: which files belong to which package, what they are, and edges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from conceptlake.operators.aggregates import digest

MANIFEST = "SKILL.md"
ROLES = ("scripts", "references", "assets")
#: Language of a script and media type of a file by its extension.
LANGUAGES = {"py": "python", "sh": "shell", "bash": "shell", "js": "javascript", "ts": "typescript", "rb": "ruby", "sql": "sql", "rs": "rust", "go": "go"}
MEDIA = {"md": "text/markdown", "txt": "text/plain", "json": "application/json", "csv": "text/csv", "png": "image/png", "svg": "image/svg+xml", "pdf": "application/pdf", "html": "text/html"}


def folder(path: str = "path") -> Column:
    return F.regexp_replace(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "^$", "")


def ancestors(path: str = "path") -> Column:
    """All folders above a path, the nearest first; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def mapped(extension: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), extension)


def classify(files: DataFrame) -> DataFrame:
    """``files`` (path) with package, kind, role, language and media type.

    A folder with a manifest is a package; a file belongs to the nearest package above it. What is owned goes first,
    then reserved files, manifests, documents; the rest is ignored. Owners are found by an equi-join on a path's folders.
    """
    homes = files.where(F.element_at(F.split("path", "/"), -1) == MANIFEST).select(folder().alias("package")).distinct()
    steps = files.select("path", F.posexplode(ancestors()).alias("up", "package")).join(homes, "package")
    owner = steps.groupBy("path").agg(F.min_by("package", "up").alias("package"))
    rows = files.join(owner, "path", "left")
    name = F.element_at(F.split("path", "/"), -1)
    inner = F.when(F.col("package") == "", F.col("path")).otherwise(F.expr("substring(path, length(package) + 2)"))
    first = F.element_at(F.split(inner, "/"), 1)
    owned = F.col("package").isNotNull() & first.isin(*ROLES) & inner.contains("/")
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kind = F.when(owned, "resource").when(name.isin("index.md", "log.md"), "reserved").when(name == MANIFEST, "manifest").when(name.endswith(".md"), "document").otherwise("ignored")
    role = F.when(owned, F.when(first == "scripts", "script").when(first == "references", "reference").otherwise("asset"))
    return rows.select("path", "package", kind.alias("kind"), role.alias("role"), F.when(role == "script", F.coalesce(mapped(extension, LANGUAGES), F.lit("unknown"))).alias("language"), F.coalesce(mapped(extension, MEDIA), F.lit("application/octet-stream")).alias("media_type"))


def membership(classified: DataFrame) -> DataFrame:
    """Edges (package, path, relation): a package uses its scripts and assets and references its references."""
    relation = F.when(F.col("role") == "reference", "REFERENCES").otherwise("USES")
    return classified.where("kind = 'resource'").select("package", "path", relation.alias("relation"))


def propagate_visibility(classified: DataFrame, visible: DataFrame) -> DataFrame:
    """Each owned file's visibility: its own (path, visibility), else its package's, else public."""
    own = visible.select("path", F.col("visibility").alias("__own"))
    home = visible.select(F.regexp_replace("path", f"/?{MANIFEST}$", "").alias("package"), F.col("visibility").alias("__home"), "path").where(F.col("path").endswith(MANIFEST)).drop("path")
    return classified.where("kind = 'resource'").join(own, "path", "left").join(home, "package", "left").select("path", "package", F.coalesce("__own", "__home", F.lit("public")).alias("visibility"))


#: What the hash covers beside the files: its domain and the versions of the classification and its checks.
HASH_HEAD = ("package:v1", "1", "1")


def package_hash(classified: DataFrame, hashes: DataFrame) -> DataFrame:
    """One hash for each package: the domain and versions and the manifest's hash, a line each, then for each member, in path
    order, role NUL path within the package NUL file hash LF."""
    rows = classified.where("kind IN ('resource', 'manifest')").join(hashes, "path")
    manifest = rows.where("kind = 'manifest'").select("package", F.concat(F.lit("\n".join(HASH_HEAD) + "\n"), "file_hash", F.lit("\n")).alias("head"))
    inner = F.when(F.col("package") == "", F.col("path")).otherwise(F.expr("substring(path, length(package) + 2)"))
    members = rows.join(manifest, "package")
    # The manifest itself adds no line; it keeps a package without members in the result.
    line = F.when(F.col("kind") == "manifest", "").otherwise(F.concat("role", F.lit("\0"), inner, F.lit("\0"), "file_hash", F.lit("\n")))
    return digest(members, "package", "path", line, F.col("head")).withColumnsRenamed({"digest": "package_hash", "n": "files"})


def get_skill(classified: DataFrame, package: str) -> DataFrame:
    """The package with its resources as ordered JSON."""
    rows = classified.where((F.col("package") == package) & (F.col("kind") == "resource"))
    return rows.groupBy("package").agg(F.to_json(F.array_sort(F.collect_list(F.struct("path", "role", "media_type")))).alias("resources"))


def get_script(classified: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """A package's script: (path, package, language, byte_size, sha256, content); no row if the path is no script."""
    script = classified.where((F.col("path") == path) & (F.col("role") == "script")).select("path", "package", "language")
    return script.join(files.select("path", "content"), "path").select("path", "package", "language", F.length("content").cast("long").alias("byte_size"), F.sha2("content", 256).alias("sha256"), "content")


def get_reference(classified: DataFrame, files: DataFrame, path: str, include_bytes: bool = True) -> DataFrame:
    """A package's reference: (path, package, media_type, byte_size, sha256, content); content is null without bytes."""
    found = classified.where((F.col("path") == path) & (F.col("role") == "reference")).select("path", "package", "media_type")
    content = F.col("content") if include_bytes else F.lit(None).cast("binary")
    return found.join(files.select("path", "content"), "path").select("path", "package", "media_type", F.length("content").cast("long").alias("byte_size"), F.sha2("content", 256).alias("sha256"), content.alias("content"))


def attestation_links(metadata: DataFrame, concepts: DataFrame) -> DataFrame:
    """Typed links of attested computations, behind their body links: (bundle_id, source_id, relation, target)."""
    attested = concepts.where(F.lower("type") == "attested computation").select("bundle_id", "concept_id")
    rows = metadata.where(F.col("key").isin("computation", "executor", "attester")).join(attested, ["bundle_id", "concept_id"], "left_semi")
    return rows.select("bundle_id", F.col("concept_id").alias("source_id"), F.concat(F.lit("attestation:"), "key").alias("relation"), F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v").alias("target"))
