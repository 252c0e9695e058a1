"""Publication of typed relationships: validated sets, staged or activated under a fence, over tables.

Rows are (source_concept_id, relation_type, direction, target_bundle_id, target_concept_id, external_target, confidence); stored
ones also have publication_id, source_bundle_id, unresolved, cross_bundle and row_hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from conceptlake.errors import Duplicate, InvalidParameter
from conceptlake.operators.aggregates import digest
from conceptlake.operators.freshness import bundle_row, live_fence

MAX_ROWS = 50_000
#: Row hashes that are put together: 4 KB.
RUN = 128
TYPE = re.compile(r"[a-z][a-z0-9_-]*:[a-z][a-z0-9_-]*")
IDENTITY = ["source_concept_id", "relation_type", "direction", "target_bundle_id", "target_concept_id", "external_target"]
PUBLICATION = """publication_id long, tenant_id string, producer string, source_bundle_id long, publication_generation long, expected_catalog_generation long,
fencing_token long, relationship_set_hash string, row_count long, state string, activated_catalog_generation long"""


def row_hash() -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*IDENTITY, "confidence")]), 256)


def malformed() -> Column:
    """What a row may not be: a type that isn't name:name, another direction, no source, a target of two kinds, a target
    bundle without a concept, or a confidence outside 0 to 1."""
    bad = ~F.col("relation_type").rlike(f"^{TYPE.pattern}$") | ~F.col("direction").isin("directed", "undirected") | F.col("source_concept_id").isNull()
    bad = bad | (F.col("target_concept_id").isNotNull() & F.col("external_target").isNotNull()) | (F.col("target_bundle_id").isNotNull() & F.col("target_concept_id").isNull())
    bad = bad | ~F.coalesce(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.lit(True))
    return F.coalesce(bad, F.lit(True))


def check(rows: DataFrame, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """One row: n, malformed ones, and those that repeat another's identity."""
    counted = rows.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("n"), F.count_if(malformed()).alias("bad"))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("malformed"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))


def validate(rows: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``rows`` with row_hash, or an error that says what is wrong."""
    seen = check(rows).first()
    if seen["n"] > max_rows:
        raise InvalidParameter(f"{seen['n']} relationships, at most {max_rows} in one publication")
    if seen["malformed"]:
        raise InvalidParameter(f"{seen['malformed']} malformed relationships")
    if seen["repeated"]:
        raise Duplicate("a relationship is given twice")
    return rows.withColumn("row_hash", row_hash())


def set_hash(rows: DataFrame) -> str:
    """Order-independent hash of a validated set; a set has at most MAX_ROWS rows."""
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row_hash")), "\n"), 256).alias("h")).first()["h"]


def resolve(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """``rows`` with unresolved: whether a named target concept isn't there. External targets and rows without a target are
    unresolved too."""
    there = concepts.select(F.col("bundle_id").alias("target_bundle_id"), F.col("concept_id").alias("target_concept_id"), F.lit(True).alias("__t"))
    joined = rows.drop("unresolved").join(there, ["target_bundle_id", "target_concept_id"], "left")
    return joined.withColumn("unresolved", F.col("__t").isNull()).drop("__t")


def with_source(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """Rows whose source concept is there; the others are quarantined, that is left out."""
    there = concepts.select(F.col("bundle_id").alias("source_bundle_id"), F.col("concept_id").alias("source_concept_id"))
    return rows.join(there, ["source_bundle_id", "source_concept_id"], "left_semi")


def replace_relationships(tables: dict[str, DataFrame], producer: str, bundle_id: int, generation: int, expected_generation: int, token: int, rows: DataFrame, now: int) -> tuple[dict[str, DataFrame], int]:
    """(tables, publication_id): a producer's relationships of a bundle, all of them anew.

    ``tables``: bundles, concepts, fences, publications, relationships. The token must hold the fence for this generation.
    Expecting the catalog's generation, the set is active at once and the producer's former one superseded; expecting the
    next one, it is staged for ``activate_staged``. The same set under the same generation again changes nothing, another
    set is an error.
    """
    bundle = bundle_row(tables["bundles"], bundle_id)
    fence = live_fence(tables["fences"], bundle_id, producer, token, now)
    if fence["target_generation"] != generation:
        raise InvalidParameter(f"the fence is for generation {fence['target_generation']}, not {generation}")
    valid = validate(rows)
    own_hash = set_hash(valid)
    mine = (F.col("source_bundle_id") == bundle_id) & (F.col("producer") == producer)
    publications = tables["publications"]
    before = publications.where(mine & (F.col("publication_generation") == generation)).limit(1).collect()
    if before:
        if before[0]["relationship_set_hash"] == own_hash:
            return tables, before[0]["publication_id"]
        raise Duplicate(f"generation {generation} was published with other relationships")
    ahead = expected_generation - bundle["catalog_generation"]
    if ahead not in (0, 1):
        raise InvalidParameter(f"the catalog is at generation {bundle['catalog_generation']}, not {expected_generation} or one before")
    number = (publications.agg(F.max("publication_id")).first()[0] or 0) + 1
    home = F.lit(bundle_id).cast("long")
    placed = valid.select(F.lit(number).cast("long").alias("publication_id"), home.alias("source_bundle_id"), *[F.when(F.col("target_concept_id").isNotNull(), F.coalesce("target_bundle_id", home)).alias(c) if c == "target_bundle_id" else F.col(c) for c in IDENTITY], "confidence", "row_hash")
    placed = resolve(placed, tables["concepts"]).withColumn("cross_bundle", F.coalesce(F.col("target_bundle_id") != home, F.lit(False)))
    if ahead == 0:
        if not placed.join(with_source(placed, tables["concepts"]), ["row_hash"], "left_anti").limit(1).isEmpty():
            raise InvalidParameter("a source concept isn't in the bundle")
        publications = publications.withColumn("state", F.when(mine & (F.col("state") == "active"), "superseded").otherwise(F.col("state")))
    row = (number, bundle["tenant_id"], producer, bundle_id, generation, expected_generation, token, own_hash, placed.count(), "active" if ahead == 0 else "staged", expected_generation if ahead == 0 else None)
    publications = publications.unionByName(rows.sparkSession.createDataFrame([row], PUBLICATION))
    stored = tables["relationships"]
    return {**tables, "publications": publications, "relationships": stored.unionByName(placed.select(*stored.columns))}, number


def activate(publications: DataFrame) -> DataFrame:
    """One winner for each (tenant, producer): the staged or active publication of the highest generation."""
    order = Window.partitionBy("tenant_id", "producer").orderBy(F.col("publication_generation").desc(), "publication_id")
    place = F.row_number().over(order)
    return publications.withColumn("state", F.when(place == 1, "active").otherwise("superseded"))


def activate_staged(tables: dict[str, DataFrame], bundle_id: int, generation: int) -> tuple[dict[str, DataFrame], bool]:
    """(tables, whether coverage went missing) when a bundle's refresh to ``generation`` is accepted.

    Active publications of the bundle are superseded, and so are staged ones for earlier generations. Of those staged for
    this one, the newest of each producer becomes active: its targets are resolved against the concepts that are there
    now, and rows whose source isn't are left out. Coverage is missing if there was an active one and none is.
    """
    publications = tables["publications"]
    ours = F.col("source_bundle_id") == bundle_id
    had = not publications.where(ours & (F.col("state") == "active")).limit(1).isEmpty()
    attempt = ours & (F.col("state") == "staged") & (F.col("expected_catalog_generation") == generation)
    winner = attempt & (F.row_number().over(Window.partitionBy("tenant_id", "producer", attempt).orderBy(F.col("publication_generation").desc(), "publication_id")) == 1)
    old = ours & ((F.col("state") == "active") | attempt | ((F.col("state") == "staged") & (F.col("expected_catalog_generation") < generation)))
    marked = publications.withColumn("__w", winner)
    after = marked.withColumn("activated_catalog_generation", F.when(F.col("__w"), F.lit(generation).cast("long")).otherwise(F.col("activated_catalog_generation")))
    after = after.withColumn("state", F.when(F.col("__w"), "active").when(old, "superseded").otherwise(F.col("state")))
    won = marked.where("__w").select("publication_id")
    stored = tables["relationships"]
    fresh = with_source(resolve(stored.join(won, "publication_id", "left_semi"), tables["concepts"]), tables["concepts"])
    relationships = stored.join(won, "publication_id", "left_anti").unionByName(fresh.select(*stored.columns))
    return {**tables, "publications": after.drop("__w"), "relationships": relationships}, had and won.limit(1).isEmpty()


def set_hashes(rows: DataFrame) -> DataFrame:
    """(publication_id, relationship_set_hash, n) of stored sets, of any size.

    Row hashes are sorted in as many tasks as they have first bytes, which is their order too, and put together in runs of
    ``RUN``; only these are sorted again, and streamed through a set's hash, by one task for each set.
    """
    raw = F.unhex("row_hash")
    known = F.when(F.col("row_hash").isNull() | ((F.length(raw) == 32) & (F.lower("row_hash") == F.col("row_hash"))), raw).otherwise(F.raise_error(F.lit("row_hash isn't a SHA-256 in lower-case hex")))
    hashed = rows.select("publication_id", known.alias("h"))
    dealt = hashed.repartition(F.xxhash64("publication_id", F.substring("h", 1, 1))).sortWithinPartitions("publication_id", "h")
    kind = to_arrow_type(rows.schema["publication_id"].dataType)
    schema = T.StructType([rows.schema["publication_id"], *[T.StructField(c, T.BinaryType()) for c in ("first", "last", "run")], T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None

        def closed() -> tuple:
            return (now, held[0], held[-1], None if held[0] is None else b"".join(held), len(held))

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = (kind, pa.binary(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

        for batch in batches:
            out = []
            for g, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # A run stays within a first byte, since those between two that a task has may be another's.
                if held and (g != now or len(held) == RUN or (h and h[0]) != (held[0] and held[0][0])):
                    out.append(closed())
                    held = []
                now = g
                held.append(h)
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([closed()])

    runs = dealt.mapInArrow(run, schema)
    sets = digest(runs, "publication_id", ["first", "last"], F.col("run"), between="\n", as_bytes=lambda b: b.hex("\n", 32).encode(), count=F.col("n"))
    return sets.withColumnRenamed("digest", "relationship_set_hash")
