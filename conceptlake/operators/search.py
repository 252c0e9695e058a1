"""Lexical search: postings, boolean match, cover-density rank, keyset pages, facets, more-like-this, BM25, hybrid."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from conceptlake.catalog import Catalog
from conceptlake.errors import Ambiguous, InvalidParameter, NotFound, bounded
from conceptlake.functions import tsquery
from conceptlake.functions.stem import lexeme
from conceptlake.functions.text import headline, tokens, weighted_tokens

KEY = ["bundle_id", "concept_id"]
LIMIT = 500
#: Reciprocal rank fusion: 1 / (RRF + rank).
RRF = 60


def postings(concepts: DataFrame, only: list[str] | None = None, config: str = "simple") -> DataFrame:
    """(bundle_id, concept_id, lexeme, pos, weight). ``only`` drops other lexemes as early as can be.

    Under ``english`` each distinct word is stemmed once; stop words keep their positions and have no rows.
    """
    if config == "simple":
        return concepts.select(*KEY, F.explode(weighted_tokens(only)).alias("p")).select(*KEY, "p.lexeme", "p.pos", "p.weight")
    rows = concepts.select(*KEY, F.explode(weighted_tokens()).alias("p")).select(*KEY, F.col("p.lexeme").alias("word"), "p.pos", "p.weight")

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(lambda w: lexeme(w, config))

    vocabulary = rows.select("word").distinct().withColumn("lexeme", stems("word")).where("lexeme IS NOT NULL")
    vocabulary = vocabulary if only is None else vocabulary.where(F.col("lexeme").isin(only))
    return rows.join(vocabulary, "word").select(*KEY, "lexeme", "pos", "weight")


@dataclass
class Index:
    """Stored postings; the BM25 text's words by lexeme (bundle_id, concept_id, lexeme, tf); and its lengths (…, len)."""

    postings: DataFrame
    terms: DataFrame | None = None
    lengths: DataFrame | None = None


def build_index(concepts: DataFrame, path: str, buckets: int = 64, config: str = "simple") -> None:
    """Write postings and BM25 terms, clustered by lexeme, so that a query's filter skips most row groups, and lengths."""

    def put(rows: DataFrame, name: str, *order: str) -> None:
        placed = rows.withColumn("bucket", F.pmod(F.xxhash64("lexeme"), F.lit(buckets)).cast("int"))
        placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "lexeme", *KEY, *order).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")

    put(postings(concepts, config=config), "postings", "pos")
    words = concepts.select(*KEY, bm25_words().alias("w"))
    put(words.select(*KEY, F.explode("w").alias("lexeme")).groupBy(*KEY, "lexeme").agg(F.count(F.lit(1)).cast("int").alias("tf")), "terms")
    words.select(*KEY, F.size("w").alias("len")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/lengths")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "lengths")])


def bm25_words() -> Column:
    return tokens(F.concat_ws(" ", "title", "description", "body_text"))


def _unit(phrase: tuple[str, ...], order) -> Column:
    """True at the first position of the phrase."""
    here = F.col("lexeme") == phrase[0]
    for k, word in enumerate(phrase[1:], 1):
        here = here & (F.lead("lexeme", k).over(order) == word) & (F.lead("pos", k).over(order) == F.col("pos") + k)
    return F.coalesce(here, F.lit(False))


def rank(index: DataFrame, query: tsquery.Query) -> DataFrame:
    """(bundle_id, concept_id, rank) of the concepts that match.

    Each smallest stretch that has all units of a clause (a cover) adds its number of units over the sum of their
    inverse weights, divided by one more than the positions in it that are no unit. For one word or words joined by
    OR that is the sum of the weights of all occurrences, which needs no ordering.
    """
    query = tsquery.Query(tuple(c for c in query.clauses if c.must))
    lexemes = query.lexemes
    rows = index.where(F.col("lexeme").isin(lexemes)) if lexemes else index.where(F.lit(False))
    if all(len(c.must) == 1 and len(c.must[0]) == 1 and not c.never for c in query.clauses):
        return rows.groupBy(*KEY).agg(F.sum("weight").cast("float").alias("rank"))
    order = Window.partitionBy(*KEY).orderBy("pos")
    parts = []
    for clause in query.clauses:
        units = [*clause.must, *clause.never]
        marked = rows.select(*KEY, "pos", "weight", *[_unit(u, order).alias(f"u{i}") for i, u in enumerate(units)])
        must, never = [f"u{i}" for i in range(len(clause.must))], [f"u{i}" for i in range(len(clause.must), len(units))]
        any_of = lambda names: reduce(lambda a, b: a | b, [F.col(c) for c in names])
        if never:
            marked = marked.withColumn("barred", F.max(any_of(never)).over(Window.partitionBy(*KEY))).where("NOT barred")
        marked = marked.where(any_of(must))
        # How many units stand at one position (two phrases may begin alike); each counts.
        at_once = reduce(lambda a, b: a + b, [F.col(c).cast("int") for c in must])
        so_far = order.rowsBetween(Window.unboundedPreceding, 0)
        marked = marked.withColumn("k", F.sum(at_once).over(so_far)).withColumn("n", at_once).withColumn("inv", F.sum(at_once / F.col("weight")).over(so_far))
        here = F.struct(F.col("pos"), (F.col("k") - F.col("n")).alias("k"), (F.col("inv") - F.col("n") / F.col("weight")).alias("inv"))
        last = [F.max(F.when(F.col(c), here)).over(so_far) for c in must]
        missing = reduce(lambda a, b: a | b, [x.isNull() for x in last])
        marked = marked.withColumn("start", F.when(~missing, F.least(*last) if len(last) > 1 else last[0]))
        marked = marked.withColumn("was", F.lag("start").over(order)).where("start IS NOT NULL AND (was IS NULL OR was.pos <> start.pos)")
        count = F.col("k") - F.col("start.k")
        noise = F.greatest(F.col("pos") - F.col("start.pos") - (count - 1), F.lit(0))
        parts.append(marked.groupBy(*KEY).agg(F.sum(count / (F.col("inv") - F.col("start.inv")) / (1 + noise)).alias("rank")))
    if not parts:
        return rows.groupBy(*KEY).agg(F.sum("weight").cast("float").alias("rank"))
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy(*KEY).agg(F.sum("rank").cast("float").alias("rank"))


def hits(catalog: Catalog, rows: DataFrame, query: tsquery.Query, index: Index | None, narrowed: bool) -> DataFrame:
    """(bundle_id, concept_id, rank) of ``rows`` (concepts) that match, by the postings of an index or of their texts.

    A clause of exclusions alone holds for all rows without them, at rank 0.
    """
    stored = index.postings if index is not None else postings(rows, query.lexemes, catalog.text_config)
    found = rank(stored, query)
    if index is not None:
        found = found.join(rows.select(*KEY), KEY, "left_semi") if narrowed else catalog.of_active(found)
    for clause in query.clauses:
        if not clause.must:
            barred = reduce(lambda a, b: a.unionByName(b), [rank(stored, tsquery.Query((tsquery.Clause((p,), ()),))).select(*KEY) for p in clause.never])
            found = found.unionByName(rows.select(*KEY).join(barred, KEY, "left_anti").withColumn("rank", F.lit(0.0).cast("float")))
    if any(not c.must for c in query.clauses):
        found = found.groupBy(*KEY).agg(F.sum("rank").cast("float").alias("rank"))
    return found


def contains_all(column: str, wanted: list[str]) -> Column:
    """``column`` has every wanted tag; null never does."""
    return F.col(column).isNotNull() & (F.size(F.array_except(F.array(*[F.lit(x) for x in wanted]), F.col(column))) == 0)


def filtered(catalog: Catalog, *, bundle_id: int | None = None, concept_type: str | None = None, concept_types: list[str] | None = None, tags: list[str] | None = None, status: str | None = None, trust_tier: str | None = None) -> DataFrame:
    """Concepts of active bundles under the structured filters that are given; an empty list is no filter."""
    rows = catalog.of_active(catalog.table("concepts"))
    if bundle_id is not None:
        rows = rows.where(F.col("bundle_id") == bundle_id)
    if concept_type is not None:
        rows = rows.where(F.col("type") == concept_type)
    if concept_types:
        rows = rows.where(F.col("type").isin(concept_types))
    if tags:
        rows = rows.where(contains_all("tags", tags))
    if status is not None or trust_tier is not None:
        prov = catalog.table("concept_provenance")
        prov = prov.where(F.col("status") == status) if status is not None else prov
        prov = prov.where(F.col("trust_tier") == trust_tier) if trust_tier is not None else prov
        rows = rows.join(prov.select(*KEY), KEY, "left_semi")
    return rows


def encode_cursor(rank: float, bundle_id: int, concept_id: str) -> str:
    return json.dumps({"rank": rank, "bundle_id": bundle_id, "concept_id": concept_id})


def after(cursor: str | None) -> Column:
    """Rows that follow the cursor's in (rank DESC, bundle_id, concept_id)."""
    if cursor is None:
        return F.lit(True)
    try:
        at = json.loads(cursor)
        r, b, c = float(at["rank"]), int(at["bundle_id"]), str(at["concept_id"])
    except (ValueError, TypeError, KeyError) as e:
        raise InvalidParameter(f"malformed cursor: {e}") from e
    value = F.lit(r).cast("float")
    same = F.col("rank") == value
    return (F.col("rank") < value) | (same & (F.col("bundle_id") > b)) | (same & (F.col("bundle_id") == b) & (F.col("concept_id") > c))


def by_rank(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.col("rank").desc(), "bundle_id", "concept_id").limit(limit)


def concept_search(catalog: Catalog, query: str, *, limit: int = 20, after_cursor: str | None = None, index: Index | None = None, headlines: bool = True, **filters) -> DataFrame:
    """Ranked search: (bundle_id, concept_id, path, title, type, rank, headline), best first.

    Only the hits of the page get their columns and headlines; ``headlines=False`` leaves those out.
    """
    bounded("limit", limit, 1, LIMIT)
    parsed = tsquery.parse(query, catalog.text_config)
    rows = filtered(catalog, **filters)
    narrowed = any(v is not None for v in filters.values())
    page = by_rank(hits(catalog, rows, parsed, index, narrowed).where(after(after_cursor)), limit)
    return described(catalog, rows, page, parsed.wanted if headlines else None)


def described(catalog: Catalog, rows: DataFrame, page: DataFrame, terms: list[str] | None) -> DataFrame:
    """A page of at most ``LIMIT`` hits (bundle_id, concept_id, rank) with path, title, type and, given terms, headline."""
    wanted = ["path", "title", "type", *(["body_text"] if terms is not None else [])]
    out = rows.select(*KEY, *wanted).join(F.broadcast(page), KEY)  # at most LIMIT rows
    if terms is not None:
        out = _with_headline(out, catalog.text_config, terms).drop("body_text")
    return out.select(*KEY, "path", "title", "type", "rank", *(["headline"] if terms is not None else [])).orderBy(F.col("rank").desc(), *KEY)


def _with_headline(page: DataFrame, config: str, terms: list[str]) -> DataFrame:
    if config == "simple":
        return page.withColumn("headline", headline(F.col("body_text"), terms))

    @F.pandas_udf("array<string>")
    def forms(body: pd.Series) -> pd.Series:
        """The words of a text that stand for one of the terms."""
        return body.map(lambda b: sorted({w for w in tsquery.words(b or "") if lexeme(w, config) in set(terms)}))

    return page.withColumn("__forms", forms("body_text")).withColumn("headline", headline(F.col("body_text"), F.col("__forms"))).drop("__forms")


def ranked_search(catalog: Catalog, query: str, *, index: Index | None = None, **options) -> DataFrame:
    """Search by the backend that the catalog asks for; BM25 falls back to the native ranking, with a warning, where there
    is no index of its terms."""
    if catalog.search_backend == "bm25" and index is not None and index.terms is not None:
        options.pop("headlines", None)
        rows = filtered(catalog, **{k: v for k, v in options.items() if k != "limit"})
        return described(catalog, rows, bm25(catalog, query, index=index, **options), None)
    if catalog.search_backend == "bm25":
        warnings.warn("no BM25 index; the native ranking is used", stacklevel=2)
    elif catalog.search_backend != "native":
        raise InvalidParameter(f"no search backend {catalog.search_backend!r}")
    return concept_search(catalog, query, index=index, **options)


def freshness_of(catalog: Catalog, rows: DataFrame) -> DataFrame:
    """``rows`` (bundle_id, concept_id, path) with freshness: the concept's state, else the path's, the bundle's, fresh."""
    concept = catalog.table("concept_freshness").select(*KEY, F.col("state").alias("__c"))
    path = catalog.table("path_freshness").select("bundle_id", "path", F.col("state").alias("__p"))
    bundle = catalog.table("bundle_freshness").select("bundle_id", F.col("state").alias("__b"))
    joined = rows.join(concept, KEY, "left").join(path, ["bundle_id", "path"], "left").join(bundle, "bundle_id", "left")
    return joined.withColumn("freshness", F.coalesce("__c", "__p", "__b", F.lit("fresh"))).drop("__c", "__p", "__b")


def concept_search_fresh(catalog: Catalog, query: str, *, freshness: str = "any", limit: int = 20, index: Index | None = None, after_cursor: str | None = None, headlines: bool = True, **filters) -> DataFrame:
    """Search with each hit's freshness, and its embedding's model, contract and whether it was made from the file as it is;
    'fresh' and 'stale' (anything else) filter before the limit."""
    if freshness not in ("any", "fresh", "stale"):
        raise InvalidParameter(f"freshness must be any, fresh or stale, not {freshness!r}")
    bounded("limit", limit, 1, LIMIT)
    parsed = tsquery.parse(query, catalog.text_config)
    rows = filtered(catalog, **filters)
    found = hits(catalog, rows, parsed, index, any(v is not None for v in filters.values())).where(after(after_cursor))
    if freshness != "any":
        marked = freshness_of(catalog, found.join(rows.select(*KEY, "path"), KEY))
        found = marked.where((F.col("freshness") == "fresh") == F.lit(freshness == "fresh")).select(*KEY, "rank")
    page = described(catalog, rows, by_rank(found, limit), parsed.wanted if headlines else None)
    out = freshness_of(catalog, page)
    if "concept_embedding" in catalog.tables:
        have = catalog.table("concept_embedding").select(*KEY, *[F.col(c).alias(f"embedding_{c}") for c in ("model", "contract", "dim") if c in catalog.tables["concept_embedding"].columns])
        out = out.join(have, KEY, "left")
    return out.orderBy(F.col("rank").desc(), *KEY)


def search_facets(catalog: Catalog, query: str, facet: str = "type", *, index: Index | None = None, **filters) -> DataFrame:
    """(value, n) over all concepts that match, most first; null values are dropped."""
    parsed = tsquery.parse(query, catalog.text_config)
    rows = filtered(catalog, **filters)
    found = hits(catalog, rows, parsed, index, any(v is not None for v in filters.values())).select(*KEY)
    return facet_counts(catalog, rows.drop("body_text").join(found, KEY, "left_semi"), facet)


def facet_counts(catalog: Catalog, rows: DataFrame, facet: str, limit: int | None = None) -> DataFrame:
    if facet in ("status", "trust_tier"):
        values = rows.join(catalog.table("concept_provenance").select(*KEY, F.col(facet).alias("value")), KEY)
    elif facet == "tag":
        values = rows.select(F.explode("tags").alias("value"))
    elif facet == "bundle":
        values = rows.join(catalog.table("bundles").select("bundle_id", F.col("name").alias("value")), "bundle_id")
    elif facet == "type":
        values = rows.select(F.col("type").alias("value"))
    else:
        raise InvalidParameter(f"no facet {facet!r}")
    counted = values.where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value")
    return counted if limit is None else counted.limit(limit)


def catalog_facets(catalog: Catalog, facet: str = "type", limit: int = 100) -> DataFrame:
    return facet_counts(catalog, filtered(catalog), facet, limit)


def seed_of(rows: DataFrame, concept_id: str, bundle_id: int | None) -> tuple[int, str]:
    """The one bundle that has the concept; more than one is ambiguous."""
    at = rows.where(F.col("concept_id") == concept_id)
    if bundle_id is not None:
        at = at.where(F.col("bundle_id") == bundle_id)
    found = at.select("bundle_id").distinct().limit(2).collect()
    if not found:
        raise NotFound(f"no concept {concept_id!r}")
    if len(found) > 1:
        raise Ambiguous(f"concept {concept_id!r} is in more than one bundle")
    return found[0][0], concept_id


def find_similar(catalog: Catalog, concept_id: str, bundle_id: int | None = None, limit: int = 10, terms: int = 20, index: Index | None = None) -> DataFrame:
    """More like this: the seed's ``terms`` most frequent lexemes of 3+ letters, joined by OR; the seed itself left out.

    The seed may be in any bundle that can be seen, an ambiguous id is an error; hits are of active bundles.
    """
    bounded("limit", limit, 1, LIMIT)
    visible = catalog.table("concepts")
    home, _ = seed_of(visible, concept_id, bundle_id)
    is_seed = (F.col("bundle_id") == home) & (F.col("concept_id") == concept_id)
    seed = index.postings.where(is_seed) if index is not None else postings(visible.where(is_seed), config=catalog.text_config)
    top = seed.where(F.length("lexeme") >= 3).groupBy("lexeme").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lexeme").limit(terms)
    wanted = [r[0] for r in top.select("lexeme").collect()]  # at most `terms`
    rows = filtered(catalog, bundle_id=bundle_id)
    query = tsquery.Query(tuple(tsquery.Clause(((w,),), ()) for w in wanted))
    found = hits(catalog, rows, query, index, bundle_id is not None).where(~is_seed)
    return described(catalog, rows, by_rank(found, limit), None)


def bm25(catalog: Catalog, query: str, *, limit: int = 20, k1: float = 1.2, b: float = 0.75, index: Index | None = None, **filters) -> DataFrame:
    """Okapi BM25 over title, description and body as one text; plain terms joined by OR, no operators.

    An index gives the terms' rows and the lengths; without one, texts are cut to words once for both passes' columns.
    """
    bounded("limit", limit, 1, LIMIT)
    terms = sorted(set(tsquery.words(query)))
    if not terms:
        raise InvalidParameter("query must not be blank")
    rows = filtered(catalog, **filters).select(*KEY, "title", "description", "body_text")
    if index is not None and index.terms is not None:
        lengths = index.lengths.join(rows.select(*KEY), KEY, "left_semi")
        found = index.terms.where(F.col("lexeme").isin(terms)).join(lengths, KEY)
    else:
        count = lambda t: F.size(F.filter(F.col("w"), lambda x: x == t))
        counts = F.array(*[F.struct(F.lit(t).alias("lexeme"), count(t).alias("tf")) for t in terms])
        lengths = rows.select(*KEY, bm25_words().alias("w")).select(*KEY, F.size("w").alias("len"), F.filter(counts, lambda c: c["tf"] > 0).alias("found"))
        found = lengths.where(F.size("found") > 0).select(*KEY, "len", F.explode("found").alias("t")).select(*KEY, "len", "t.lexeme", "t.tf")
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    often = found.groupBy("lexeme").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    # One row, and a row a term.
    scored = found.join(F.broadcast(often), "lexeme").crossJoin(F.broadcast(stats))
    return by_rank(scored.groupBy(*KEY).agg(F.sum(part).cast("float").alias("rank")), limit)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, in double; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def eligible(catalog: Catalog, contract: str | None = "v1") -> DataFrame:
    """Embeddings that semantic search may rank: of the contract, of a concept of an active bundle whose freshness row says
    fresh, and that no state of its concept or path overrides."""
    rows = catalog.table("concept_embedding")
    rows = rows if contract is None else rows.where(F.col("contract") == contract)
    fresh = catalog.table("bundle_freshness").where("state = 'fresh'").select("bundle_id")
    concepts = catalog.of_active(catalog.table("concepts").select(*KEY, "path", "title", "type")).join(fresh, "bundle_id", "left_semi")
    stale_concept = catalog.table("concept_freshness").where("state <> 'fresh'").select(*KEY)
    stale_path = catalog.table("path_freshness").where("state <> 'fresh'").select("bundle_id", "path")
    concepts = concepts.join(stale_concept, KEY, "left_anti").join(stale_path, ["bundle_id", "path"], "left_anti")
    return rows.select(*KEY, "embedding").join(concepts, KEY)


def concept_search_semantic(catalog: Catalog, query: list[float], *, bundle_id: int | None = None, limit: int = 20, concept_types: list[str] | None = None, contract: str | None = "v1") -> DataFrame:
    """Nearest of the eligible embeddings by cosine: (bundle_id, concept_id, path, title, type, rank).

    Filters first, then top-k. The query vector is compared with all that is left: exact, one pass, and only ``limit``
    rows leave each task.
    """
    bounded("limit", limit, 1, LIMIT)
    if not query or any(x != x or x in (float("inf"), float("-inf")) for x in query):
        raise InvalidParameter("the query embedding must be finite and not empty")
    rows = eligible(catalog, contract).where(F.size("embedding") == len(query))
    rows = rows if bundle_id is None else rows.where(F.col("bundle_id") == bundle_id)
    rows = rows.where(F.col("type").isin(concept_types)) if concept_types else rows
    at = F.array(*[F.lit(float(x)).cast("float") for x in query])
    scored = rows.select(*KEY, "path", "title", "type", cosine(F.col("embedding"), at).cast("float").alias("rank"))
    return by_rank(scored.where("rank IS NOT NULL"), limit)


def fuse(lexical: DataFrame, near: DataFrame, limit: int) -> DataFrame:
    """Reciprocal rank fusion of two short lists (bundle_id, concept_id, place)."""
    a, b = lexical.select(*KEY, F.col("place").alias("pa")), near.select(*KEY, F.col("place").alias("pb"))
    score = F.coalesce(1 / (RRF + F.col("pa")), F.lit(0.0)) + F.coalesce(1 / (RRF + F.col("pb")), F.lit(0.0))
    return by_rank(a.join(b, KEY, "full_outer").select(*KEY, score.cast("float").alias("rank")), limit)


def concept_search_hybrid(catalog: Catalog, query: str, vector: list[float], *, bundle_id: int | None = None, limit: int = 20, concept_types: list[str] | None = None, contract: str | None = "v1", index: Index | None = None) -> DataFrame:
    """Lexical and semantic lists, each under the filters and cut to ``limit``, fused by their ranks."""
    words = ranked_search(catalog, query, limit=limit, index=index, headlines=False, bundle_id=bundle_id, concept_types=concept_types or None)
    near = concept_search_semantic(catalog, vector, bundle_id=bundle_id, limit=limit, concept_types=concept_types, contract=contract)
    # Both lists have at most `limit` rows by now.
    place = F.row_number().over(Window.orderBy(F.col("rank").desc(), *KEY)).alias("place")
    fused = fuse(words.select(*KEY, place), near.select(*KEY, place), limit)
    return described(catalog, catalog.of_active(catalog.table("concepts")), fused, None)


def index_status(catalog: Catalog) -> DataFrame:
    """Coverage of the indexes: concepts, embedded ones and their share in per cent."""
    concepts = catalog.table("concepts").select(*KEY)
    embedded = catalog.table("concept_embedding").select(*KEY).distinct().withColumn("has", F.lit(1))
    return concepts.join(embedded, KEY, "left").agg(F.count(F.lit(1)).alias("concepts"), F.count("has").alias("embedded"), F.round(100 * F.count("has") / F.count(F.lit(1)), 2).alias("embedded_pct"))
