"""Search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from conceptlake.catalog import Catalog
from conceptlake.operators import aggregates as agg, search
from conceptlake.plans import oracle as o
from conceptlake.plans.register import KEY, query, rounded


def of_provenance(where: str) -> str:
    return f"(SELECT s.* FROM seen s SEMI JOIN (SELECT * FROM prov WHERE {where}) p USING (bundle_id, concept_id))"


SEARCHES = {
    "search_term": ("thnd", {}, "seen"),
    "search_or": ("thnd OR onan OR leaux", {}, "seen"),
    "search_and": ("the of", {}, "seen"),
    "search_phrase": ('"of the"', {}, "seen"),
    "search_phrase_and_word": ('"of the" and', {}, "seen"),
    "search_not": ("the -and", {}, "seen"),
    "search_only_not": ("-the", {}, "seen"),
    "search_or_not": ("onan OR -the -de", {}, "seen"),
    "search_mixed": ('"in the" of OR ouéon -le OR des', {}, "seen"),
    "search_type": ("de", {"concept_type": "fr"}, o.sub("type = 'fr'")),
    "search_types": ("de OR der", {"concept_types": ["fr", "de"]}, o.sub("type IN ('fr', 'de')")),
    "search_tags": ("the", {"tags": ["en", "curated"]}, o.sub("list_has_all(tags, ['en', 'curated'])")),
    "search_bundle": ("the", {"bundle_id": 3}, o.sub("bundle_id = 3")),
    "search_status": ("the", {"status": "draft"}, of_provenance("status = 'draft'")),
    "search_trust": ("the", {"trust_tier": "unverified"}, of_provenance("trust_tier = 'unverified'")),
}
for _name, (_text, _filters, _rows) in SEARCHES.items():
    query(_name, o.search_sql(_text, _rows), lambda c, t=_text, f=_filters: rounded(search.concept_search(c, t, headlines=False, **f)))

query(
    "search_headlines",
    f"""SELECT bundle_id, concept_id, path, title, type, round(r::DOUBLE, 4) AS rank, {o.headline_sql(["onan", "thnd"])} AS headline
FROM (SELECT bundle_id, concept_id, rank AS r FROM {o.rank_sql("thnd OR onan")}) JOIN concepts USING (bundle_id, concept_id) ORDER BY r DESC, bundle_id, concept_id LIMIT 50""",
    lambda c: rounded(search.concept_search(c, "thnd OR onan", limit=50)),
)


def second_page(c: Catalog) -> DataFrame:
    text = "thnd OR onan OR leaux"
    last = search.concept_search(c, text, headlines=False).orderBy(F.col("rank").asc(), F.col("bundle_id").desc(), F.col("concept_id").desc()).first()
    cursor = search.encode_cursor(last["rank"], last["bundle_id"], last["concept_id"])
    return rounded(search.concept_search(c, text, after_cursor=cursor, headlines=False))


query("search_page_2", o.search_sql("thnd OR onan OR leaux", offset=20), second_page)


def fresh_sql(text: str, where: str) -> str:
    return f"""SELECT x.bundle_id, x.concept_id, x.path, title, type, round(r::DOUBLE, 4) AS rank, {o.FRESH} AS freshness,
  CASE WHEN e.concept_id IS NULL THEN '-' ELSE 'm1' END AS embedding_model, coalesce(e.contract, '-') AS embedding_contract, coalesce(len(e.embedding), 0) AS embedding_dim
FROM (SELECT s.*, h.rank AS r FROM seen s JOIN {o.rank_sql(text)} h USING (bundle_id, concept_id)) x {o.FRESH_JOIN}
LEFT JOIN emb e ON x.bundle_id = e.bundle_id AND x.concept_id = e.concept_id WHERE {where} ORDER BY r DESC, x.bundle_id, x.concept_id LIMIT 20"""


def fresh(c: Catalog, text: str, freshness: str) -> DataFrame:
    found = search.concept_search_fresh(c, text, freshness=freshness, headlines=False)
    return rounded(found).fillna("-", ["embedding_model", "embedding_contract"]).fillna(0, ["embedding_dim"])


query("search_fresh_stale", fresh_sql("thnd OR onan", f"{o.FRESH} <> 'fresh'"), lambda c: fresh(c, "thnd OR onan", "stale"))
query("search_fresh_any", fresh_sql("the of", "true"), lambda c: fresh(c, "the of", "any"))

for _facet in ("type", "bundle", "status", "trust_tier", "tag"):
    query(f"facets_{_facet}", o.facet_sql("the OR de", _facet), lambda c, f=_facet: search.search_facets(c, "the OR de", f))
query("catalog_facets", "SELECT unnest(tags) AS value, count(*) AS n FROM seen GROUP BY value", lambda c: search.catalog_facets(c, "tag"))
query(
    "facet_merge",
    "SELECT value, count(*) AS n FROM (SELECT type AS value FROM seen UNION ALL SELECT unnest(tags) FROM seen) GROUP BY value",
    lambda c: agg.merge_facets(search.catalog_facets(c, "type"), search.catalog_facets(c, "tag")),
)

_SEED = "(SELECT * FROM concepts WHERE concept_id = 'doc/24')"
query(
    "find_similar",
    f"""SELECT bundle_id, concept_id, path, title, type, round(r::DOUBLE, 4) AS rank FROM (
  SELECT bundle_id, concept_id, CAST(sum(weight) AS FLOAT) AS r FROM {o.posts()}
  WHERE lexeme IN (SELECT lexeme FROM {o.posts(_SEED)} WHERE length(lexeme) >= 3 GROUP BY lexeme ORDER BY count(*) DESC, lexeme LIMIT 20) GROUP BY ALL
) JOIN concepts USING (bundle_id, concept_id) WHERE concept_id <> 'doc/24' ORDER BY r DESC, bundle_id, concept_id LIMIT 10""",
    lambda c: rounded(search.find_similar(c, "doc/24")),
)

_WORDS = o.TOKENS.format("concat_ws(' ', title, description, body_text)")
BM25 = f"""SELECT bundle_id, concept_id, round(CAST(CAST(s AS FLOAT) AS DOUBLE), 3) AS rank FROM (
  SELECT d.bundle_id, d.concept_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS s
  FROM (SELECT bundle_id, concept_id, len(w) AS len, t, len(list_filter(w, lambda x: x = t)) AS tf FROM words, terms) d
  JOIN (SELECT t, count(*) FILTER (len(list_filter(w, lambda x: x = t)) > 0) AS df FROM words, terms GROUP BY t) f USING (t), (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM words)
  WHERE tf > 0 GROUP BY ALL) ORDER BY CAST(s AS FLOAT) DESC, bundle_id, concept_id LIMIT 20"""
query(
    "search_bm25",
    f"{o.CATALOG},\nwords AS (SELECT bundle_id, concept_id, {_WORDS} AS w FROM seen),\nterms AS (SELECT unnest(['thnd', 'onan']) AS t)\n{BM25}",
    lambda c: rounded(search.bm25(c, "onan thnd"), digits=3),
)


def vector(c: Catalog) -> list[float]:
    return list(c.table("concept_embedding").where("vec_id = 0").select("embedding").first()[0])


def semantic_sql(where: str, limit: int) -> str:
    return f"SELECT bundle_id, concept_id, path, title, type, round(s::DOUBLE, 4) AS rank FROM {o.SEM} WHERE {where} ORDER BY s DESC, bundle_id, concept_id LIMIT {limit}"


query("search_semantic", semantic_sql("true", 20), lambda c: rounded(search.concept_search_semantic(c, vector(c))))
query("search_semantic_types", semantic_sql("type IN ('en', 'fr')", 15), lambda c: rounded(search.concept_search_semantic(c, vector(c), limit=15, concept_types=["en", "fr"])))


def hybrid_sql(text: str, where: str) -> str:
    score = "CAST(coalesce(1 / (60 + pa), 0) + coalesce(1 / (60 + pb), 0) AS FLOAT)"
    return f"""SELECT bundle_id, concept_id, path, title, type, round(s::DOUBLE, 6) AS rank FROM (SELECT bundle_id, concept_id, {score} AS s FROM
  (SELECT bundle_id, concept_id, row_number() OVER (ORDER BY rank DESC, bundle_id, concept_id) AS pa FROM {o.rank_sql(text, f"(SELECT * FROM seen WHERE {where})")} QUALIFY pa <= 20) a FULL JOIN
  (SELECT bundle_id, concept_id, row_number() OVER (ORDER BY s DESC, bundle_id, concept_id) AS pb FROM {o.SEM} WHERE {where} QUALIFY pb <= 20) b USING (bundle_id, concept_id)
) JOIN concepts USING (bundle_id, concept_id) ORDER BY s DESC, bundle_id, concept_id LIMIT 20"""


query("search_hybrid", hybrid_sql("thnd OR onan", "true"), lambda c: rounded(search.concept_search_hybrid(c, "thnd OR onan", vector(c)), digits=6))
query("search_hybrid_types", hybrid_sql("the OR de", "type IN ('de', 'en')"), lambda c: rounded(search.concept_search_hybrid(c, "the OR de", vector(c), concept_types=["de", "en"]), digits=6))
query(
    "index_status",
    "SELECT count(*) AS concepts, count(e.concept_id) AS embedded, round(100 * count(e.concept_id) / count(*), 2) AS embedded_pct FROM concepts c LEFT JOIN emb e USING (bundle_id, concept_id)",
    search.index_status,
)
query(
    "index_postings",
    f"SELECT lexeme, count(*) AS n, count(DISTINCT concept_id) AS docs, round(sum(weight), 3) AS weight FROM {o.posts('concepts')} GROUP BY lexeme",
    lambda c: search.postings(c.table("concepts")).groupBy("lexeme").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(*KEY[1:]).alias("docs"), F.round(F.sum("weight"), 3).alias("weight")),
)
