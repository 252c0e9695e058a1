"""The queries of this subpackage: op1 to op10 and the pipeline, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from conceptlake.llm import fingerprints, gif, language, mixing, quality, secrets, sentencepieces, simhash, stages, tokencounts, urlfilter
from conceptlake.session import cut, tuned


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = cut(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark")))
    mixed = mixing.mix(sizes, size=F.col("size"), mark=F.col("mark"))
    taken = F.aggregate("mix.pieces", F.lit(0).cast("long"), lambda n, p: n + p["word_to"] - p["word_from"])
    return mixed.select("row.doc_id", "mix.size", "mix.source_size", "mix.target", taken.alias("taken"), "mix.pieces")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op4_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_columns(table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_and_decode(table(spark, sf_dir, "documents"), ["doc_id"])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.remainder(F.col("doc_id"), 4) == 2
    model = language.train(docs, ~held_out, "doc_id", "text", "lang")
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model, ["doc_id", "held_out"])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = language.remainder(F.col("doc_id"), 5) == 0
    model = quality.train(docs, labels, ~held_out)
    return quality.score_quality(docs.select("doc_id", held_out.alias("held_out"), "text"), model, ["doc_id", "held_out"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_secrets, op2_mixing, op3_fingerprints, op4_gif, op5_urls, op6_sentencepiece, op7_simhash, op8_tokens, op9_language, op10_quality, pipeline)}


def _spans(rule: secrets.Rule, k: int) -> str:
    """Rows (doc_id, k, a, b) of one rule: gaps and matches alternate, so their lengths give the places."""
    pattern = (rule.sql or rule.pattern).replace("'", "''")
    value = f"regexp_extract(m[i], '{pattern}', {rule.group})"
    return f"""
SELECT doc_id, {k} AS k, a, a + length(m[i]) AS b FROM (
  SELECT doc_id, m, i, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM texts), LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i)
) WHERE length({value}) >= {rule.least}"""


def _op1_sql() -> str:
    kinds = "CASE k " + " ".join(f"WHEN {i} THEN '{r.kind}'" for i, r in enumerate(secrets.RULES)) + " END"
    counts = ", ".join(f"CAST(count(*) FILTER (k = {i}) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(secrets.BASE))
    return f"""
WITH texts AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS MATERIALIZED ({" UNION ALL ".join(_spans(r, k) for k, r in enumerate(secrets.RULES))}),
said AS (SELECT doc_id, {counts},
  coalesce(string_agg({kinds} || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < {len(secrets.BASE)}), '') AS base,
  coalesce(string_agg({kinds} || ':' || a || ':' || b, ',' ORDER BY a, k), '') AS spans, count(*) AS n FROM spans GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n, 0) AS BIGINT) AS n_spans
FROM texts t LEFT JOIN said s USING (doc_id)"""


ORACLES: dict[str, str] = {"op1_secrets": _op1_sql()}
