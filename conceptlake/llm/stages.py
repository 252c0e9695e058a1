"""The stages of the corpus pipeline: language ID, near-dedup, secret scans, mixing, SentencePiece.

``STAGES`` are (name, function of (spark, docs, sf_dir)). Each result is written as Parquet and read again as the next
stage's ``docs``; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from conceptlake.llm import language, mixing, secrets, sentencepieces, similar
from conceptlake.session import cut, drop, scratch, tuned


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay; those that the classifier rejects go."""
    tuned(spark)
    held_out = language.remainder(F.col("doc_id"), 4) == 2
    model = language.train(docs, ~held_out, "doc_id", "text", "lang")
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text"))
    return language.identify(packed, model, ["__row"]).where("accepted").select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id stays."""
    tuned(spark)
    return similar.deduplicated(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    tuned(spark)
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a row each time, shard after shard and each shuffled; a document is cut in
    parts where a shard's or the target's end is."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's pieces with merge-dropout, checked by decoding."""
    tuned(spark)
    return sentencepieces.encode_and_decode(docs, ["doc_id", "source"])


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", hide_secrets),
    ("mixing to target weights", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: SimHash, learnt centroids and seeded dropout are beyond SQL: tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written goes when the next one's result is there."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:
            docs = keep(cut(stage(spark, docs, sf_dir)))
        if i:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
