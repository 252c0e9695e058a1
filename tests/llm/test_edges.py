"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conceptlake.llm import fingerprints, gif, language, mixing, quality, secrets, sentencepieces, simhash, similar, stages, tokencounts, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, score int, fp string, id int, block int, media string, path string, page_id long, url string"


def rows():
    long = "palabra larga " * 8000
    base = [(1, None, None, None), (2, "", "en", "a"), (3, long, "es", "a"), (4, "the cat sat on the mat", "en", "b"), (4, "the cat sat on the mat", "en", "b"), (None, "no id here at all", "en", None), (5, "the cat sat on the mat", None, "b"), (6, "12 34 !!", "en", "c"), (7, "x", "fr", "c")]
    return [(i, t, lang, s, None if t is None else len(t), 1, "r", 2, "f", 3, 4, "m", "p", i, None if t is None else f"http://{t[:9]}.com/a?b=1") for i, t, lang, s in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def taken(d):
    return mixing.mix(d).select("row.doc_id", "mix.size", F.size("mix.pieces").alias("n"))


def languages(d):
    return language.identify(d, language.train(d, F.lit(True), "doc_id", "text", "lang"), ["doc_id"])


def scores(d):
    labels = d.select("doc_id", F.when(F.col("doc_id") < 4, 1).otherwise(0).alias("quality"))
    return quality.score_quality(d, quality.train(d, labels, F.lit(True), epochs=3), ["doc_id"])


OPERATORS = {
    "secrets": secrets.scan_secrets, "mixing": taken, "fingerprints": fingerprints.fingerprint_pairs, "gif": gif.media_columns, "urls": urlfilter.filter_urls,
    "pieces": lambda d: sentencepieces.encode_and_decode(d, ["doc_id"]), "simhash": simhash.near_duplicates, "tokens": tokencounts.count_tokens, "language": languages, "quality": scores,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(name, docs, empty):
    assert OPERATORS[name](docs).count() == 9
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in stages.STAGES], ids=[n for n, _ in stages.STAGES])
def test_stages(stage, spark, docs, empty):
    out = stage(spark, docs, "")
    assert out.count() > 0
    assert stage(spark, empty, "").count() == 0
    if stage is not stages.STAGES[-1][1]:
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]


def test_dedup_keeps_one_of_each(spark, docs):
    kept = [r[0] for r in similar.deduplicated(docs).select("doc_id").collect()]
    assert sorted(x for x in kept if x is not None) == [1, 3, 4, 6, 7] and kept.count(None) == 1  # 2 is empty like 1, 5 a copy of 4


def by_id(df):
    """Rows by id, as lists of their other columns (repeated ids have several)."""
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"] if "doc_id" in df.columns else r["page_id"], []).append({k: v for k, v in r.asDict(True).items() if k not in ("doc_id", "page_id")})
    return out


def test_values_of_edge_cases(docs):
    """What the docstrings say of nulls, empty and very long texts, ties and repeated rows."""
    n_long = len("palabra larga " * 8000)
    got = by_id(secrets.scan_secrets(docs))
    assert all(r["spans"] == "" and r["n_spans"] == 0 for rows in got.values() for r in rows) and len(got[4]) == 2 and None in got
    got = by_id(taken(docs))
    assert [got[i][0]["size"] for i in (1, 2, 3, 4, 5, 6, 7)] == [0, 0, 16000, 6, 6, 3, 1] and got[1][0]["n"] == 0 == got[2][0]["n"]
    got = by_id(fingerprints.fingerprint_pairs(docs))
    assert got[1][0]["fingerprint"] == got[2][0]["fingerprint"] == fingerprints.EMPTY and got[1][0]["near_next"] == 1.0
    assert got[3][0]["n_chars"] == n_long and got[4][0]["fingerprint"] == got[4][1]["fingerprint"] == got[5][0]["fingerprint"] and got[4][0]["near_next"] == 1.0
    got = by_id(gif.media_columns(docs))
    assert got[1] == got[2] and got[1][0]["payload_bytes"] == 64 and got[4][0] == got[4][1] == got[5][0] and got[3][0]["n_bytes"] == n_long
    got = by_id(urlfilter.filter_urls(docs))
    assert (got[1][0]["host"], got[1][0]["path"], got[1][0]["rule"]) == ("", "", None) and got[4][0] == got[4][1]
    got = by_id(OPERATORS["pieces"](docs))
    assert got[1][0] == got[2][0] and got[1][0]["n_pieces"] == 0 and got[3][0]["n_bytes"] == n_long and all(r["lossless"] for rows in got.values() for r in rows)
    got = by_id(simhash.near_duplicates(docs))
    assert got[1][0] == {"fp": 0, "component_id": 1} == got[2][0] and [r["component_id"] for r in got[4]] == [4, 4] == [got[5][0]["component_id"], 4] and got[None][0]["component_id"] is None
    got = by_id(tokencounts.count_tokens(docs))
    assert got[1] == got[2] == [{"n_bytes": 0, "n_tokens": 0, "over_limit": False}] and got[3][0]["over_limit"] and got[4][0] == got[4][1] == got[5][0]
    got = by_id(languages(docs))
    assert all(got[i] == [{"lang_pred": "und", "score": 0.0, "accepted": False}] for i in (1, 2, 6)) and got[3][0]["lang_pred"] == "es" and got[4][0] == got[4][1] == got[5][0]
    got = by_id(scores(docs))
    assert got[1] == got[2] and got[4][0] == got[4][1] == got[5][0] and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for rows in got.values() for r in rows)


def test_kept_columns_give_way_to_new_ones(docs):
    model = language.train(docs, F.lit(True), "doc_id", "text", "lang")
    out = language.identify(docs, model, ["doc_id", "score", "source"])
    assert out.columns == ["doc_id", "source", "lang_pred", "score", "accepted"] and out.where("doc_id = 3").first()["score"] > 0.5
    clash = docs.selectExpr("doc_id", "text", "source", "n_chars", "1 AS shard", "2 AS slot", "3 AS epoch", "4 AS mix", "5 AS node", "6 AS mark", "7 AS component", "8 AS __h")
    assert mixing.mixed_documents(clash).columns == clash.columns and similar.deduplicated(clash).count() == 6


def test_null_is_empty(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, "", "a")], "doc_id long, text string, source string")
    for name in ("secrets", "gif", "tokens", "pieces"):
        a, b = (tuple(r)[1:] for r in OPERATORS[name](d).orderBy("doc_id").collect())
        assert a == b, name
