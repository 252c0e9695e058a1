"""The pipeline's near-dedup against exact five-word similarity, on both sides of 0.8."""

from __future__ import annotations

import random

from conceptlake.llm import similar
from test_brute import similar_components


def edited(words, kind, new, rng):
    n = len(words)
    if kind == "cut":
        return words[: int(0.83 * n)]
    if kind == "append":
        return words + new(int(0.2 * n))
    if kind == "block":
        at = rng.randrange(n // 2)
        return words[:at] + new(int(0.08 * n)) + words[at + int(0.08 * n) :]
    out = list(words)
    for at in rng.sample(range(n), int(kind * n)):
        out[at] = new(1)[0]
    return out


def kept(spark, texts):
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r[0] for r in similar.deduplicated(d).select("doc_id").collect()}


def corpus(kinds, seed, groups=40):
    rng = random.Random(seed)
    new = lambda k: ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(k)]
    texts = {}
    for _ in range(groups):
        for kind in kinds:
            words = new(rng.randint(80, 400))
            texts[len(texts)] = " ".join(words)
            texts[len(texts)] = " ".join(edited(words, kind, new, rng))
    return texts


def test_contiguous_edits_are_found(spark):
    texts = corpus(["cut", "append", "block", 0.015], 3)
    want = set(similar_components(texts, 0.8).values())
    assert len(want) < 0.6 * len(texts) and kept(spark, texts) == want


def test_texts_below_stay(spark):
    """Scattered changes at 0.55 to 0.75, and texts that have only a repeated line in common."""
    texts = corpus([0.03, 0.045, 0.06], 4)
    rng, line = random.Random(9), "all rights to this text are reserved by those who wrote it "
    for _ in range(40):
        texts[len(texts)] = line * 20 + " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(200))
    want = set(similar_components(texts, 0.8).values())
    assert len(want) > 0.9 * len(texts) and kept(spark, texts) == want


def test_a_large_group_around_one_text(spark):
    """Copies that are alike only by way of the text they were made from, which isn't the one with the smallest id."""
    rng = random.Random(6)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    texts = {i: " ".join([*base[:at], *(f"new{i}x{k}" for k in range(24)), *base[at + 24 :]]) for i in range(150) for at in [rng.randrange(270)]}
    texts[200] = " ".join(base)
    want = set(similar_components(texts, 0.8).values())
    assert len(want) == 1 and kept(spark, texts) == want


def test_repeated_ids_and_rows(spark):
    """An id with two texts is two documents (3 is a near copy of the second); a row that is there twice is one; rows without id stay."""
    a, b = "one two three four five six seven", "other words that have nothing in common with it"
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "y"), (2, a, "x"), (3, b + " indeed", "x"), (None, a, "x"), (None, a, "x")]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in similar.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert kept == sorted([(0, a), (0, a), (1, a), (1, b)])
    runs = [sorted(tuple(r) for r in similar.deduplicated(spark.createDataFrame(rows[::k], "doc_id long, text string, source string").where("doc_id IS NOT NULL")).collect()) for k in (1, -1)]
    assert runs[0] == runs[1]


def test_components_have_the_smallest_id(spark):
    texts = corpus([0.015], 12, groups=10)
    want = similar_components(texts, 0.8)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want


def test_recall_on_the_test_table(spark):
    """All pairs at 0.8 of the whole small table, and none below."""
    texts = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    want = set(similar_components(texts, 0.8).values())
    assert len(want) < len(texts) and kept(spark, texts) == want
