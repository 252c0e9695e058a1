"""Merge-dropout: plain versions, independence, variation between occurrences, documents and repetitions, equal reruns."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from conceptlake.llm import sentencepieces

LINE = "several international universities published remarkable discoveries "
CHUNKS = re.compile(" *[^ ]+| +")


@pytest.fixture(scope="module")
def encoder():
    return sentencepieces.Encoder(sentencepieces.model_path(), 0.1, seed=5)


def test_occurrences_vary(encoder):
    plain = sentencepieces.Encoder(sentencepieces.model_path(), 0.0)
    text = " international" * 2000
    ids = encoder.encode(text)
    assert encoder.decode(ids) == text and len(set(ids)) > len(set(plain.encode(text)))
    assert encoder.encode(text) == ids == sentencepieces.Encoder(sentencepieces.model_path(), 0.1, seed=5).encode(text)
    assert encoder.encode(text, 1) != ids and encoder.encode(text + " x")[: len(ids)] != ids


def test_repeated_rows_vary_and_reruns_agree(spark):
    d = spark.createDataFrame([(i, LINE * 20) for i in (1, 1, 1, 2)], "doc_id long, text string")
    runs = [sorted((r["doc_id"], r["pieces_sha256"], r["lossless"]) for r in sentencepieces.encode_and_decode(x, ["doc_id"]).collect()) for x in (d, d.repartition(3))]
    assert runs[0] == runs[1] and len({h for _, h, _ in runs[0]}) == 4 and all(ok for *_, ok in runs[0])


def plain_agenda(e, chunk, skipped):
    """One chunk by looking through all adjacent pairs for the best at every step; ``skipped`` are candidates' numbers."""
    text = chunk.replace(sentencepieces.MARK, "\0").replace(" ", sentencepieces.MARK)
    parts, tried, at = [(i, i + 1) for i in range(len(text))], set(), 0
    while True:
        open_ = [(e.pieces.rank[text[a[0] : b[1]]], a[0], b[1] - a[0], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if text[a[0] : b[1]] in e.pieces.rank and (a, b) not in tried]
        if not open_:
            break
        *_, k = min(open_)
        at += 1
        if at - 1 in skipped:
            tried.add((parts[k], parts[k + 1]))
        else:
            parts[k : k + 2] = [(parts[k][0], parts[k + 1][1])]
    out = []
    for a, b in parts:
        out += [e.pieces.ids[text[a:b]]] if text[a:b] in e.pieces.ids else [e.pieces.byte_id[x] for x in chunk[a:b].encode()]
    return out, at


def spelt(e, symbols):
    return [i for s in symbols for i in ([s] if s < sentencepieces.OTHER else [e.pieces.byte_id[b] for b in chr(s - sentencepieces.OTHER).encode()])]


def gaps(skipped):
    last = -1
    for s in skipped:
        yield s - last - 1
        last = s
    while True:
        yield 1 << 40


def test_the_heap_equals_a_plain_agenda(encoder):
    rng = random.Random(3)
    for chunk in [" international", " Donaudampfschiff", " aaaaaaaaaa", " x", " 日本語", "   ", " misunderstandings", " ouéon", " a▁b"]:
        for _ in range(60):
            skipped = tuple(sorted(rng.sample(range(14), rng.randint(0, 4))))
            symbols, n = encoder.chunk(chunk, gaps(skipped).__next__)
            assert (spelt(encoder, symbols), n) == plain_agenda(encoder, chunk, skipped), (chunk, skipped)


def plain_encode(e, text, key, agenda):
    """A text chunk after chunk, with the skips that the keyed hash says."""
    mixed, one = sentencepieces.mixed, lambda x: np.array([x & sentencepieces.MASK], np.uint64)
    own = one(xxh64_intdigest(text.encode(), e.seed))[0] ^ mixed(one(key))[0]
    out = []
    for k, chunk in enumerate(CHUNKS.findall(" " + text)):
        chunk_key = int(mixed(one(int(own) + int(sentencepieces.GOLD) * (k + 1)))[0])
        out += agenda(chunk, e.draws(chunk_key))
    return out


def by_plain(e):
    def agenda(chunk, draws):
        skipped, at = [], -1
        for d in draws:
            at += d + 1
            if at > 4 * len(chunk):
                break
            skipped.append(at)
        return plain_agenda(e, chunk, skipped)[0]

    return agenda


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_texts_equal_a_plain_run(dropout):
    e = sentencepieces.Encoder(sentencepieces.model_path(), dropout, seed=5)
    rng = random.Random(1)
    texts = [LINE * 6, "  two  spaces end ", "日本語 テキスト and ▁ mark", "", "x", " ", "a" * 47 + " " + "b" * 48 + " " + "ab" * 40, "aaaaaaaa bbbbbbbbbbb thethethethe", *("".join(rng.choices("etaoin shé", k=60)) for _ in range(20))]
    keys = list(range(70, 70 + len(texts)))
    got = e.encode_many(texts, keys)
    for text, key, ids in zip(texts, keys, got, strict=True):
        assert ids.tolist() == (plain_encode(e, text, key, by_plain(e)) if text else []), text


def test_a_long_chunk_equals_the_heap(encoder):
    text = "ab" * 3000 + " " + LINE + "x" * 5000
    want = plain_encode(encoder, text, 7, lambda c, draws: spelt(encoder, encoder.chunk(c, draws.__next__)[0]))
    assert encoder.encode(text, 7) == want and encoder.decode(want) == text


def test_what_is_encoded_together_changes_nothing(encoder):
    texts, keys = [LINE * k for k in range(12)], list(range(12))
    assert [x.tolist() for x in encoder.encode_many(texts, keys)] == [encoder.encode(t, k) for t, k in zip(texts, keys, strict=True)]


def test_drops_are_independent(encoder):
    """Of candidates i and j both are skipped in about p^2 of the cases, next to one another too; in neighbouring chunks too."""
    hits, runs, was = Counter(), 20_000, set()
    for k in range(runs):
        at, few = -1, set()
        for d in encoder.draws(int(sentencepieces.mixed(np.array([k + 1], np.uint64) * sentencepieces.GOLD)[0])):
            at += d + 1
            if at >= 6:
                break
            few.add(at)
        hits.update(few)
        hits.update((i, j) for i in few for j in few if i < j)
        hits.update(("next", i, j) for i in few for j in was)
        was = few
    for i in range(6):
        assert hits[i] / runs == pytest.approx(0.1, abs=0.01)
        assert all(hits[i, j] / runs == pytest.approx(0.01, abs=0.003) for j in range(i + 1, 6))
        assert all(hits["next", i, j] / runs == pytest.approx(0.01, abs=0.003) for j in range(6))


def test_undisturbed_words_are_as_frequent_as_they_should_be(encoder):
    ids, n = encoder.chunk(" published")
    texts = ["published"] * 6000
    same = np.mean([x.tolist() == ids for x in encoder.encode_many(texts, list(range(6000)))])
    assert 0.9**n - 0.02 <= same < 0.9**n + 0.2


def test_one_word_has_several_segmentations_in_a_run(spark, encoder):
    d = spark.createDataFrame([(i, "x universities y") for i in range(400)], "doc_id long, text string")
    rows = sentencepieces.encode_column(d, ["doc_id"]).collect()
    assert len({tuple(r["pieces"]) for r in rows}) > 4 and all(encoder.decode(list(r["pieces"])) == "x universities y" for r in rows)
    back = sentencepieces.decode_column(sentencepieces.encode_column(d, ["doc_id"]), ["doc_id"]).collect()
    assert {r["text"] for r in back} == {"x universities y"}
