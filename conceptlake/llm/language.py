"""Language ID by nearest centroids.

A text's letters (lower case, with their combining marks; runs of anything else are one space) give character n-grams of
1 to 3, hashed to ``DIM`` places; the TF-IDF vector is normalised. For each language spherical k-means gives ``clusters``
centroids; the score of a language is the best cosine with one of its centroids. A text is rejected if its distance
(1 - cosine) from the nearest centroid is beyond what training texts of that centroid have, by ``slack``; op9's contract
wants a language for every text with letters, so rejection is a column of its own.

Training uses at most ``sample`` labelled rows of each language, those with the smallest keyed hashes, and at most ``most``
rows in all, an equal number of each language where that binds. Whole texts are counted on the executors; the driver gets
sparse counts (``DIM`` places at most for a row), in a constant number of jobs. N-gram statistics (IDF) are the classifier's
own and come from these rows. Predictions use the text only.

Defined results: null text, or one without a letter: ``und``, score 0, not accepted. Ties of languages go to the first in
order. Rows without language, text or id, and texts without letters, train nothing; rows that repeat an id in one language
are one, by the least text; without labelled rows every text is ``und`` and rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from conceptlake.llm.arrowtext import map_text
from conceptlake.llm.sampling import smallest_hashes_of_each

DIM, STRETCH = 1 << 13, 1 << 17
SAMPLE, MOST, CLUSTERS, SLACK = 400, 8000, 3, 0.15
NOT_LETTERS, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def grams(text: str) -> np.ndarray | None:
    """Counts of hashed n-grams, or None without a letter."""
    text = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not LETTER.search(text):
        return None
    c = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32)
    counts = np.zeros(DIM, np.int64)
    # Stretches of a long text, each with the two characters before it, of which no n-gram is counted again.
    for i in range(0, len(c), STRETCH):
        back = min(2, i)
        part = c[i - back : i + STRETCH]
        one = part * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (part[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (part[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        last = i + STRETCH >= len(c)
        singles = one[back or 1 : -1 if last else None]  # without the blanks at the text's ends
        places = np.concatenate((singles, two[max(0, back - 1) :], three))
        counts += np.bincount(places >> np.uint32(19), minlength=DIM)
    return counts.astype(np.float32)


def sparse(text: str | None) -> bytes | None:
    """``grams`` as bytes: the places that occur and their counts."""
    counts = grams(text) if text else None
    if counts is None:
        return None
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + counts[at].astype("<f4").tobytes()


def dense(rows: list[bytes]) -> np.ndarray:
    x = np.zeros((len(rows), DIM), np.float32)
    for i, raw in enumerate(rows):
        n = len(raw) // 6
        x[i, np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    return x


def k_means(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means with farthest-first starts: deterministic."""
    centres = [x.mean(0)]
    while len(centres) < min(k, len(x)):
        near = (x @ np.array([c / (np.linalg.norm(c) or 1) for c in centres]).T).max(1)
        centres.append(x[int(np.argmin(near))])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  #: one row each, unit length
    owner: np.ndarray  #: a centroid's language
    farthest: np.ndarray  #: a centroid's distance limit

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        counts = grams(text) if text and len(self.languages) else None
        if counts is None:
            return "und", 0.0, False
        v = counts * self.idf
        norm = float(np.sqrt(v @ v))
        cos = self.centroids @ v / norm if norm else np.zeros(len(self.centroids), np.float32)
        best = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[best])))
        return self.languages[self.owner[best]], score, bool(1.0 - score <= self.farthest[best])


def fit(rows: list[tuple[bytes, str]], clusters: int = CLUSTERS, slack: float = SLACK) -> Model:
    """From (sparse counts, language) rows; the vectors of one language at a time are held in full."""
    if not rows:
        return Model([], np.zeros(DIM, np.float32), np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(0))
    having = np.zeros(DIM)
    for raw, _ in rows:
        having[np.frombuffer(raw, "<u2", len(raw) // 6)] += 1
    idf = (np.log((1 + len(rows)) / (1 + having)) + 1).astype(np.float32)
    languages = sorted({lang for _, lang in rows})
    centres, owner, limits = [], [], []
    for k, language in enumerate(languages):
        own = dense([raw for raw, lang in rows if lang == language]) * idf
        own /= np.linalg.norm(own, axis=1, keepdims=True)
        c = k_means(own, clusters)
        cos = own @ c.T
        nearest = cos.argmax(1)
        for i in range(len(c)):
            mine = cos[nearest == i, i]
            centres.append(c[i])
            owner.append(k)
            limits.append(min(1.0, (1 - float(mine.min()) if len(mine) else 1 - float(cos.min())) + slack))
    return Model(languages, idf, np.array(centres, np.float32), np.array(owner), np.array(limits))


def remainder(key: Column, n: int) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def train(df: DataFrame, may_learn: Column, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE, most: int = MOST, seed: int = 42, **options) -> Model:
    """A model from at most ``sample`` labelled rows of each language, and ``most`` in all."""
    known = df.where(may_learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"))
    chosen = smallest_hashes_of_each(known, "__lang", "__id", sample, most, seed)
    texts = known.join(F.broadcast(chosen), ["__lang", "__id"], "left_semi").groupBy("__lang", "__id").agg(F.min("__text").alias("__text"))  # at most `most` rows

    def start():
        return lambda some: [(sparse(t),) for t in some]

    rows = map_text(texts, ["__lang"], [("counts", T.BinaryType())], start, "__text").where("counts IS NOT NULL").collect()
    return fit(sorted((bytes(r["counts"]), r["__lang"]) for r in rows), **options)


def identify(df: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred, score and accepted, a row for each row."""

    def start():
        return lambda texts: [model.judge(t) for t in texts]

    return map_text(df, keep, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("accepted", T.BooleanType())], start, text_col)
