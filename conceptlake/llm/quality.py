"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded as a vector of shares: hashed word forms
(whole ones, runs of a character class cut to one), pairs of neighbouring forms, hashed words and pairs of words, and
lengths. The vector goes through a learnt layer with tanh. Gated attention (tanh and sigmoid branches, multiplied) gives
each passage a weight, learnt from document labels alone; the softmax-weighted sum of passage vectors is the document's
representation, which a logistic layer scores.

Training takes at most ``sample`` labelled documents, those with the smallest keyed hashes, as far as they have
``passages`` passages together (one that goes beyond is passed over); they are encoded on the executors and gathered in a
constant number of jobs. The gradient is written out in numpy and followed by Adam. Every whole text is scored; passages
are encoded in blocks, so a long text's vectors are never held at once.

Defined results: null and empty texts are a bag of one empty passage and have a score; repeated rows are scored alike;
documents without label or id train nothing; an id with several labels has the greatest, one with several texts the
least of them; without labels all score 0.5.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from conceptlake.llm.arrowtext import map_text
from conceptlake.llm.sampling import smallest_hashes
from conceptlake.session import cut, scratch

PASSAGE, HIDDEN, ATTEND = 64, 16, 8
#: Places of the vector: forms, pairs of forms, words, pairs of words, and what is measured.
FORMS, FORM_PAIRS, WORDS, WORD_PAIRS, MEASURES = 128, 128, 512, 256, 8
OFFSETS = np.cumsum([0, FORMS, FORM_PAIRS, WORDS, WORD_PAIRS])
DIM = int(OFFSETS[-1]) + MEASURES
#: Passages that are encoded at once.
BLOCK = 512
SAMPLE, PASSAGES = 3000, 30_000
#: A character's class: lower and upper case letters, digits, marks that prose has, other marks.
CLASSES = [("a", str.islower), ("A", str.isupper), ("0", str.isdigit), (".", set(".,;:'\"()?!-").__contains__)]
RUNS = re.compile(r"(.)\1+")


class Hashed(dict):
    """A word's form and the word itself, hashed to 16 bits each; a bounded cache."""

    def __missing__(self, word: str) -> int:
        form = RUNS.sub(r"\1", "".join(next((s for s, f in CLASSES if f(c)), c if ord(c) < 128 else "u") for c in word))
        code = (crc32(form.encode()) >> 16) << 16 | crc32(word.lower().encode()) >> 16
        if len(self) > 200_000:
            self.clear()
        if len(word) <= 64:
            self[word] = code
        return code


HASHED = Hashed()


def blocks(text: str | None, size: int = BLOCK):
    """The passages' vectors, ``size`` passages at a time (passages x DIM)."""
    words = (text or "").split()
    if not words:
        x = np.zeros((1, DIM), np.float32)
        x[0, -1] = 1
        yield x
    for i in range(0, len(words), size * PASSAGE):
        # One word of the next block takes part in the last pair.
        yield encoded(words[i : i + size * PASSAGE + 1], min(len(words) - i, size * PASSAGE))


def encoded(words: list[str], count: int) -> np.ndarray:
    """The vectors of the first ``count`` words; a word behind them is only the second of a pair."""
    code = np.fromiter(map(HASHED.__getitem__, words), np.int64, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))[:count]
    form, word = code >> 16, code & 0xFFFF
    bag = np.arange(count) // PASSAGE
    n = int(bag[-1]) + 1
    left = bag[: len(words) - 1]
    x = np.zeros((n, DIM), np.float32)
    for at, values, room in ((0, form[:count], FORMS), (1, form[:-1] * 31 + form[1:] * 17, FORM_PAIRS), (2, word[:count], WORDS), (3, word[:-1] * 31 + word[1:] * 17, WORD_PAIRS)):
        own = bag if at % 2 == 0 else left
        mixed = (values * 0x9E3779B1 & 0xFFFFFFFF) >> 15
        x[:, OFFSETS[at] : OFFSETS[at + 1]] = np.bincount(own * room + mixed % room, minlength=n * room).reshape(n, room)
    total = np.bincount(bag, minlength=n).astype(np.float32)
    m = x[:, OFFSETS[-1] :]
    m[:, 0] = np.bincount(bag, size, n) / 8
    m[:, 1] = np.bincount(bag, size > 12, n)
    m[:, 2] = np.bincount(bag, size < 3, n)
    m[:, 3] = np.bincount(left, form[1:] == form[:-1], n)
    m[:, 4] = np.bincount(left, word[1:] == word[:-1], n)
    x /= total[:, None]
    m[:, 5] = np.log1p(total) / 4
    return x


def encode(text: str | None) -> np.ndarray:
    """passages x DIM: what each passage looks like."""
    return np.concatenate(list(blocks(text)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """h = tanh(x We + be); a = softmax(w . (tanh(h V) * sigmoid(h U))); score = sigmoid(c . sum a h + d)."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p["We"] + self.p["be"])

    def attend(self, h: np.ndarray, start: np.ndarray):
        """h: the hidden vectors of all passages of some bags; start: where each bag begins."""
        p = self.p
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
        e = np.exp(e - np.maximum.reduceat(e, start)[bag])
        a = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        return t, g, a, z, bag, _sigmoid(z @ p["c"] + p["d"])

    def score(self, text: str | None) -> float:
        h = np.concatenate([self.hidden(x) for x in blocks(text)])
        return float(self.attend(h, np.zeros(1, np.int64))[-1][0])

    def gradient(self, x: np.ndarray, start: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean logistic loss of some bags, and what it changes by with each parameter."""
        p = self.p
        h = self.hidden(x)
        t, g, a, z, bag, s = self.attend(h, start)
        ds = (s - y) / len(y)
        dz = ds[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, start)[bag])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dx = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        clear = np.clip(s, 1e-12, 1 - 1e-12)
        loss = float(-(y * np.log(clear) + (1 - y) * np.log(1 - clear)).mean())
        return loss, {"c": z.T @ ds, "d": ds.sum(keepdims=True), "w": (t * g).T @ de, "V": h.T @ dt, "U": h.T @ dg, "We": ((x - self.mean) / self.scale).T @ dx, "be": dx.sum(0)}


def fit(bags: list[tuple[np.ndarray, int]], epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 42) -> Model:
    """From (passages x DIM, label) rows."""
    rng = np.random.Generator(np.random.PCG64(seed))
    p = {"We": rng.normal(0, DIM**-0.5, (DIM, HIDDEN)), "be": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTEND)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTEND)), "w": rng.normal(0, ATTEND**-0.5, ATTEND), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1)}
    y = np.array([label for _, label in bags], float)
    if not bags or y.min() == y.max():
        p["c"][:] = 0
        p["d"][:] = 0 if not bags else 8 if y[0] else -8
        return Model(p, np.zeros(DIM), np.ones(DIM))
    n = sum(len(x) for x, _ in bags)
    mean = sum(x.sum(0, dtype=float) for x, _ in bags) / n
    spread = np.sqrt(sum(((x - mean) ** 2).sum(0) for x, _ in bags) / n)
    model = Model(p, mean, spread + 0.02)
    one, two, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            x = np.concatenate([bags[j][0] for j in some])
            start = np.concatenate(([0], np.cumsum([len(bags[j][0]) for j in some])[:-1]))
            _, grad = model.gradient(x, start, y[some])
            step += 1
            now = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
            for k in p:
                d = grad[k] + decay * p[k]
                one[k] = 0.9 * one[k] + 0.1 * d
                two[k] = 0.999 * two[k] + 0.001 * d * d
                p[k] -= now * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, passages: int = PASSAGES, seed: int = 42, **options) -> Model:
    """A model from at most ``sample`` labelled documents of at most ``passages`` passages."""
    known = labels.where(may_learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__y"))
    chosen = smallest_hashes(known, sample, seed, "__id").select("__id", "__y")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id").groupBy("__id", "__y").agg(F.min("__text").alias("__text"))  # at most `sample` rows

    def start():
        def step(texts: list) -> list[tuple]:
            out = []
            for t in texts:
                n = max(1, -(-len((t or "").split()) // PASSAGE))
                out.append((n, encode(t).astype("<f2").tobytes() if n <= passages else None))
            return out

        return step

    # Vectors of 16-bit numbers are gathered for the documents that fit; which they are follows from their sizes alone.
    with scratch(docs.sparkSession):
        found = cut(map_text(rows, ["__id", "__y"], [("n", T.LongType()), ("x", T.BinaryType())], start, "__text"))
        left, fits = passages, []
        for r in found.select("__id", "n").orderBy(F.xxhash64(F.lit(seed), "__id"), "__id").collect():
            if r["n"] <= left:
                fits.append((r["__id"],))
                left -= r["n"]
        picked = docs.sparkSession.createDataFrame(fits, T.StructType([known.schema[0]]))
        bags = sorted((r["__id"], int(r["__y"]), bytes(r["x"])) for r in found.join(F.broadcast(picked), "__id").collect())
    return fit([(np.frombuffer(x, "<f2").reshape(-1, DIM).astype(np.float32), y) for _, y, x in bags], **options)


def score_quality(df: DataFrame, model: Model, keep: list[str], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``keep`` columns with score and predicted (1 if score >= threshold), a row for each row."""

    def start():
        def step(texts: list) -> list[tuple]:
            scores = [model.score(t) for t in texts]
            return [(s, int(s >= threshold)) for s in scores]

        return step

    return map_text(df, keep, [("score", T.DoubleType()), ("predicted", T.IntegerType())], start, text_col)
