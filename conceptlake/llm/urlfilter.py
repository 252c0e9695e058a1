"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

Host and path are cut from the url with SQL functions; a rule (host, path) fits its host and all subdomains where the
url's path starts with the rule's path, and the longest fitting rule wins. Urls without a rule are judged by boosted
regression trees (logistic loss) on lexical features alone: lengths, depth, digit ratio, entropy, parameter counts and
statistics of the suffix and of the last label (how often labelled urls with it are to be blocked, smoothed).

A suffix is what names are registered under: the last label, or the last two where the last has two letters and the one
before it is a registry's (``REGISTRIES``). Training rows get their suffix statistics from the other folds of ``FOLDS``, so
the trees don't see a row's own label in them; a fold holds whole hosts. Urls that are judged get those of all rows.

Labelled urls train the trees. ``filter_urls`` takes them as a table (url, block); without one, the urls that a rule
decides are the labels, so the trees carry what the rules say over to urls that look alike. Training uses at most
``sample`` distinct (url, block), those with the smallest keyed hashes, weighted by how often each occurs (up to
``WEIGHT``), so that neither partitioning nor repetition decides what is chosen; every url is judged. The model (some
hundred numbers, and a suffix table of at most two entries a training row) goes to the tasks with the function. If the
labels have one class or none, the verdict for urls without a rule is that class, or allow.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is judged by the model like
any other; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from conceptlake.llm.arrowtext import slices
from conceptlake.llm.sampling import smallest_hashes

#: (verdict, rule): host, then a slash, then the path's beginning.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
SAMPLE, FOLDS, WEIGHT = 20_000, 5, 100
#: Second-level labels that registries use below country codes.
REGISTRIES = frozenset({"ac", "co", "com", "edu", "gov", "net", "or", "org"})
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "host_entropy", "parameters", "query_length", "hyphens", "https", "suffix_rate", "suffix_count", "last_rate", "last_count")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in reversed(ordered):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8))
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


def suffixes_of(host: str) -> tuple[str, str]:
    """What the host's name is registered under, and its last label."""
    labels = host.split(".")
    two = len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in REGISTRIES
    return ".".join(labels[-2:]) if two else "." + labels[-1], labels[-1]


#: Weight of all rows and of those to block, by suffix and by last label.
Tally = dict[str, tuple[float, float]]


def tally(rows: list[tuple[str, int, float]]) -> Tally:
    """From (host, block, weight) rows."""
    out: Tally = {}
    for host, block, weight in rows:
        for s in suffixes_of(host):
            n, b = out.get(s, (0.0, 0.0))
            out[s] = (n + weight, b + weight * block)
    return out


def lexical(url: str | None, host: str, path: str, known: Tally, base: float) -> list[float]:
    url = url or ""
    query = url.partition("?")[2].partition("#")[0]
    seen = [known.get(s, (0.0, 0.0)) for s in suffixes_of(host)]
    rates = [x for n, b in seen for x in ((b + 5 * base) / (n + 5), float(np.log1p(n)))]
    return [len(url), len(host), len(path), sum(bool(x) for x in path.split("/")), host.count(".") + bool(host), sum(c.isdigit() for c in url) / max(1, len(url)), entropy(url), entropy(host), sum(bool(x) for x in query.split("&")), len(query), host.count("-"), float(url[:8].lower() == "https://"), *rates]


@dataclass
class Tree:
    """Node i: rows with feature[i] <= cut[i] go to left[i], others to right[i]; a leaf has feature -1 and its value."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def grow(self, x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, reg: float, rate: float) -> int:
        me = len(self.feature)
        for part, v in zip((self.feature, self.cut, self.left, self.right, self.value), (-1, 0.0, -1, -1, 0.0), strict=True):
            part.append(v)
        gs, hs = g[rows].sum(), h[rows].sum()
        self.value[me] = float(-rate * gs / (hs + reg))
        if depth == 0 or len(rows) < 20:
            return me
        best = (1e-6, -1, 0.0)
        for f, edges in enumerate(cuts):
            if not len(edges):
                continue
            bins = np.searchsorted(edges, x[rows, f], "left")
            gl = np.cumsum(np.bincount(bins, g[rows], len(edges) + 1))[:-1]
            hl = np.cumsum(np.bincount(bins, h[rows], len(edges) + 1))[:-1]
            gain = gl**2 / (hl + reg) + (gs - gl) ** 2 / (hs - hl + reg) - gs**2 / (hs + reg)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, float(edges[k]))
        if best[1] < 0:
            return me
        down = x[rows, best[1]] <= best[2]
        self.feature[me], self.cut[me] = best[1], best[2]
        self.left[me] = self.grow(x, cuts, g, h, rows[down], depth - 1, reg, rate)
        self.right[me] = self.grow(x, cuts, g, h, rows[~down], depth - 1, reg, rate)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        feature, cut, left, right, value = map(np.array, (self.feature, self.cut, self.left, self.right, self.value))
        while (inner := np.flatnonzero(feature[node] >= 0)).size:
            at = node[inner]
            node[inner] = np.where(x[inner, feature[at]] <= cut[at], left[at], right[at])
        return value[node]


@dataclass
class Model:
    base: float
    trees: list[Tree]
    known: Tally
    rate: float  #: share of blocked labels, for suffixes never seen

    def score(self, rows: list[tuple[str | None, str, str]]) -> np.ndarray:
        """The chance that a url is one to block."""
        if not rows:
            return np.zeros(0)
        x = np.array([lexical(*r, self.known, self.rate) for r in rows])
        return 1 / (1 + np.exp(-(self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x))))))


def fold_of(host: str) -> int:
    return crc32(host.encode()) % FOLDS


def train(rows: list[tuple[str | None, str, str, int, float]], rounds: int = 60, depth: int = 3, rate: float = 0.2, reg: float = 1.0, bins: int = 32) -> Model:
    """Boosted trees from (url, host, path, block, weight) rows."""
    y, weight = np.array([r[3] for r in rows], float), np.array([r[4] for r in rows], float)
    share = float((y * weight).sum() / weight.sum()) if len(y) else 0.0
    if not len(y) or share in (0.0, 1.0):
        return Model(50.0 if share == 1.0 else -50.0, [], {}, share)
    folds = [tally([(h, b, w) for _, h, _, b, w in rows if fold_of(h) != k]) for k in range(FOLDS)]
    x = np.array([lexical(u, h, p, folds[fold_of(h)], share) for u, h, p, _, _ in rows])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    base, trees = float(np.log(share / (1 - share))), []
    at = np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-at))
        tree = Tree()
        tree.grow(x, cuts, weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), depth, reg, rate)
        trees.append(tree)
        at += tree.predict(x)
    return Model(base, trees, tally([(h, b, w) for _, h, _, b, w in rows]), share)


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None, rules=RULES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """(id, host, path, rule, verdict, score), a row for each row; score is the model's chance of block."""
    parts = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.select("*", rule.alias("rule"), verdict.alias("said"))
    if labels is None:
        known = parts.where(F.col("said").isNotNull()).select("url", "host", "path", (F.col("said") == "block").cast("int").alias("block"))
    else:
        known = labels.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("block").cast("int").alias("block")).where(F.col("block").isNotNull())
    chosen = smallest_hashes(known, sample, seed, "url", "block")
    model = train([(*r[:4], float(min(r["n"], WEIGHT))) for r in chosen.collect()])  # at most `sample` rows
    schema = T.StructType([T.StructField(id_col, df.select(id_col).schema[0].dataType), *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids, urls, hosts, paths, said_rule, said = batch.columns
            score = model.score(list(zip(urls.to_pylist(), hosts.to_pylist(), paths.to_pylist(), strict=True)))
            verdicts = [v or ("block" if s >= 0.5 else "allow") for v, s in zip(said.to_pylist(), score, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, hosts, paths, said_rule, pa.array(verdicts, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return parts.mapInArrow(run, schema)
