"""Near-dedup at a similarity: SimHash candidates first, then all others by min-hashes, each verified exactly.

Texts are sets of distinct five-word shingles (words as in ``simhash``); the similarity is Jaccard's, and two texts are
linked if it is 0.8 or more. Texts with equal sets are one node. Candidates are taken in rounds; each pair is verified by its
sets, which are made again from the texts in question, and only verified links go into components:

1. SimHash: the nodes' fingerprints (of the same shingles) go through ``simhash``'s byte-position index with its count
   filter. That finds most copies with few changes at 20 postings a fingerprint.
2. Pairs at 0.8 differ in some 10 of 64 bits, where no byte index has a guarantee that is worth its postings. So a set also
   has ``BANDS`` keys of ``ROWS`` min-hashes each. Two sets of similarity j have a given key in common with probability
   j^6, so a pair of similarity 0.8 shares none of 48 keys with (1 - 0.8^6)^48 < 5e-7, and this does not depend on how the
   changes lie in the text. Nodes that share a key meet in its bucket; there, each that isn't connected yet is held against
   the bucket's least member, then, in rounds, against one chosen by the key's hash, and tested with the few that it meets
   most often. A node beside a large component has several chances so, and is held against all of its members only after.
3. What is left are nodes in buckets that still have members of several components. Among these, all pairs at 0.8 are
   found by their rarest shingles: of two sets in order of frequency, rare ones first, that have four fifths of their union
   in common, one of the first fifth of each is in both, and enough shingles follow it in both. Pairs that meet so are held
   against one another by a sketch, one bit of each of 64 x ``WORDS`` min-hashes, before they are rows: at 0.8 a tenth of the
   bits differ, and over ``FAR`` of them with under 2e-4 (with under 1e-5 at 0.81). So a family of texts that share much, but less than 0.8, makes few
   pairs, and a large group of copies, which is connected by now, none.

Defined results: null and empty texts are one set, the empty shingle. A document is an id with a text: rows that repeat both
are one document, rows that repeat an id with other texts are documents of their own. Rows without id are left alone. Ties
go to the smallest id, then to the smallest hash of the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from conceptlake.llm import simhash
from conceptlake.llm.arrowtext import map_text
from conceptlake.llm.components import components, loose
from conceptlake.session import cut, drop

SHINGLE, ROWS, BANDS = 5, 6, 48
#: Links have so many fifths of their shingles in common.
FIFTHS = 4
_RNG = np.random.default_rng(20)
FACTORS = _RNG.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)
#: Rounds of buckets whose member is chosen by a hash: how many of those that a node meets it is tested with in each.
ROUNDS = (1, 3, 3)
WORDS, FAR = 32, 256
BIT_FACTORS = _RNG.integers(0, 1 << 63, 64 * WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A list of documents is broadcast if it is counted to be below this, and joined by a shuffle else.
BROADCAST_BYTES, ENTRY_BYTES = 8 << 20, 64


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes, in order; an empty text has one, the empty shingle."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE))


def keys_of(hashes: np.ndarray) -> np.ndarray:
    """A key for each band."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 256):
        np.minimum(least, (FACTORS[:, None] * hashes[None, i : i + 256]).min(1), out=least)
    key = BAND.copy()
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """A bit of each of many min-hashes, as ``WORDS`` numbers."""
    least = np.full(len(BIT_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 128):
        np.minimum(least, (BIT_FACTORS[:, None] * hashes[None, i : i + 128]).min(1), out=least)
    bits = ((least ^ (least >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
    return np.packbits(bits.astype(bool)).view(np.int64)


def marks_of(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep`` columns with the set's digest (d1, d2), its size n, its keys and its SimHash fp."""

    def start():
        def mark(text: str | None) -> tuple:
            hashes = shingle_set(text)
            d = np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64)
            return int(d[0]), int(d[1]), len(hashes), keys_of(hashes).view(np.int64), simhash.signed(simhash.majority(hashes))

        return lambda texts: [mark(t) for t in texts]

    long = T.LongType()
    return map_text(df, keep, [("d1", long), ("d2", long), ("n", long), ("keys", T.ArrayType(long)), ("fp", long)], start, text_col)


def fits(n: Column, m: Column) -> Column:
    """Sizes that allow for the similarity."""
    return F.least(n, m) * 5 >= F.greatest(n, m) * FIFTHS


def small(df: DataFrame) -> DataFrame:
    """A table of ``cut``, to be broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() * ENTRY_BYTES <= BROADCAST_BYTES else df


class Documents:
    """The documents of ``df`` (id, text), their sets as nodes, and the links found so far."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str) -> None:
        self.rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
        self.marks = cut(marks_of(self.rows, ["id", "mark"], "text"))
        sets = self.marks.groupBy("d1", "d2").agg(F.min(F.struct("id", "mark")).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
        # Numbers that a table holds, so they are the same whenever it is read.
        self.index = cut(sets.withColumn("node", F.monotonically_increasing_id()))
        #: (node, c): the component of each node so far, and the pairs that have been verified.
        self.labels = cut(self.index.select("node", F.col("node").alias("c")))
        self.tested: DataFrame | None = None

    def test(self, pairs: DataFrame) -> None:
        """Verify those of ``pairs`` (a, b: nodes; ca, cb: their components) that haven't been, and unite what they link."""
        new = cut(pairs if self.tested is None else pairs.join(self.tested, ["a", "b"], "left_anti"))
        wanted = new.select(F.col("a").alias("node")).unionByName(new.select(F.col("b").alias("node"))).distinct()
        sets = cut(self.sets_of(wanted))
        good = cut(verified(new, sets))
        drop(sets)
        self.tested = new.select("a", "b") if self.tested is None else self.tested.unionByName(new.select("a", "b"))
        self.unite(good)
        drop(good)

    def unite(self, good: DataFrame) -> None:
        united = components(good.select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).where("a <> b").distinct())
        was = self.labels
        self.labels = cut(was.join(united, was["c"] == united["node"], "left").select(was["node"], F.coalesce("component", "c").alias("c")))
        drop(was)

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """(node, s): the shingles of some nodes, made again from their texts."""

        def start():
            return lambda texts: [(shingle_set(t).view(np.int64),) for t in texts]

        firsts = cut(self.index.join(small(cut(wanted)), "node", "left_semi").select("node", "first.id", "first.mark"))
        texts = self.rows.join(small(firsts), ["id", "mark"]).select("node", "text").dropDuplicates(["node"])
        return map_text(texts, ["node"], [("s", T.ArrayType(T.LongType()))], start)

    def near_fingerprints(self) -> DataFrame:
        """Pairs of nodes that ``simhash`` links or that have one fingerprint: each with one that it leads to."""
        prints = cut(self.index.groupBy("fp").agg(F.min("node").alias("rep")))
        same = self.index.select("node", "fp").join(prints, "fp").select(F.col("node").alias("a"), F.col("rep").alias("b"))
        near = simhash.links(prints)
        near = near.groupBy("a").agg(F.min("b").alias("b")).unionByName(near.groupBy("a").agg(F.max("b").alias("b")))
        return same.unionByName(near).where("a <> b").distinct().select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))

    def link(self) -> None:
        bucket = Window.partitionBy("key")
        self.test(self.near_fingerprints())
        # The buckets that have members of several components; only they are looked at again, and they get fewer.
        several = F.min("c").over(bucket) < F.max("c").over(bucket)
        whole = self.index.select("node", "n", "keys").join(self.labels, "node").select(F.explode("keys").alias("key"), "node", "n", "c")
        rest = cut(whole.withColumn("several", several).where("several").drop("several"))

        def narrowed() -> DataFrame:
            now = rest.drop("c").join(self.labels, "node")
            out = cut(now.withColumn("several", several).where("several").drop("several"))
            drop(rest)
            return out

        by_hash = [(F.struct(F.xxhash64("key", "node", F.lit(seed)).alias("h"), "node", "n", "c"), most) for seed, most in enumerate(ROUNDS)]
        for first, most in [(F.struct("node", "n", "c"), 1), *by_hash]:
            near = rest.withColumn("p", F.min(first).over(bucket)).where("c <> p.c").where(fits(F.col("n"), F.col("p.n")))
            # Of all that a node is held against, those with which it shares the most keys.
            shared = near.groupBy("node", "c", F.col("p.node").alias("to"), F.col("p.c").alias("ct")).agg(F.count(F.lit(1)).alias("keys"))
            best = F.slice(F.sort_array(F.collect_list(F.struct("keys", "to", "ct")), asc=False), 1, most)
            met = shared.groupBy("node", "c").agg(best.alias("m")).select("node", "c", F.explode("m").alias("m"))
            self.test(paired(met.select("node", "c", F.col("m.to").alias("to"), F.col("m.ct").alias("ct"))))
            rest = narrowed()
        open_ = cut(rest.select("node", "n", "c").distinct())
        sets = cut(self.sets_of(open_.select("node")))
        good = cut(verified(rare_pairs(sets, open_), sets))
        self.unite(good)
        for table in (rest, open_, sets, good):
            drop(table)

    def components(self) -> DataFrame:
        """(d1, d2, first, component) of each node: component is the least node reachable."""
        return self.index.select("node", "d1", "d2", "first").join(self.labels, "node").withColumnRenamed("c", "component")


def paired(df: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, ca, cb), a > b, from (node, c, to, ct)."""
    swap = F.col("node") < F.col("to")
    pick = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    return df.select(pick("node", "to", "a"), pick("to", "node", "b"), pick("c", "ct", "ca"), pick("ct", "c", "cb")).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b, ca, cb) whose sets (node, s) are alike enough."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").select("a", loose("b"), "ca", "cb", "sa")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    both = two.select("a", "b", "ca", "cb", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return both.where(F.col("both") * 5 >= (F.col("n") - F.col("both")) * FIFTHS).select("a", "b", "ca", "cb")


def rare_pairs(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, ca, cb) of ``nodes`` (node, n, c) in different components, with all that can be alike enough.

    Shingles are in the order of frequency among these sets. If one is the first that two sets share, they share at most
    what is behind it in either, and they must share four ninths of both sizes.
    """

    def start():
        return lambda rows: [(sketch_of(np.array(s, np.int64).view(np.uint64)),) for s in rows]

    nodes = nodes.join(map_text(sets, ["node"], [("sketch", T.ArrayType(T.LongType()))], start, "s"), "node")
    tokens = sets.select("node", F.explode("s").alias("t"))
    often = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    known = tokens.join(often, "t").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("ft")).join(nodes, "node")
    # Shingles that no other set has come first, and can't be shared.
    alone = F.col("n") - F.size("ft")
    most = F.col("n") - F.ceil(F.col("n") * FIFTHS / 5)
    first = F.filter("ft", lambda x, i: alone + i <= most)
    postings = cut(known.select("node", "n", "c", "sketch", alone.alias("alone"), F.posexplode(first).alias("i", "x")).select("node", "n", "c", F.col("x.t").alias("t"), (F.col("n") - F.col("alone") - F.col("i")).alias("behind"), *[F.col("sketch")[k].alias(f"k{k}") for k in range(WORDS)]))
    other = postings.select("t", F.col("node").alias("to"), F.col("n").alias("m"), F.col("c").alias("ct"), F.col("behind").alias("after"), *[F.col(f"k{k}").alias(f"o{k}") for k in range(WORDS)])
    differ = sum((F.bit_count(F.col(f"k{k}").bitwiseXOR(F.col(f"o{k}"))) for k in range(1, WORDS)), F.bit_count(F.col("k0").bitwiseXOR(F.col("o0"))))
    enough = F.least("behind", "after") * 9 >= (F.col("n") + F.col("m")) * FIFTHS
    return paired(postings.join(other, "t").where("node < to AND c <> ct").where(fits(F.col("n"), F.col("m")) & enough & (differ <= FAR)))


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, component_id) for each row of ``df`` that has an id: the smallest id that links lead to; mark is the text's hash."""
    docs = Documents(df, id_col, text_col)
    docs.link()
    of = docs.components()
    least = of.groupBy("component").agg(F.min("first.id").alias("component_id"))
    named = of.join(least, "component").select("d1", "d2", "component_id")
    return docs.marks.select("id", "mark", "d1", "d2").join(named, ["d1", "d2"]).select(F.col("id").alias(id_col), "mark", "component_id")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: the first document of each component, once, and the rows without id."""
    docs = Documents(df, id_col, text_col)
    docs.link()
    first = docs.components().groupBy("component").agg(F.min("first").alias("f")).select("f.id", "f.mark")
    counted = docs.marks.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n"))
    kept = cut(counted.join(first, ["id", "mark"], "left_semi"))
    others = cut(counted.select("id", "mark").join(kept.where("n = 1").select("id", "mark"), ["id", "mark"], "left_anti"))

    def of(names: DataFrame, how: str) -> DataFrame:
        return df.join(names, (df[id_col] == names["id"]) & (F.xxhash64(df[text_col]) == names["mark"]), how)

    # The shorter way: to leave out what goes, if that is little, or to pick what stays.
    few = others.count() * ENTRY_BYTES <= BROADCAST_BYTES
    once = of(F.broadcast(others), "left_anti").where(F.col(id_col).isNotNull()) if few else of(kept.where("n = 1"), "left_semi")
    # Of rows that repeat a document, one stays, the same in every run; they are put together before they are dealt.
    again = small(cut(kept.where("n > 1").select("id", "mark")))
    hashed = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])
    rows = of(again, "left_semi").groupBy(F.struct(F.col(id_col), F.xxhash64(text_col))).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), hashed).alias("__row"))
    return once.unionByName(rows.select("__row.*")).unionByName(df.where(F.col(id_col).isNull()))
