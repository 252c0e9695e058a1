"""SimHash near-dedup with a byte-position inverted index and count filtering.

Fingerprints are 64 bits: four-word shingles of the lower-cased text, repeats included, are hashed by XXH64
(seed 42), and a bit is set if it is set in over half the hashes. Two documents link if their fingerprints differ in at
most 4 bits. Each differing bit spoils one of the eight bytes at most, so linked fingerprints share at least
4 bytes at the same positions: that is the guaranteed minimum of matches.

The index holds distinct fingerprints. A posting list of one (position, byte) has a 256th of all fingerprints, so
tallying all pairs of all lists is quadratic; postings are read three at a time instead. Of any four positions, three
are together in one of ``TRIPLES``, 20 triples (Turan's (8, 4, 3) system); so every pair that shares four bytes meets in
the intersection of three lists, which holds about one 2^24th of the fingerprints. There the shared bytes of each pair
are tallied in blocks, pairs reaching 4 are retained and verified by their bits. No pair is emitted: an
intersection gives each member's link to the least member it is connected with, which keeps all of the linkage.

Intersections are counted first. One of over ``LARGE`` members (a family of texts that share three bytes) is dealt into
blocks of about that size, and each pair of blocks is a task's work of its own; so no task holds more than two blocks.

Exact copies meet once, when fingerprints are grouped (with map-side pre-aggregation); a group of copies of any size is
one fingerprint. Components of the links come from ``components``; all steps are tables or shuffles by fingerprint or
posting key, nothing is collected to the driver.

A fingerprint's distance says little about a similarity as high as 0.8 (such pairs differ in some 10 of 64 bits). So what
promises one (``similar``, the pipeline's stage) takes this index's links for its first candidates, verifies them by their
shingles, and finds the others by min-hashes.

Defined results: null and empty texts have fingerprint 0 and link like any other; rows without id have a fingerprint
and no component; rows that repeat an id are one document; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from xxhash import xxh64_intdigest

from conceptlake.llm.arrowtext import map_text
from conceptlake.llm.components import components
from conceptlake.session import cut

SEED, SHINGLE = 42, 4
#: Linked fingerprints differ in at most so many bits, and share at least so many bytes.
BITS, LEAST = 4, 4
#: Positions 0-7 in groups {0,1,2}, {3,4,5}, {6,7}; triples within a group, or two of one and one of the next.
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
TRIPLES = tuple(sorted({tuple(sorted(t)) for i, g in enumerate(GROUPS) for t in [*([g] if len(g) == 3 else []), *[(a, b, c) for a in g for b in g if a < b for c in GROUPS[(i + 1) % 3]]]}))
#: Members of an intersection that one task compares with one another; and what a list of larger ones may be broadcast with.
LARGE, BROADCAST_BYTES = 1 << 13, 8 << 20


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only the six ASCII blanks separate
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The SimHash of hashes: bits that are set in over half of them, as an unsigned number."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text, an unsigned number of 64 bits."""
    return majority(shingle_hashes(text, shingle)) if text and text.encode().strip() else 0


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with the fingerprint ``fp`` as a signed long."""

    def start():
        return lambda texts: [(signed(fingerprint(t)),) for t in texts]

    return map_text(df, keep, [("fp", T.LongType())], start, text_col)


def settle(own: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite linked members: ``own`` gives each member the least one it is connected with so far."""
    while True:
        a, b = own[i], own[j]
        differ = a != b
        if not differ.any():
            return
        i, j, low, high = i[differ], j[differ], np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(own, high, low)
        while (own[own] != own).any():
            own[:] = own[own]


def linked(f: np.ndarray, block: int = 256) -> np.ndarray:
    """For the fingerprints of one intersection: the least member that each is connected with.

    Members are compared in blocks of ``block`` x ``block``, so memory doesn't grow with the number of pairs. Pairs that are
    connected already are passed over: in a large group of copies almost all are, once a few members have been compared
    with all others.
    """
    own = np.arange(len(f))
    byte = np.frombuffer(np.ascontiguousarray(f).tobytes(), np.uint8).reshape(len(f), -1)

    def compare(rows: np.ndarray, cols: np.ndarray) -> None:
        for k in range(0, len(cols), block):
            c = cols[k : k + block]
            shared = np.zeros((len(rows), len(c)), np.uint8)
            for p in range(8):
                shared += byte[rows, p][:, None] == byte[c, p]
            i, j = np.nonzero(shared >= LEAST)
            i, j = rows[i], c[j]
            near = np.bitwise_count(f[i] ^ f[j]) <= BITS
            settle(own, i[near], j[near])

    everyone = np.arange(len(f))
    if len(f) > block:
        for i in np.linspace(0, len(f) - 1, 16).astype(np.int64):
            compare(np.array([i]), everyone)
    for a in range(0, len(f), block):
        rows, rest = everyone[a : a + block], everyone[a:]
        main = int(np.bincount(own[rows]).argmax())
        # Those of the commonest component need only be compared with what is outside it, whichever side it stands on.
        inside = own[rows] == main
        compare(rows[~inside], rest)
        outside = everyone[own != main]
        compare(rows[inside], outside)
    return own


def dealt(postings: DataFrame, large: int) -> DataFrame:
    """``postings`` (key, rep, fp) with ``part``: members of a key with the same part are compared with one another.

    A key of at most ``large`` members is one part. One with more has its members in blocks by a hash, and a part for each
    pair of blocks, in which the members of both stand; so every two members meet in one part at least.
    """
    many = cut(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("key", F.ceil(F.col("n") / large).cast("long").alias("blocks")))
    side = F.broadcast(many) if many.count() * 64 <= BROADCAST_BYTES else many
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    parts = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
    return postings.join(side, "key", "left").select("key", F.explode(parts).alias("part"), "rep", "fp")


def links(index: DataFrame, large: int = LARGE) -> DataFrame:
    """Edges (a, b) that connect what is linked among distinct fingerprints ``index`` (fp, rep)."""
    spark = index.sparkSession
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = F.array(*[(F.lit(k << 24) + F.shiftleft(byte[a], 16) + F.shiftleft(byte[b], 8) + byte[c]).cast("long") for k, (a, b, c) in enumerate(TRIPLES)])
    postings = dealt(index.select(F.explode(keys).alias("key"), "rep", "fp"), large)
    postings = postings.repartition(slots, "key", "part").sortWithinPartitions("key", "part", "rep")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64),) * 4
        for batch in batches:
            key, part, rep, fp = (np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns, strict=True))
            if not len(key):
                continue
            # The last part may go on in the next batch.
            before = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            last = int(before[-1]) + 1 if len(before) else 0
            held = tuple(x[last:] for x in (key, part, rep, fp))
            yield from answers(*(x[:last] for x in (key, part, rep, fp)))
        yield from answers(*held)

    def answers(key: np.ndarray, part: np.ndarray, rep: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key) < 2:
            return
        start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
        size = np.diff(np.append(start, len(key)))
        f = fp.view(np.uint64)
        two = start[size == 2]
        x = f[two] ^ f[two + 1]
        enough = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= LEAST
        close = two[enough][np.bitwise_count(x[enough]) <= BITS]
        a, b = [rep[close]], [rep[close + 1]]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = linked(f[s : s + n])
            i = np.flatnonzero(own != np.arange(n))
            a.append(rep[s + i])
            b.append(rep[s + own[i]])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return postings.mapInArrow(run, schema)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id), a row for each row of ``df``."""
    marks = cut(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"]))
    index = cut(marks.where("id is not null").groupBy("fp").agg(F.min(F.col("id").cast("long")).alias("rep")))
    found = components(links(index))
    of = index.join(found, index["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    joined = marks.join(of, "fp", "left")
    return joined.select(F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
