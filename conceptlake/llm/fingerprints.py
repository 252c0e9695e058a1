"""Document fingerprints by Order MinHash.

A text's k-mers (``K`` code points, the whole text if it is shorter) are numbered by occurrence, so repeats differ.
For each of ``M`` hash permutations of (k-mer, occurrence number) the ``L`` minimal ones are selected, put back in
their text order, and the tuple of their k-mers hashed to 16 bits; the fingerprint is the M hashes in hex. Two texts'
likeness is the share of equal places, which falls with their edit distance: moved text changes the order in tuples,
which plain MinHash does not see.

``fingerprint_pairs`` also compares each document with the next in ascending id and with an edited copy that takes over
that one's beginning. Documents are dealt to blocks of neighbouring ids: block boundaries are quantiles of the id column,
which are ids that occur, so that a block's first document is known from its boundary and is copied to the block before
as its last document's neighbour. An id that has the rows of several blocks, and the rows without id, are dealt to as many
blocks by a hash of the text. One shuffle moves each text once; a task streams its blocks in order and holds two documents.

Defined results: null text is empty; the empty text has a fingerprint of its own; with one document, the next is itself;
rows of equal id follow each other by text, nulls first, or by the text's hash where the id has several blocks; rows whose
id is null come last, by the text's hash; an empty table gives no rows. Ids are numbers, dates or times.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from conceptlake.errors import InvalidParameter
from conceptlake.llm.arrowtext import arrow_type, slices

K, L, M = 8, 2, 48
EMPTY = "0" * (4 * M)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class OrderMinHash:
    def __init__(self, k: int = K, l: int = L, m: int = M, seed: int = 42) -> None:  # noqa: E741
        self.k, self.l, self.m = k, l, m
        self.room, self.flags = np.empty(1 << 18, np.uint32), np.empty(1 << 18, bool)
        rng = np.random.Generator(np.random.PCG64(seed))
        self.factor = rng.integers(0, 1 << 32, m, dtype=np.uint64).astype(np.uint32) | np.uint32(1)  # odd: a permutation of 32-bit numbers
        self.power = _mix64(rng.integers(1, 1 << 62, max(k, 32), dtype=np.uint64)) | np.uint64(1)

    def kmers(self, text: str) -> np.ndarray:
        """A 64-bit hash of each k-mer, in text order."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        if len(codes) <= self.k:
            return _mix64((codes * self.power[: len(codes)]).sum(keepdims=True) + np.uint64(len(codes)))
        # By doubling: hashes of 1, 2, 4, ... code points, put together as the bits of k ask.
        n, width, power = len(codes) - self.k + 1, 1, codes
        total, done = np.zeros(n, np.uint64), 0
        for j, factor in enumerate(self.power):
            if self.k & width:
                total = total * factor + power[done : done + n]
                done += width
            if 2 * width > self.k:
                break
            power = power[:-width] * self.power[-1 - j] + power[width:]
            width *= 2
        return _mix64(total)

    def numbered(self, kmers: np.ndarray) -> np.ndarray:
        """A 32-bit hash of each (k-mer, occurrence number)."""
        n = len(kmers)
        bits = np.uint64(max(1, int(n).bit_length()))
        order = np.sort((kmers >> bits) << bits | np.arange(n, dtype=np.uint64))
        at = (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        order >>= bits
        hashes = _mix64(kmers)
        again = np.flatnonzero(order[1:] == order[:-1]) + 1
        if len(again):
            index = np.arange(len(again))
            first = np.maximum.accumulate(np.where(np.diff(again, prepend=-1) != 1, index, 0))
            hashes[at[again]] = _mix64(kmers[at[again]] + (index - first + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def signature(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(self.m, np.uint16)
        kmers = self.kmers(text)
        hashes = self.numbered(kmers)
        n, take = len(hashes), min(self.l, len(hashes))
        picks = np.empty((self.m, take), np.int64)
        # Values under `limit` hold the minimal ones but in rare cases, which are then searched whole.
        limit = np.uint32(min(0xFFFFFFFE, int((take + 10) / n * 2**32)))
        step = max(1, (1 << 18) // n)
        wide = -(-n // 8) * 8
        padded = np.zeros(wide, np.uint32)
        padded[:n] = hashes
        for j in range(0, self.m, step):
            factors = self.factor[j : j + step, None]
            size = len(factors) * wide
            if size > len(self.room):
                self.room, self.flags = np.empty(size, np.uint32), np.empty(size, bool)
            x = np.multiply(padded[None, :], factors, out=self.room[:size].reshape(-1, wide))
            x[:, n:] = 0xFFFFFFFF
            # Eight flags are looked at as one word: few have a hit.
            flags = np.less(x.ravel(), limit, out=self.flags[:size]) if n > 32 else np.ones(size, bool)
            words = np.flatnonzero(flags.view(np.uint64))
            near = (words[:, None] * 8 + np.arange(8))[flags.reshape(-1, 8)[words]]
            row, at = np.divmod(near, wide)
            order = np.argsort(row.astype(np.uint64) << np.uint64(32) | x.ravel()[near], kind="stable")
            head = np.searchsorted(row, np.arange(len(x) + 1))
            slot = head[:-1, None] + np.arange(take)
            full = np.flatnonzero(np.diff(head) >= take)
            picks[j + full] = at[order[slot[full]]]
            for i in np.flatnonzero(np.diff(head) < take):
                picks[j + i] = np.argsort(x[i, :n], kind="stable")[:take]
        picks.sort(axis=1)
        chosen = kmers[picks]
        out = np.full(self.m, np.uint64(take))
        for i in range(take):
            out = _mix64(out * np.uint64(0x9E3779B97F4A7C15) + chosen[:, i])
        return (out >> np.uint64(48)).astype(np.uint16)


def as_hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, blocks: int | None = None, k: int = K, l: int = L, m: int = M, seed: int = 42) -> DataFrame:  # noqa: E741
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row."""
    spark = df.sparkSession
    kind = df.select(id_col).schema[0].dataType
    if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise InvalidParameter(f"ids are numbers, dates or times, not {kind.simpleString()}")
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows, firsts = blocked(rows, kind, blocks)
    # The block before the first is the last.
    bound = spark.createDataFrame([(x, h, firsts[i - 1][0]) for i, (_, x, h) in enumerate(firsts)], T.StructType([T.StructField("__start", kind), T.StructField("__h", T.LongType()), T.StructField("__to", T.IntegerType())]))
    copied = rows.join(F.broadcast(bound), rows["id"].eqNullSafe(bound["__start"]) & (rows["h"] == bound["__h"]), "left")  # a row a block
    own, ghost = F.struct(F.col("block"), F.lit(0).alias("ghost")), F.struct(F.col("__to").alias("block"), F.lit(1).alias("ghost"))
    rows = copied.select("id", "h", "text", F.explode(F.array_compact(F.array(own, F.when(F.col("__to").isNotNull(), ghost)))).alias("b")).select("b.block", "b.ghost", "id", "h", "text")
    rows = rows.repartitionById(max(1, len(firsts), *(f[0] + 1 for f in firsts)) if firsts else 1, F.col("block")).sortWithinPartitions("block", "ghost", F.col("id").asc_nulls_last(), "h", F.col("text").asc_nulls_first())
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omh = OrderMinHash(k, l, m, seed)
        held, out = None, []

        def settle(follow: tuple[str, np.ndarray]) -> None:
            _, key, text, own = held
            text2 = edited(text, follow[0])
            two = own if text2 == text else omh.signature(text2)
            out.append((key, len(text), hashlib.sha256(text2.encode()).hexdigest(), as_hex(own), as_hex(two), likeness(own, two), likeness(own, follow[1])))

        for batch in (part for whole in batches for part in slices(whole, 3)):
            for block, ghost, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ghost and (held is None or held[0] != block):
                    continue  # a further copy of the same boundary
                text = text or ""
                own = held[3] if held is not None and held[2] == text else omh.signature(text)
                if held is not None:
                    settle((text, own))
                held = None if ghost else (block, key, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)
                out.clear()
        assert held is None, "a block ended without its neighbour"

    kinds = [arrow_type(f.dataType) for f in schema]
    return rows.select("block", "ghost", "id", "text").mapInArrow(run, schema)


def blocked(rows: DataFrame, kind: T.DataType, blocks: int) -> tuple[DataFrame, list[tuple]]:
    """``rows`` (id, text) with ``h`` and ``block``, and (block, id, h) of the first row of each block that has rows.

    ``h`` is a hash of the text where an id has several blocks, and 0 elsewhere.
    """
    total, low, nulls = rows.agg(F.count(F.lit(1)), F.min("id"), F.count_if(F.col("id").isNull())).first()
    of_null = -(-nulls * blocks // total) if nulls else 0
    of_ids = max(1, blocks - of_null)
    inner = rows.agg(F.percentile_approx("id", [i / of_ids for i in range(1, of_ids)], 100 * of_ids)).first()[0] if of_ids > 1 and low is not None else []
    # How many blocks begin at each start, which are ids that occur.
    starts = sorted(Counter([low, *inner]).items()) if low is not None else []
    base = [0]
    for _, n in starts:
        base.append(base[-1] + n)
    width = [n for _, n in starts] + [of_null]
    array = lambda xs, as_type: F.array(*[F.lit(x) for x in xs]).cast(T.ArrayType(as_type))
    at = F.when(F.col("id").isNull(), F.lit(len(starts))).otherwise(position(F.col("id"), [x for x, _ in starts], kind)) if starts else F.lit(0)
    placed = rows.withColumn("__i", at).withColumn("__n", F.element_at(array(width, T.IntegerType()), F.col("__i") + 1))
    is_start = F.col("id").isNull() | (F.col("id") == F.element_at(array([*(x for x, _ in starts), low], kind), F.col("__i") + 1))
    several = F.col("__n") > 1
    placed = placed.withColumn("h", F.when(F.col("id").isNull() | (several & is_start), F.shiftrightunsigned(F.xxhash64("text"), 1)).otherwise(F.lit(0).cast("long")))
    # The rows of a start's id share its blocks by their hash; the ids behind it are in the last of them.
    inside = F.when(several & is_start, F.shiftright(F.shiftright("h", 32) * F.col("__n"), 31)).when(several, F.col("__n") - 1).otherwise(0)
    placed = placed.withColumn("block", (F.element_at(array(base, T.IntegerType()), F.col("__i") + 1) + inside).cast("int"))
    firsts = [(base[i], x, 0) for i, (x, n) in enumerate(starts) if n == 1]
    if nulls or len(firsts) < len(starts):
        wide = placed.where(several | F.col("id").isNull()).groupBy("block").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("h").alias("h"))).alias("f"))
        firsts += [(r["block"], r["f"]["id"], r["f"]["h"]) for r in wide.collect()]  # a row a block
    return placed.select("id", "h", "text", "block"), sorted(firsts, key=lambda f: f[0])


def position(x: Column, starts: list, kind: T.DataType) -> Column:
    """The last index whose start is at most ``x``, by binary search in an array."""
    array = F.array(*[F.lit(s) for s in starts]).cast(T.ArrayType(kind))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        down = x < F.element_at(array, middle + 1)
        open_ = acc["high"] - acc["low"] > 1
        return F.struct(F.when(open_ & ~down, middle).otherwise(acc["low"]).alias("low"), F.when(open_ & down, middle).otherwise(acc["high"]).alias("high"))

    ends = F.struct(F.lit(0).alias("low"), F.lit(len(starts)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(starts).bit_length())), ends, halve, lambda acc: acc["low"])
