"""Mixing sources to target weights, with DataFrame and SQL functions only.

1. Sources get word targets: shares of ``share`` x all words by weight, at most ``epochs`` x their own size, what is
   over that shared again by weight (water filling).
2. A source's documents, in keyed-hash order, form a stream of words, read again for each epoch; the stream is cut in
   blocks of ``block_words`` words, so consecutive blocks are a random permutation of the source. A target is an exact
   quota of blocks, of which the last may be short.
3. A binary tree of multivariate-hypergeometric draws splits the vector of quotas among ``shards`` output shards: each
   node's blocks go left or right in halves, drawn without replacement, source by source. The leaves' quotas add up to
   the source quotas exactly.
4. Each shard takes the next blocks of its quota from the stream, so shards' blocks are disjoint.
5. Shards are shuffled locally: each piece has a ``slot``, a keyed hash, and a shard's rows stand in the order of their
   slots. A shard is written by ``parts`` tasks, each of which sorts a range of slots, so it may be of any size.

A document's place in its source's stream is found in two tiers: a source's rows are dealt into hash buckets, about as many
as each has rows, running sums are taken in a bucket, and bucket totals (one row a bucket) are summed before it. So a source
with a third of all rows is spread over many tasks, and neither tier holds more than about the square root of its rows. The
hash covers the id and the text (or what stands for it), so an id that is repeated, or null, with different texts is spread
too; rows that are repeated whole share a bucket. One row a source, with an array of shard bounds, is joined back: by
broadcast if its size, which is counted first, is below ``BROADCAST_BYTES``, else by a shuffled join. The tree is
computed in one row that holds the array of quotas, so the number of sources is meant to be in the thousands; they are
sources, not documents.

Defined results: null text has size 0; the null source is a source, ordered last; ties (equal hash) are ordered by id,
then size; repeated rows are documents of their own; an empty table gives no rows; sources of size 0 have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from conceptlake.session import cut

WORD, BLANKS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]*"
WEIGHTS = (5, 2, 1)
BROADCAST_BYTES = 8 << 20
#: Words of a shard that one task sorts and writes, some 100 MB.
PART_WORDS = 1 << 24


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from a keyed hash."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) * F.lit(2.0**-53)


def log_factorial(x: Column) -> Column:
    """Natural logarithm of x!, by Stirling's series from 20 on."""
    x = x.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(F.lit(6.283185307179586) * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(x < 20, F.log(F.factorial(F.least(x, F.lit(20.0)).cast("int")).cast("double"))).otherwise(series)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` balls are good, of ``total`` with ``good`` good ones: the inverse distribution at ``u``.

    Probabilities are summed by recurrence over the twelve standard deviations around the mode; outside lies less than
    a double's precision. Results keep to the support in any case.
    """

    def around(s: Column) -> Column:
        low, high = F.greatest(F.lit(0).cast("long"), s["n"] + s["g"] - s["t"]), F.least(s["g"], s["n"])
        t = F.greatest(s["t"].cast("double"), F.lit(2.0))
        spread = F.sqrt(s["n"] * (s["g"] / t) * ((t - s["g"]) / t) * ((t - s["n"]) / (t - 1)))
        mode = F.floor((s["n"] + 1.0) * (s["g"] + 1.0) / (s["t"] + 2.0))
        near = F.struct(F.lit(0).cast("long").alias("zero"), low.alias("low"), high.alias("high"), mode.alias("mode"), (F.ceil(12 * spread) + 4).alias("reach"))
        return let(near, lambda r: F.struct(*[s[c].alias(c) for c in "tgnu"], F.greatest(r["low"], r["mode"] - r["reach"]).alias("a"), F.least(r["high"], r["mode"] + r["reach"]).alias("b")))

    def draw(s: Column) -> Column:
        ups, downs = (s["g"], s["t"] - s["g"], s["n"], s["t"] - s["n"]), (s["a"], s["g"] - s["a"], s["n"] - s["a"], s["t"] - s["g"] - s["n"] + s["a"], s["t"])
        logs = lambda xs: F.aggregate(F.array(*xs), F.lit(0.0), lambda acc, x: acc + log_factorial(x))
        zero = F.struct(F.exp(logs(ups) - logs(downs)).alias("p"), F.lit(0.0).alias("c"), s["a"].alias("x"), F.lit(False).alias("end"))

        def step(acc: Column, k: Column) -> Column:
            ratio = (s["g"] - k) * (s["n"] - k) / ((k + 1.0) * (s["t"] - s["g"] - s["n"] + k + 1.0))
            over = acc["end"] | (acc["c"] + acc["p"] > s["u"])
            return F.struct((acc["p"] * ratio).alias("p"), (acc["c"] + acc["p"]).alias("c"), F.when(over, acc["x"]).otherwise(k + 1).alias("x"), over.alias("end"))

        return F.when(s["a"] >= s["b"], s["a"]).otherwise(F.least(F.aggregate(F.sequence(s["a"], s["b"]), zero, step, lambda acc: acc["x"]), s["b"]))

    return let(let(F.struct(total.alias("t"), good.alias("g"), drawn.alias("n"), u.alias("u")), around), draw)


def water_fill(sources: DataFrame, share: float, epochs: int) -> DataFrame:
    """``sources`` (key, source_size, n_docs, ...) with sid, weight and target."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("key").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("ratio"), F.col("sid"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = sources.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", F.element_at(weights, ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int")))
    ranked = ranked.withColumn("most", (F.col("source_size") * epochs).cast("long")).withColumn("ratio", F.col("most") / F.col("weight").cast("double"))
    # With the sources of the smallest ratios held at their most, the others get `level` for each unit of weight.
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("level", level).withColumn("free", F.col("level") <= F.col("ratio"))
    final = F.min(F.when(F.col("free"), F.struct("ratio", "sid", "level"))).over(everything)
    return ranked.withColumn("final", final["level"]).withColumn("target", F.when(F.col("final").isNull() | (F.col("final") * F.col("weight") >= F.col("most")), F.col("most").cast("double")).otherwise(F.col("final") * F.col("weight")))


def split_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """From one row (q array<long>) to 2**levels rows (node, q): exact multivariate-hypergeometric splits."""
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), "q")
    for level in range(levels):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        nodes = nodes.withColumn("total", total)
        indexed = F.transform("q", lambda x, i: F.struct(x.alias("q"), i.alias("i")))

        def step(acc: Column, x: Column) -> Column:
            u = uniform(F.lit(seed), acc["level"], acc["node"], x["i"])
            got = hypergeometric(acc["rest"], x["q"], acc["left"], u).cast("long")
            return F.struct(acc["level"].alias("level"), acc["node"].alias("node"), (acc["rest"] - x["q"]).alias("rest"), (acc["left"] - got).alias("left"), F.concat(acc["out"], F.array(got)).alias("out"))

        zero = F.struct(F.lit(level).alias("level"), F.col("node"), F.col("total").alias("rest"), F.expr("total div 2").alias("left"), F.array().cast("array<long>").alias("out"))
        left = F.aggregate(indexed, zero, step, lambda acc: acc["out"])
        halves = let(left, lambda got: F.array(F.struct((F.col("node") * 2).alias("node"), got.alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", got, lambda a, b: a - b).alias("q"))))
        nodes = nodes.select(F.explode(halves).alias("n")).select("n.node", "n.q")
    return nodes


def mix_plan(sizes: DataFrame, *, shards: int, block_words: int, share: float, epochs: int, seed: int) -> DataFrame:
    """One row a source: key, sid, source_size, target, take (words), buckets, bounds (shards + 1 stream positions)."""
    levels = max(0, shards - 1).bit_length()
    sources = sizes.groupBy(F.col("__source").alias("key")).agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = water_fill(sources, share, epochs).withColumn("take", F.least(F.round("target").cast("long"), F.col("most"))).withColumn("blocks", F.ceil(F.col("take") / block_words).cast("long"))
    sources = cut(sources.select("key", "sid", "source_size", "n_docs", "target", "take", "blocks"))
    quotas = sources.agg(F.array_sort(F.collect_list(F.struct("sid", "blocks"))).alias("s")).select(F.transform("s", lambda x: x["blocks"]).alias("q"))
    leaves = split_tree(quotas, levels, seed).select("node", F.posexplode("q").alias("i", "n"))
    in_order = Window.partitionBy("i").orderBy("node")
    ends = leaves.withColumn("end", F.sum("n").over(in_order)).groupBy((F.col("i") + 1).alias("sid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "end"))), lambda x: x["end"]).alias("ends"))
    bounds = F.transform("ends", lambda x: F.least(x * block_words, F.col("take")))
    return cut(sources.join(ends, "sid").select("*", bounds.alias("bounds"), F.ceil(F.sqrt("n_docs")).cast("long").alias("buckets")).drop("ends"))


def sized(docs: DataFrame, id_col: str, source_col: str, size: Column, mark: Column, seed: int) -> DataFrame:
    """Rows (in a struct) with id, source, size and the hash that places them."""
    return docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), size.alias("__size"), F.xxhash64(F.lit(seed), F.col(id_col), mark).alias("__h"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, *, text_col: str = "text", mark: Column | None = None,
    shards: int = 32, block_words: int = 4096, share: float = 1.5, epochs: int = 2, seed: int = 42, plan: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``docs`` (in a struct ``row``) with their ``mix``: struct<source_size, target, size, pieces>.

    ``pieces`` is an array of struct<epoch, shard, word_from, word_to, slot>: the words [word_from, word_to) of the
    document that each shard takes, by epoch and shard; empty if none are taken. Pass ``size`` where the number of
    words is a column already, and ``mark``, a hash of the text, with it. Reruns agree: nothing depends on partitioning.
    ``plan`` is ``mix_plan`` of these rows, if it has been made.
    """
    size = n_words(F.col(text_col)) if size is None else size
    mark = F.xxhash64(F.col(text_col)) if mark is None else mark
    rows = sized(docs, id_col, source_col, size, mark, seed)
    if plan is None:
        plan = mix_plan(rows.select("__source", "__size"), shards=shards, block_words=block_words, share=share, epochs=epochs, seed=seed)
    small = plan.count() * (shards + 16) * 8 <= BROADCAST_BYTES

    def placed(df: DataFrame, *cols: str) -> DataFrame:
        side = plan.select("key", "sid", "buckets", *cols)
        joined = df.join(F.broadcast(side) if small else side, df["__source"].eqNullSafe(side["key"]))
        return joined.withColumn("__b", F.pmod(F.shiftrightunsigned("__h", 20), F.col("buckets")))

    totals = placed(rows.select("__source", "__h", "__size")).groupBy("sid", "__b").agg(F.sum("__size").alias("__t"))
    base = totals.withColumn("__base", F.sum("__t").over(Window.partitionBy("sid").orderBy("__b")) - F.col("__t")).drop("__t")
    in_bucket = Window.partitionBy("sid", "__b").orderBy("__h", "__id", "__size").rowsBetween(Window.unboundedPreceding, 0)
    out = placed(rows, "source_size", "target", "take", "bounds").withColumn("__off", F.sum("__size").over(in_bucket) - F.col("__size")).join(base, ["sid", "__b"])
    start = F.col("__base") + F.col("__off")

    def pieces_of(epoch: int) -> Column:
        # Shard j takes the stream's words [bounds[j-1], bounds[j]); a piece is what of the document lies there.
        at = F.struct((start + F.col("source_size") * epoch).alias("a"), F.col("bounds"), F.col("__size").alias("n"), F.col("__h").alias("h"))

        def cut_up(s: Column) -> Column:
            first = F.size(F.filter(s["bounds"], lambda b: b <= s["a"]))
            last = F.size(F.filter(s["bounds"], lambda b: b < s["a"] + s["n"]))
            each = F.sequence(first, F.least(last, F.size(s["bounds"]) - 1))

            def piece(j: Column) -> Column:
                low = F.when(j > 0, F.element_at(s["bounds"], F.greatest(j, F.lit(1)))).otherwise(F.lit(0).cast("long"))
                return F.struct(F.lit(epoch).alias("epoch"), j.alias("shard"), F.greatest(low - s["a"], F.lit(0).cast("long")).alias("word_from"), F.least(F.element_at(s["bounds"], j + 1) - s["a"], s["n"]).alias("word_to"), F.xxhash64(F.lit(seed + 1), F.lit(epoch), j, s["h"]).alias("slot"))

            some = (s["n"] > 0) & (first < F.size(s["bounds"]))
            return F.when(some, F.filter(F.transform(each, piece), lambda p: p["word_to"] > p["word_from"]))

        return let(at, cut_up)

    none = F.array().cast("array<struct<epoch:int,shard:int,word_from:bigint,word_to:bigint,slot:bigint>>")
    pieces = F.concat(*[F.coalesce(pieces_of(e), none) for e in range(epochs)])
    return out.select("row", F.struct(F.col("source_size"), F.col("target"), F.col("__size").alias("size"), pieces.alias("pieces")).alias("mix"))


def pieces_of_text(text: Column, low: Column, high: Column, size: Column) -> Column:
    """The words [low, high) of a text of ``size`` words as they stand: what is behind a word up to the next goes with it,
    what is before the first word goes with that. So a text's pieces put together are the text."""
    words = F.regexp_extract_all(text, F.lit(WORD + BLANKS), F.lit(0))
    part = F.array_join(F.slice(words, (low + 1).cast("int"), (high - low).cast("int")), "")
    head = F.when(low == 0, F.regexp_extract(text, "^" + BLANKS, 0)).otherwise("")
    return F.when((low == 0) & (high == size), text).otherwise(F.concat(head, part))


def ordered(pieces: DataFrame, shards: int, parts: int, *ties: str) -> DataFrame:
    """Rows with ``shard`` and ``slot``, each shard's in the order of its slots: partition shard * parts + k has the k-th of
    ``parts`` equal ranges of slots."""
    upper = F.floor((F.shiftrightunsigned("slot", 11) * F.lit(2.0**-53)) * parts).cast("int")
    # Slots are signed; their order as unsigned numbers is that of the ranges.
    order = F.col("slot").bitwiseXOR(F.lit(-(2**63)))
    placed = pieces.withColumn("__at", (F.col("shard") * parts + F.least(upper, F.lit(parts - 1))).cast("int")).withColumn("__o", order)
    # A partition has one shard; it is named first because a writer that splits by it would sort anew otherwise.
    return placed.repartitionById(shards * parts, F.col("__at")).sortWithinPartitions("shard", "__o", *ties).drop("__at", "__o")


def shuffled(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", *, text_col: str = "text", length_col: str = "n_chars", shards: int = 32, block_words: int = 4096,
    share: float = 1.5, epochs: int = 2, seed: int = 42, part_words: int = PART_WORDS,
) -> DataFrame:
    """The mix as rows: the columns of ``docs`` in a struct ``row``, with epoch, shard, word_from, word_to and slot, shard
    after shard and each shuffled, by as many tasks as have ``part_words`` words each.

    A piece's text is cut from the document's as it stands; ``length_col``, if there, is its length.
    """
    plan = mix_plan(docs.select(F.col(source_col).alias("__source"), n_words(F.col(text_col)).alias("__size")), shards=shards, block_words=block_words, share=share, epochs=epochs, seed=seed)
    leaves = 1 << max(0, shards - 1).bit_length()
    parts = max(1, -(-(plan.agg(F.sum("take")).first()[0] or 0) // (leaves * part_words)))
    out = mix(docs, id_col, source_col, text_col=text_col, shards=shards, block_words=block_words, share=share, epochs=epochs, seed=seed, plan=plan).select("row", "mix.size", F.explode("mix.pieces").alias("p"))
    whole = (F.col("p.word_from") == 0) & (F.col("p.word_to") == F.col("size"))
    text = pieces_of_text(F.col("row")[text_col], F.col("p.word_from"), F.col("p.word_to"), F.col("size"))
    out = out.select("row", "p.*", whole.alias("__whole"), text.alias("__t"))
    cols = [F.col("__t").alias(c) if c == text_col else F.when(F.col("__whole"), F.col("row")[c]).otherwise(F.length("__t").cast(docs.schema[c].dataType)).alias(c) if c == length_col else F.col("row")[c].alias(c) for c in docs.columns]
    rows = out.select(F.struct(*cols).alias("row"), "epoch", "shard", "word_from", "word_to", "slot")
    return ordered(rows.withColumn("__i", F.col("row")[id_col]), leaves, parts, "__i", "epoch", "word_from").drop("__i")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix in training order, with the columns of ``docs`` alone: shard after shard, each shuffled."""
    return shuffled(docs, **options).select("row.*")


def write_mix(docs: DataFrame, path: str, **options) -> None:
    """Write the training order: one folder a shard, with its pieces (row, epoch, word_from, word_to, slot) in order."""
    shuffled(docs, **options).write.partitionBy("shard").parquet(path)
