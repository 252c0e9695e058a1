"""Bounded samples that depend on the data alone, not on its partitioning."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame, Window, functions as F, types as T


def threshold(k: int, distinct: int) -> int | None:
    """What hashes of 63 bits must be below so that well over ``k`` of ``distinct`` ones are; None if all are.

    Ten standard deviations beyond k, and the error of the sketch that gave ``distinct``.
    """
    share = 1.3 * (k + 10 * sqrt(k) + 50) / max(1, distinct)
    return int(2**63 * share) if share < 1 else None


def smallest_hashes(df: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    """At most ``k`` distinct rows of ``df``, those with the smallest hashes of ``keys``, with ``n``, how often each is there.

    Rows are first cut to hashes below a threshold that well over ``k`` distinct ones are expected to pass, at any size of
    the table; the number of distinct hashes is estimated by a sketch, so a key that is repeated ever so often counts
    once. What passes is counted with map-side sums, and the sort has few rows. Two jobs, whatever the partitioning.
    """
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in keys]), 1)
    most = threshold(k, df.agg(F.approx_count_distinct(h)).first()[0])
    if most is not None:
        df = df.where(h < F.lit(most))
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).orderBy(h, *keys).limit(k)


def smallest_hashes_of_each(df: DataFrame, group: str, key: str, k: int, most: int, seed: int) -> DataFrame:
    """Distinct (group, key): of each group the ``k`` with the smallest hashes of the key, and at most ``most`` in all.

    Where ``most`` binds, the groups' first rows go before their second ones, and so on; beyond ``most`` groups the largest
    are taken. As in ``smallest_hashes``, rows are cut by a threshold before anything is shuffled, one for each group, so a
    group may hold almost all rows, and a key may be repeated ever so often.
    """
    rows = df.select(group, key, F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 1).alias("__h"))
    counts = rows.groupBy(group).agg(F.approx_count_distinct("__h").alias("n")).orderBy(F.col("n").desc(), group).limit(most).collect()
    limits = [(r[group], t if (t := threshold(k, r["n"])) is not None else 2**63 - 1) for r in counts]
    bounds = df.sparkSession.createDataFrame(limits, T.StructType([df.select(group).schema[0], T.StructField("__most", T.LongType())]))
    few = rows.join(F.broadcast(bounds), group).where("__h <= __most").select(group, key, "__h").distinct()  # bounds: at most `most` rows
    ranked = few.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy("__h", key))).where(F.col("__r") <= k)
    return ranked.orderBy("__r", "__h", group, key).limit(most).select(group, key)
