"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature

from pyspark.sql import DataFrame, SparkSession, functions as F

from conceptlake.plans import oracle as o
from conceptlake.sources.testdata import catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = ["bundle_id", "concept_id"]
#: Times that queries are asked for: seconds and microseconds since 1970.
NOW_S, AT_US = 1704240000, 1705363200000000


def query(name: str, sql: str | None, f: Callable) -> None:
    """Register ``f`` of the catalog (and the data's folder, if it takes a second argument); ``sql`` follows the catalog's
    WITH, unless it is a whole statement of its own (of the driver's tables)."""
    assert name not in QUERIES, name
    two = len([p for p in signature(f).parameters.values() if p.default is p.empty]) == 2
    QUERIES[name] = (lambda spark, sf_dir: f(catalog(spark, sf_dir), sf_dir)) if two else (lambda spark, sf_dir: f(catalog(spark, sf_dir)))
    if sql is not None:
        ORACLES[name] = sql if sql.lstrip().startswith("WITH") else f"{o.CATALOG}\n{sql}"


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    for c in columns or ("rank",):
        df = df.withColumn(c, F.round(F.col(c).cast("double"), digits))
    return df
