"""Joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32
HOT_SHARE = 1000
HOT_FLOOR = 100_000


def hot_keys(counts: DataFrame, key: str, rows: str, share: int = HOT_SHARE, floor: int = HOT_FLOOR) -> list[str]:
    """Keys that hold at least ``floor`` rows and one ``share``-th of all rows.

    ``counts`` has one row per key, so it comes out of a map-side combined aggregate. At most
    ``share`` keys can qualify, whatever the size of the data: the list is safe on the driver.
    """
    heavy = counts.filter(F.col(rows) >= floor)
    found = heavy.orderBy(F.col(rows).desc(), key).limit(share).collect()
    if not found:
        return []
    total = counts.agg(F.sum(rows)).first()[0]
    return [r[key] for r in found if r[rows] * share >= total]


def salted_join(
    big: DataFrame, small: DataFrame, key: str, spread: Column, hot: list[str], how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Join ``big`` to ``small`` (one row per key) on ``key``, dealing hot keys out over ``salts`` partitions.

    Only the hot keys' rows of ``small`` are copied, ``salts`` times each. Null keys never match
    and are spread as well. Without hot keys this is a plain equi-join.
    """
    if not hot:
        return big.join(small, key, how)
    is_hot = F.col(key).isin(hot)
    salt = F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = big.withColumn("_salt", salt)
    right = small.withColumn("_salt", F.explode(copies))
    return left.join(right, [key, "_salt"], how).drop("_salt")
