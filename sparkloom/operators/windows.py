"""Best rows, top rows and deduplication per key, by window functions with a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_per(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key: DISTINCT ON. order is to end in a unique column."""
    return numbered(df, keys, order, "_rn").where("_rn = 1").drop("_rn")


def top_k_per(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], k: int | Column, name: str = "rn") -> DataFrame:
    """The first k rows of each key, numbered; k may be a Column, such as a cap looked up by key.

    A literal k lets Spark cut each partition to k rows a key before the shuffle (its window group limit).
    """
    return numbered(df, keys, order, name).where(F.col(name) <= k)


def ranked(df: DataFrame, order: Sequence[str | Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows overall with their rank. The limit comes first, so the one partition of the rank holds k rows."""
    return df.orderBy(*order).limit(k).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def round_robin(df: DataFrame, keys: Sequence[str], best: Column, order: Sequence[str | Column]) -> DataFrame:
    """Rows so that keys take turns: each key's best, then each key's second, keys in order of their best value."""
    own = Window.partitionBy(*keys)
    out = df.withColumns({"turn": F.row_number().over(own.orderBy(*order)), "key_best": F.max(best).over(own)})
    return out.orderBy("turn", F.col("key_best").desc(), *keys)


def page(df: DataFrame, order: Sequence[str | Column], limit: int, offset: int) -> DataFrame:
    """One page and the total number of rows in a column."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str | Column], *, update: bool = True) -> DataFrame:
    """old with new merged in by keys: a new row replaces an old one, or with update=False fills gaps only."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_per(both, keys, [F.col("_new").desc() if update else F.col("_new"), *order]).drop("_new")
