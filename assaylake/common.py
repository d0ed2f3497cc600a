"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import assaylake

# Functions of this package travel to the Python workers by value, so the workers need no copy of it.
cloudpickle.register_pickle_by_value(assaylake)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean(c: Column) -> Column:
    """NaN means missing: NaN and NULL both become NULL."""
    return F.when(~F.isnan(c), c)


def latest_version(df: DataFrame, key: str, version: str, columns: Sequence[str]) -> DataFrame:
    """One row per ``key``, the one with the latest ``version``.

    Versions that tie are ordered by the other columns, so the choice never depends on the
    partitioning; NULL versions lose; rows with a NULL key are one delivery each and all stay
    out, as they can't be told apart. Partial aggregation runs before the shuffle, so a key that was
    delivered very often is never collected.
    """
    rest = [c for c in columns if c != key and c != version]
    best = F.max(F.struct(col(version).alias("_v"), *[col(c) for c in rest])).alias("_best")
    out = df.where(col(key).isNotNull()).groupBy(col(key)).agg(best)
    return out.select(col(key), *[F.col("_best").getField(c).alias(c) for c in rest], *([F.col("_best._v").alias(version)] if version in columns else []))


#: A key is hot from this share of all rows on, so at most 1 / HOT_SHARE keys are hot whatever the data.
HOT_SHARE = 1e-3


def hot_keys(df: DataFrame, keys: Sequence[str], least: int, share: float = HOT_SHARE, per_salt: int | None = None) -> DataFrame:
    """(keys..., n, salts) of the keys that hold more than ``least`` rows and more than ``share`` of all rows.

    Never more than 1 / ``share`` rows, so the result may be broadcast. ``salts`` grows with the key's rows, one for every
    ``per_salt`` (by default ``least``) of them. NULL is a key like any other.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    hot = counts.crossJoin(F.broadcast(total)).where((F.col("n") > least) & (F.col("n") > F.col("_total") * share)).drop("_total")
    return hot.withColumn("salts", F.ceil(F.col("n") / F.lit(per_salt or max(least, 1))).cast("int"))


def join_frequent(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], least: int, share: float = HOT_SHARE) -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has one row for every key of ``rows`` and ``n``, their number.

    The few keys with very many rows, at most 1 / ``share``, are joined by broadcast, all others by shuffle, so no task gets a hot
    key's rows. NULL is a key like any other.
    """
    total = keyed.agg(F.sum("n").alias("_total"))
    often = (F.col("n") > least) & (F.col("n") > F.col("_total") * share)
    marked = keyed.crossJoin(F.broadcast(total)).withColumn("_often", often).drop("_total")
    named = marked.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in marked.columns if c not in (*keys, "n")])
    on = [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    hot, drop = F.broadcast(named.where("_often")), ["_often", *[f"_k{i}" for i in range(len(keys))]]
    cold = rows.join(hot.select(*drop[1:]), on, "left_anti").join(named.where(~F.col("_often")), on)
    return rows.join(hot, on).drop(*drop).unionByName(cold.drop(*drop))
