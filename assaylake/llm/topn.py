"""Top N rows of every group by descending score bands."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.common import clean, col
from assaylake.session import Scratch

#: Shares of all rows above which a band begins; the last band holds the rest.
BAND_SHARES = (0.125, 0.5)
#: Buckets of the bitmap of groups that still lack rows: 2 MB whatever the data. A bucket without such a group has
#: full groups only; once the bitmap is crowded, more rows reach the exact anti-join behind the shuffle.
BUCKET_BITS = 24
LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


@contextmanager
def _limits_up_to(spark: SparkSession, n: int) -> Iterator[None]:
    """Plans made inside rank at most ``n`` rows of a group in each map task; by itself Spark does so up to 1000 only."""
    before = spark.conf.get(LIMIT, None)
    spark.conf.set(LIMIT, str(max(n, int(before or 1000))))
    try:
        yield
    finally:
        spark.conf.unset(LIMIT) if before is None else spark.conf.set(LIMIT, before)


def _open_buckets(open_: DataFrame, bits: int) -> DataFrame:
    """One row with 2 ** bits bits as an array of longs: the buckets in which some group is open."""
    bucket = F.pmod(F.xxhash64("_g"), F.lit(1 << bits))
    words = open_.groupBy(F.shiftright(bucket, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(_g), {1 << bits}) % 64 as int))")).alias("b")).collect()
    out = [0] * (1 << (bits - 6))
    for r in words:
        out[r.w] = r.b
    return open_.sparkSession.createDataFrame([(out,)], "_bits array<bigint>", verifySchema=False)


def top_n_per_group(
    df: DataFrame,
    group: str,
    score: str,
    ties: Sequence[str],
    n: int,
    band_source: DataFrame | None = None,
    band_shares: Sequence[float] = BAND_SHARES,
    bucket_bits: int = BUCKET_BITS,
) -> DataFrame:
    """The ``n`` rows of each group with the highest score: (group, ties..., score, rank).

    The score range is cut into bands at approximate quantiles (of ``band_source``, by default of
    ``df``; where they fall affects speed only). Bands are processed from the top: all groups that are
    full already, or have no rows left, are anti-joined away, the rest is ranked exactly, and of a boundary band a group
    takes just what it still lacks. Most rows of such groups are dropped before the shuffle by a bitmap of fixed size, which never
    drops a row of an open group; the join behind the shuffle decides. Equal scores are always in one band, so ties are decided by
    ``ties`` ascending, NULLs last. Ranking limits each group to ``n`` rows inside each map task before the
    shuffle, for any ``n``, so a group with a third of all rows sends at most ``n`` rows per task.

    Rows with a NULL group or a missing (NULL, NaN) score take no part. Groups with fewer than ``n``
    rows come out whole. Rows that are equal in all of group, score and ties are each counted. An
    empty input gives an empty result; other columns are ignored; infinite scores are ordinary.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    s = clean(col(score).cast("double"))
    cuts_from = (band_source if band_source is not None else df).select(s.alias("s")).where("s is not null")
    cuts = sorted(set(cuts_from.approxQuantile("s", [1 - x for x in band_shares], 0.005)), reverse=True)
    band = F.lit(len(cuts))
    for k in range(len(cuts) - 1, -1, -1):
        band = F.when(F.col("_s") >= F.lit(cuts[k]), F.lit(k)).otherwise(band)
    names = [f"t{k}" for k in range(len(ties))]
    rows = (
        df.where(col(group).isNotNull())
        .select(col(group).alias("_g"), s.alias("_s"), *[col(t).alias(a) for t, a in zip(ties, names, strict=True)])
        .where("_s is not null")
        .withColumn("_band", band)
    )
    banded = scratch.write(rows, "banded", ["_band"])
    order = Window.partitionBy("_g").orderBy(F.desc("_s"), *[F.asc_nulls_last(a) for a in names])
    # What each group can still give and get: written again after each band, so a band reads the last table only.
    state: DataFrame | None = None
    done: DataFrame | None = None
    with _limits_up_to(spark, n):
        for k in range(len(cuts) + 1):
            rows = banded.where(F.col("_band") == k).drop("_band")
            if state is None:
                taken = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)
            else:
                bits = _open_buckets(state, bucket_bits)
                bucket = f"pmod(xxhash64(_g), {1 << bucket_bits})"
                rows = rows.join(F.broadcast(bits), F.expr(f"(shiftright(_bits[cast(shiftright({bucket}, 6) as int)], cast({bucket} % 64 as int)) & 1L) = 1L")).drop("_bits")
                ranked = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)
                # Ranked rows are partitioned by group already, so this join moves only the counts.
                taken = ranked.join(state.select("_g", "_have"), "_g").withColumn("_rank", F.col("_rank") + F.col("_have")).where(F.col("_rank") <= n).drop("_have")
            taken = scratch.write(taken, f"taken{k}")
            done = taken if done is None else done.unionByName(taken)
            if k == len(cuts):
                break
            if state is None:
                # Groups of lower bands that the first one doesn't hold are open as well.
                sizes = banded.groupBy("_g").agg(F.count(F.lit(1)).alias("_size"))
            have = taken.groupBy("_g").agg(F.max("_rank").alias("_now"))
            known = sizes.withColumn("_have", F.lit(0)) if state is None else state
            state = known.join(have, "_g", "left").select("_g", "_size", F.coalesce("_now", "_have").alias("_have"))
            state = scratch.write(state.where(F.col("_have") < F.least(F.col("_size"), F.lit(n))), f"open{k}")
    scratch.drop("banded", *[f"open{k}" for k in range(len(cuts))])
    return done.select(F.col("_g").alias(group), *[F.col(a).alias(t) for a, t in zip(names, ties, strict=True)], F.col("_s").alias(score), F.col("_rank").alias("rank"))
