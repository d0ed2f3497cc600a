"""Percentiles per group by exact bisection, and counts that combine over periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.common import HOT_SHARE, clean, col
from assaylake.session import Scratch

#: Sub-intervals per pass; 32 are five halvings at once.
WAYS = 32
#: Intervals are broadcast to the rows up to this many, counted before every pass (some 15 MB); beyond, only those of hot groups
#: are, and the others are joined by shuffle.
BROADCAST_INTERVALS = 100_000
#: A group is hot beyond this many rows and HOT_SHARE of all rows, so at most 1 / HOT_SHARE groups are.
HOT_ROWS = 1_000_000
#: Infinite values take part as the largest finite double.
LARGEST = 1.7976931348623157e308


def _finite(v: Column) -> Column:
    return F.greatest(F.least(v, F.lit(LARGEST)), F.lit(-LARGEST))


def group_percentiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    max_rank_error: float = 0.0,
    ways: int = WAYS,
    broadcast_groups: int = BROADCAST_INTERVALS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Percentiles of ``value`` per group: (groups..., n, p0, p1, ...) in the order of ``probabilities``.

    Every group keeps one value interval per order statistic that it needs (intervals that coincide
    are kept once). A pass splits each interval into ``ways`` equal parts, counts the rows of each
    part and keeps the part that holds the wanted rank, tightened to the values that occur in it, until
    it holds one value only. Counts add up over partitions and days, rows are never sorted or
    collected, and the passes needed grow with the logarithm of a group's distinct values.

    The result is exact with ``max_rank_error`` 0; else an interval is given up for its lower end
    once it holds at most that share of its group. Values between two order statistics are
    interpolated linearly. NULL and NaN are left out, a group without any value is not in the result, NULL
    is a group key like any other, infinite values are ordered normally (interpolation
    between a finite and an infinite one is infinite), equal values and repeated rows count each.
    An empty input gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    keys = [f"g{k}" for k in range(len(groups))]
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    inside = lambda r, s: r.alias("r").join(s.alias("s"), [*same, F.col("v").between(F.col("lo"), F.col("hi"))]).select(*[f"r.{k}" for k in keys], "lo", "hi", "v")
    rows = (
        df.select(*[col(g).alias(k) for g, k in zip(groups, keys, strict=True)], clean(col(value).cast("double")).alias("v"))
        .where("v is not null")
        .withColumn("v", _finite(F.col("v")))
    )
    # One shuffle brings a group's rows into few tasks, so that later counts combine before theirs; adaptive execution
    # splits a hot group, also one of equal values, by its size.
    rows = scratch.write(spark.sql(f"SELECT /*+ REBALANCE({', '.join(keys)}) */ * FROM {{rows}}", rows=rows), "rows")
    lows = [F.floor(F.col("n") * F.lit(0) + F.lit(p) * (F.col("n") - 1)).cast("long") for p in probabilities]
    ranks = F.array_sort(F.array_distinct(F.array(*[x for lo in lows for x in (lo, F.least(lo + 1, F.col("n") - 1))])))
    state = scratch.write(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("below", F.lit(0).cast("long")).withColumn("inside", F.col("n")).withColumn("ranks", ranks),
        "state0",
    )
    resolved = (F.col("lo") == F.col("hi")) | (F.col("inside") <= F.col("n") * F.lit(max_rank_error))
    total = F.lit(rows.count())
    is_hot = F.col("n") > F.greatest(F.lit(float(hot_rows)), total * HOT_SHARE)
    hot_groups = F.broadcast(state.where(is_hot).select(*[F.col(k).alias(f"h_{k}") for k in keys]))
    done, step = [state.where(resolved)], 0
    while True:
        open_ = state.where(~resolved)
        n_open = open_.count()
        if not n_open:
            break
        step += 1
        small = n_open <= broadcast_groups
        if small:
            hit = inside(rows, F.broadcast(open_))
        else:
            cold = rows.join(hot_groups, [F.col(k).eqNullSafe(F.col(f"h_{k}")) for k in keys], "left_anti")
            hit = inside(rows, F.broadcast(open_.where(is_hot))).unionByName(inside(cold, open_.where(~is_hot)))
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * ways), F.lit(ways - 1)).cast("int")
        # Counts, smallest and largest values only are summed up, which hashing can do; the rest of the state joins the sums.
        counted = hit.groupBy(*keys, "lo", part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("first"), F.max("v").alias("last")).alias("r")
        own = open_.select(*keys, F.col("lo").alias("own_lo"), "n", "below", "ranks").alias("s")
        counted = counted.join(F.broadcast(own) if small else own, [*same, F.col("lo") == F.col("own_lo")]).select(*[f"r.{k}" for k in keys], "lo", "part", "c", "first", "last", "n", "below", "ranks")
        before = Window.partitionBy(*keys, "lo").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        at = F.col("below") + F.coalesce(F.sum("c").over(before), F.lit(0))
        state = counted.withColumn("at", at).withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("at")) & (r < F.col("at") + F.col("c")))).where(F.size("ranks") > 0)
        state = scratch.write(state.select(*keys, "n", F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("at").alias("below"), F.col("c").alias("inside"), "ranks"), f"state{step}")
        done.append(state.where(resolved))
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    per = found.groupBy(*keys).agg(F.first("n").alias("n"), F.map_from_entries(F.flatten(F.collect_list(F.transform("ranks", lambda r: F.struct(r, F.col("lo")))))).alias("at"))
    outs = []
    for p, lo in zip(probabilities, lows, strict=True):
        a, b = F.col("at")[lo], F.col("at")[F.least(lo + 1, F.col("n") - 1)]
        real = lambda x: F.when(x >= LARGEST, F.lit(float("inf"))).when(x <= -LARGEST, F.lit(float("-inf"))).otherwise(x)
        share = F.lit(p) * (F.col("n") - 1) - lo
        outs.append(F.when((share == 0) | (a == b), real(a)).otherwise(real(a) + (real(b) - real(a)) * share).alias(f"p{len(outs)}"))
    scratch.drop("rows")
    return per.select(*[F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)], "n", *outs)


def period_counts(df: DataFrame, groups: Sequence[str], value: str, period: str, width: float) -> DataFrame:
    """Mergeable state: rows per group, period and grid cell (cell = floor(value / width)).

    States of any partitions, periods or loads are combined by ``unionAll`` alone, since their counts
    add. Missing values are left out; infinite ones and those beyond 9e18 cells count in the outermost cells, so
    that ranks stay right; an empty input gives an empty state.
    """
    v = clean(col(value).cast("double"))
    cell = F.floor(F.greatest(F.least(v / F.lit(width), F.lit(9e18)), F.lit(-9e18)))
    return df.where(v.isNotNull()).groupBy(*[col(g) for g in groups], col(period), cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def percentiles_from_counts(state: DataFrame, groups: Sequence[str], probabilities: Sequence[float], width: float) -> DataFrame:
    """Percentiles of a combined state, at most ``width`` / 2 from the exact lower order statistic.

    Only cells are ordered, never rows: a group has as many as its value range holds widths.
    """
    keys = [col(g) for g in groups]
    cells = state.groupBy(*keys, "cell").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    c = cells.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))
    outs = [F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("total") - 1)), (F.col("cell") + 0.5) * F.lit(width))).alias(f"p{k}") for k, p in enumerate(probabilities)]
    return c.groupBy(*keys).agg(F.first("total").alias("n"), *outs)
