"""Filling missing values by predictive mean matching."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.common import clean, col, hot_keys, join_frequent
from assaylake.session import Scratch

#: Rows of one group that one window partition holds on average; a larger group that also holds HOT_SHARE of all rows is cut
#: at quantiles into ranges, and donors at the range borders are handed over to the next range.
RANGE_ROWS = 100_000
#: Ranges of one group at most; a group beyond RANGE_ROWS times as many rows has longer ranges.
MOST_RANGES = 512
#: Predictions whose distances differ by less than this share are equally near, as far as rounding can tell.
ROUNDING = 1e-6


#: A group's means are sent to its rows by broadcast beyond this many rows and HOT_SHARE of all rows.
HOT_GROUP = 100_000


def with_prediction(df: DataFrame, group: Sequence[str], target: str, predictors: Sequence[str], out: str = "prediction", fit_by: str | None = None) -> DataFrame:
    """Add a column with the group-aware linear prediction of ``target``.

    The model is target = group mean + slopes * (predictors - group means), fitted by least squares
    on the rows with an observed target: slopes are shared, intercepts belong to the group. Moments are
    summed per group and only their total, a matrix as wide as the predictors, reaches the driver. ``fit_by`` names one of the group columns with
    few values, such as the field: each value gets a fit of its own, in the same pass.

    Missing (NULL, NaN) predictors count as their group mean; a group without any observed target is
    predicted from the mean of all groups; if no target is observed at all, the prediction is NULL; a NULL
    group is a group; collinear predictors share their effect; columns named like the helpers are kept.
    """
    k = len(predictors)
    keys = [f"__g{j}" for j in range(len(group))]
    y = clean(col(target).cast("double"))
    xs = [clean(col(p).cast("double")) for p in predictors]
    wide = df.select("*", *[col(g).alias(a) for g, a in zip(group, keys, strict=True)])
    means = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("__y"), *[F.coalesce(F.avg(F.when(y.isNotNull(), x)), F.avg(x)).alias(f"__x{j}") for j, x in enumerate(xs)])
    both = join_frequent(wide, means, keys, HOT_GROUP)
    dx = [F.coalesce(x - F.col(f"__x{j}"), F.lit(0.0)) for j, x in enumerate(xs)]
    dy = y - F.col("__y")
    sums = [F.sum(F.when(dy.isNotNull(), dx[i] * dx[j])).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(dx[i] * dy).alias(f"b{i}") for i in range(k)] + [F.avg(y).alias("mean")]
    fits = both.groupBy(*([col(fit_by).alias("fit")] if fit_by is not None else [F.lit(None).cast("string").alias("fit")])).agg(*sums).collect()
    pred = F.lit(None).cast("double")
    for m in fits:
        a = np.array([[m[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]).reshape(k, k)
        b = np.array([m[f"b{i}"] or 0.0 for i in range(k)])
        slopes = np.linalg.lstsq(a, b, rcond=None)[0] if k else b
        p = F.coalesce(F.col("__y"), F.lit(m["mean"]).cast("double"))
        for s, d in zip(slopes, dx, strict=True):
            p = p + F.lit(float(s)) * d
        pred = p if fit_by is None else F.when(col(fit_by).eqNullSafe(F.lit(m["fit"])), p).otherwise(pred)
    return both.withColumn(out, pred).drop("__y", *keys, *[f"__x{j}" for j in range(k)])


def nearest_donors(df: DataFrame, row_id: str, group: Sequence[str], value: str, prediction: str, range_rows: int = RANGE_ROWS, along: str | None = None) -> DataFrame:
    """For each row without a ``value`` the row of its group with the nearest ``prediction``.

    Result: (row id, group..., filled, donor_id, distance). ``value`` must be NULL where it is missing or
    invalid. Of two equally near donors the one with the lower prediction is taken; of donors with the
    same prediction the one with the smallest id. Rows with a NULL prediction neither give nor
    get; a group column that is NULL excludes the row; groups without any donor give no result;
    an empty input gives an empty result; ids are taken as unique, further columns are ignored.

    ``along`` names a column in which the predictions of a group rise or fall evenly, such as the only predictor of their fit.
    Rows are then sorted by it, and it decides, the lower one first, where predictions are equally near or equal up to
    rounding, as they all are if the fit has no slope; ``distance`` is the one along it.

    The search is a merge: donors and recipients are sorted inside (group, range), and the
    last donor before and the first one behind are carried along. Ranges cut large groups at quantiles, and the nearest
    donors outside a range come from a small table of one row per range.
    """
    keys = [f"g{j}" for j in range(len(group))]
    order = along if along is not None else prediction
    base = df.select(col(row_id).alias("id"), *[col(g).alias(k) for g, k in zip(group, keys, strict=True)], col(value).alias("v"), col(order).alias("p"), col(prediction).cast("double").alias("q"))
    base = base.where(F.col("p").isNotNull() & ~F.isnan(F.col("p").cast("double")) & F.col("q").isNotNull() & ~F.isnan("q"))
    for k in keys:
        base = base.where(F.col(k).isNotNull())
    # Everything below reads these rows, and the fit behind them is made once.
    scratch = Scratch(df.sparkSession)
    base = scratch.write(base, "base")
    # A table of no more rows has no group to cut.
    hot = scratch.write(hot_keys(base, keys, range_rows), "hot") if base.count() > range_rows else None
    donors = base.where("v is not null").groupBy(*keys, "p").agg(F.min(F.struct("id", "v", "q")).alias("d"))
    donors = donors.select(*keys, "p", F.col("d.q").alias("q"), F.struct(F.col("p"), F.col("d.id").alias("id"), F.col("d.v").alias("v"), F.col("d.q").alias("q")).alias("d"))
    wanted = base.where("v is null").select("id", *keys, "p", "q")
    give = donors.select(*keys, F.lit(None).cast(dict(wanted.dtypes)["id"]).alias("id"), "p", "q", "d")
    take = wanted.select(*keys, "id", "p", "q", F.lit(None).cast(donors.schema["d"].dataType).alias("d"))
    ready = lambda events: events.withColumn("split", F.lit(False)).withColumn("bucket", F.lit(0))
    events, spans = ready(give.unionByName(take)), None
    if hot is not None and not hot.isEmpty():
        # Recipients of hot groups without any donor drop out before anything is shuffled; the others are cut at quantiles.
        has = base.where("v is not null").join(F.broadcast(hot.select(*keys)), keys, "left_semi").select(*keys).distinct()
        idle = F.broadcast(hot.select(*keys).join(has, keys, "left_anti"))
        cuts = [(i + 1) / MOST_RANGES for i in range(MOST_RANGES - 1)]
        bounds = base.join(F.broadcast(hot.select(*keys)), keys, "left_semi").groupBy(*keys).agg(F.percentile_approx("p", cuts, 4 * MOST_RANGES).alias("all"))
        ranges = F.least(F.col("salts"), F.lit(MOST_RANGES))
        places = F.transform(F.sequence(F.lit(1), ranges - 1), lambda i: F.col("all")[F.floor(i * MOST_RANGES / ranges).cast("int") - 1])
        bounds = bounds.join(hot.select(*keys, "salts"), keys).select(*keys, F.when(ranges > 1, F.array_distinct(places)).otherwise(F.filter("all", lambda b: F.lit(False))).alias("bounds"))
        bounds = F.broadcast(scratch.write(bounds, "bounds"))
        events = give.unionByName(take.join(idle, keys, "left_anti")).join(bounds, keys, "left")
        events = events.select(*keys, "id", "p", "q", "d", F.col("bounds").isNotNull().alias("split"), F.coalesce(F.size(F.filter("bounds", lambda b: b < F.col("p"))), F.lit(0)).alias("bucket"))
        edges = events.where("split and d is not null").groupBy(*keys, "bucket").agg(F.min("d").alias("first"), F.max("d").alias("last"))
        # One row per range, also of ranges without donors: recipients of those look further.
        spans = bounds.select(*keys, F.explode(F.sequence(F.lit(0), F.size("bounds"))).alias("bucket")).join(edges, [*keys, "bucket"], "left")
        by = Window.partitionBy(*keys)
        spans = spans.withColumn("carry_before", F.last("last", ignorenulls=True).over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        spans = spans.withColumn("carry_behind", F.last("first", ignorenulls=True).over(by.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)))
    # Donors come before recipients with the same order in either direction of the merge.
    up = Window.partitionBy(*keys, "bucket").orderBy(F.asc("p"), F.asc_nulls_first("id")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "bucket").orderBy(F.desc("p"), F.asc_nulls_first("id")).rowsBetween(Window.unboundedPreceding, 0)
    inside = events.withColumn("before", F.last("d", ignorenulls=True).over(up)).withColumn("behind", F.last("d", ignorenulls=True).over(down)).where("id is not null")
    if spans is None:
        all_ = inside.withColumn("carry_before", F.lit(None).cast(inside.schema["d"].dataType)).withColumn("carry_behind", F.lit(None).cast(inside.schema["d"].dataType))
    else:
        # At most MOST_RANGES rows for each of 1 / HOT_SHARE groups.
        all_ = inside.join(F.broadcast(spans.select(*keys, "bucket", "carry_before", "carry_behind")), [*keys, "bucket"], "left")
    all_ = all_.withColumn("a", F.coalesce("before", "carry_before")).withColumn("b", F.coalesce("behind", "carry_behind"))
    gap_a, gap_b = F.abs(F.col("q") - F.col("a.q")), F.abs(F.col("b.q") - F.col("q"))
    step_a, step_b = F.col("p") - F.col("a.p"), F.col("b.p") - F.col("p")
    nearer = gap_a <= gap_b
    if along is not None:
        alike = F.abs(gap_a - gap_b) <= F.greatest(gap_a, gap_b) * ROUNDING + F.greatest(F.abs("q"), F.lit(1.0)) * 1e-9
        nearer = F.when(alike, step_a <= step_b).otherwise(nearer)
    all_ = all_.withColumn("best", F.when(F.col("b").isNull() | nearer, F.col("a")).otherwise(F.col("b"))).where("best is not null")
    return all_.select(F.col("id").alias(row_id), *[F.col(k).alias(g) for g, k in zip(group, keys, strict=True)], F.col("best.v").alias("filled"), F.col("best.id").alias("donor_id"), F.abs(F.col("p") - F.col("best.p")).alias("distance"))


def fill_from_donors(df: DataFrame, row_id: str, group: Sequence[str], value: str, prediction: str, range_rows: int = RANGE_ROWS, along: str | None = None) -> DataFrame:
    """``df`` with ``value`` filled where a donor exists, and columns ``<value>_filled`` (boolean) and ``<value>_donor``."""
    found = nearest_donors(df, row_id, group, value, prediction, range_rows, along).select(col(row_id).alias("__id"), F.col("filled").alias("__v"), F.col("donor_id").alias(f"{value}_donor"))
    out = df.join(found, col(row_id) == F.col("__id"), "left")
    return out.withColumn(f"{value}_filled", F.col("__id").isNotNull() & F.col("__v").isNotNull()).withColumn(value, F.coalesce(col(value), F.col("__v"))).drop("__id", "__v")
