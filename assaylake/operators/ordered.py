"""Running totals over a global order, without bringing all rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.common import hot_keys
from assaylake.session import Scratch

#: Ranges of the ordering value; their totals are all that is ordered globally.
RANGES = 256


def running_totals(df: DataFrame, x: str, weights: Sequence[str], descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """One row per distinct ``x`` with, for each weight w, its sum ``w`` and ``w_before``, the sum over smaller (descending: larger) x.

    Values are first summed per distinct x, then ordered inside ranges cut at approximate quantiles; the offset of a range
    comes from a table with one row per range. Where the cuts fall changes nothing in the result. NULL x is left out.
    """
    # Three passes read the sums, so they are written once.
    per = Scratch(df.sparkSession).write(df.where(F.col(x).isNotNull()).groupBy(x).agg(*[F.sum(w).alias(w) for w in weights]), "sums")
    cuts = sorted(set(per.select(F.col(x).cast("double").alias("x")).approxQuantile("x", [i / ranges for i in range(1, ranges)], 1 / (2 * ranges))))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    per = per.withColumn("_r", F.size(F.filter(bounds, lambda c: c < F.col(x).cast("double"))))
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    totals = per.groupBy("_r").agg(*[F.sum(w).alias(f"_t{i}") for i, w in enumerate(weights)])
    before = Window.orderBy(order("_r")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_r", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(weights))])
    inside = Window.partitionBy("_r").orderBy(order(x)).rowsBetween(Window.unboundedPreceding, -1)
    out = per.select("*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"_i{i}") for i, w in enumerate(weights)]).join(F.broadcast(offsets), "_r")
    return out.select(x, *weights, *[(F.col(f"_i{i}") + F.col(f"_o{i}")).alias(f"{w}_before") for i, w in enumerate(weights)])


def empirical_p(df: DataFrame, x: str, is_null: str, out: str = "p_value") -> DataFrame:
    """Q5: add the share of null rows whose x is at least as large; NULL x or an empty null distribution give NULL."""
    n = df.withColumn("_n", F.coalesce(F.col(is_null) & F.col(x).isNotNull(), F.lit(False)).cast("long"))
    n = Scratch(df.sparkSession).write(n, "null")
    at = running_totals(n, x, ["_n"], descending=True).select(F.col(x).alias("_x"), (F.col("_n") + F.col("_n_before")).alias("_ge"))
    total = n.agg(F.sum("_n").alias("_total"))
    j = n.drop("_n").join(at, F.col(x) == F.col("_x"), "left").crossJoin(F.broadcast(total))
    return j.withColumn(out, F.try_divide(F.col("_ge"), F.col("_total"))).drop("_x", "_ge", "_total")


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Q13: Mann-Whitney AUC of positives over negatives, ties count half; one row, NULL if a class is empty."""
    n = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).select(F.col(score), F.col(positive).cast("long").alias("p"), (1 - F.col(positive).cast("long")).alias("n"))
    r = running_totals(n, score, ["p", "n"])
    return r.agg(F.try_divide(F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def precision_recall(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Precision and recall when everything from a score upwards is flagged, per distinct score."""
    n = df.where(F.col(score).isNotNull()).select(F.col(score), F.col(positive).cast("long").alias("p"), F.lit(1).cast("long").alias("c"))
    r = running_totals(n, score, ["p", "c"], descending=True)
    total = n.agg(F.sum("p").alias("all"))
    tp, flagged = F.col("p") + F.col("p_before"), F.col("c") + F.col("c_before")
    return r.crossJoin(F.broadcast(total)).select(score, F.col("p").alias("hits"), (tp / flagged).alias("precision"), F.try_divide(tp, F.col("all")).alias("recall"), "all")


def average_precision(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Sum of precision times the step in recall."""
    return precision_recall(df, score, positive).agg(F.sum(F.col("precision") * F.try_divide("hits", "all")).alias("average_precision"))


def numbered(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column], out: str, total: str | None = None) -> DataFrame:
    """Add the row number (from 1) of each row in ``order`` within ``by``, and with ``total`` the number of rows.

    ``bucket`` must rise with the order, such as a digit of a digest or a range of a value; rows are ordered inside (by, bucket) only, and the
    offsets come from a table of one row per bucket. NULL is a group like any other; without groups ``by`` is empty.
    """
    d = df.withColumn("_b", bucket)
    counts = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(by)], F.col("_b").alias("_ob"), before.alias("_before"), F.sum("_c").over(whole).alias("_total"))
    inside = d.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)))
    j = inside.join(offsets, [*[F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(by)], F.col("_b").eqNullSafe(F.col("_ob"))])
    j = j.withColumn(out, (F.col("_place") + F.col("_before")).cast("long"))
    if total is not None:
        j = j.withColumn(total, F.col("_total"))
    return j.drop("_b", "_ob", "_before", "_total", "_place", *[f"_o{i}" for i in range(len(by))])


def ranges_of(df: DataFrame, x: str, ranges: int = RANGES) -> Column:
    """A range number that rises with the number in column ``x``, cut at approximate quantiles; NULL is in the last range."""
    cuts = sorted(set(df.select(F.col(x).cast("double").alias("x")).where("x is not null").approxQuantile("x", [i / ranges for i in range(1, ranges)], 1 / (2 * ranges))))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    return F.when(F.col(x).isNotNull(), F.size(F.filter(bounds, lambda c: c < F.col(x).cast("double")))).otherwise(F.lit(len(cuts) + 1))


def percentiles(df: DataFrame, x: str, probabilities: Sequence[float], names: Sequence[str]) -> DataFrame:
    """One row with exact percentiles of the whole column, interpolated linearly; NULL is left out, no value at all gives NULLs.

    The rows at the ranks are found by running totals, so no task holds all distinct values.
    """
    r = running_totals(df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x"), F.lit(1).cast("long").alias("c")), "x", ["c"])
    j = r.crossJoin(F.broadcast(r.agg(F.sum("c").alias("n"))))
    found = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("n") - 1)
        for side, rank in (("a", F.floor(at)), ("b", F.ceil(at))):
            found.append(F.max(F.when((F.col("c_before") <= rank) & (rank < F.col("c_before") + F.col("c")), F.col("x"))).alias(f"{side}{i}"))
    one = j.agg(F.max("n").alias("n"), *found)
    share = [F.lit(float(p)) * (F.col("n") - 1) - F.floor(F.lit(float(p)) * (F.col("n") - 1)) for p in probabilities]
    return one.select(*[F.when(F.col(f"a{i}") == F.col(f"b{i}"), F.col(f"a{i}")).otherwise(F.col(f"a{i}") * (1 - s) + F.col(f"b{i}") * s).alias(n) for i, (s, n) in enumerate(zip(share, names, strict=True))])


#: A group's distinct values are gathered in one task up to this many rows, or 1 / 1000 of all rows; a larger group is cut into ranges.
GATHERED_ROWS = 5_000_000


def group_percentiles(df: DataFrame, keys: Sequence[str], value: Column, probabilities: Sequence[float], names: Sequence[str], hot_rows: int = GATHERED_ROWS) -> DataFrame:
    """(keys..., names...): exact percentiles per group, interpolated linearly; a group without values has NULLs, NULL is a group.

    ``df`` is read several times, so it is best a written table. Of a hot group only the ranges that hold a wanted rank are ordered,
    and equal values are counted before, so no task holds the group.
    """
    spark = df.sparkSession
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], value.cast("double").alias("v"))
    own = [f"k{i}" for i in range(len(keys))]
    back = [F.col(o).alias(k) for o, k in zip(own, keys, strict=True)]
    plain = lambda d: d.groupBy(*own).agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in probabilities])).alias("q")).select(*back, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
    # A table of no more rows has no such group.
    if rows.count() <= hot_rows:
        return plain(rows)
    hot = Scratch(spark).write(hot_keys(rows.where("v is not null"), own, hot_rows).select(*own), "hot")
    if hot.isEmpty():
        return plain(rows)
    same = [F.col(o).eqNullSafe(F.col(f"h{o}")) for o in own]
    named = hot.select(*[F.col(o).alias(f"h{o}") for o in own])
    cold = rows.join(F.broadcast(named), same, "left_anti")
    large = rows.where("v is not null").join(F.broadcast(named), same, "left_semi")
    bounds = large.groupBy(*own).agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 4 * RANGES).alias("bounds")).select(*[F.col(o).alias(f"h{o}") for o in own], "bounds")
    ranged = large.join(F.broadcast(bounds), same).select(*own, F.size(F.filter("bounds", lambda b: b < F.col("v"))).alias("r"), "v")
    per = Scratch(spark).write(ranged.groupBy(*own, "r", "v").agg(F.count(F.lit(1)).alias("c")), "counts")
    group = Window.partitionBy(*own)
    sums = per.groupBy(*own, "r").agg(F.sum("c").alias("all")).withColumn("n", F.sum("all").over(group)).withColumn("before", F.coalesce(F.sum("all").over(group.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in probabilities]
    ranks = F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))
    # At most two ranges for each percentile of each hot group.
    wanted = sums.withColumn("ranks", F.filter(ranks, lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("all")))).where(F.size("ranks") > 0)
    wanted = wanted.select(*[F.col(o).alias(f"h{o}") for o in own], F.col("r").alias("hr"), "before", "n", "ranks")
    found = per.join(F.broadcast(wanted), [*same, F.col("r") == F.col("hr")])
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*own, "r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("upto", upto).withColumn("k", F.explode("ranks")).where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("c")))
    one = found.groupBy(*own).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("at"))
    outs = []
    for a, n in zip(at, names, strict=True):
        low, high = F.col("at")[F.floor(a).cast("long")], F.col("at")[F.ceil(a).cast("long")]
        share = a - F.floor(a)
        outs.append(F.when(low == high, low).otherwise(low * (1 - share) + high * share).alias(n))
    return plain(cold).unionByName(one.select(*back, *outs))
