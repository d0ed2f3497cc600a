"""Normalisation, drift correction and alignment of batches on the long table.

The long table has (feature, sample, batch, value) and boolean columns named in the arguments; NULL is
missing. Medians and quantiles are exact and interpolated linearly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median(c: str | Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def sample_median(df: DataFrame) -> DataFrame:
    """A3: every sample's median becomes the median of all sample medians."""
    m = df.groupBy("sample").agg(median("value").alias("m"))
    g = m.agg(median("m").alias("g"))
    return df.join(m, "sample").crossJoin(F.broadcast(g)).withColumn("value", F.col("value") * F.try_divide("g", "m")).drop("m", "g")


def qc_median(df: DataFrame, qc: str = "is_qc") -> DataFrame:
    """A4: divide by sample median / median of the control sample medians; unchanged without controls."""
    m = df.groupBy("sample").agg(median("value").alias("m"), F.max(qc).alias("qc"))
    g = m.agg(median(F.when(F.col("qc"), F.col("m"))).alias("g"))
    factor = F.coalesce(F.try_divide("m", "g"), F.lit(1.0))
    return df.join(m.select("sample", "m"), "sample").crossJoin(F.broadcast(g)).withColumn("value", F.when(factor > 0, F.col("value") / factor).otherwise(F.col("value"))).drop("m", "g")


def pqn(df: DataFrame, by: Sequence[str] = ("batch",), qc: str = "is_qc") -> DataFrame:
    """A5: divide each sample by the median quotient to the control medians; samples without a positive factor stay."""
    ref = df.where(F.col(qc)).groupBy(*by, "feature").agg(median("value").alias("ref"))
    q = df.join(ref.where("ref > 0"), [*by, "feature"]).where("value > 0").groupBy("sample").agg(median(F.col("value") / F.col("ref")).alias("factor"))
    return df.join(q, "sample", "left").withColumn("value", F.when(F.col("factor") > 0, F.col("value") / F.col("factor")).otherwise(F.col("value"))).drop("factor")


def bridge_factors(df: DataFrame, bridge: str = "is_bridge", max_factor: float = 5.0, offset: float = 1.0, minimum: float = 0.0) -> DataFrame:
    """(feature, batch, factor) from log medians of bridge samples, limited to [1 / max, max]."""
    use = df.where(F.col(bridge) & (F.col("value") > minimum))
    centers = use.groupBy("feature", "batch").agg(median(F.ln(F.col("value") + offset)).alias("center"))
    grand = centers.groupBy("feature").agg(median("center").alias("grand"))
    f = F.exp(F.col("grand") - F.col("center"))
    return centers.join(grand, "feature").select("feature", "batch", F.greatest(F.least(f, F.lit(max_factor)), F.lit(1.0 / max_factor)).alias("factor"))


def bridge_scale(df: DataFrame, **how: object) -> DataFrame:
    """A6 applied to all samples of a batch; cells without a factor stay."""
    return df.join(bridge_factors(df, **how), ["feature", "batch"], "left").withColumn("value", F.col("value") * F.coalesce("factor", F.lit(1.0))).drop("factor")


def half_min_all(df: DataFrame, zero_too: bool = True) -> DataFrame:
    """Q2: missing, infinite and zero cells become half of the smallest positive value of all (1e-10 if none)."""
    bad = F.col("value").isNull() | (F.abs("value") == float("inf")) | ((F.col("value") == 0) if zero_too else F.lit(False))
    m = df.agg((F.min(F.when((F.col("value") > 0) & (F.col("value") < float("inf")), F.col("value"))) / 2).alias("m"))
    return df.crossJoin(F.broadcast(m)).withColumn("value", F.when(bad, F.coalesce("m", F.lit(1e-10))).otherwise(F.col("value"))).drop("m")


def half_min_feature(df: DataFrame) -> DataFrame:
    """Q3: zeros become half of the feature's smallest positive value; NULL stays."""
    m = F.min(F.when(F.col("value") > 0, F.col("value"))).over(Window.partitionBy("feature"))
    return df.withColumn("value", F.when((F.col("value") == 0) & m.isNotNull(), m / 2).otherwise(F.col("value")))


def scale(df: DataFrame, method: str = "robust", fit: Column | None = None) -> DataFrame:
    """Q4: robust ((x - median) / IQR, IQR 0 counts as 1), standard (population sd, 0 counts as 1), or none, fitted on rows where ``fit`` holds."""
    if method == "none":
        return df
    v = F.when(fit, F.col("value")) if fit is not None else F.col("value")
    if method == "robust":
        s = df.groupBy("feature").agg(F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select("feature", F.col("q")[1].alias("mid"), (F.col("q")[2] - F.col("q")[0]).alias("spread"))
    elif method == "standard":
        s = df.groupBy("feature").agg(F.avg(v).alias("mid"), F.stddev_pop(v).alias("spread"))
    else:
        raise ValueError(f"unknown scaling: {method}")
    spread = F.when(F.col("spread") == 0, 1.0).otherwise(F.col("spread"))
    return df.join(s, "feature").withColumn("value", (F.col("value") - F.col("mid")) / spread).drop("mid", "spread")


def log_ratio(df: DataFrame, name: str, numerator: Sequence[str], denominator: Sequence[str], key: str = "sample", strict: bool = True) -> DataFrame:
    """Q18, Q19: rows (key, feature = name, value) with log10 of a ratio of sums of log10 features.

    Strict: a missing part makes the ratio missing, and a missing feature yields no rows at all. Otherwise parts that are
    missing are left out of the sums; a ratio of zero is missing and a zero denominator gives infinity.
    """
    parts = df.where(F.col("feature").isin(*numerator, *denominator))
    if strict:
        have = {r.feature for r in parts.select("feature").distinct().collect()}
        if not have.issuperset({*numerator, *denominator}):
            return df.sparkSession.createDataFrame([], f"{key} {dict(df.dtypes)[key]}, feature string, value double")
    raw = F.pow(F.lit(10.0), "value")
    side = lambda names: (F.sum(F.when(F.col("feature").isin(*names), raw)), F.count(F.when(F.col("feature").isin(*names), F.col("value"))))
    (a, na), (b, nb) = side(numerator), side(denominator)
    s = parts.groupBy(key).agg(a.alias("a"), na.alias("na"), b.alias("b"), nb.alias("nb"))
    if strict:
        value = F.when((F.col("na") == len(numerator)) & (F.col("nb") == len(denominator)), F.log10("a") - F.log10("b"))
    else:
        x, y = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
        value = F.when(x == 0, F.lit(None).cast("double")).when(y == 0, F.lit(float("inf"))).otherwise(F.log10(x / F.when(y != 0, y)))
    return s.select(key, F.lit(name).alias("feature"), value.alias("value"))


def derive_ratios(df: DataFrame, specs: Sequence[dict], key: str) -> tuple[DataFrame, DataFrame]:
    """Q18: (``df`` with one more feature for each ratio, audit of (name, numerator, denominator, status)).

    A spec has a name, and a feature or list of features as numerator and denominator; values are log10, lists are summed before
    the logarithm. Names are checked against the features of ``df`` only. The status is derived, incomplete_spec, name_collision or
    missing_parent with the absent features.
    """
    # The four words of the status.
    terms = lambda v: [] if v is None else [v] if isinstance(v, str) else list(v)
    asked = {t for s in specs for t in (s.get("name"), *terms(s.get("numerator")), *terms(s.get("denominator"))) if t}
    have = {r.feature for r in df.where(F.col("feature").isin(*asked)).select("feature").distinct().collect()} if asked else set()
    out, audit = df, []
    for s in specs:
        name, a, b = str(s.get("name") or "").strip(), terms(s.get("numerator")), terms(s.get("denominator"))
        absent = [t for t in (*a, *b) if t not in have]
        status = "incomplete_spec" if not (name and a and b) else "name_collision" if name in have else f"missing_parent: {','.join(absent)}" if absent else "derived"
        audit.append((name, "+".join(a), "+".join(b), status))
        if status == "derived":
            out = out.unionByName(log_ratio(df, name, a, b, key), allowMissingColumns=True)
    return out, df.sparkSession.createDataFrame(audit, "name string, numerator string, denominator string, status string")


def positions(df: DataFrame, order: str, tie: str, by: Sequence[str] = ("batch",)) -> DataFrame:
    """``position`` 0.. within a batch by injection order, missing ones last, ties by ``tie``; -1 sorts first as a number."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last(order), F.asc(tie))) - 1)


def interpolate(df: DataFrame, by: Sequence[str], x: str, y: str, out: str) -> DataFrame:
    """Fill ``y`` between the neighbouring rows that have it, linearly in ``x``; constant beyond the ends."""
    point = F.when(F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    up = Window.partitionBy(*by).orderBy(F.asc(x)).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_a", F.last(point, ignorenulls=True).over(up)).withColumn("_b", F.last(point, ignorenulls=True).over(down))
    a, b = F.col("_a"), F.col("_b")
    between = a["y"] + (b["y"] - a["y"]) * F.try_divide(F.col(x) - a["x"], b["x"] - a["x"])
    return d.withColumn(out, F.when(a.isNull(), b["y"]).when(b.isNull() | (a["x"] == b["x"]), a["y"]).otherwise(between)).drop("_a", "_b")


def nearest(df: DataFrame, by: Sequence[str], x: str, y: str, out: str) -> DataFrame:
    """Take ``y`` of the row that has it and is nearest in ``x``; of two equally near the earlier."""
    point = F.when(F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    up = Window.partitionBy(*by).orderBy(F.asc(x)).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_a", F.last(point, ignorenulls=True).over(up)).withColumn("_b", F.last(point, ignorenulls=True).over(down))
    first = F.col("_b").isNull() | (F.col(x) - F.col("_a.x") <= F.col("_b.x") - F.col(x))
    return d.withColumn(out, F.when(F.col("_a").isNotNull() & first, F.col("_a.y")).otherwise(F.col("_b.y"))).drop("_a", "_b")


#: Numbers of one block of weights: 32 MB. More controls are fitted block by block.
LOWESS_NUMBERS = 4_000_000


def lowess(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 3, numbers: int = LOWESS_NUMBERS) -> np.ndarray:
    """Cleveland's local linear regression at each x (sorted): tricube weights over the nearest points, then bisquare rounds."""
    n = len(x)
    k = min(n, max(2, int(share * n + 1e-10)))
    robust, fit = np.ones(n), np.asarray(y, dtype=float).copy()
    step = max(1, numbers // max(n, 1))
    blocks = [slice(i, min(i + step, n)) for i in range(0, n, step)]

    def weights(at: slice) -> np.ndarray:
        near = np.abs(x[at, None] - x[None, :])
        reach = np.partition(near, k - 1, axis=1)[:, k - 1]
        return np.where(near <= 0.001 * reach[:, None], 1.0, np.where(near < 0.999 * reach[:, None], (1 - (near / reach[:, None]) ** 3) ** 3, 0.0))

    with np.errstate(all="ignore"):
        only = weights(blocks[0]) if len(blocks) == 1 else None
        for _ in range(rounds + 1):
            new, total = np.empty(n), np.empty(n)
            for at in blocks:
                w = (weights(at) if only is None else only) * robust
                total[at] = w.sum(axis=1)
                mx, my = (w * x).sum(axis=1) / total[at], (w * y).sum(axis=1) / total[at]
                dx = x[None, :] - mx[:, None]
                sxx = (w * dx * dx).sum(axis=1)
                slope = np.where(np.sqrt(sxx / total[at]) > 0.001 * (x[-1] - x[0]), (w * dx * y).sum(axis=1) / sxx, 0.0)
                new[at] = my + slope * (x[at] - mx)
            fit = np.where(total > 0, new, y)
            rest = np.abs(y - fit)
            s = np.median(rest)
            if s == 0:
                break
            u = rest / (6 * s)
            robust = np.where(u < 0.999, (1 - u * u) ** 2, 0.0)
            robust[u < 0.001] = 1.0
    return fit


def drift_factors(df: DataFrame, share: float = 0.5, least_mean: float = 0.1, outlier_iqr: float = 3.0, qc: str = "is_qc") -> DataFrame:
    """Q1: (batch, feature, position, factor, cleaned) at the control samples with a value.

    Outlying controls become the median of the others; features that never show in the controls or
    have a low mean, and batches with fewer than two controls, get no factor. Only control rows reach Python.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        x, y = pdf["position"].to_numpy(dtype=float), pdf["value"].to_numpy(dtype=float)
        q1, q3 = np.percentile(y, [25, 75])
        out = (y < q1 - outlier_iqr * (q3 - q1)) | (y > q3 + outlier_iqr * (q3 - q1))
        if out.any() and not out.all():
            y = np.where(out, np.median(y[~out]), y)
        factor = np.full(len(y), np.nan)
        if len(y) >= 2 and (y > 0).any() and y.mean() > least_mean:
            smooth = lowess(x, y, share)
            with np.errstate(all="ignore"):
                factor = np.median(y) / smooth
        factor = np.where(np.isfinite(factor), factor, np.nan)
        return pd.DataFrame({"batch": pdf["batch"], "feature": pdf["feature"], "position": pdf["position"], "factor": factor, "cleaned": y})

    types = dict(df.dtypes)
    rows = df.where(F.col(qc) & F.col("value").isNotNull()).select("batch", "feature", "position", "value")
    out = rows.groupBy("batch", "feature").applyInPandas(fit, f"batch {types['batch']}, feature string, position {types['position']}, factor double, cleaned double")
    return out.withColumn("factor", F.when(~F.isnan("factor"), F.col("factor")))


def drift_correct(df: DataFrame, low: float = 0.5, high: float = 2.0, join: str = "interpolate", **how: object) -> DataFrame:
    """Q1: multiply by the factor interpolated between controls (or of the nearest control), limited to [low, high]; Q1c is ``drift_correct_shared``."""
    f = drift_factors(df, **how)
    d = df.join(f, ["batch", "feature", "position"], "left")
    d = (interpolate if join == "interpolate" else nearest)(d, ["batch", "feature"], "position", "factor", "use")
    # least and greatest skip NULLs, so a missing factor is told apart first.
    factor = F.when(F.col("use").isNotNull(), F.greatest(F.least(F.col("use"), F.lit(high)), F.lit(low))).otherwise(1.0)
    return d.withColumn("value", F.coalesce("cleaned", "value") * factor).drop("factor", "cleaned", "use")


def drift_correct_shared(df: DataFrame, share: float = 0.5, top: float = 0.1, qc: str = "is_qc") -> DataFrame:
    """Drift is fitted per batch on the features with a mean of the controls at or above its quantile 1 - ``top``.

    Their factor is mean / smooth (1 where the smooth isn't positive) at a control, and that of the nearest control elsewhere;
    the share is 1 below 10 controls and at least 0.5 below 20. All other features of the batch get, per position, the median
    factor of the whole table, in which they count as 1. Batches with fewer than two controls stay as they are. Controls
    without a value are left out of the fit.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        y, n = pdf["value"].to_numpy(dtype=float), len(pdf)
        smooth = lowess(pdf["position"].to_numpy(dtype=float), y, 1.0 if n < 10 else max(share, 0.5) if n < 20 else share)
        factor = np.divide(y.mean(), smooth, out=np.ones(n), where=smooth > 0)
        return pd.DataFrame({"batch": pdf["batch"], "feature": pdf["feature"], "position": pdf["position"], "factor": factor})

    types, cell = dict(df.dtypes), ["batch", "feature", "position"]
    controls = df.where(F.col(qc))
    enough = controls.groupBy("batch").agg(F.count_distinct("position").alias("n")).where("n >= 2")
    mean = controls.groupBy("batch", "feature").agg(F.avg("value").alias("m")).where("m is not null").join(enough.select("batch"), "batch", "left_semi")
    cut = mean.groupBy("batch").agg(F.percentile("m", F.lit(1 - top)).alias("cut"))
    fitted = mean.join(cut, "batch").where("m >= cut").select("batch", "feature")
    rows = controls.where("value is not null").select(*cell, "value").join(fitted, ["batch", "feature"], "left_semi")
    at_controls = rows.groupBy("batch", "feature").applyInPandas(fit, f"batch {types['batch']}, feature string, position {types['position']}, factor double")
    places = df.select("batch", "position").distinct()
    dense = nearest(fitted.join(places, "batch").join(at_controls, cell, "left"), ["batch", "feature"], "position", "factor", "use").select(*cell, "use")
    counts = df.groupBy("batch").agg(F.count_distinct("feature").alias("every")).join(fitted.groupBy("batch").agg(F.count(F.lit(1)).alias("n")), "batch")
    rest = places.join(counts.where("every > n"), "batch").select("batch", "position", F.lit(1.0).alias("use"), (F.col("every") - F.col("n")).alias("times"))
    shared = dense.select("batch", "position", "use", F.lit(1).cast("long").alias("times")).unionByName(rest).groupBy("batch", "position").agg(F.percentile("use", F.lit(0.5), F.col("times")).alias("shared"))
    out = df.join(dense, cell, "left").join(shared, ["batch", "position"], "left")
    return out.withColumn("value", F.col("value") * F.coalesce("use", "shared", F.lit(1.0))).select(df.columns)


def combat(df: DataFrame, gamma: float = 1.0, floor_at_zero: bool = True, tolerance: float = 1e-4) -> DataFrame:
    """Q22: empirical Bayes adjustment of batch location and scale (Johnson, Li and Rabinovic 2007).

    Features without variation stay as they are. Everything but the final adjustment runs on one row per
    feature and batch: counts, sums and sums of squares carry all that the iteration needs. ``gamma`` blends
    the result with the input.
    """
    v = F.col("value")
    cell = df.where(v.isNotNull()).groupBy("feature", "batch").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"))
    whole = cell.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), (F.sum(F.col("n") * F.col("var")) / F.sum("n")).alias("pooled"))
    z = cell.join(whole.where("pooled > 0"), "feature").withColumn("sd", F.sqrt("pooled"))
    z = z.withColumn("g", (F.col("mean") - F.col("grand")) / F.col("sd")).withColumn("d", F.when(F.col("n") > 1, F.col("var") / F.col("pooled") * F.col("n") / (F.col("n") - 1)))
    prior = z.groupBy("batch").agg(F.avg("g").alias("gbar"), F.var_samp("g").alias("t2"), F.avg("d").alias("m"), F.var_samp("d").alias("s2"))
    z = z.join(prior, "batch").select("feature", "batch", "grand", "sd", "n", "g", "d", "gbar", "t2", "m", "s2")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            n, g0, d0 = (p[c].to_numpy(dtype=float) for c in ("n", "g", "d"))
            gbar, t2, m, s2 = (p[c].to_numpy(dtype=float) for c in ("gbar", "t2", "m", "s2"))
            with np.errstate(all="ignore"):
                a, b = (2 * s2 + m * m) / s2, (m * s2 + m**3) / s2
                ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(t2) & np.isfinite(d0)
                squares = d0 * (n - 1)
                # A feature rests once it has converged, so no other row of its Arrow batch changes its result.
                g, d, live = g0.copy(), d0.copy(), np.ones(len(g0), dtype=bool)
                for _ in range(1000):
                    g1 = np.where(ok, (t2 * n * g0 + d * gbar) / (t2 * n + d), g0)
                    d1 = np.where(ok, (0.5 * (squares + n * (g0 - g1) ** 2) + b) / (n / 2 + a - 1), d0)
                    moves = live & ((np.abs(g1 - g) / np.abs(g) > tolerance) | (np.abs(d1 - d) / d > tolerance))
                    g, d = np.where(live, g1, g), np.where(live, d1, d)
                    live = moves
                    if not live.any():
                        break
            yield pd.DataFrame({"feature": p["feature"], "batch": p["batch"], "grand": p["grand"], "sd": p["sd"], "shift": g, "spread": np.where(np.isfinite(d) & (d > 0), d, 1.0)})

    star = z.mapInPandas(solve, f"feature string, batch {dict(df.dtypes)['batch']}, grand double, sd double, shift double, spread double")
    new = ((F.col("value") - F.col("grand")) / F.col("sd") - F.col("shift")) / F.sqrt("spread") * F.col("sd") + F.col("grand")
    new = F.col("value") + F.lit(gamma) * (new - F.col("value"))
    if floor_at_zero:
        new = F.when(F.col("value").isNotNull(), F.greatest(new, F.lit(0.0)))
    return df.join(star, ["feature", "batch"], "left").withColumn("value", F.when(F.col("sd").isNotNull(), new).otherwise(F.col("value"))).drop("grand", "sd", "shift", "spread")
