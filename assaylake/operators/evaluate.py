"""Evaluation of decisions, guardrails and resampled results."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators.draws import mix, poisson
from assaylake.operators.ordered import percentiles, running_totals


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by Lentz's evaluation of its continued fraction; the terms needed grow with the root of a and b."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    value = 1.0
    for i in range(1_000_000):
        m = i // 2
        term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = (1 + term / c) or tiny
        value *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (value - 1)


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Q12: exact binomial confidence limits: quantiles of the beta distribution, by halving."""
    if n <= 0:
        return math.nan, math.nan

    def solve(target: float, least: int) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(100):
            mid = (lo + hi) / 2
            # The chance of at least that many successes is a value of the incomplete beta function.
            lo, hi = (mid, hi) if beta_share(mid, least, n - least + 1) < target else (lo, mid)
        return (lo + hi) / 2

    a = (1 - level) / 2
    return (0.0 if k == 0 else solve(a, k)), (1.0 if k == n else solve(1 - a, k + 1))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row tp, fp, fn, tn; rows whose class is NULL are left out."""
    a, p = F.col(actual), F.coalesce(F.col(predicted), F.lit(False))
    return df.where(a.isNotNull()).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))


def breakdown(df: DataFrame, keys: Sequence[str], flagged: str) -> DataFrame:
    """Counts and flag rate per combination of labels, missing labels being groups of their own."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(flagged).alias("flagged"), (F.count_if(flagged) / F.count(F.lit(1))).alias("rate"))


def realistic(df: DataFrame, score: str, reference: Column, outlier: Column, inlier: Column, share: float, prevalence: float) -> DataFrame:
    """threshold = percentile of the reference scores, flag scores at or below it, and metrics at an assumed prevalence."""
    t = percentiles(df.where(reference), score, [share], ["threshold"])
    hit = F.col(score) <= F.col("threshold")
    r = df.crossJoin(F.broadcast(t)).agg(F.first("threshold").alias("threshold"), F.try_divide(F.count_if(outlier & hit), F.count_if(outlier)).alias("recall"), F.try_divide(F.count_if(inlier & hit), F.count_if(inlier)).alias("fpr"))
    tp, fp = F.lit(prevalence) * F.col("recall"), F.lit(1 - prevalence) * F.col("fpr")
    r = r.withColumn("precision", F.try_divide(tp, tp + fp))
    return r.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("accuracy", tp + F.lit(1 - prevalence) * (1 - F.col("fpr")))


def lowest_flags(df: DataFrame, score: str, share: float) -> DataFrame:
    """Flag the round(share * n) lowest scores, ties with the last one included; the cut is a percentile by rank, found by aggregation."""
    n = F.col("c_before") + F.col("c")
    r = running_totals(df.where(F.col(score).isNotNull()).select(score, F.lit(1).cast("long").alias("c")), score, ["c"])
    k = F.bround(F.lit(float(share)) * F.col("n"), 0)
    # The score at the last rank to be flagged; NULL, and nothing flagged, if that rank is 0.
    cut = r.crossJoin(F.broadcast(r.agg(F.sum("c").alias("n")))).where((F.col("c_before") < k) & (k <= n)).agg(F.max(score).alias("cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("flagged", F.coalesce(F.col(score) <= F.col("cut"), F.lit(False))).drop("cut")


def guardrail(df: DataFrame, markers: DataFrame, reference: str, limit: float) -> DataFrame:
    """(sample, n_hits) of samples with a marker beyond ``limit`` standard deviations of the reference; names are compared trimmed and without case."""
    m = markers.select(F.lower(F.trim("marker")).alias("m")).distinct()
    rows = df.withColumn("m", F.lower(F.trim("feature"))).join(m, "m", "left_semi")
    s = rows.groupBy("m").agg(F.avg(F.when(F.col(reference), F.col("value"))).alias("mu"), F.stddev_pop(F.when(F.col(reference), F.col("value"))).alias("sd")).where("sd >= 1e-10")
    hit = rows.join(s, "m").where(F.abs(F.col("value") - F.col("mu")) / (F.col("sd") + 1e-10) > limit)
    return hit.groupBy("sample").agg(F.count_distinct("m").alias("n_hits"))


def combine(model: DataFrame, rail: DataFrame, key: str) -> DataFrame:
    """Add guardrail and combined (model or guardrail) flags; keys are compared as text."""
    r = rail.select(F.col(key).cast("string").alias("_k")).distinct().withColumn("_g", F.lit(True))
    out = model.join(r, F.col(key).cast("string") == F.col("_k"), "left").withColumn("guardrail", F.coalesce("_g", F.lit(False)))
    return out.withColumn("combined", F.coalesce("flagged", F.lit(False)) | F.col("guardrail")).drop("_k", "_g")


def deviations(df: DataFrame, top: int = 10) -> DataFrame:
    """Per sample the ``top`` features with the largest |z| against all samples: (sample, feature, z, rank)."""
    s = df.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    z = df.join(s.where("sd > 0"), "feature").where("value is not null").select("sample", "feature", ((F.col("value") - F.col("mu")) / F.col("sd")).alias("z"))
    return z.withColumn("rank", F.row_number().over(Window.partitionBy("sample").orderBy(F.desc(F.round(F.abs("z"), 9)), "feature"))).where(F.col("rank") <= top)


def folds_summary(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, sd (sample and population), min, max of metrics as rows (by..., metric, ...)."""
    long = df.unpivot(list(by), list(metrics), "metric", "x")
    return long.groupBy(*by, "metric").agg(F.avg("x").alias("mean"), F.percentile("x", F.lit(0.5)).alias("median"), F.stddev_samp("x").alias("sd"), F.stddev_pop("x").alias("sd0"), F.min("x").alias("least"), F.max("x").alias("most"))


def stability(df: DataFrame, key: str, flagged: str, value: str, name: str) -> DataFrame:
    """Per key over repeated runs: runs, times flagged, share, mean value and the most frequent non-blank name (first by name on ties)."""
    n = df.where(F.trim(F.coalesce(F.col(name), F.lit(""))) != "").groupBy(key, name).agg(F.count(F.lit(1)).alias("c"))
    top = n.groupBy(key).agg(F.max_by(name, F.struct("c", F.lit(0))).alias("_any"), F.max("c").alias("c"))
    mode = n.join(top.select(key, F.col("c").alias("_c")), key).where("c = _c").groupBy(key).agg(F.min(name).alias("mode_name"))
    s = df.groupBy(key).agg(F.count(F.lit(1)).alias("runs"), F.count_if(flagged).alias("times"), (F.count_if(flagged) / F.count(F.lit(1))).alias("share"), F.avg(value).alias("mean_value"))
    return s.join(mode, key, "left")


def spikes(df: DataFrame, frequent: float = 0.5, narrow: float = 0.08) -> DataFrame:
    """Features one value of which holds at least ``frequent`` of the rows while the IQR is at most ``narrow``; the smallest such value."""
    c = df.where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    top = c.groupBy("feature").agg(F.max(F.struct("c", (-F.col("value")).alias("minus"))).alias("t"), F.sum("c").alias("n"))
    q = df.groupBy("feature").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    out = top.join(q, "feature").select("feature", (-F.col("t.minus")).alias("spike"), (F.col("t.c") / F.col("n")).alias("share"), (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    return out.where((F.col("share") >= frequent) & (F.col("iqr") <= narrow))


def diverging(stats: DataFrame, ids: DataFrame, ratio: float = 2.0) -> DataFrame:
    """Metabolites with several features whose scales differ more than ``ratio`` times."""
    s = stats.join(ids.select("feature", "hmdb_id").distinct(), "feature").groupBy("hmdb_id").agg(F.count(F.lit(1)).alias("n"), F.min("scale").alias("least"), F.max("scale").alias("most"))
    return s.where((F.col("n") > 1) & (F.col("most") > ratio * F.col("least")))


def drift_stats(df: DataFrame, group: str, score: str, nominal: float, reference: Column) -> DataFrame:
    """Per group counts, moments and percentiles of the scores, the rate below the reference threshold, a warning and the shift of the mean."""
    t = percentiles(df.where(reference), score, [nominal], ["cut"]).crossJoin(F.broadcast(df.agg(F.avg(F.when(reference, F.col(score))).alias("base"))))
    q = F.percentile(score, F.array(F.lit(0.02), F.lit(0.5), F.lit(0.98)))
    s = df.crossJoin(F.broadcast(t)).groupBy(group).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), q.alias("q"), F.avg((F.col(score) <= F.col("cut")).cast("int")).alias("rate"), F.first("base").alias("base"))
    return s.select(group, "n", "mean", "sd", F.col("q")[0].alias("p2"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p98"), "rate", (F.col("rate") > max(3 * nominal, nominal + 0.05)).alias("warn"), (F.col("mean") - F.col("base")).alias("shift"))


def bootstrap_mean(df: DataFrame, key: str, value: str, replicates: int = 200, seed: int = 20260923) -> DataFrame:
    """(replicate, mean) of a bootstrap by hashed Poisson(1) weights.

    Each row draws its weight for each replicate by a hash of key, seed and replicate, so resampling needs no
    copy of the data in any task and gives the same result under every partitioning.
    """
    steps, p = [], math.exp(-1)
    total = 0.0
    for k in range(12):
        total += p
        steps.append(total)
        p /= k + 1
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("replicate"), F.col(key)), 11) / F.lit(float(1 << 53))
    w = F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: s < u))
    rows = df.where(F.col(value).isNotNull()).select(key, value, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).withColumn("w", w)
    return rows.groupBy("replicate").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("mean"))


def bootstrap_auc(df: DataFrame, key: str, score: str, positive: str, replicates: int = 2000, seed: int = 20260923, level: float = 0.95, parts: int | None = None) -> DataFrame:
    """Q14: one row (auc, low, high, n): the AUC and the percentile interval of its bootstrap by Poisson(1) weights.

    Rows are cut into ranges of the score. Each range is read in order once, for all replicates together, and gives
    per replicate its weights of both classes and of its ordered pairs; running totals over the ranges add the pairs
    between them. Replicates without one of the classes are left out; ``n`` is the number of the others.
    """
    spark = df.sparkSession
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(positive).isNotNull()).select(F.xxhash64(F.lit(seed), key).alias("h"), F.col(score).cast("double").alias("x"), F.col(positive).alias("p"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        pairs, ps, ns, p_open, n_open = (np.zeros(replicates + 1) for _ in range(5))
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                x, pos = part["x"].to_numpy(), part["p"].to_numpy(dtype=bool)[:, None]
                # Replicate 0 is the sample itself.
                w = np.concatenate([np.ones((len(x), 1), dtype=np.uint8), poisson(part["h"].to_numpy(), replicates)], axis=1)
                starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                p, n = (np.add.reduceat(w * m, starts, axis=0, dtype=np.float64) for m in (pos, ~pos))
                same = last is not None and x[0] == last
                before = np.cumsum(n, axis=0) - n + ns
                if same:
                    # The chunk goes on with a score whose earlier rows are counted in ns already: half pairs with them, not whole ones.
                    pairs += (n[0] * p_open - p[0] * n_open) / 2
                pairs += np.einsum("gr,gr->r", p, before + n / 2)
                ps, ns = ps + p.sum(axis=0), ns + n.sum(axis=0)
                go_on = same and len(starts) == 1
                p_open, n_open = (p_open + p[0], n_open + n[0]) if go_on else (p[-1], n[-1])
                first, last = x[0] if first is None else first, x[-1]
        if first is not None:
            yield pd.DataFrame({"lo": first, "replicate": np.arange(replicates + 1), "pairs": pairs, "ps": ps, "ns": ns})

    ranges = rows.repartitionByRange(parts, "x").sortWithinPartitions("x").mapInPandas(run, "lo double, replicate int, pairs double, ps double, ns double")
    before = F.coalesce(F.sum("ns").over(Window.partitionBy("replicate").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    per = ranges.withColumn("pairs", F.col("pairs") + F.col("ps") * before).groupBy("replicate").agg(F.try_divide(F.sum("pairs"), F.sum("ps") * F.sum("ns")).alias("auc"))
    drawn, a = F.when(F.col("replicate") > 0, F.col("auc")), (1 - level) / 2
    return per.agg(F.max(F.when(F.col("replicate") == 0, F.col("auc"))).alias("auc"), F.percentile(drawn, F.lit(a)).alias("low"), F.percentile(drawn, F.lit(1 - a)).alias("high"), F.count(drawn).alias("n"))


def interval(replicates: DataFrame, value: str = "mean", level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return replicates.agg(F.percentile(value, F.lit(a)).alias("low"), F.percentile(value, F.lit(1 - a)).alias("high"))


def threshold_stability(scores: DataFrame, key: str, sample: str, score: str, share: float = 0.99, replicates: int = 200, seed: int = 20260923) -> DataFrame:
    """Q21: (key, median, wobble) of the reference scores' percentile per key over bootstraps of the samples; wobble is IQR / median.

    A bootstrap of n draws contains a given sample with probability 1 - 1/e; drawn samples count once. Whether a
    sample is drawn depends on its id and the replicate, so all keys see the same samples. The scores of a key are
    sorted once for all replicates.
    """
    bound = np.uint64(round((1 - math.exp(-1)) * 2**53))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x, h, cut = pdf["x"].to_numpy(), pdf["h"].to_numpy(), np.full(replicates, np.nan)
        for r in range(replicates):
            at = np.flatnonzero((mix(h, np.array([r + 1]))[:, 0] >> np.uint64(11)) < bound)
            if len(at):
                place = share * (len(at) - 1)
                low = x[at[math.floor(place)]]
                cut[r] = low + (place - math.floor(place)) * (x[at[math.ceil(place)]] - low)
        q = np.nanpercentile(cut, [25, 50, 75]) if np.isfinite(cut).any() else [np.nan] * 3
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "median": q[1], "iqr": q[2] - q[0]})

    rows = scores.where(F.col(score).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(F.lit(seed), sample).alias("h"), F.col(score).cast("double").alias("x"))
    out = rows.groupBy("k").applyInPandas(run, f"k {dict(rows.dtypes)['k']}, median double, iqr double").where("not isnan(median)")
    return out.select(F.col("k").alias(key), "median", F.try_divide("iqr", "median").alias("wobble"))


def rsd_report(df: DataFrame, qc: str, by: Sequence[str] = ()) -> DataFrame:
    """Relative deviation of the controls per feature."""
    v = F.when(F.col(qc), F.col("value"))
    return df.groupBy(*by, "feature").agg(F.count(v).alias("n"), (F.try_divide(F.stddev_samp(v), F.avg(v)) * 100).alias("rsd"))


def calibration_check(z: DataFrame) -> DataFrame:
    """Per feature the median and the interquartile range of z, which are 0 and 1 in well calibrated normals."""
    q = z.groupBy("feature").agg(F.percentile("z", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("feature", F.col("q")[1].alias("mid"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def group_evidence(flags: DataFrame, group: str, pathway: str = "smp_id") -> DataFrame:
    """Per group the number of flagged pathways and mean, median and largest excess."""
    return flags.groupBy(group).agg(F.count_distinct(F.when(F.col("flagged"), F.col(pathway))).alias("pathways"), F.avg("excess").alias("mean"), F.percentile("excess", F.lit(0.5)).alias("median"), F.max("excess").alias("most"))


def confusion_per(df: DataFrame, by: str, actual: Column, hit: Column) -> DataFrame:
    """Hits and misses of the actual cases per group."""
    return df.groupBy(by).agg(F.count_if(actual & hit).alias("tp"), F.count_if(actual & ~hit).alias("fn"))
