"""Scores of metabolites and pathways against normal samples, flags and sample decisions.

Long tables: z has (sample, feature, z); links has (feature, hmdb_id, smp_id); scores has (sample, smp_id,
pathway_name, score columns). Missing is NULL. Percentiles over the normals are exact per group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from assaylake.operators.ordered import empirical_p, group_percentiles
from assaylake.session import Scratch


def reference_stats(df: DataFrame, normal: str = "is_normal", method: str = "iqr") -> DataFrame:
    """(feature, median, scale, n_normal_values, p_normal_missing) over the normals; scale is IQR or population sd."""
    df = Scratch(df.sparkSession).write(df.select("feature", "sample", "value", normal), "values")
    v = F.when(F.col(normal), F.col("value"))
    q = group_percentiles(df, ["feature"], v, [0.25, 0.5, 0.75], ["low", "median", "high"]).withColumnRenamed("feature", "_f")
    n = df.where(F.col(normal)).agg(F.count_distinct("sample").alias("normals"))
    s = df.groupBy("feature").agg(F.stddev_pop(v).alias("sd"), F.count(v).alias("n_normal_values")).crossJoin(F.broadcast(n))
    s = s.join(q, F.col("feature").eqNullSafe(F.col("_f")))
    spread = F.col("high") - F.col("low") if method == "iqr" else F.col("sd")
    return s.select("feature", "median", spread.alias("scale"), "n_normal_values", (1 - F.try_divide("n_normal_values", "normals")).alias("p_normal_missing"))


def calibration_reason(least_scale: float = 0.0) -> Column:
    """why a feature can't be calibrated, NULL if it can."""
    return F.when(F.col("n_normal_values") == 0, "no_normal_values").when(F.col("scale").isNull() | (F.col("scale") <= 0), "zero_scale").when(F.col("scale") < least_scale, "small_scale")


def robust_z(df: DataFrame, stats: DataFrame, least_scale: float = 0.0) -> DataFrame:
    """Q17: (value - median) / scale for features that can be calibrated."""
    ok = stats.where(calibration_reason(least_scale).isNull()).select("feature", "median", "scale")
    return df.join(ok, "feature").withColumn("z", (F.col("value") - F.col("median")) / F.col("scale")).drop("median", "scale")


def usable_pathways(links: DataFrame, z: DataFrame, least: int = 3) -> DataFrame:
    """(smp_id, n_usable) of pathways with enough metabolites among the scored features."""
    live = links.join(z.select("feature").distinct(), "feature", "left_semi")
    return live.groupBy("smp_id").agg(F.count_distinct("hmdb_id").alias("n_usable")).where(F.col("n_usable") >= least)


def metabolite_z(z: DataFrame, ids: DataFrame, weights: DataFrame | None = None, cap: float | None = None) -> DataFrame:
    """(sample, hmdb_id, z): weighted mean over the features of a metabolite that are present.

    ``ids`` has (feature, hmdb_id); a pair counts once. Features without a weight have weight 1.
    """
    limited = F.greatest(F.least(F.col("z"), F.lit(cap)), F.lit(-cap)) if cap else F.col("z")
    j = z.where("z is not null").withColumn("z", limited).join(ids.select("feature", "hmdb_id").distinct(), "feature")
    j = j.join(weights.select("feature", "weight"), "feature", "left") if weights is not None else j.withColumn("weight", F.lit(1.0))
    w = F.coalesce("weight", F.lit(1.0))
    return j.groupBy("sample", "hmdb_id").agg((F.sum(w * F.col("z")) / F.sum(w)).alias("z"))


def stouffer(z: DataFrame, links: DataFrame, samples: DataFrame, least: int = 3, weights: DataFrame | None = None, cap: float | None = 10.0) -> DataFrame:
    """(sample, smp_id, n_metabolites_used, z_stouffer, z_stouffer_abs) for every sample and scored pathway.

    Features of a metabolite are combined first; a sample with fewer than ``least`` metabolites of a pathway gets
    NULL scores; a pathway with fewer than ``least`` metabolites in all isn't scored.
    """
    live = links.join(z.select("feature").distinct(), "feature", "left_semi")
    members = live.select("hmdb_id", "smp_id").distinct()
    scored = members.groupBy("smp_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("smp_id")
    m = metabolite_z(z, live, weights, cap).join(members.join(scored, "smp_id"), "hmdb_id")
    s = m.groupBy("sample", "smp_id").agg(F.count("z").alias("k"), F.sum("z").alias("s"), F.sum(F.abs("z")).alias("a"))
    grid = samples.select("sample").distinct().crossJoin(F.broadcast(scored))
    out = grid.join(s, ["sample", "smp_id"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    enough = F.col("k") >= least
    return out.select("sample", "smp_id", F.col("k").alias("n_metabolites_used"), F.when(enough, F.col("s") / F.sqrt("k")).alias("z_stouffer"), F.when(enough, F.col("a") / F.sqrt("k")).alias("z_stouffer_abs"))


def panel_scores(z: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """Like Stouffer, but a member with a direction counts only its excess that way; ``members`` has (panel, hmdb_id, direction), z (sample, hmdb_id, z)."""
    up, down = F.greatest("z", F.lit(0.0)), F.greatest(-F.col("z"), F.lit(0.0))
    use = F.when(F.col("direction") == "up", up).when(F.col("direction") == "down", down).otherwise(F.abs("z"))
    j = z.where("z is not null").join(members.select("panel", "hmdb_id", "direction").distinct(), "hmdb_id")
    s = j.groupBy("sample", "panel").agg(F.count(F.lit(1)).alias("k"), F.sum(use).alias("s"))
    return s.select("sample", "panel", "k", F.when(F.col("k") >= least, F.col("s") / F.sqrt("k")).alias("score"))


def normal_percentiles(scores: DataFrame, keys: Sequence[str], score: str, normal: str, probabilities: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles of the normals per key, as columns p50, p95, ..."""
    rows = Scratch(scores.sparkSession).write(scores.select(*keys, F.when(F.col(normal), F.abs(score)).alias("_v")), "values")
    return group_percentiles(rows, keys, F.col("_v"), probabilities, [f"p{round(p * 100)}" for p in probabilities])


def threshold_flags(scores: DataFrame, keys: Sequence[str], score: str, normal: str, probability: float = 0.95) -> DataFrame:
    """Q6, Q7: add threshold (percentile of the normals; infinite without normals), excess = score / threshold, flagged = excess > 1.

    A NULL score isn't flagged; at threshold 0 a positive score has infinite excess and a zero score none.
    """
    # Thresholds and flags both read the scores, which are often dear to make.
    scores = Scratch(scores.sparkSession).write(scores, "scores")
    t = group_percentiles(scores, keys, F.when(F.col(normal), F.abs(score)), [probability], ["threshold"]).withColumn("threshold", F.coalesce("threshold", F.lit(float("inf"))))
    x = F.abs(score)
    excess = F.when(F.col("threshold") == 0, F.when(x > 0, F.lit(float("inf")))).otherwise(F.try_divide(x, "threshold"))
    return scores.join(t, list(keys)).withColumn("excess", excess).withColumn("flagged", F.coalesce(F.col("excess") > 1, F.lit(False)))


@F.pandas_udf(DoubleType())
def _binomial_sf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    def sf(k: float, n: float, p: float) -> float:
        if k <= 0:
            return 1.0
        if k > n or p <= 0:
            return 0.0
        if p >= 1:
            return 1.0
        a = math.lgamma(n + 1)
        return min(1.0, sum(math.exp(a - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(int(k), int(n) + 1)))

    return pd.Series([sf(*x) for x in zip(k, n, p, strict=True)])


def binomial_sf(k: Column, n: Column, p: Column) -> Column:
    """Q11: P(X >= k), exact, in log space; arguments repeat a lot, so apply it to distinct ones."""
    return _binomial_sf(k.cast("double"), n.cast("double"), p.cast("double"))


def sample_summary(flags: DataFrame, sample: str, pathway: str, score: str, top: int = 3) -> DataFrame:
    """Per sample the counts, the pathway with the largest excess (first by name on ties) and the ``top`` names.

    Only the best ``top`` rows of a sample are gathered; ranking limits them before the shuffle.
    """
    w = Window.partitionBy(sample).orderBy(F.desc("excess"), F.asc(pathway))
    best = flags.where("excess is not null").select(sample, pathway, score, "excess", F.row_number().over(w).alias("r")).where(F.col("r") <= top)
    lists = best.groupBy(sample).agg(
        F.max(F.when(F.col("r") == 1, F.col(pathway))).alias("top_name"), F.max(F.when(F.col("r") == 1, F.col(score))).alias("top_score"), F.max("excess").alias("top_excess"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", pathway))), lambda x: x[pathway]), "; ").alias("top_names"),
    )
    counts = flags.groupBy(sample).agg(F.count_if("flagged").alias("n_flagged"), F.count(F.lit(1)).alias("n_scored"))
    return counts.join(lists, sample, "left")


def decide(summary: DataFrame, normal: str, rule: str = "empirical", least: int = 1, most_p: float = 0.05, rate: float | None = None) -> DataFrame:
    """Q10: add sample_p_value and decision by a rule: none, empirical (count), max_excess or binomial."""
    n = F.col("n_flagged")
    if rule == "none":
        out = summary.withColumn("sample_p_value", F.lit(None).cast("double"))
        return out.withColumn("decision", n >= least)
    if rule in ("empirical", "max_excess"):
        out = empirical_p(summary, "n_flagged" if rule == "empirical" else "top_excess", normal, "sample_p_value")
    elif rule == "binomial":
        if rate is None:
            raise ValueError("the binomial rule needs the rate")
        keys = summary.select("n_flagged", "n_scored").distinct()
        keys = keys.withColumn("sample_p_value", binomial_sf(F.col("n_flagged"), F.col("n_scored"), F.lit(rate)))
        out = summary.join(keys, ["n_flagged", "n_scored"])
    else:
        raise ValueError(f"unknown rule: {rule}")
    return out.withColumn("decision", F.coalesce((n >= least) & (F.col("sample_p_value") <= most_p), F.lit(False)))


def depth(z: DataFrame, samples: DataFrame, normal: str = "is_normal") -> DataFrame:
    """Per sample the largest |z|, its metabolite, flagged ones and the empirical p of the depth; z has (sample, name, z, flagged)."""
    a = F.abs("z")
    s = z.where("z is not null").groupBy("sample").agg(F.max(a).alias("max_abs_z"), F.max_by("name", F.struct(a, "name")).alias("top_name"), F.count_if("flagged").alias("n_flagged"))
    return empirical_p(samples.join(s, "sample", "left"), "max_abs_z", normal, "depth_p")


def directed_depth(z: DataFrame, tests: DataFrame, samples: DataFrame, probability: float = 0.95, normal: str = "is_normal", most_p: float = 0.05) -> DataFrame:
    """Q8, Q9: per sample the deepest directed test, a flag if any test exceeds its threshold, and one global null of depths.

    ``tests`` has (test, name, direction), ``z`` (sample, name, z), ``samples`` (sample, is_normal).
    """
    j = z.where("z is not null").join(tests.select("test", "name", "direction").distinct(), "name").join(samples.select("sample", F.col(normal).alias("_null")), "sample")
    d = F.when(F.col("direction") == "up", F.col("z")).when(F.col("direction") == "down", -F.col("z")).otherwise(F.abs("z"))
    f = threshold_flags(j.withColumn("d", d), ["test", "name"], "z", "_null", probability)
    f = f.withColumn("hit", F.coalesce(F.col("d") > F.col("threshold"), F.lit(False)))
    s = f.groupBy("sample").agg(F.max("d").alias("depth"), F.max_by("test", F.struct("d", "test")).alias("top_test"), F.max("hit").alias("any_hit"))
    out = empirical_p(samples.join(s, "sample", "left"), "depth", normal, "depth_p")
    return out.withColumn("flagged", F.coalesce(F.col("any_hit") & (F.col("depth_p") <= most_p), F.lit(False)))


def hygiene(df: DataFrame, most_depth: float = 10.0, rounds: int = 10, cap_share: float | None = None) -> DataFrame:
    """Q16: (sample, depth, round): candidates whose largest leave-one-out |z| exceeds ``most_depth``, in rounds.

    ``df`` has (feature, sample, value) of the candidates. A candidate is scored by median and IQR of the
    other remaining candidates. Both follow from the values around the quartiles in the sorted order of
    each feature: removing a value shifts the ranks behind it by one. Only ranks travel; no list is gathered.
    """
    scratch = Scratch(df.sparkSession)
    left = scratch.write(df.where("value is not null").select("feature", "sample", "value"), "left0")
    n_all = df.select("sample").distinct().count()
    out, gone = None, 0
    for r in range(1, rounds + 1):
        w = Window.partitionBy("feature").orderBy("value", "sample")
        a = left.withColumn("rank", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("feature")))
        near = lambda q: F.floor((F.col("n") - 2) * q)
        wanted = F.lit(False)
        for q in (0.25, 0.5, 0.75):
            wanted = wanted | F.col("rank").between(near(q), near(q) + 2)
        around = a.where(wanted).groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
        j = a.where("n >= 3").join(around, "feature")

        def quantile(q: float) -> Column:
            pos = (F.col("n") - 2) * F.lit(q)
            lo = F.floor(pos).cast("int")
            hi = F.ceil(pos).cast("int")
            pick = lambda k: F.col("at")[F.when(k < F.col("rank"), k).otherwise(k + 1)]
            return pick(lo) + (pick(hi) - pick(lo)) * (pos - lo)

        iqr = quantile(0.75) - quantile(0.25)
        z = F.abs((F.col("value") - quantile(0.5)) / F.when(iqr > 0, iqr))
        worst = j.groupBy("sample").agg(F.max(z).alias("depth")).where(F.col("depth") > most_depth)
        if cap_share is not None:
            room = int(n_all * cap_share) - gone
            worst = worst.orderBy(F.desc("depth"), "sample").limit(max(room, 0))
        new = scratch.write(worst.withColumn("round", F.lit(r)), f"round{r}")
        n = new.count()
        if not n:
            break
        gone += n
        out = new if out is None else out.unionByName(new)
        left = scratch.write(left.join(new.select("sample"), "sample", "left_anti"), f"left{r}")
    return out if out is not None else df.sparkSession.createDataFrame([], f"sample {dict(df.dtypes)['sample']}, depth double, round int")


def with_thresholds(scores: DataFrame, reference: DataFrame, threshold: str, score: str = "score") -> DataFrame:
    """Scores beside the published threshold of their pathway, flagged beyond it; without a threshold nothing is flagged."""
    return scores.join(reference.select("smp_id", threshold), "smp_id", "left").withColumn("flagged", F.coalesce(F.col(score) > F.col(threshold), F.lit(False)))


def attachment_flags(z: DataFrame, attachments: DataFrame, samples: DataFrame, normal: str = "is_normal", probability: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """Q9: flags through attached markers: (per sample, pathway and marker, per sample).

    ``z`` has (sample, hmdb_id, z) of metabolites, ``attachments`` (smp_id, hmdb_id), ``samples`` (sample, is_normal). A marker is flagged beyond
    the percentile of the normals' |z|; the summary has the number of flagged markers, the largest |z| with its marker, and the
    share of normals whose largest |z| is as large.
    """
    pairs = attachments.where("smp_id is not null and hmdb_id is not null").select("smp_id", "hmdb_id").distinct()
    own = z.join(pairs.select("hmdb_id").distinct(), "hmdb_id", "left_semi").join(samples.select("sample", F.col(normal).alias("_null")), "sample")
    flags = threshold_flags(own, ["hmdb_id"], "z", "_null", probability)
    per = flags.join(pairs, "hmdb_id").select("sample", "smp_id", "hmdb_id", F.abs("z").alias("abs_z"), "threshold", "excess", "flagged")
    summary = depth(flags.select("sample", F.col("hmdb_id").alias("name"), "z", "flagged"), samples, normal)
    return per, summary.withColumn("biomarker_flagged", F.coalesce(F.col("n_flagged") >= 1, F.lit(False)))
