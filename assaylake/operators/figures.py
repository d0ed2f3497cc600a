"""Data frames behind the figures; drawing them is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def excess_heatmap(flags: DataFrame, pathway: str, sample: str, top: int = 20) -> DataFrame:
    """V1: mean excess per (pathway, sample) of the ``top`` pathways by mean excess."""
    best = flags.groupBy(pathway).agg(F.avg("excess").alias("m")).where("m is not null").orderBy(F.desc(F.round("m", 9)), pathway).limit(top)
    return flags.join(F.broadcast(best.select(pathway)), pathway, "left_semi").groupBy(pathway, sample).agg(F.avg("excess").alias("excess"))


def flag_drivers(flags: DataFrame, pathway: str, top: int = 20) -> DataFrame:
    """V2: the pathways with the most flags."""
    return flags.where("flagged").groupBy(pathway).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), pathway).limit(top)


def depth_breadth(summary: DataFrame, sample: str) -> DataFrame:
    """V3: top excess and p value per sample."""
    return summary.select(sample, "top_excess", "sample_p_value")


def disturbance_box(scores: DataFrame, pathway: str, score: str, used: str, least: int = 3, top: int = 20) -> DataFrame:
    """V4: five-number summary of the score of the ``top`` pathways by mean, where enough metabolites were used."""
    s = scores.where(F.col(used) >= least).groupBy(pathway).agg(F.avg(score).alias("mean"), F.percentile(score, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q"))
    s = s.where("mean is not null").orderBy(F.desc(F.round("mean", 9)), pathway).limit(top)
    return s.select(pathway, "mean", *[F.col("q")[i].alias(n) for i, n in enumerate(("least", "q1", "median", "q3", "most"))])


def sample_panel(flags: DataFrame, sample: str, pathway: str, top: int = 10) -> DataFrame:
    """V5, V6: per sample its ``top`` pathways by excess with their rank."""
    w = Window.partitionBy(sample).orderBy(F.desc("excess"), pathway)
    return flags.where("excess is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def waterfall(z: DataFrame, members: DataFrame, best: DataFrame) -> DataFrame:
    """V7: the metabolites of the top pathway of each sample: (sample, smp_id, hmdb_id, z); ``best`` has (sample, smp_id)."""
    return best.join(members.select("smp_id", "hmdb_id").distinct(), "smp_id").join(z, ["sample", "hmdb_id"])


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins; values outside are in bin 0 and bins + 1."""
    return df.where(F.col(value).isNotNull()).groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def rsd_distribution(rsd: DataFrame, cap: float) -> DataFrame:
    """Share of features up to and above the cap."""
    return rsd.where("rsd is not null").agg(F.count_if(F.col("rsd") <= cap).alias("within"), F.count_if(F.col("rsd") > cap).alias("above"))


def mean_intensity(df: DataFrame) -> DataFrame:
    """Mean per sample with its batch."""
    return df.groupBy("batch", "sample").agg(F.avg("value").alias("mean"))
