"""Scoring samples as they arrive against frozen reference statistics; an extension of the batch pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_z(cells: DataFrame, reference: DataFrame) -> DataFrame:
    """z of each arriving cell (sample, feature, value, at) by a stream-static join with (feature, median, scale)."""
    return cells.join(reference.where("scale > 0").select("feature", "median", "scale"), "feature").withColumn("z", (F.col("value") - F.col("median")) / F.col("scale")).drop("median", "scale")


def stream_stouffer(z: DataFrame, links: DataFrame, delay: str = "1 hour", span: str = "1 day", least: int = 3) -> DataFrame:
    """Pathway scores per sample and time window of an arriving z stream with column ``at``.

    A cell that is delivered again within the watermark counts once; links has one feature per metabolite and pathway.
    """
    once = z.withWatermark("at", delay).dropDuplicatesWithinWatermark(["sample", "feature"])
    j = once.where("z is not null").join(links.select("feature", "smp_id").distinct(), "feature")
    s = j.groupBy(F.window("at", span), "sample", "smp_id").agg(F.count(F.lit(1)).alias("k"), F.sum("z").alias("s"), F.sum(F.abs("z")).alias("a"))
    return s.where(F.col("k") >= least).select(F.col("window.start").alias("day"), "sample", "smp_id", "k", (F.col("s") / F.sqrt("k")).alias("z_stouffer"), (F.col("a") / F.sqrt("k")).alias("z_stouffer_abs"))
