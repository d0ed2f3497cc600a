"""Labels, roles, groups and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.names import contains_any
from assaylake.operators.ordered import numbered


def clip(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL, which ``least`` and ``greatest`` alone don't do."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def is_normal(classification: Column, oordeel: Column) -> Column:
    return F.coalesce((classification == 0) & (oordeel == 0), F.lit(False))


def group_of(classification: Column, oordeel: Column, imd_requires_oordeel: bool = False, non_treated: Column | None = None) -> Column:
    """Normal, imd or other; being normal overrides.

    With ``non_treated`` only untreated patients (label 1) are imd; a missing label is no proof. Without that column the rule rests.
    """
    imd = F.coalesce(classification == 1, F.lit(False))
    if non_treated is not None:
        imd = imd & F.coalesce(non_treated == 1, F.lit(False))
    if imd_requires_oordeel:
        imd = imd & F.coalesce(oordeel == 1, F.lit(False))
    return F.when(is_normal(classification, oordeel), "normal").when(imd, "imd").otherwise("other")


def lab_role(classification: Column, oordeel: Column, non_treated: Column | None = None) -> Column:
    """outlier, inlier or gray; NULL if a label is missing. Without the third label two suffice for an outlier."""
    both = (classification == 1) & (oordeel == 1)
    out = both & F.coalesce(non_treated == 1, F.lit(False)) if non_treated is not None else both
    known = classification.isNotNull() & oordeel.isNotNull()
    return F.when(known, F.when((classification == 0) & (oordeel == 0), "inlier").when(out, "outlier").otherwise("gray"))


def label_rows(df: DataFrame, scheme: str, classification: str = "classification", oordeel: str = "oordeel_targeted") -> DataFrame:
    """Add ``label`` (0 normal, 1 abnormal) by a scheme and drop the rows that it leaves out; rows with a missing label are dropped first."""
    c, o = F.col(classification), F.col(oordeel)
    rows = df.where(c.isNotNull() & o.isNotNull())
    normal = (c == 0) & (o == 0)
    if scheme == "confident_normals":
        return rows.withColumn("label", F.when(normal, 0).otherwise(1))
    if scheme == "oordeel":
        return rows.where(o.isin(0, 1)).withColumn("label", o.cast("int"))
    if scheme == "binary_simplified":
        return rows.where(c.isin(0, 1, 3)).withColumn("label", F.when(c == 1, 1).otherwise(0))
    if scheme == "default":
        return rows.where(~(c.isin(2, 3) & (o == 0))).withColumn("label", F.when(normal, 0).otherwise(1))
    raise ValueError(f"unknown label scheme: {scheme}")


def qc_with_fallback(df: DataFrame, column: str, primary: str, fallback: str) -> DataFrame:
    """Add ``is_qc``: the primary pattern, or the fallback if the primary matches no row at all."""
    a, b = contains_any(F.col(column), [primary]), contains_any(F.col(column), [fallback])
    any_ = df.agg(F.coalesce(F.max(a), F.lit(False)).alias("any"))
    return df.crossJoin(F.broadcast(any_)).withColumn("is_qc", F.when(F.col("any"), a).otherwise(b)).drop("any")


def _dealt(df: DataFrame, key: str, stratum: str, seed: int) -> DataFrame:
    """Add ``_n``, a reproducible place inside a stratum by a digest of key and seed, and ``_all``, the stratum's rows; no task orders a whole stratum."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return numbered(df.withColumn("_d", digest), [stratum], F.substring("_d", 1, 3), [F.col("_d"), F.col(key)], "_n", "_all").drop("_d")


def stratified_folds(df: DataFrame, key: str, stratum: str, k: int, seed: int) -> DataFrame:
    return _dealt(df, key, stratum, seed).withColumn("fold", ((F.col("_n") - 1) % k).cast("int")).drop("_n", "_all")


def stratified_split(df: DataFrame, key: str, stratum: str, fraction: float, seed: int) -> DataFrame:
    """Add ``is_validation``: round(n * fraction) of each stratum, halves to even."""
    return _dealt(df, key, stratum, seed).withColumn("is_validation", F.col("_n") <= F.bround(F.col("_all") * F.lit(fraction), 0)).drop("_n", "_all")


def error_lists(df: DataFrame) -> DataFrame:
    """Rows with (role, flagged) that are missed outliers (fn), flagged inliers (fp) or flagged gray ones."""
    kind = F.when((F.col("role") == "outlier") & ~F.col("flagged"), "fn").when((F.col("role") == "inlier") & F.col("flagged"), "fp").when((F.col("role") == "gray") & F.col("flagged"), "gray")
    return df.withColumn("list", kind).where("list is not null")


def roles_by_sample(df: DataFrame, groups: DataFrame, key: str = "sample_id") -> DataFrame:
    """Add ``role`` by the labels (key, classification, oordeel) of each sample; samples with a missing label drop out."""
    known = groups.where("classification is not null and oordeel is not null")
    return df.join(known.select(key, lab_role(F.col("classification"), F.col("oordeel")).alias("role")), key)


def with_batch(df: DataFrame, batches: DataFrame, key: str = "sample", unknown: str = "unknown") -> DataFrame:
    """M3: add ``batch_label`` from (key, batch), ``unknown`` for samples that no batch lists."""
    return df.join(batches.select(key, F.col("batch").cast("string").alias("batch_label")), key, "left").withColumn("batch_label", F.coalesce("batch_label", F.lit(unknown)))


def half_summary(decisions: DataFrame, prefix_column: str = "is_validation") -> DataFrame:
    """Per half of a split the number of normals, their flag rate and how many each channel flags; ``decisions`` has (grp, flagged, pathway_flag, biomarker_flag)."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = decisions.where(F.col("grp") == "normal").groupBy(prefix_column)
    return n.agg(F.count(F.lit(1)).alias("n_normals"), F.avg(yes("flagged").cast("int")).alias("flag_rate"), F.count_if(yes("pathway_flag")).alias("flagged_pathway"), F.count_if(yes("biomarker_flag")).alias("flagged_biomarker"))


def missed(decisions: DataFrame) -> DataFrame:
    """Validation samples of the group imd that weren't flagged."""
    return decisions.where((F.col("grp") == "imd") & F.coalesce("is_validation", F.lit(False)) & ~F.coalesce("flagged", F.lit(False)))
