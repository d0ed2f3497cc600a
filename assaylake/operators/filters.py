"""Feature filters: an aggregate per feature over the long table, then a semi-join.

The long table has (feature, sample, value) and boolean columns named in the arguments; missing cells are
NULL or absent rows. Features whose name contains a protected text always stay where ``protect`` is given.
Quantiles are exact and interpolated linearly; they are taken over one number per feature.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.session import Scratch

PROTECT = "HMDB"


def _protected(protect: str | None) -> Column:
    return F.col("feature").contains(protect) if protect else F.lit(False)


def _keep(df: DataFrame, stats: DataFrame, condition: Column) -> DataFrame:
    return df.join(stats.where(condition).select("feature"), "feature", "left_semi")


def _quantile(stats: DataFrame, column: str, q: float) -> DataFrame:
    """Add the quantile of a per-feature number as column ``cut``."""
    cut = stats.agg(F.percentile(column, F.lit(q)).alias("cut"))
    return stats.crossJoin(F.broadcast(cut))


def above_threshold(df: DataFrame, threshold: float) -> DataFrame:
    """any value above the threshold."""
    return _keep(df, df.groupBy("feature").agg(F.max("value").alias("m")), F.col("m") > threshold)


def named(df: DataFrame) -> DataFrame:
    """the feature has a name."""
    return df.where(F.col("feature").isNotNull() & ~F.lower(F.trim("feature")).isin("", "nan", "none", "null"))


def low_intensity(df: DataFrame, minimum: float, quantile: float | None = None, by: str = "max", blank: str = "is_blank", protect: str | None = PROTECT) -> DataFrame:
    """maximum or mean outside blanks reaches ``minimum``, or the mean reaches a quantile of all means."""
    v = F.when(~F.col(blank), F.col("value"))
    s = df.groupBy("feature").agg(F.max(v).alias("top"), F.avg(v).alias("mean"))
    if by == "quantile":
        return _keep(df, _quantile(s, "mean", quantile), (F.col("mean") >= F.col("cut")) | _protected(protect))
    return _keep(df, s, (F.col("top" if by == "max" else "mean") >= minimum) | _protected(protect))


def blank_contaminant(df: DataFrame, ratio: float = 2.0, rescue: float = 10.0, blank: str = "is_blank", protect: str | None = PROTECT) -> DataFrame:
    """not (mean outside blanks below ratio * blank mean, and the maximum below rescue * blank mean)."""
    bio, empty = F.when(~F.col(blank), F.col("value")), F.when(F.col(blank), F.col("value"))
    s = df.groupBy("feature").agg(F.avg(bio).alias("bio"), F.max(bio).alias("top"), F.avg(empty).alias("blank"))
    bad = (F.col("bio") < ratio * F.col("blank")) & (F.col("blank") > 0) & ~(F.col("top") >= rescue * F.col("blank"))
    return _keep(df, s, ~F.coalesce(bad, F.lit(False)) | _protected(protect))


def low_variance(df: DataFrame, minimum: float = 0.0, quantile: float | None = None, above: float | None = None, blank: str = "is_blank", protect: str | None = PROTECT) -> DataFrame:
    """sample variance outside blanks, of values above ``above`` only if given.

    With fewer than two such values the variance counts as 0, or as infinite if the maximum is ten times the threshold.
    """
    v = F.when(~F.col(blank), F.col("value"))
    use = F.when(v > above, v) if above is not None else v
    s = df.groupBy("feature").agg(F.var_samp(use).alias("var"), F.count(use).alias("n"), F.max(v).alias("top"))
    var = F.when(_protected(protect), F.lit(float("inf")))
    if above is not None:
        var = var.when((F.col("n") < 2) & (F.col("top") >= above * 10), F.lit(float("inf"))).otherwise(F.coalesce("var", F.lit(0.0)))
    else:
        var = var.otherwise(F.col("var"))
    s = s.withColumn("var", var)
    if quantile is not None:
        return _keep(df, _quantile(s, "var", quantile), F.col("var") >= F.col("cut"))
    return _keep(df, s, F.col("var") >= minimum)


def in_batches(df: DataFrame, batches: int = 2, noise_share: float = 0.1, rescue: float | None = None, protect: str | None = PROTECT) -> DataFrame:
    """median above noise in enough batches; noise is a share of the median of the sample medians (1e-5 if not positive)."""
    noise = df.groupBy("sample").agg(F.percentile("value", F.lit(0.5)).alias("m")).agg((F.percentile("m", F.lit(0.5)) * noise_share).alias("x"))
    noise = noise.select(F.when(F.col("x") > 0, F.col("x")).otherwise(1e-5).alias("noise"))
    per = df.groupBy("feature", "batch").agg(F.percentile("value", F.lit(0.5)).alias("m"), F.max("value").alias("top")).crossJoin(F.broadcast(noise))
    s = per.groupBy("feature").agg(F.count_if(F.col("m") > F.col("noise")).alias("n"), F.max("top").alias("top"))
    ok = (F.col("n") >= batches) | _protected(protect)
    if rescue is not None:
        ok = ok | (F.col("top") >= rescue)
    many = df.agg((F.count_distinct("batch") < 2).alias("single"))
    return _keep(df, s.crossJoin(F.broadcast(many)), ok | F.col("single"))


def qc_rsd(df: DataFrame, low: float = 50.0, high: float = 25.0, border: float = 100_000.0, qc: str = "is_qc", protect: str | None = PROTECT) -> DataFrame:
    """relative deviation of control samples within the limit of its intensity tier; needs two controls in all."""
    v = F.when(F.col(qc), F.col("value"))
    s = df.groupBy("feature").agg(F.avg(v).alias("mean"), (F.try_divide(F.stddev_samp(v), F.avg(v)) * 100).alias("rsd"))
    enough = df.agg((F.count_distinct(F.when(F.col(qc), F.col("sample"))) < 2).alias("few"))
    limit = F.when(F.col("mean") < border, low).otherwise(high)
    return _keep(df, s.crossJoin(F.broadcast(enough)), (F.coalesce("rsd", F.lit(0.0)) <= limit) | _protected(protect) | F.col("few"))


def qc_present(df: DataFrame, qc: str = "is_qc") -> DataFrame:
    """F8: a value in every control sample."""
    all_ = df.where(F.col(qc)).agg(F.count_distinct("sample").alias("all"))
    s = df.groupBy("feature").agg(F.count_distinct(F.when(F.col(qc) & F.col("value").isNotNull(), F.col("sample"))).alias("n"))
    return _keep(df, s.crossJoin(F.broadcast(all_)), F.col("n") == F.col("all"))


def qc_intensity(df: DataFrame, quantile: float, qc: str = "is_qc") -> DataFrame:
    """control mean at or above the quantile of all control means."""
    s = df.groupBy("feature").agg(F.avg(F.when(F.col(qc), F.col("value"))).alias("mean"))
    return _keep(df, _quantile(s, "mean", quantile), F.col("mean") >= F.col("cut"))


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame], cut: Scratch | None = None) -> DataFrame:
    """filters one after another; each sees the survivors, so quantiles are taken anew.

    A filter reads its input twice; with ``cut`` each result is written, so that a long chain doesn't repeat the first steps.
    """
    for i, step in enumerate(steps):
        df = cut.write(step(df), f"chain{i}") if cut else step(df)
    return df


def qc_quality(df: DataFrame, missing: float = 0.1, rsd: float = 10.0, snr: float | None = 2.0, quantile: float = 0.3, exempt: str | None = None, qc: str = "is_qc") -> DataFrame:
    """present in all controls, few missing, small deviation, signal to noise, mean above a quantile, each on the survivors."""
    free = F.col("feature").rlike(f"(?i){exempt}") if exempt else F.lit(False)
    n = df.where(F.col(qc)).agg(F.count_distinct("sample").alias("all"))
    v = F.when(F.col(qc), F.col("value"))
    s = df.groupBy("feature").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")).crossJoin(F.broadcast(n))
    s = s.where((F.col("n") == F.col("all")) | free)
    s = s.where(((1 - F.col("n") / F.col("all")) <= missing) | free)
    s = s.where((F.coalesce(F.try_divide("sd", "mean") * 100, F.lit(100.0)) <= rsd) | free)
    if snr is not None:
        s = s.where((F.try_divide("mean", "sd") >= snr) | free)
    return _keep(df, _quantile(s, "mean", quantile), (F.col("mean") >= F.col("cut")) | free)


def biological_quality(df: DataFrame, missing: float = 0.2, quantile: float = 0.1, qc: str = "is_qc") -> DataFrame:
    """few missing outside controls, then mean above a quantile of the survivors' means."""
    n = df.where(~F.col(qc)).agg(F.count_distinct("sample").alias("all"))
    v = F.when(~F.col(qc), F.col("value"))
    s = df.groupBy("feature").agg(F.count(v).alias("n"), F.avg(v).alias("mean")).crossJoin(F.broadcast(n)).where((1 - F.col("n") / F.col("all")) <= missing)
    return _keep(df, _quantile(s, "mean", quantile), F.col("mean") >= F.col("cut"))


def add_protected(filtered: DataFrame, original: DataFrame, pattern: str) -> DataFrame:
    """rows of protected features that a filter dropped come back; what is there already wins."""
    back = original.where(F.col("feature").rlike(f"(?i){pattern}")).join(filtered.select("feature").distinct(), "feature", "left_anti")
    return filtered.unionByName(back)


def mostly_missing(df: DataFrame, samples: DataFrame, low: float, most: float = 0.5) -> DataFrame:
    """drop features that are low or missing in more than ``most`` of all samples."""
    n = samples.agg(F.count_distinct("sample").alias("all"))
    s = df.groupBy("feature").agg(F.count_if(F.col("value") > low).alias("ok")).crossJoin(F.broadcast(n))
    return _keep(df, s, (1 - F.col("ok") / F.col("all")) <= most)


def mask_low(df: DataFrame, low: float, exempt: Column | None = None) -> DataFrame:
    """F16: values at or below the threshold become NULL."""
    ok = F.col("value") > low
    return df.withColumn("value", F.when(ok | exempt if exempt is not None else ok, F.col("value")))


def drop_samples(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """rows whose column contains none of the patterns (case ignored)."""
    from assaylake.functions.names import contains_any

    return df.where(~contains_any(F.col(column), patterns))


def batch_specific(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of features with values in more than one batch, rows of features with values in one only)."""
    s = df.groupBy("feature").agg(F.count_distinct(F.when(F.col("value").isNotNull(), F.col("batch"))).alias("n"))
    return _keep(df, s, F.col("n") > 1), _keep(df, s, F.col("n") == 1)


def exclude_names(df: DataFrame, names: DataFrame, norm: Callable[[Column], Column]) -> DataFrame:
    """drop features whose normalised name is listed (``names`` has one column ``name``)."""
    return df.withColumn("_n", norm(F.col("feature"))).join(names.select(norm(F.col("name")).alias("_n")).distinct(), "_n", "left_anti").drop("_n")


def exclude_containing(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """drop features whose name contains a text (case ignored)."""
    from assaylake.functions.names import contains_any

    return df.where(~contains_any(F.col("feature"), parts))


def keep_listed(df: DataFrame, names: DataFrame, exact: Callable[[Column], Column], loose: Callable[[Column], Column], protect: str | None = PROTECT) -> DataFrame:
    """features that are protected or listed exactly or loosely; adds ``matched`` with the way."""
    f = df.select("feature").distinct().withColumn("_e", exact(F.col("feature"))).withColumn("_l", loose(F.col("feature")))
    e = names.select(exact(F.col("name")).alias("_e")).distinct().withColumn("by_e", F.lit(True))
    o = names.select(loose(F.col("name")).alias("_l")).where(F.length("_l") >= 3).distinct().withColumn("by_l", F.lit(True))
    f = f.join(e, "_e", "left").join(o, "_l", "left")
    f = f.withColumn("matched", F.when(_protected(protect), "tag").when(F.col("by_e"), "exact").when(F.col("by_l"), "loose")).where("matched is not null")
    return df.join(f.select("feature", "matched"), "feature")


def split_constant(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of features that vary, rows of features that don't)."""
    s = df.groupBy("feature").agg(F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("var"))
    return _keep(df, s, F.col("var") > 0), _keep(df, s, F.col("var") <= 0)


def impute_mean(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """missing values become the mean of their feature within ``by`` (train and test apart, for instance)."""
    return df.withColumn("value", F.coalesce("value", F.avg("value").over(Window.partitionBy("feature", *by))))


def drop_incomplete(df: DataFrame, key: str) -> DataFrame:
    """drop all rows of a feature or sample that has a missing value."""
    return df.join(df.where("value is null").select(key).distinct(), key, "left_anti")


def sum_same_named(df: DataFrame, name: str = "name", by: Sequence[str] = ("sample",)) -> DataFrame:
    """A2: values of features with the same name are summed, missing ones counting 0; a single one stays as it is, also if missing."""
    one = F.count(F.lit(1)) == 1
    return df.groupBy(name, *by).agg(F.when(one, F.first("value")).otherwise(F.coalesce(F.sum("value"), F.lit(0.0))).alias("value"))


def without_demoted(df: DataFrame, demoted: DataFrame) -> DataFrame:
    """what is scored: all but the demoted features, which stay in the output elsewhere."""
    return df.join(demoted.select("feature").distinct(), "feature", "left_anti")


def presence(df: DataFrame, group: str) -> DataFrame:
    """Per feature and group of controls the share of the group's samples with a value, and whether all have one."""
    n = df.groupBy(group).agg(F.count_distinct("sample").alias("n"))
    c = df.groupBy("feature", group).agg(F.count("value").alias("c")).join(n, group)
    return c.select("feature", group, (F.col("c") / F.col("n")).alias("share"), (F.col("c") >= F.col("n")).alias("in_all"))


# Parts of names that occur in many compounds and say nothing alone; straight chains in both spellings.
_CHAINS = "PROPAN BUTAN PENTAN HEXAN HEPTAN OCTAN DECAN DODECAN TETRADECAN HEXADECAN OCTADECAN EICOSAN DOCOSAN TETRACOSAN".split()
FRAGMENTS = frozenset(
    ["CARBOXYLIC ACID", "DICARBOXYLIC ACID", "DOCOSAHEXAENOATE", *(f"{c}OIC ACID" for c in _CHAINS), *(f"{c}OATE" for c in _CHAINS)]
    + "SULFATE SULFONATE SULFITE PHOSPHATE PHOSPHONATE PHOSPHONOOXY PHOSPHOLIPID ACETATE FORMATE BENZOATE GLUCOSIDE GALACTOSIDE RIBOSIDE NUCLEOSIDE HYDROXY METHYL PHENYL BENZYL GLYCEROL".split()
)


def near_misses(dropped: DataFrame, names: DataFrame, norm: Callable[[Column], Column], least: int = 6, longest: int = 80, generic: frozenset[str] = FRAGMENTS) -> DataFrame:
    """(feature, name) of dropped features that hold a listed name between word boundaries, or stand so within one.

    All dropped features are looked at. Every run of words of the longer text is a key that is joined by equality, so no
    feature is compared with every name. Texts beyond ``longest`` characters and shorter ones below ``least`` take no part.
    """

    def runs(df: DataFrame, own: str) -> DataFrame:
        # Pieces alternate between words and what lies between them; a run begins and ends with a word.
        pieces = F.filter(F.split(F.col("_t"), "(?<=[A-Z0-9])(?=[^A-Z0-9])|(?<=[^A-Z0-9])(?=[A-Z0-9])"), lambda p: p != "")
        d = df.where(F.length("_t").between(least, longest)).withColumn("_p", pieces)
        at = F.filter(F.sequence(F.lit(1), F.size("_p")), lambda i: F.element_at("_p", i).rlike("^[A-Z0-9]"))
        spans = F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda j: j >= i), lambda j: F.array_join(F.slice("_p", i, j - i + 1), ""))))
        return d.select(own, F.explode(F.array_distinct(spans)).alias("_k")).where(F.length("_k") >= least)

    f = dropped.select("feature").distinct().withColumn("_t", norm(F.col("feature")))
    n = names.select(norm(F.col("name")).alias("name")).where(F.length("name") >= least).distinct().where(~F.col("name").isin(*generic)).withColumn("_t", F.col("name"))
    inside = runs(f, "feature").join(n.select("name", F.col("_t").alias("_k")), "_k").select("feature", "name")
    around = runs(n, "name").join(f.where(F.length("_t").between(least, longest)).select("feature", F.col("_t").alias("_k")), "_k").select("feature", "name")
    return inside.unionByName(around).distinct()
