"""Cross-validation, grids and repeated seeds; configurations are looped on the driver, data stay distributed."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators.evaluate import folds_summary
from assaylake.operators.labels import stratified_folds, stratified_split
from assaylake.operators.ordered import auc, average_precision
from assaylake.operators.scorers import scorer
from assaylake.session import Scratch


def out_of_fold(vectors: DataFrame, name: str, folds: int = 5, **options: Any) -> DataFrame:
    """(id, score, fold): each fold is scored by a model of the normals outside it; ``vectors`` has (id, vector, is_normal, fold)."""
    parts = []
    for k in range(folds):
        fit = F.col("is_normal") & (F.col("fold") != k)
        own = vectors.where(F.col("fold") == k)
        parts.append(scorer(name)(vectors, fit, of=own, **options).withColumn("fold", F.lit(k)))
    return reduce(DataFrame.unionByName, parts)


def with_folds(vectors: DataFrame, folds: int = 5, seed: int = 7) -> DataFrame:
    return stratified_folds(vectors, "id", "is_normal", folds, seed)


def grid(**choices: Iterable[Any]) -> list[dict[str, Any]]:
    return [dict(zip(choices, v, strict=True)) for v in product(*choices.values())]


def grid_search(vectors: DataFrame, name: str, configurations: Sequence[Mapping[str, Any]], folds: int = 3) -> DataFrame:
    """One row per configuration with AUC and average precision of the out-of-fold scores, best first."""
    rows = []
    for i, c in enumerate(configurations):
        s = out_of_fold(vectors, name, folds, **c).join(vectors.select("id", "is_normal"), "id").select((-F.col("score")).alias("risk"), (~F.col("is_normal")).alias("positive"))
        rows.append((i, str(dict(c)), auc(s, "risk", "positive").first()[0], average_precision(s, "risk", "positive").first()[0]))
    return vectors.sparkSession.createDataFrame(rows, "configuration int, options string, auc double, average_precision double").orderBy(F.desc_nulls_last("auc"), "configuration")


def repeated_splits(samples: DataFrame, key: str, stratum: str, runs: int = 20, base: int = 20260923, step: int = 1000, fraction: float = 0.5) -> DataFrame:
    """(key, run, seed, is_validation) of repeated stratified splits with seeds base + step * run."""
    # Every run reads the samples, so they are written once.
    samples = Scratch(samples.sparkSession).write(samples.select(key, stratum), "samples")
    parts = [stratified_split(samples, key, stratum, fraction, base + step * r).select(key, F.lit(r).alias("run"), F.lit(base + step * r).alias("seed"), "is_validation") for r in range(runs)]
    return reduce(DataFrame.unionByName, parts)


def runs_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Metrics over runs."""
    return folds_summary(df, metrics)
