"""The logical tables that the demonstration queries run on, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.common import clean, latest_version, table

#: Features of the matrix of records.
FEATURES = ("neszumjoboside", "rolmabmuposide", "kashotpinic_acid", "gudsispetoside", "gudbushotamide", "garjevgaric_acid")
LABELS = ("classification", "oordeel_targeted", "non_treated")
KEEP = ("record_id", "sample_id", "original_col", "batch", "sample_type", "injection_order", *LABELS, *FEATURES, "acquired_at")


def records(spark: SparkSession, d: str) -> DataFrame:
    """One row per injection, missing values NULL."""
    out = latest_version(table(spark, d, "merged_data_with_classification"), "record_id", "loaded_at", KEEP)
    return out.select([clean(F.col(c)).alias(c) if c in (*LABELS, *FEATURES) else F.col(c) for c in KEEP])


def long_records(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, sample_id, original_col, batch, sample_type, injection_order, labels..., feature, value), log10 values, missing cells as NULL rows."""
    ids = [c for c in KEEP if c not in FEATURES]
    return records(spark, d).unpivot(ids, list(FEATURES), "feature", "value")


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """(feature, sample, batch, is_qc, is_blank, is_bridge, value): sales of a kind of part by a supplier; absent pairs are missing."""
    line, part, supplier = (table(spark, d, t) for t in ("lineitem", "part", "supplier"))
    cells = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("feature"), F.col("l_suppkey").alias("sample")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    out = cells.join(supplier.select(F.col("s_suppkey").alias("sample"), F.col("s_nationkey").alias("batch")), "sample")
    flag = lambda m, r: (F.col("sample") % m == r)
    return out.select("feature", "sample", "batch", flag(10, 0).alias("is_qc"), (flag(17, 0) & ~flag(10, 0)).alias("is_blank"), flag(10, 1).alias("is_bridge"), "value")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Latest pathway scores, missing scores NULL."""
    cols = ["score_id", "sample_id", "smp_id", "pathway_name", "n_metabolites_used", "z_stouffer", "z_stouffer_abs", "cohort", "sample_group", "scored_at"]
    out = latest_version(table(spark, d, "pathway_stouffer_scores"), "score_id", "loaded_at", cols)
    return out.select([clean(F.col(c)).alias(c) if c.startswith("z_") else F.col(c) for c in cols])


def _latest(name: str, key: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC) AS version FROM {name} WHERE {key} IS NOT NULL) WHERE version = 1)"


def _nn(c: str) -> str:
    return f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}"


SQL_RECORDS = f"records AS (SELECT {', '.join(_nn(c) if c in (*LABELS, *FEATURES) else c for c in KEEP)} FROM {_latest('merged_data_with_classification', 'record_id')} x)"
_IDS = ", ".join(c for c in KEEP if c not in FEATURES)
SQL_LONG = f"{SQL_RECORDS}, long AS (" + " UNION ALL ".join(f"SELECT {_IDS}, '{f}' AS feature, {f} AS value FROM records" for f in FEATURES) + ")"
SQL_MATRIX = """matrix AS (SELECT p_brand || ' ' || p_type AS feature, l_suppkey AS sample, s_nationkey AS batch, l_suppkey % 10 = 0 AS is_qc,
    (l_suppkey % 17 = 0 AND l_suppkey % 10 <> 0) AS is_blank, l_suppkey % 10 = 1 AS is_bridge, round(sum(l_extendedprice), 2) AS value
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""
SQL_SCORES = f"scores AS (SELECT * REPLACE (CASE WHEN isnan(z_stouffer) THEN NULL ELSE z_stouffer END AS z_stouffer, CASE WHEN isnan(z_stouffer_abs) THEN NULL ELSE z_stouffer_abs END AS z_stouffer_abs) FROM {_latest('pathway_stouffer_scores', 'score_id')} x)"
