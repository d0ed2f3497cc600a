"""Queries of readers, writers, tuning and the remaining joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.common import table
from assaylake.operators import evaluate as E
from assaylake.operators import figures as V
from assaylake.operators import filters as X
from assaylake.operators import labels as L
from assaylake.operators import matching as M
from assaylake.operators import tuning as T
from assaylake.plans.q_evaluate import _vectors
from assaylake.plans.q_pathways import _F, _S, _flags, _scored, _summary
from assaylake.plans.registry import Registry
from assaylake.plans.views import SQL_LONG, SQL_MATRIX, SQL_RECORDS, SQL_SCORES, long_records, matrix, records, scores
from assaylake.session import Scratch
from assaylake.sources import readers, writers

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
_R, _M, _L, _SC = f"WITH {SQL_RECORDS}", f"WITH {SQL_MATRIX}", f"WITH {SQL_LONG}", f"WITH {SQL_SCORES}"


@R.add("R01_wide_round_trip", f"{_M} SELECT feature, 'S' || sample AS sample_id, value FROM matrix WHERE is_qc")
def r1(spark, d):
    return _round_trip(spark, matrix(spark, d).where("is_qc"), "wide")


@R.add("R01_wide_round_trip_whole", f"{_M} SELECT feature, 'S' || sample AS sample_id, value FROM matrix")
def r1w(spark, d):
    return _round_trip(spark, matrix(spark, d), "whole")


def _round_trip(spark, cells: DataFrame, name: str) -> DataFrame:
    scratch = Scratch(spark)
    # The writer reads it twice, for the columns and for the cells.
    m = scratch.write(cells.select(F.col("feature").alias("Name"), F.concat(F.lit("Area: S"), F.col("sample").cast("string"), F.lit(".raw (F1)")).alias("c"), "value"), name)
    path = scratch.path(f"{name}.csv")
    writers.write_wide(m, ["Name"], "c", "value", path)
    return readers.read_wide(spark, path).where("value is not null").select("feature", "sample_id", "value")


@R.add("R08_matrix_file", f"{_R} SELECT CAST(record_id AS VARCHAR) AS sample, classification, feature, value FROM (SELECT record_id, classification, 'neszumjoboside' AS feature, neszumjoboside AS value FROM records UNION ALL SELECT record_id, classification, 'rolmabmuposide', rolmabmuposide FROM records) WHERE classification IS NOT NULL")
def r8(spark, d):
    path = Scratch(spark).path("matrix.csv")
    writers.write_delimited(records(spark, d).select("record_id", "classification", "neszumjoboside", "rolmabmuposide"), path)
    return readers.read_matrix(spark, path, ["classification"], "record_id")


@R.add("W02_widen", f"{_L} SELECT record_id, max(value) FILTER (feature = 'neszumjoboside') AS neszumjoboside, max(value) FILTER (feature = 'gudsispetoside') AS gudsispetoside FROM long GROUP BY 1")
def w2(spark, d):
    return writers.widen(long_records(spark, d), "record_id", "feature", "value", ["neszumjoboside", "gudsispetoside"])


@R.add("T07_base_name", f"{_R} SELECT record_id, regexp_replace(sample_id, '_[12]$', '') AS base FROM records")
def t7(spark, d):
    return records(spark, d).select("record_id", F.regexp_replace("sample_id", "_[12]$", "").alias("base"))


@R.add("F17_prefix", f"{_R} SELECT record_id FROM records WHERE starts_with(sample_id, 'posneg')")
def f17(spark, d):
    return records(spark, d).where(F.col("sample_id").startswith("posneg")).select("record_id")


@R.add("F24_keyword_drop", "SELECT DISTINCT pathway_id FROM pathway_names WHERE name IS NOT NULL AND NOT contains(lower(name), 'transport') AND NOT contains(lower(name), 'type i')")
def f24(spark, d):
    p = table(spark, d, "pathway_names").where("name is not null").withColumnRenamed("name", "feature")
    return X.exclude_containing(p, ["Transport", "type I"]).select("pathway_id").distinct()


@R.add("F25_min_coverage", "SELECT coverage_id, loaded_at, coverage FROM pathway_coverage WHERE coverage >= 0.2 AND NOT isnan(coverage)")
def f25(spark, d):
    return table(spark, d, "pathway_coverage").where("coverage >= 0.2 and not isnan(coverage)").select("coverage_id", "loaded_at", "coverage")


@R.add("F29_demoted", f"{_M} SELECT feature, sample FROM matrix WHERE feature NOT IN (SELECT DISTINCT p_brand || ' ' || p_type FROM part WHERE p_size = 1)")
def f29(spark, d):
    out = table(spark, d, "part").where("p_size = 1").select(F.concat_ws(" ", "p_brand", "p_type").alias("feature"))
    return X.without_demoted(matrix(spark, d), out).select("feature", "sample")


@R.add("J19_scored_links", f"{_S}, e AS (SELECT DISTINCT smp_id, hmdb_id FROM biomarker_attachments WHERE hmdb_id IS NOT NULL AND smp_id IS NOT NULL) SELECT smp_id, hmdb_id, count(*) AS n FROM sc JOIN e USING (smp_id) WHERE score IS NOT NULL GROUP BY 1, 2")
def j19(spark, d):
    e = table(spark, d, "biomarker_attachments").where("hmdb_id is not null and smp_id is not null").select("smp_id", "hmdb_id").distinct()
    return M.scored_links(e, _scored(spark, d).where("score is not null"))


@R.add("J21_roles", f"""{_SC}, {SQL_RECORDS}, g AS (SELECT sample_id, max(classification) AS c, max(oordeel_targeted) AS o FROM records WHERE sample_id IS NOT NULL GROUP BY 1)
    SELECT score_id, CASE WHEN c = 0 AND o = 0 THEN 'inlier' WHEN c = 1 AND o = 1 THEN 'outlier' ELSE 'gray' END AS role FROM scores JOIN g USING (sample_id) WHERE c IS NOT NULL AND o IS NOT NULL""")
def j21(spark, d):
    g = records(spark, d).where("sample_id is not null").groupBy("sample_id").agg(F.max("classification").alias("classification"), F.max("oordeel_targeted").alias("oordeel"))
    return L.roles_by_sample(scores(spark, d), g).select("score_id", "role")


@R.add("J26_merge_decisions", f"{_F}, a AS (SELECT sample_id, bool_or(flagged) AS pathway_flag FROM flags GROUP BY 1), b AS (SELECT DISTINCT sample_id FROM merged_data_with_classification WHERE classification = 1) SELECT sample_id, pathway_flag OR sample_id IN (SELECT sample_id FROM b WHERE sample_id IS NOT NULL) AS flagged FROM a")
def j26(spark, d):
    a = _flags(spark, d).groupBy("sample_id").agg(F.max("flagged").alias("flagged"))
    b = table(spark, d, "merged_data_with_classification").where("classification = 1").select("sample_id").distinct()
    return E.combine(a, b, "sample_id").select("sample_id", F.col("combined").alias("flagged"))


@R.add("A22_group_evidence", f"{_F}, g AS (SELECT CASE WHEN is_normal THEN 'normal' ELSE 'other' END AS grp, * FROM flags) SELECT grp, count(DISTINCT smp_id) FILTER (flagged) AS pathways, round(avg(excess), 2) AS mean, round(quantile_cont(excess, 0.5), 2) AS median, round(max(excess), 2) AS most FROM g GROUP BY 1")
def a22(spark, d):
    f = _flags(spark, d).withColumn("grp", F.when(F.col("is_normal"), "normal").otherwise("other"))
    return E.group_evidence(f, "grp").select("grp", "pathways", *[F.round(c, 2).alias(c) for c in ("mean", "median", "most")])


@R.add("A27_mean_per_key", f"{_SC} SELECT sample_id, smp_id, round(avg(z_stouffer), 7) AS z, round(avg(z_stouffer_abs), 7) AS a FROM scores WHERE sample_id IS NOT NULL GROUP BY 1, 2")
def a27(spark, d):
    return scores(spark, d).where("sample_id is not null").groupBy("sample_id", "smp_id").agg(F.round(F.avg("z_stouffer"), 7).alias("z"), F.round(F.avg("z_stouffer_abs"), 7).alias("a"))


@R.add("N06_best_flag", f"{_F} SELECT sample_id, arg_max(score_id, (excess, -score_id)) AS score_id FROM flags WHERE flagged GROUP BY 1")
def n6(spark, d):
    return _flags(spark, d).where("flagged").groupBy("sample_id").agg(F.max_by("score_id", F.struct("excess", (-F.col("score_id")).alias("m"))).alias("score_id"))


@R.add("L05_drop_missing_labels", f"{_R} SELECT record_id FROM records WHERE classification IS NOT NULL AND oordeel_targeted IS NOT NULL")
def l5(spark, d):
    return records(spark, d).na.drop(subset=["classification", "oordeel_targeted"]).select("record_id")


@R.add("V03_depth_breadth")
def v3(spark, d):
    from assaylake.operators.pathways import decide

    return V.depth_breadth(decide(_summary(spark, d), "is_normal"), "sample_id")


@R.add("V10_confusion_per_batch", f"{_R} SELECT batch, count(*) FILTER (classification = 1 AND coalesce(neszumjoboside > 5, false)) AS tp, count(*) FILTER (classification = 1 AND NOT coalesce(neszumjoboside > 5, false)) AS fn FROM records WHERE classification IS NOT NULL GROUP BY 1")
def v10(spark, d):
    hit = F.coalesce(F.col("neszumjoboside") > 5, F.lit(False))
    return E.confusion_per(records(spark, d).where("classification is not null"), "batch", F.col("classification") == 1, hit)


@R.add("T14_markers_per_pathway", "SELECT smp_id, count(DISTINCT hmdb_id) AS n FROM biomarker_attachments GROUP BY 1")
def t14b(spark, d):
    return table(spark, d, "biomarker_attachments").groupBy("smp_id").agg(F.count_distinct("hmdb_id").alias("n"))


def _folded(spark, d) -> DataFrame:
    return T.with_folds(_vectors(spark, d).withColumn("is_normal", F.col("label") < 8), 3)


@R.add("S04_one_class_svm")
def s4(spark, d):
    from assaylake.operators.scorers import one_class_svm

    return one_class_svm(_vectors(spark, d), "label < 8")


@R.add("S11_out_of_fold")
def s11(spark, d):
    return T.out_of_fold(_folded(spark, d), "mahalanobis", 3)


@R.add("S17_grid_search")
def s17(spark, d):
    return T.grid_search(_folded(spark, d), "pca_reconstruction", T.grid(k=[2, 10]), 3)


@R.add("S20_repeated_splits", f"""{_R}, o AS (SELECT sample_id, max(coalesce(classification, -1)) AS c FROM records WHERE sample_id IS NOT NULL GROUP BY 1), s AS (SELECT unnest([0, 1, 2]) AS run),
    r AS (SELECT sample_id, run, 20260923 + 1000 * run AS seed, row_number() OVER (PARTITION BY run, c ORDER BY md5(sample_id || ':' || CAST(20260923 + 1000 * run AS VARCHAR)), sample_id) AS r, count(*) OVER (PARTITION BY run, c) AS n FROM o, s)
    SELECT sample_id, run, seed, r <= round_even(n * 0.5, 0) AS is_validation FROM r""")
def s20(spark, d):
    o = records(spark, d).where("sample_id is not null").groupBy("sample_id").agg(F.max(F.coalesce("classification", F.lit(-1.0))).alias("c"))
    return T.repeated_splits(o, "sample_id", "c", 3)


@R.add("S20_repeated_splits_whole", f"""{_R}, o AS (SELECT sample_id, max(coalesce(classification, -1)) AS c FROM records WHERE sample_id IS NOT NULL GROUP BY 1), s AS (SELECT unnest(range(20)) AS run),
    r AS (SELECT sample_id, run, 20260923 + 1000 * run AS seed, row_number() OVER (PARTITION BY run, c ORDER BY md5(sample_id || ':' || CAST(20260923 + 1000 * run AS VARCHAR)), sample_id) AS r, count(*) OVER (PARTITION BY run, c) AS n FROM o, s)
    SELECT sample_id, run, seed, r <= round_even(n * 0.5, 0) AS is_validation FROM r""")
def s20w(spark, d):
    o = records(spark, d).where("sample_id is not null").groupBy("sample_id").agg(F.max(F.coalesce("classification", F.lit(-1.0))).alias("c"))
    return T.repeated_splits(o, "sample_id", "c")


@R.add("R13_typed_keep_list", "SELECT DISTINCT trim(name) AS name FROM hmdb_metabolites WHERE length(trim(name)) >= 3")
def r13(spark, d):
    path = Scratch(spark).path("keep.tsv")
    t = table(spark, d, "hmdb_metabolites").select(F.lit("").alias("HMDB_ID"), F.col("name").alias("Name"), F.lit("").alias("Synonyms"))
    writers.write_delimited(t, path, "\t")
    return readers.read_keep_list(spark, path)
