"""Queries of batch merges, group rules, audits, attached markers and saved runs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from assaylake.common import table
from assaylake.functions import names as N
from assaylake.operators import evaluate as E
from assaylake.operators import filters as X
from assaylake.operators import labels as L
from assaylake.operators import matching as M
from assaylake.operators import normalise as S
from assaylake.operators import pathways as P
from assaylake.plans.q_matrix import _COVSETS, _JACC, _RT, _cover_sets, _retention
from assaylake.plans.q_pathways import _F, _LK, _V, _flags, _links, _z
from assaylake.plans.registry import Registry
from assaylake.plans.views import FEATURES, SQL_LONG, SQL_RECORDS, long_records, records
from assaylake.session import Scratch
from assaylake.sources import readers, writers

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
_R, _L = f"WITH {SQL_RECORDS}", f"WITH {SQL_LONG}"


@R.add("L08_groups_untreated", f"{_R} SELECT record_id, CASE WHEN coalesce(classification = 0 AND oordeel_targeted = 0, false) THEN 'normal' WHEN coalesce(classification = 1, false) AND coalesce(non_treated = 1, false) THEN 'imd' ELSE 'other' END AS grp FROM records")
def l8u(spark, d):
    return records(spark, d).select("record_id", L.group_of(F.col("classification"), F.col("oordeel_targeted"), non_treated=F.col("non_treated")).alias("grp"))


@R.add("L08_groups_with_oordeel", f"{_R} SELECT record_id, CASE WHEN coalesce(classification = 0 AND oordeel_targeted = 0, false) THEN 'normal' WHEN coalesce(classification = 1, false) AND coalesce(oordeel_targeted = 1, false) THEN 'imd' ELSE 'other' END AS grp FROM records")
def l8o(spark, d):
    return records(spark, d).select("record_id", L.group_of(F.col("classification"), F.col("oordeel_targeted"), True).alias("grp"))


RATIOS = (
    {"name": "r1", "numerator": FEATURES[0], "denominator": FEATURES[1]},
    {"name": "r2", "numerator": FEATURES[0], "denominator": [FEATURES[2], FEATURES[3]]},
    {"name": "r3", "numerator": FEATURES[0], "denominator": ["no_such_feature", FEATURES[3]]},
    {"name": FEATURES[4], "numerator": FEATURES[0], "denominator": FEATURES[1]},
    {"name": "r5", "numerator": None, "denominator": FEATURES[1]},
)


@R.add("Q18_ratio_audit", f"""SELECT * FROM (VALUES ('r1', '{FEATURES[0]}', '{FEATURES[1]}', 'derived'), ('r2', '{FEATURES[0]}', '{FEATURES[2]}+{FEATURES[3]}', 'derived'),
    ('r3', '{FEATURES[0]}', 'no_such_feature+{FEATURES[3]}', 'missing_parent: no_such_feature'), ('{FEATURES[4]}', '{FEATURES[0]}', '{FEATURES[1]}', 'name_collision'), ('r5', '', '{FEATURES[1]}', 'incomplete_spec')) AS t(name, numerator, denominator, status)""")
def q18a(spark, d):
    return S.derive_ratios(long_records(spark, d).select("record_id", "feature", "value"), RATIOS, "record_id")[1]


@R.add("Q18_derived_ratios", f"""{_R} SELECT record_id, 'r1' AS feature, round({FEATURES[0]} - {FEATURES[1]}, 8) AS value FROM records
    UNION ALL SELECT record_id, 'r2', round({FEATURES[0]} - log10(pow(10, {FEATURES[2]}) + pow(10, {FEATURES[3]})), 8) FROM records""")
def q18d(spark, d):
    out = S.derive_ratios(long_records(spark, d).select("record_id", "feature", "value"), RATIOS, "record_id")[0]
    return out.where(F.col("feature").isin("r1", "r2")).select("record_id", "feature", F.round("value", 8).alias("value"))


_ATT = f"""{_V}{_LK}, att AS (SELECT DISTINCT smp_id, hmdb_id FROM links WHERE starts_with(smp_id, 'S')), own AS (SELECT sample, hmdb_id, z, sample % 3 = 0 AS is_normal FROM mz WHERE hmdb_id IN (SELECT hmdb_id FROM att)),
    t AS (SELECT hmdb_id, coalesce(quantile_cont(abs(z), 0.99) FILTER (is_normal), 'inf'::DOUBLE) AS threshold FROM own GROUP BY 1), fl AS (SELECT own.*, threshold, coalesce(abs(z) / threshold > 1, false) AS flagged FROM own JOIN t USING (hmdb_id))"""


def _attached(spark, d):
    links = _links(spark, d)
    z = P.metabolite_z(_z(spark, d), links, cap=10.0)
    return P.attachment_flags(z, links.where(F.col("smp_id").startswith("S")), z.select("sample").distinct().withColumn("is_normal", F.col("sample") % 3 == 0))


@R.add("Q09_attachment_flags", f"{_ATT} SELECT sample, smp_id, hmdb_id, round(abs(z), 7) AS abs_z, round(threshold, 7) AS threshold, flagged FROM fl JOIN att USING (hmdb_id)")
def q9(spark, d):
    return _attached(spark, d)[0].select("sample", "smp_id", "hmdb_id", F.round("abs_z", 7).alias("abs_z"), F.round("threshold", 7).alias("threshold"), "flagged")


@R.add("Q09_attachment_summary", f"""{_ATT}, s AS (SELECT sample, bool_or(is_normal) AS is_normal, max(abs(z)) AS m, count(*) FILTER (flagged) AS n_flagged, arg_max(hmdb_id, (abs(z), hmdb_id)) AS top_name FROM fl GROUP BY 1)
    SELECT sample, round(m, 7) AS max_abs_z, top_name, n_flagged, round((SELECT count(*) FROM s n WHERE n.is_normal AND n.m >= s.m) / (SELECT count(*) FROM s WHERE is_normal), 8) AS depth_p, n_flagged >= 1 AS biomarker_flagged FROM s""")
def q9s(spark, d):
    return _attached(spark, d)[1].select("sample", F.round("max_abs_z", 7).alias("max_abs_z"), "top_name", "n_flagged", F.round("depth_p", 8).alias("depth_p"), "biomarker_flagged")


@R.add("F22_near_misses")
def f22n(spark, d):
    typed, names = table(spark, d, "feature_to_hmdb").where("feature is not null").select("feature").distinct(), table(spark, d, "hmdb_metabolites").select("name")
    kept = X.keep_listed(typed, names, N.normal_name, N.loose_name).select("feature")
    return X.near_misses(typed.join(kept, "feature", "left_anti"), names, N.normal_name)


@R.add("Q20_representatives", f"""WITH RECURSIVE {_COVSETS}, {_JACC}, e AS (SELECT a AS u, b AS v FROM similar_pairs UNION SELECT b, a FROM similar_pairs), reach AS (SELECT DISTINCT k AS key, k AS pt FROM sets UNION SELECT key, v FROM reach JOIN e ON pt = u),
    comp AS (SELECT key, min(pt) AS component FROM reach GROUP BY 1), size AS (SELECT k AS key, count(*) AS n FROM sets GROUP BY 1), nm AS (SELECT coverage_id AS key, min(pathway_name) AS name FROM pathway_coverage GROUP BY 1),
    r AS (SELECT component, c.key, row_number() OVER (PARTITION BY component ORDER BY CASE WHEN coalesce(contains(lower(name), 'deficiency') OR contains(lower(name), 'disease') OR contains(lower(name), 'aciduria'), false) THEN 1 ELSE 0 END, n DESC, coalesce(name, CAST(c.key AS VARCHAR)), c.key) AS r
    FROM comp c LEFT JOIN size USING (key) LEFT JOIN nm USING (key))
    SELECT comp.key, r.key AS represented_by FROM comp JOIN r ON comp.component = r.component AND r.r = 1""")
def q20r(spark, d):
    s = _cover_sets(spark, d)
    groups = M.components(s.select(F.col("k").alias("key")).distinct(), M.similar_sets(s, "k", "m", 0.8).select("a", "b"))
    names = table(spark, d, "pathway_coverage").select(F.col("coverage_id").alias("key"), F.col("pathway_name").alias("name"))
    return M.representatives(groups, s.groupBy(F.col("k").alias("key")).agg(F.count(F.lit(1)).alias("n")), names)


@R.add("M03_batch_labels", f"{_R}, b AS (SELECT DISTINCT sample_id, batch FROM records WHERE sample_type = 'sample' AND sample_id IS NOT NULL), one AS (SELECT sample_id, min(batch) AS batch FROM b GROUP BY 1) SELECT record_id, coalesce(CAST(one.batch AS VARCHAR), 'unknown') AS batch_label FROM records LEFT JOIN one USING (sample_id)")
def m3(spark, d):
    r = records(spark, d)
    own = r.where("sample_type = 'sample' and sample_id is not null").groupBy("sample_id").agg(F.min("batch").alias("batch"))
    return L.with_batch(r.drop("batch"), own, "sample_id").select("record_id", "batch_label")


_MERGE = f"""{_RT}, v AS (SELECT p_brand || '_' || CAST(l_partkey AS VARCHAR) AS feature, l_suppkey || '-' || (p_size % 3) AS sample, p_size % 3 AS batch, CASE WHEN l_suppkey % 11 = 0 THEN 'expQC' ELSE 'S' END || l_suppkey AS sample_name, sum(l_quantity) AS value
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), m AS (SELECT match_key AS feature, sample, batch, sample_name, avg(value) AS value FROM v JOIN g USING (feature) JOIN k USING (base, grp) WHERE sample_name NOT LIKE 'expQC%' GROUP BY ALL),
    n AS (SELECT feature, count(DISTINCT batch) AS n FROM m GROUP BY 1)"""


def _merged(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    batch, supplier = (F.col("p_size") % 3), F.col("l_suppkey").cast("string")
    name = F.concat(F.when(F.col("l_suppkey") % 11 == 0, "expQC").otherwise("S"), supplier)
    cells = lines.groupBy(F.concat_ws("_", "p_brand", F.col("l_partkey").cast("string")).alias("feature"), F.concat_ws("-", supplier, batch.cast("string")).alias("sample"), batch.alias("batch"), name.alias("sample_name")).agg(F.sum("l_quantity").alias("value"))
    return M.merge_batches(cells, _retention(spark, d), 0.0035)


@R.add("M07_merged_batches", f"{_MERGE} SELECT feature, sample, batch, sample_name, round(value, 6) AS value FROM m JOIN n USING (feature) WHERE n > 1")
def m7(spark, d):
    return _merged(spark, d)[0].select("feature", "sample", "batch", "sample_name", F.round("value", 6).alias("value"))


@R.add("M07_batch_specific", f"{_MERGE} SELECT feature, sample, batch, sample_name, round(value, 6) AS value FROM m JOIN n USING (feature) WHERE n = 1")
def m7b(spark, d):
    return _merged(spark, d)[1].select("feature", "sample", "batch", "sample_name", F.round("value", 6).alias("value"))


@R.add("M10_aligned_samples", f"{_R} SELECT DISTINCT sample_id, 'values' AS side FROM records WHERE sample_id IN (SELECT sample_id FROM pathway_stouffer_scores) UNION ALL SELECT DISTINCT sample_id, 'scores' FROM pathway_stouffer_scores WHERE sample_id IN (SELECT sample_id FROM records)")
def m10(spark, d):
    a, b = M.align(records(spark, d).where("sample_id is not null"), table(spark, d, "pathway_stouffer_scores").where("sample_id is not null"), "sample_id")
    return a.select("sample_id", F.lit("values").alias("side")).distinct().unionByName(b.select("sample_id", F.lit("scores").alias("side")).distinct())


_DEC = f"""{_F}, dec AS (SELECT sample_id, CASE WHEN bool_or(is_normal) THEN 'normal' ELSE 'imd' END AS grp, length(sample_id) % 2 = 0 AS is_validation, bool_or(flagged) AS pathway_flag, count(*) FILTER (flagged) >= 3 AS biomarker_flag FROM flags GROUP BY 1)"""


def _decisions(spark, d):
    f = _flags(spark, d).groupBy("sample_id").agg(F.max("is_normal").alias("n"), F.max("flagged").alias("pathway_flag"), (F.count_if("flagged") >= 3).alias("biomarker_flag"))
    return f.select("sample_id", F.when(F.col("n"), "normal").otherwise("imd").alias("grp"), (F.length("sample_id") % 2 == 0).alias("is_validation"), "pathway_flag", "biomarker_flag", (F.col("pathway_flag") & F.col("biomarker_flag")).alias("flagged"))


@R.add("M24_half_summary", f"{_DEC} SELECT is_validation, count(*) AS n_normals, round(avg(CAST(pathway_flag AND biomarker_flag AS INTEGER)), 8) AS flag_rate, count(*) FILTER (pathway_flag) AS flagged_pathway, count(*) FILTER (biomarker_flag) AS flagged_biomarker FROM dec WHERE grp = 'normal' GROUP BY 1")
def m24(spark, d):
    return L.half_summary(_decisions(spark, d)).withColumn("flag_rate", F.round("flag_rate", 8))


@R.add("M25_missed", f"{_DEC} SELECT sample_id FROM dec WHERE grp = 'imd' AND is_validation AND NOT (pathway_flag AND biomarker_flag)")
def m25(spark, d):
    return L.missed(_decisions(spark, d)).select("sample_id")


@R.add("R17_saved_run", f"{_F} SELECT sample_id, arg_max(score_id, (excess, -score_id)) AS score_id FROM flags WHERE flagged GROUP BY 1")
def r17(spark, d):
    folder = Scratch(spark).path("run")
    writers.save_run(folder, flags=_flags(spark, d))
    flags = readers.load_run(spark, folder, "flags")["flags"]
    return flags.where("flagged").groupBy("sample_id").agg(F.max_by("score_id", F.struct("excess", (-F.col("score_id")).alias("m"))).alias("score_id"))


@R.add("Q12_limits_checked", "SELECT k, n, CASE WHEN k = 0 THEN NULL ELSE 0.025 END AS at_low, CASE WHEN k = n THEN NULL ELSE 0.025 END AS at_high FROM (SELECT n, unnest(range(n + 1)) AS k FROM (SELECT unnest([1, 7, 40]) AS n))")
def q12c(spark, d):
    """The binomial tails at the limits, summed term by term: half of what the level leaves on each side."""
    tail = lambda p, n, ks: round(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in ks), 8)
    rows = []
    for n in (1, 7, 40):
        for k in range(n + 1):
            low, high = E.clopper_pearson(k, n)
            rows.append((k, n, None if k == 0 else tail(low, n, range(k, n + 1)), None if k == n else tail(high, n, range(k + 1))))
    return spark.createDataFrame(rows, "k bigint, n int, at_low double, at_high double")
