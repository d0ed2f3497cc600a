"""Queries of scores, flags and decisions (A, Q, J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.common import table
from assaylake.operators import matching as M
from assaylake.operators import ordered as O
from assaylake.operators import pathways as P
from assaylake.plans.registry import Registry
from assaylake.plans.views import SQL_MATRIX, SQL_SCORES, matrix, scores

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


def _values(spark, d) -> DataFrame:
    return matrix(spark, d).select("feature", "sample", F.log10("value").alias("value"), (F.col("sample") % 3 == 0).alias("is_normal"))


def _links(spark, d) -> DataFrame:
    f = matrix(spark, d).select("feature").distinct().withColumn("hmdb_id", F.split_part("feature", F.lit(" "), F.lit(1)))
    smp = F.array(F.concat(F.lit("S"), F.substring("hmdb_id", 7, 1)), F.concat(F.lit("T"), F.substring("hmdb_id", 8, 1)))
    return f.select("feature", "hmdb_id", F.explode(smp).alias("smp_id"))


_V = f"""WITH {SQL_MATRIX}, vals AS (SELECT feature, sample, log10(value) AS value, sample % 3 = 0 AS is_normal FROM matrix),
    st AS (SELECT feature, quantile_cont(value, 0.5) FILTER (is_normal) AS median, quantile_cont(value, 0.75) FILTER (is_normal) - quantile_cont(value, 0.25) FILTER (is_normal) AS scale, count(value) FILTER (is_normal) AS n FROM vals GROUP BY 1),
    z AS (SELECT feature, sample, is_normal, (value - median) / scale AS z FROM vals JOIN st USING (feature) WHERE n > 0 AND scale > 0)"""
_LK = """, links AS (SELECT DISTINCT feature, split_part(feature, ' ', 1) AS hmdb_id, unnest(['S' || substring(split_part(feature, ' ', 1), 7, 1), 'T' || substring(split_part(feature, ' ', 1), 8, 1)]) AS smp_id FROM matrix),
    mz AS (SELECT sample, hmdb_id, avg(least(greatest(z, -10), 10)) AS z FROM z JOIN (SELECT DISTINCT feature, hmdb_id FROM links) USING (feature) WHERE z IS NOT NULL GROUP BY 1, 2),
    members AS (SELECT DISTINCT hmdb_id, smp_id FROM links WHERE feature IN (SELECT feature FROM z)), scored AS (SELECT smp_id FROM members GROUP BY 1 HAVING count(*) >= 3),
    agg AS (SELECT sample, smp_id, count(z) AS k, sum(z) AS s, sum(abs(z)) AS a FROM mz JOIN members USING (hmdb_id) WHERE smp_id IN (SELECT smp_id FROM scored) GROUP BY 1, 2),
    sc AS (SELECT sample, smp_id, coalesce(k, 0) AS n_metabolites_used, CASE WHEN k >= 3 THEN s / sqrt(k) END AS z_stouffer, CASE WHEN k >= 3 THEN a / sqrt(k) END AS z_stouffer_abs
    FROM (SELECT DISTINCT sample FROM vals) CROSS JOIN scored LEFT JOIN agg USING (sample, smp_id))"""


@R.add("A16_reference_stats", f"{_V} SELECT feature, round(median, 8) AS median, round(scale, 8) AS scale, n AS n_normal_values, round(1 - n / (SELECT count(DISTINCT sample) FROM vals WHERE is_normal), 8) AS p_normal_missing FROM st")
def a16(spark, d):
    s = P.reference_stats(_values(spark, d))
    return s.select("feature", F.round("median", 8).alias("median"), F.round("scale", 8).alias("scale"), "n_normal_values", F.round("p_normal_missing", 8).alias("p_normal_missing"))


@R.add("F27_calibration_reason", f"{_V} SELECT feature, CASE WHEN n = 0 THEN 'no_normal_values' WHEN scale IS NULL OR scale <= 0 THEN 'zero_scale' WHEN scale < 0.35 THEN 'small_scale' END AS reason FROM st")
def f27(spark, d):
    return P.reference_stats(_values(spark, d)).select("feature", P.calibration_reason(0.35).alias("reason"))


def _z(spark, d) -> DataFrame:
    v = _values(spark, d)
    return P.robust_z(v, P.reference_stats(v))


@R.add("Q17_robust_z", f"{_V} SELECT feature, sample, round(z, 7) AS z FROM z")
def q17(spark, d):
    return _z(spark, d).select("feature", "sample", F.round("z", 7).alias("z"))


@R.add("F26_usable_pathways", f"{_V}{_LK} SELECT smp_id, count(*) AS n_usable FROM members GROUP BY 1 HAVING count(*) >= 3")
def f26(spark, d):
    return P.usable_pathways(_links(spark, d), _z(spark, d))


@R.add("A17_metabolite_z", f"{_V}{_LK} SELECT sample, hmdb_id, round(z, 7) AS z FROM mz")
def a17(spark, d):
    return P.metabolite_z(_z(spark, d), _links(spark, d), cap=10.0).select("sample", "hmdb_id", F.round("z", 7).alias("z"))


@R.add("A17_weighted_z", f"{_V}{_LK}, w AS (SELECT sample, hmdb_id, sum(scale * scale * z) / sum(scale * scale) AS z FROM z JOIN st USING (feature) JOIN (SELECT DISTINCT feature, hmdb_id FROM links) USING (feature) GROUP BY 1, 2) SELECT sample, hmdb_id, round(z, 7) AS z FROM w")
def a17b(spark, d):
    v = _values(spark, d)
    s = P.reference_stats(v)
    w = s.select("feature", (F.col("scale") * F.col("scale")).alias("weight"))
    return P.metabolite_z(P.robust_z(v, s), _links(spark, d), w).select("sample", "hmdb_id", F.round("z", 7).alias("z"))


@R.add("A18_stouffer", f"{_V}{_LK} SELECT sample, smp_id, n_metabolites_used, round(z_stouffer, 7) AS z_stouffer, round(z_stouffer_abs, 7) AS z_stouffer_abs FROM sc")
def a18(spark, d):
    v = _values(spark, d)
    s = P.stouffer(_z(spark, d), _links(spark, d), v.select("sample"))
    return s.select("sample", "smp_id", "n_metabolites_used", F.round("z_stouffer", 7).alias("z_stouffer"), F.round("z_stouffer_abs", 7).alias("z_stouffer_abs"))


@R.add("A19_panel", f"""{_V}{_LK}, p AS (SELECT DISTINCT smp_id AS panel, hmdb_id, CASE WHEN smp_id LIKE '%1' THEN 'up' WHEN smp_id LIKE '%2' THEN 'down' ELSE '' END AS direction FROM members)
    SELECT sample, panel, count(*) AS k, CASE WHEN count(*) >= 2 THEN round(sum(CASE direction WHEN 'up' THEN greatest(z, 0) WHEN 'down' THEN greatest(-z, 0) ELSE abs(z) END) / sqrt(count(*)), 7) END AS score FROM mz JOIN p USING (hmdb_id) GROUP BY 1, 2""")
def a19(spark, d):
    links = _links(spark, d)
    members = links.select(F.col("smp_id").alias("panel"), "hmdb_id", F.when(F.col("smp_id").endswith("1"), "up").when(F.col("smp_id").endswith("2"), "down").otherwise("").alias("direction"))
    s = P.panel_scores(P.metabolite_z(_z(spark, d), links, cap=10.0), members)
    return s.select("sample", "panel", "k", F.round("score", 7).alias("score"))


_S = f"WITH {SQL_SCORES}, sc AS (SELECT score_id, sample_id, smp_id, pathway_name, z_stouffer_abs AS score, coalesce(sample_group = 'normal', false) AS is_normal FROM scores WHERE sample_id IS NOT NULL)"
_F = f"""{_S}, t AS (SELECT smp_id, coalesce(quantile_cont(score, 0.95) FILTER (is_normal), 'inf'::DOUBLE) AS threshold FROM sc GROUP BY 1), flags AS (SELECT sc.*, threshold, score / threshold AS excess, coalesce(score / threshold > 1, false) AS flagged FROM sc JOIN t USING (smp_id))"""
_SUM = f"""{_F}, counts AS (SELECT sample_id, count(*) FILTER (flagged) AS n_flagged, count(*) AS n_scored, bool_or(is_normal) AS is_normal FROM flags GROUP BY 1),
    r AS (SELECT sample_id, pathway_name, score, excess, row_number() OVER (PARTITION BY sample_id ORDER BY excess DESC, smp_id, score_id) AS r FROM flags WHERE excess IS NOT NULL),
    summary AS (SELECT c.*, excess AS top_excess FROM counts c LEFT JOIN r ON c.sample_id = r.sample_id AND r = 1)"""


def _scored(spark, d) -> DataFrame:
    return scores(spark, d).where("sample_id is not null").select("score_id", "sample_id", "smp_id", "pathway_name", F.col("z_stouffer_abs").alias("score"), F.coalesce(F.col("sample_group") == "normal", F.lit(False)).alias("is_normal"))


def _flags(spark, d) -> DataFrame:
    return P.threshold_flags(_scored(spark, d), ["smp_id"], "score", "is_normal", 0.95)


def _summary(spark, d) -> DataFrame:
    f = _flags(spark, d)
    return P.sample_summary(f, "sample_id", "smp_id", "score").join(f.groupBy("sample_id").agg(F.max("is_normal").alias("is_normal")), "sample_id")


@R.add("A18_reference_percentiles", f"{_S} SELECT smp_id, round(quantile_cont(score, 0.5), 7) AS p50, round(quantile_cont(score, 0.95), 7) AS p95, round(quantile_cont(score, 0.99), 7) AS p99 FROM sc WHERE is_normal GROUP BY 1")
def a18b(spark, d):
    p = P.normal_percentiles(_scored(spark, d).where("is_normal"), ["smp_id"], "score", "is_normal")
    return p.select("smp_id", *[F.round(c, 7).alias(c) for c in ("p50", "p95", "p99")])


@R.add("Q06_pathway_flags", f"{_F} SELECT score_id, round(threshold, 7) AS threshold, round(excess, 7) AS excess, flagged FROM flags")
def q6(spark, d):
    return _flags(spark, d).select("score_id", F.round("threshold", 7).alias("threshold"), F.round("excess", 7).alias("excess"), "flagged")


@R.add("Q07_metabolite_flags", f"""{_V}, t AS (SELECT feature, coalesce(quantile_cont(abs(z), 0.99) FILTER (is_normal), 'inf'::DOUBLE) AS threshold FROM z GROUP BY 1) SELECT feature, sample, round(abs(z) / threshold, 7) AS excess, coalesce(abs(z) / threshold > 1, false) AS flagged FROM z JOIN t USING (feature)""")
def q7(spark, d):
    return P.threshold_flags(_z(spark, d), ["feature"], "z", "is_normal", 0.99).select("feature", "sample", F.round("excess", 7).alias("excess"), "flagged")


@R.add("A20_sample_summary", f"{_SUM} SELECT sample_id, n_flagged, n_scored, round(top_excess, 7) AS top_excess FROM summary")
def a20(spark, d):
    return _summary(spark, d).select("sample_id", "n_flagged", "n_scored", F.round("top_excess", 7).alias("top_excess"))


_N = ", nul AS (SELECT * FROM summary WHERE is_normal)"


@R.add("Q05_empirical_p", f"{_SUM}{_N} SELECT sample_id, round((SELECT count(*) FROM nul n WHERE n.top_excess >= s.top_excess) / (SELECT count(top_excess) FROM nul), 8) AS p FROM summary s WHERE top_excess IS NOT NULL")
def q5(spark, d):
    return O.empirical_p(_summary(spark, d), "top_excess", "is_normal", "p").where("top_excess is not null").select("sample_id", F.round("p", 8).alias("p"))


@R.add("Q10_rule_empirical", f"""{_SUM}{_N}, p AS (SELECT sample_id, n_flagged, (SELECT count(*) FROM nul n WHERE n.n_flagged >= s.n_flagged) / (SELECT count(*) FROM nul) AS p FROM summary s)
    SELECT sample_id, round(p, 8) AS sample_p_value, n_flagged >= 1 AND p <= 0.05 AS decision FROM p""")
def q10(spark, d):
    return P.decide(_summary(spark, d), "is_normal", "empirical").select("sample_id", F.round("sample_p_value", 8).alias("sample_p_value"), "decision")


@R.add("Q10_rule_max_excess", f"""{_SUM}{_N}, p AS (SELECT sample_id, n_flagged, CASE WHEN top_excess IS NOT NULL THEN (SELECT count(*) FROM nul n WHERE n.top_excess >= s.top_excess) / (SELECT count(top_excess) FROM nul) END AS p FROM summary s)
    SELECT sample_id, round(p, 8) AS sample_p_value, coalesce(n_flagged >= 1 AND p <= 0.05, false) AS decision FROM p""")
def q10b(spark, d):
    return P.decide(_summary(spark, d), "is_normal", "max_excess").select("sample_id", F.round("sample_p_value", 8).alias("sample_p_value"), "decision")


@R.add("Q10_rule_none", f"{_SUM} SELECT sample_id, n_flagged >= 2 AS decision FROM summary")
def q10c(spark, d):
    return P.decide(_summary(spark, d), "is_normal", "none", least=2).select("sample_id", "decision")


@R.add("Q11_rule_binomial", f"""{_SUM}, k AS (SELECT DISTINCT n_flagged, n_scored FROM summary), term AS (SELECT k.*, unnest(range(n_flagged, n_scored + 1)) AS i FROM k),
    p AS (SELECT n_flagged, n_scored, CASE WHEN n_flagged <= 0 THEN 1.0 ELSE least(1.0, sum(exp(lgamma(n_scored + 1.0) - lgamma(i + 1.0) - lgamma(n_scored - i + 1.0) + i * ln(0.05) + (n_scored - i) * ln(0.95)))) END AS p FROM term GROUP BY 1, 2)
    SELECT sample_id, s.n_flagged, s.n_scored, round(p, 8) AS sample_p_value, s.n_flagged >= 1 AND p <= 0.05 AS decision FROM summary s JOIN p USING (n_flagged, n_scored)""")
def q11(spark, d):
    return P.decide(_summary(spark, d), "is_normal", "binomial", rate=0.05).select("sample_id", "n_flagged", "n_scored", F.round("sample_p_value", 8).alias("sample_p_value"), "decision")


@R.add("A21_depth", f"""{_V}, s AS (SELECT sample, bool_or(is_normal) AS is_normal, max(abs(z)) AS m, count(*) FILTER (abs(z) > 3) AS n_flagged, arg_max(feature, (abs(z), feature)) AS top_name FROM z GROUP BY 1)
    SELECT sample, round(m, 7) AS max_abs_z, top_name, n_flagged, round((SELECT count(*) FROM s n WHERE n.is_normal AND n.m >= s.m) / (SELECT count(*) FROM s WHERE is_normal), 8) AS depth_p FROM s""")
def a21(spark, d):
    z = _z(spark, d)
    out = P.depth(z.select("sample", F.col("feature").alias("name"), "z", (F.abs("z") > 3).alias("flagged")), z.groupBy("sample").agg(F.max("is_normal").alias("is_normal")))
    return out.select("sample", F.round("max_abs_z", 7).alias("max_abs_z"), "top_name", "n_flagged", F.round("depth_p", 8).alias("depth_p"))


@R.add("Q08_directed_depth", f"""{_V}{_LK}, ms AS (SELECT sample, hmdb_id AS name, z, sample % 3 = 0 AS is_normal FROM mz), tests AS (SELECT DISTINCT smp_id AS test, hmdb_id AS name, CASE WHEN smp_id LIKE '%1' THEN 'up' WHEN smp_id LIKE '%2' THEN 'down' ELSE '' END AS direction FROM members),
    j AS (SELECT ms.*, test, CASE direction WHEN 'up' THEN z WHEN 'down' THEN -z ELSE abs(z) END AS dz FROM ms JOIN tests USING (name)), t AS (SELECT test, name, coalesce(quantile_cont(abs(z), 0.95) FILTER (is_normal), 'inf'::DOUBLE) AS threshold FROM j GROUP BY 1, 2),
    s AS (SELECT sample, bool_or(is_normal) AS is_normal, max(dz) AS depth, arg_max(test, (dz, test)) AS top_test, bool_or(dz > threshold) AS any_hit FROM j JOIN t USING (test, name) GROUP BY 1),
    p AS (SELECT *, (SELECT count(*) FROM s n WHERE n.is_normal AND n.depth >= s.depth) / (SELECT count(*) FROM s WHERE is_normal) AS depth_p FROM s)
    SELECT sample, round(depth, 7) AS depth, top_test, round(depth_p, 8) AS depth_p, any_hit AND depth_p <= 0.05 AS flagged FROM p""")
def q8(spark, d):
    links = _links(spark, d)
    z = P.metabolite_z(_z(spark, d), links, cap=10.0).withColumnRenamed("hmdb_id", "name")
    tests = links.select(F.col("smp_id").alias("test"), F.col("hmdb_id").alias("name"), F.when(F.col("smp_id").endswith("1"), "up").when(F.col("smp_id").endswith("2"), "down").otherwise("").alias("direction"))
    out = P.directed_depth(z, tests, z.select("sample").distinct().withColumn("is_normal", F.col("sample") % 3 == 0))
    return out.select("sample", F.round("depth", 7).alias("depth"), "top_test", F.round("depth_p", 8).alias("depth_p"), "flagged")


@R.add("J22_panel_replaces", f"{_S} SELECT score_id FROM sc WHERE smp_id NOT IN (SELECT DISTINCT smp_id FROM biomarker_attachments WHERE smp_id IS NOT NULL)")
def j22(spark, d):
    return M.replace_by_panels(_scored(spark, d), table(spark, d, "biomarker_attachments")).select("score_id")


@R.add("J20_threshold_join", f"""{_S}, ref AS (SELECT smp_id, max(normal_z_stouffer_abs_p95) AS p95 FROM pathway_stouffer_reference WHERE NOT isnan(normal_z_stouffer_abs_p95) GROUP BY 1) SELECT score_id, p95, coalesce(score > p95, false) AS flagged FROM sc LEFT JOIN ref USING (smp_id)""")
def j20(spark, d):
    ref = table(spark, d, "pathway_stouffer_reference").where("not isnan(normal_z_stouffer_abs_p95)").groupBy("smp_id").agg(F.max("normal_z_stouffer_abs_p95").alias("p95"))
    return P.with_thresholds(_scored(spark, d), ref, "p95").select("score_id", "p95", "flagged")


@R.add("Q16_hygiene")
def q16(spark, d):
    return P.hygiene(_values(spark, d).where("is_normal").select("feature", "sample", "value"), 6.0)
