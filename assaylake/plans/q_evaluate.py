"""Queries of evaluation, batch effects, scorers and figure frames (A, Q, S, V, M)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.common import table
from assaylake.operators import effects as B
from assaylake.operators import evaluate as E
from assaylake.operators import figures as V
from assaylake.operators import filters
from assaylake.operators import labels as L
from assaylake.operators import ordered as O
from assaylake.operators import pathways as P
from assaylake.operators import scorers as S
from assaylake.plans.q_pathways import _F, _S, _V, _LK, _flags, _links, _scored, _values, _z
from assaylake.plans.registry import Registry
from assaylake.plans.views import SQL_MATRIX, SQL_RECORDS, matrix, records

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
_M = f"WITH {SQL_MATRIX}"
_R = f"WITH {SQL_RECORDS}"


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def _rounded(df: DataFrame, *cols: str, digits: int = 7) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@R.add("A07_rsd_report", f"{_M} SELECT feature, count(value) FILTER (is_qc) AS n, round(stddev_samp(value) FILTER (is_qc) / avg(value) FILTER (is_qc) * 100, 7) AS rsd FROM matrix GROUP BY 1")
def a7(spark, d):
    return _rounded(E.rsd_report(matrix(spark, d), "is_qc"), "rsd")


@R.add("A08_batch_medians", f"{_M}, m AS (SELECT batch, sample, quantile_cont(value, 0.5) AS m FROM matrix GROUP BY 1, 2) SELECT batch, round(quantile_cont(m, 0.5), 5) AS median, round(stddev_pop(m) / avg(m), 7) AS cv FROM m GROUP BY 1")
def a8(spark, d):
    out = B.batch_medians(matrix(spark, d))
    return out.select("batch", F.round("median", 5).alias("median"), F.round("cv", 7).alias("cv"))


@R.add("A09_variance_ratio", f"{_M}, b AS (SELECT feature, batch, avg(value) AS m, var_pop(value) AS v, count(value) AS n FROM matrix GROUP BY 1, 2), s AS (SELECT feature, var_pop(m) AS x, avg(v) FILTER (n > 1) AS y FROM b GROUP BY 1) SELECT feature, round(CASE WHEN y > 0 THEN x / y ELSE 0 END, 7) AS ratio FROM s")
def a9(spark, d):
    return _rounded(B.variance_ratio(matrix(spark, d)), "ratio")


@R.add("A10_batch_r2", f"{_M}, g AS (SELECT feature, avg(value) AS grand FROM matrix GROUP BY 1), b AS (SELECT feature, batch, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM matrix GROUP BY 1, 2), s AS (SELECT feature, sum(n * pow(m - grand, 2)) AS x, sum(n * v) AS y FROM b JOIN g USING (feature) GROUP BY 1) SELECT feature, round(x / (x + y), 7) AS r2 FROM s")
def a10(spark, d):
    return _rounded(B.batch_r2(matrix(spark, d)), "r2")


_PAIR = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, a.label AS la, b.label AS lb, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)"""


@R.add("A11_silhouette", f"""{_PAIR}, m AS (SELECT id, la, lb, avg(d) AS d FROM p GROUP BY ALL), s AS (SELECT id, max(d) FILTER (la = lb) AS a, min(d) FILTER (la <> lb) AS b FROM m GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 7) AS silhouette FROM s""")
def a11(spark, d):
    return _rounded(B.silhouette(_vectors(spark, d)), "silhouette")


@R.add("A12_mixing_entropy", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS id, b.label AS lb, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM e a JOIN e b ON true),
    c AS (SELECT id, lb, count(*) / 10 AS p FROM p WHERE r <= 10 GROUP BY 1, 2), h AS (SELECT id, -sum(p * log2(p)) AS h FROM c GROUP BY 1) SELECT round(avg(h), 7) AS entropy FROM h""")
def a12(spark, d):
    return _rounded(B.mixing_entropy(_vectors(spark, d), 10), "entropy")


@R.add("A13_cluster_spread", f"{_PAIR} SELECT la AS label, round(avg(d), 7) AS mean_distance, round(max(d), 7) AS max_distance FROM p WHERE la = lb GROUP BY 1")
def a13(spark, d):
    return _rounded(B.cluster_spread(_vectors(spark, d)), "mean_distance", "max_distance")


@R.add("A14_permanova")
def a14(spark, d):
    return B.permanova(_vectors(spark, d))


@R.add("J24_nearest_neighbours", f"{_PAIR}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS r FROM p) SELECT id, neighbour, round(d, 6) AS distance, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 5")
def j24(spark, d):
    return _rounded(B.nearest_neighbours(_vectors(spark, d), 5), "distance", digits=6)


@R.add("M13_presence", f"{_M} SELECT feature, is_bridge, round(count(value) / (SELECT count(DISTINCT sample) FROM matrix x WHERE x.is_bridge = m.is_bridge), 7) AS share FROM matrix m GROUP BY 1, 2")
def m13(spark, d):
    m = matrix(spark, d)
    return filters.presence(m, "is_bridge").select("feature", "is_bridge", F.round("share", 7).alias("share"))


@R.add("A23_breakdown", f"{_R} SELECT classification, oordeel_targeted, non_treated, count(*) AS n, count(*) FILTER (neszumjoboside > 5) AS flagged, round(count(*) FILTER (neszumjoboside > 5) / count(*), 8) AS rate FROM records GROUP BY 1, 2, 3")
def a23(spark, d):
    r = records(spark, d).withColumn("hit", F.coalesce(F.col("neszumjoboside") > 5, F.lit(False)))
    return _rounded(E.breakdown(r, ["classification", "oordeel_targeted", "non_treated"], "hit"), "rate", digits=8)


_METRICS = "FROM (SELECT cohort, z_stouffer AS x, 'z_stouffer' AS metric FROM scores UNION ALL SELECT cohort, z_stouffer_abs, 'z_stouffer_abs' FROM scores) WHERE x IS NOT NULL GROUP BY 1, 2"


@R.add("A26_folds_summary", f"{_S} SELECT cohort, metric, round(avg(x), 7) AS mean, round(quantile_cont(x, 0.5), 7) AS median, round(stddev_samp(x), 7) AS sd, round(stddev_pop(x), 7) AS sd0, min(x) AS least, max(x) AS most {_METRICS}")
def a26(spark, d):
    from assaylake.plans.views import scores

    out = E.folds_summary(scores(spark, d).select("cohort", "z_stouffer", "z_stouffer_abs"), ["z_stouffer", "z_stouffer_abs"], ["cohort"])
    return _rounded(out, "mean", "median", "sd", "sd0")


@R.add("A25_stability", f"""{_F}, n AS (SELECT sample_id, pathway_name, count(*) AS c FROM flags WHERE trim(coalesce(pathway_name, '')) <> '' GROUP BY 1, 2), mo AS (SELECT sample_id, arg_min(pathway_name, (-c, pathway_name)) AS mode_name FROM n GROUP BY 1)
    SELECT sample_id, count(*) AS runs, count(*) FILTER (flagged) AS times, round(count(*) FILTER (flagged) / count(*), 8) AS share, round(avg(excess), 7) AS mean_value, any_value(mode_name) AS mode_name FROM flags LEFT JOIN mo USING (sample_id) GROUP BY 1""")
def a25(spark, d):
    out = E.stability(_flags(spark, d), "sample_id", "flagged", "excess", "pathway_name")
    return out.select("sample_id", "runs", "times", F.round("share", 8).alias("share"), F.round("mean_value", 7).alias("mean_value"), "mode_name")


@R.add("A28_spikes", """WITH v AS (SELECT l_linenumber AS feature, CASE WHEN l_quantity > 12 THEN 1.0 ELSE 1.0 + l_quantity / 1000 END AS value FROM lineitem),
    n AS (SELECT feature, value, count(*) AS c FROM v GROUP BY 1, 2), t AS (SELECT feature, arg_max(value, (c, -value)) AS spike, max(c) / sum(c) AS share FROM n GROUP BY 1), q AS (SELECT feature, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM v GROUP BY 1)
    SELECT feature, spike, round(share, 8) AS share, round(iqr, 8) AS iqr FROM t JOIN q USING (feature) WHERE share >= 0.5 AND iqr <= 0.08""")
def a28(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("feature"), F.when(F.col("l_quantity") > 12, 1.0).otherwise(1.0 + F.col("l_quantity") / 1000).alias("value"))
    return _rounded(E.spikes(v), "share", "iqr", digits=8)


@R.add("A29_diverging", f"{_V}{_LK}, i AS (SELECT DISTINCT feature, hmdb_id FROM links) SELECT hmdb_id, count(*) AS n, round(min(scale), 7) AS least, round(max(scale), 7) AS most FROM st JOIN i USING (feature) GROUP BY 1 HAVING count(*) > 1 AND max(scale) > 1.2 * min(scale)")
def a29(spark, d):
    return _rounded(E.diverging(P.reference_stats(_values(spark, d)), _links(spark, d), 1.2), "least", "most")


@R.add("A30_calibration_check", f"{_V} SELECT feature, round(quantile_cont(z, 0.5), 6) AS mid, round(quantile_cont(z, 0.75) - quantile_cont(z, 0.25), 6) AS iqr FROM z GROUP BY 1")
def a30(spark, d):
    return E.calibration_check(_z(spark, d)).select("feature", F.round("mid", 6).alias("mid"), F.round("iqr", 6).alias("iqr"))


@R.add("A31_drift_stats", f"""{_S}, t AS (SELECT quantile_cont(score, 0.05) FILTER (is_normal) AS cut, avg(score) FILTER (is_normal) AS base FROM sc), c AS (SELECT s.cohort, sc.* FROM sc JOIN scores s USING (score_id))
    SELECT cohort, count(score) AS n, round(avg(score), 7) AS mean, round(stddev_pop(score), 7) AS sd, round(quantile_cont(score, 0.02), 7) AS p2, round(quantile_cont(score, 0.5), 7) AS p50, round(quantile_cont(score, 0.98), 7) AS p98,
    round(avg(CASE WHEN score <= cut THEN 1 WHEN score > cut THEN 0 END), 8) AS rate, avg(CASE WHEN score <= cut THEN 1 WHEN score > cut THEN 0 END) > 0.15 AS warn, round(avg(score) - any_value(base), 7) AS shift FROM c, t GROUP BY 1""")
def a31(spark, d):
    from assaylake.plans.views import scores

    s = scores(spark, d).where("sample_id is not null")
    out = E.drift_stats(s, "cohort", "z_stouffer_abs", 0.05, F.coalesce(F.col("sample_group") == "normal", F.lit(False)))
    return _rounded(_rounded(out, "mean", "sd", "p2", "p50", "p98", "shift"), "rate", digits=8)


_CF = f"{_R}, c AS (SELECT classification = 1 AS actual, coalesce(neszumjoboside > 5, false) AS hit FROM records WHERE classification IS NOT NULL)"


@R.add("A32_confusion", f"{_CF} SELECT count(*) FILTER (actual AND hit) AS tp, count(*) FILTER (NOT actual AND hit) AS fp, count(*) FILTER (actual AND NOT hit) AS fn, count(*) FILTER (NOT actual AND NOT hit) AS tn FROM c")
def a32(spark, d):
    return E.confusion(records(spark, d).select((F.col("classification") == 1).alias("actual"), (F.col("neszumjoboside") > 5).alias("hit")), "actual", "hit")


@R.add("A33_distinct", f"{_S} SELECT smp_id, count(DISTINCT sample_id) AS samples, count(DISTINCT cohort) AS cohorts FROM scores GROUP BY 1")
def a33(spark, d):
    from assaylake.plans.views import scores

    return scores(spark, d).groupBy("smp_id").agg(F.count_distinct("sample_id").alias("samples"), F.count_distinct("cohort").alias("cohorts"))


def _binary(spark, d) -> DataFrame:
    return records(spark, d).where("classification is not null and neszumjoboside is not null").select("record_id", F.col("neszumjoboside").alias("score"), (F.col("classification") == 1).alias("positive"))


_B = f"{_R}, b AS (SELECT neszumjoboside AS score, classification = 1 AS positive FROM records WHERE classification IS NOT NULL AND neszumjoboside IS NOT NULL)"


@R.add("Q13_auc", f"""{_B}, r AS (SELECT positive, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM b)
    SELECT round((sum(r) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2) / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)), 9) AS auc FROM r""")
def q13(spark, d):
    return _rounded(O.auc(_binary(spark, d), "score", "positive"), "auc", digits=9)


@R.add("S19_average_precision", f"""{_B}, g AS (SELECT score, count(*) FILTER (positive) AS p, count(*) AS c FROM b GROUP BY 1), w AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(c) OVER (ORDER BY score DESC) AS n, sum(p) OVER () AS total FROM g)
    SELECT round(sum(tp / n * p / total), 9) AS average_precision FROM w""")
def s19(spark, d):
    return _rounded(O.average_precision(_binary(spark, d), "score", "positive"), "average_precision", digits=9)


@R.add("V13_precision_recall", f"""{_B}, g AS (SELECT score, count(*) FILTER (positive) AS p, count(*) AS c FROM b GROUP BY 1)
    SELECT score, round(sum(p) OVER w / sum(c) OVER w, 9) AS "precision", round(sum(p) OVER w / sum(p) OVER (), 9) AS recall FROM g WINDOW w AS (ORDER BY score DESC)""")
def v13(spark, d):
    return O.precision_recall(_binary(spark, d), "score", "positive").select("score", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@R.add("Q12_clopper_pearson")
def q12(spark, d):
    c = records(spark, d).where("classification is not null").agg(F.count_if(F.col("neszumjoboside") > 5).alias("k"), F.count(F.lit(1)).alias("n")).first()
    low, high = E.clopper_pearson(c.k, c.n)
    return spark.createDataFrame([(c.k, c.n, low, high)], "k bigint, n bigint, low double, high double")


@R.add("Q14_bootstrap")
def q14(spark, d):
    return E.bootstrap_auc(_binary(spark, d), "record_id", "score", "positive")


@R.add("Q21_threshold_stability")
def q21(spark, d):
    s = _scored(spark, d).where("is_normal and score is not null")
    return E.threshold_stability(s, "smp_id", "sample_id", "score", 0.95)


@R.add("S12_realistic", f"""{_R}, x AS (SELECT -neszumjoboside AS score, CASE WHEN classification IS NULL OR oordeel_targeted IS NULL THEN NULL WHEN classification = 0 AND oordeel_targeted = 0 THEN 'inlier' WHEN classification = 1 AND oordeel_targeted = 1 AND coalesce(non_treated = 1, false) THEN 'outlier' ELSE 'gray' END AS role FROM records WHERE neszumjoboside IS NOT NULL),
    t AS (SELECT quantile_cont(score, 0.1) FILTER (role = 'inlier') AS t FROM x), m AS (SELECT any_value(t) AS threshold, count(*) FILTER (role = 'outlier' AND score <= t) / count(*) FILTER (role = 'outlier') AS recall, count(*) FILTER (role = 'inlier' AND score <= t) / count(*) FILTER (role = 'inlier') AS fpr FROM x, t)
    SELECT round(threshold, 7) AS threshold, round(recall, 7) AS recall, round(fpr, 7) AS fpr, round(0.05 * recall / (0.05 * recall + 0.95 * fpr), 7) AS "precision" FROM m""")
def s12(spark, d):
    r = records(spark, d).where("neszumjoboside is not null").select((-F.col("neszumjoboside")).alias("score"), L.lab_role(F.col("classification"), F.col("oordeel_targeted"), F.col("non_treated")).alias("role"))
    role = lambda x: F.coalesce(F.col("role") == x, F.lit(False))
    out = E.realistic(r, "score", role("inlier"), role("outlier"), role("inlier"), 0.1, 0.05)
    return _rounded(out, "threshold", "recall", "fpr", "precision").select("threshold", "recall", "fpr", "precision")


@R.add("S13_lowest_flags", "SELECT c_custkey, c_acctbal <= (SELECT quantile_disc(c_acctbal, 0.05) FROM customer) AS flagged FROM customer")
def s13(spark, d):
    return E.lowest_flags(table(spark, d, "customer"), "c_acctbal", 0.05).select("c_custkey", "flagged")


@R.add("S14_guardrail", f"""{_V}, s AS (SELECT feature, avg(value) FILTER (is_normal) AS mu, stddev_pop(value) FILTER (is_normal) AS sd FROM vals WHERE feature LIKE 'Brand#1%' GROUP BY 1)
    SELECT sample, count(DISTINCT feature) AS n_hits FROM vals JOIN s USING (feature) WHERE sd >= 1e-10 AND abs(value - mu) / (sd + 1e-10) > 2.5 GROUP BY 1""")
def s14(spark, d):
    v = _values(spark, d)
    markers = v.where(F.col("feature").like("Brand#1%")).select(F.upper("feature").alias("marker")).distinct()
    return E.guardrail(v, markers, "is_normal", 2.5)


@R.add("S15_combine", f"""{_V}, s AS (SELECT feature, avg(value) FILTER (is_normal) AS mu, stddev_pop(value) FILTER (is_normal) AS sd FROM vals WHERE feature LIKE 'Brand#1%' GROUP BY 1),
    g AS (SELECT DISTINCT sample FROM vals JOIN s USING (feature) WHERE sd >= 1e-10 AND abs(value - mu) / (sd + 1e-10) > 2.5), m AS (SELECT sample, max(abs(z)) > 5 AS flagged FROM z GROUP BY 1)
    SELECT sample, flagged, sample IN (SELECT sample FROM g) AS guardrail, flagged OR sample IN (SELECT sample FROM g) AS combined FROM m""")
def s15(spark, d):
    v = _values(spark, d)
    markers = v.where(F.col("feature").like("Brand#1%")).select(F.upper("feature").alias("marker")).distinct()
    model = _z(spark, d).groupBy("sample").agg((F.max(F.abs("z")) > 5).alias("flagged"))
    return E.combine(model, E.guardrail(v, markers, "is_normal", 2.5), "sample")


@R.add("S16_deviations", f"""{_V}, s AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM vals GROUP BY 1), y AS (SELECT sample, feature, (value - mu) / sd AS z FROM vals JOIN s USING (feature) WHERE sd > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY round(abs(z), 9) DESC, feature) AS r FROM y) SELECT sample, feature, round(z, 7) AS z, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 5""")
def s16(spark, d):
    return _rounded(E.deviations(_values(spark, d), 5), "z")


_FIT = "id % 3 <> 0"


@R.add("S01_isolation_forest")
def s1(spark, d):
    return S.isolation_forest(_vectors(spark, d), _FIT)


@R.add("S02_mahalanobis")
def s2(spark, d):
    return S.mahalanobis(_vectors(spark, d), _FIT)


@R.add("S03_reconstruction")
def s3(spark, d):
    return S.reconstruction(_vectors(spark, d), _FIT, 10)


@R.add("S07_lof", """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), b AS (SELECT * FROM e WHERE id % 3 <> 0), nb AS (SELECT a.id, c.id AS neighbour, list_distance(a.v, c.v) AS d, a.id % 3 <> 0 AS fitted, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, c.v), c.id) AS r FROM e a JOIN b c ON a.id <> c.id),
    n AS (SELECT * FROM nb WHERE r <= 20), k AS (SELECT id AS neighbour, max(d) AS kd FROM n WHERE fitted GROUP BY 1), l AS (SELECT id, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN k USING (neighbour) GROUP BY 1)
    SELECT n.id, round(-avg(x.lrd / y.lrd), 6) AS score FROM n JOIN l x ON x.id = n.neighbour JOIN l y ON y.id = n.id GROUP BY 1""")
def s7(spark, d):
    return _rounded(S.local_outlier_factor(_vectors(spark, d), _FIT, 20), "score", digits=6)


@R.add("S08_kth_distance", """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT a.id, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r FROM e a JOIN e b ON b.id % 3 <> 0)
    SELECT id, round(-max(d), 6) AS score FROM n WHERE r <= 5 GROUP BY 1""")
def s8(spark, d):
    return _rounded(S.kth_distance(_vectors(spark, d), _FIT, 5), "score", digits=6)


@R.add("S09_ensemble")
def s9(spark, d):
    v = _vectors(spark, d)
    return S.ensemble([S.mahalanobis(v, _FIT), S.reconstruction(v, _FIT, 10), S.kth_distance(v, _FIT, 5)], v.where(_FIT))


@R.add("Q23_pca")
def q23(spark, d):
    v = _vectors(spark, d)
    mean, axes, _ = S.components(v, _FIT, 5)
    return S.project(v, mean, axes)


@R.add("V01_heatmap", f"""{_F}, best AS (SELECT smp_id FROM flags GROUP BY 1 HAVING avg(excess) IS NOT NULL ORDER BY round(avg(excess), 9) DESC, smp_id LIMIT 20) SELECT smp_id, sample_id, round(avg(excess), 7) AS excess FROM flags WHERE smp_id IN (SELECT smp_id FROM best) GROUP BY 1, 2""")
def v1(spark, d):
    return _rounded(V.excess_heatmap(_flags(spark, d), "smp_id", "sample_id"), "excess")


@R.add("V02_flag_drivers", f"{_F} SELECT smp_id, count(*) AS n FROM flags WHERE flagged GROUP BY 1 ORDER BY n DESC, smp_id LIMIT 20")
def v2(spark, d):
    return V.flag_drivers(_flags(spark, d), "smp_id")


@R.add("V04_disturbance_box", f"""{_S}, s AS (SELECT smp_id, avg(z_stouffer_abs) AS mean, quantile_cont(z_stouffer_abs, 0.25) AS q1, quantile_cont(z_stouffer_abs, 0.5) AS median, max(z_stouffer_abs) AS most FROM scores WHERE n_metabolites_used >= 3 GROUP BY 1)
    SELECT smp_id, round(mean, 7) AS mean, round(q1, 7) AS q1, round(median, 7) AS median, most FROM s WHERE mean IS NOT NULL ORDER BY round(mean, 9) DESC, smp_id LIMIT 20""")
def v4(spark, d):
    from assaylake.plans.views import scores

    out = V.disturbance_box(scores(spark, d), "smp_id", "z_stouffer_abs", "n_metabolites_used")
    return _rounded(out, "mean", "q1", "median").select("smp_id", "mean", "q1", "median", "most")


@R.add("V06_sample_panel", f"""{_F}, r AS (SELECT sample_id, score_id, excess, row_number() OVER (PARTITION BY sample_id ORDER BY excess DESC, score_id) AS r FROM flags WHERE excess IS NOT NULL) SELECT sample_id, score_id, round(excess, 7) AS excess, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 10""")
def v6(spark, d):
    return _rounded(V.sample_panel(_flags(spark, d), "sample_id", "score_id"), "excess").select("sample_id", "score_id", "excess", "rank")


@R.add("V07_waterfall", f"{_V}{_LK}, best AS (SELECT sample, arg_max(smp_id, (z_stouffer_abs, smp_id)) AS smp_id FROM sc WHERE z_stouffer_abs IS NOT NULL GROUP BY 1) SELECT sample, smp_id, hmdb_id, round(z, 7) AS z FROM best JOIN (SELECT DISTINCT smp_id, hmdb_id FROM members) USING (smp_id) JOIN mz USING (sample, hmdb_id)")
def v7(spark, d):
    links, z = _links(spark, d), _z(spark, d)
    s = P.stouffer(z, links, z.select("sample"))
    best = s.where("z_stouffer_abs is not null").groupBy("sample").agg(F.max_by("smp_id", F.struct("z_stouffer_abs", "smp_id")).alias("smp_id"))
    return _rounded(V.waterfall(P.metabolite_z(z, links, cap=10.0), links, best), "z").select("sample", "smp_id", "hmdb_id", "z")


@R.add("V09_histogram", f"{_S} SELECT CAST(CASE WHEN z_stouffer_abs < 0 THEN 0 WHEN z_stouffer_abs >= 20 THEN 41 ELSE floor(z_stouffer_abs / 0.5) + 1 END AS BIGINT) AS bin, count(*) AS n FROM scores WHERE z_stouffer_abs IS NOT NULL GROUP BY 1")
def v9(spark, d):
    from assaylake.plans.views import scores

    return V.histogram(scores(spark, d), "z_stouffer_abs", 0.0, 20.0, 40)


@R.add("V11_rsd_distribution", f"{_M}, r AS (SELECT feature, stddev_samp(value) FILTER (is_qc) / avg(value) FILTER (is_qc) * 100 AS rsd FROM matrix GROUP BY 1) SELECT count(*) FILTER (rsd <= 50) AS within, count(*) FILTER (rsd > 50) AS above FROM r WHERE rsd IS NOT NULL")
def v11(spark, d):
    return V.rsd_distribution(E.rsd_report(matrix(spark, d), "is_qc"), 50.0)


@R.add("V12_mean_intensity", f"{_M} SELECT batch, sample, round(avg(value), 5) AS mean FROM matrix GROUP BY 1, 2")
def v12(spark, d):
    return _rounded(V.mean_intensity(matrix(spark, d)), "mean", digits=5)
