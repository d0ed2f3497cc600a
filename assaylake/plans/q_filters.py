"""Queries of the feature filters (F): the features that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.common import table
from assaylake.functions import names as N
from assaylake.operators import filters as X
from assaylake.plans.registry import Registry
from assaylake.plans.views import SQL_LONG, SQL_MATRIX, long_records, matrix

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
_M = f"WITH {SQL_MATRIX}"
_L = f"WITH {SQL_LONG}, cells AS (SELECT feature, record_id AS sample, batch, coalesce(sample_type = 'qc', false) AS is_qc, coalesce(sample_type = 'blank', false) AS is_blank, value FROM long)"


def _cells(spark, d) -> DataFrame:
    r = long_records(spark, d)
    return r.select("feature", F.col("record_id").alias("sample"), "batch", F.coalesce(F.col("sample_type") == "qc", F.lit(False)).alias("is_qc"), F.coalesce(F.col("sample_type") == "blank", F.lit(False)).alias("is_blank"), "value")


def _names(df: DataFrame) -> DataFrame:
    return df.select("feature").distinct()


@R.add("F01_above_threshold", f"{_M} SELECT feature FROM matrix GROUP BY 1 HAVING max(value) > 400000")
def f1(spark, d):
    return _names(X.above_threshold(matrix(spark, d), 400000))


@R.add("F02_named", f"{_M} SELECT DISTINCT feature FROM matrix WHERE lower(trim(feature)) NOT IN ('', 'nan', 'none', 'null')")
def f2(spark, d):
    return _names(X.named(matrix(spark, d)))


@R.add("F03_low_intensity", f"""{_M}, s AS (SELECT feature, avg(value) FILTER (NOT is_blank) AS mean FROM matrix GROUP BY 1)
    SELECT feature FROM s WHERE mean >= (SELECT quantile_cont(mean, 0.3) FROM s) OR contains(feature, '#11')""")
def f3(spark, d):
    return _names(X.low_intensity(matrix(spark, d), 0, 0.3, "quantile", protect="#11"))


@R.add("F04_blank_contaminant", f"""{_M}, s AS (SELECT feature, avg(value) FILTER (NOT is_blank) AS bio, max(value) FILTER (NOT is_blank) AS top, avg(value) FILTER (is_blank) AS blank FROM matrix GROUP BY 1)
    SELECT feature FROM s WHERE NOT coalesce(bio < 1.1 * blank AND blank > 0 AND NOT top >= 4 * blank, false)""")
def f4(spark, d):
    return _names(X.blank_contaminant(matrix(spark, d), 1.1, 4.0))


@R.add("F05_low_variance", f"""{_M}, s AS (SELECT feature, var_samp(value) FILTER (NOT is_blank) AS var FROM matrix GROUP BY 1)
    SELECT feature FROM s WHERE var >= (SELECT quantile_cont(var, 0.25) FROM s)""")
def f5(spark, d):
    return _names(X.low_variance(matrix(spark, d), quantile=0.25))


@R.add("F05_low_variance_above", f"""{_M}, s AS (SELECT feature, var_samp(value) FILTER (NOT is_blank AND value > 100000) AS var, count(*) FILTER (NOT is_blank AND value > 100000) AS n, max(value) FILTER (NOT is_blank) AS top FROM matrix GROUP BY 1)
    SELECT feature FROM s WHERE CASE WHEN n < 2 AND top >= 1000000 THEN 'inf'::DOUBLE ELSE coalesce(var, 0) END >= 1e9""")
def f5b(spark, d):
    return _names(X.low_variance(matrix(spark, d), 1e9, above=100000.0))


@R.add("F06_in_batches", f"""{_M}, noise AS (SELECT CASE WHEN x > 0 THEN x ELSE 1e-5 END AS noise FROM (SELECT quantile_cont(m, 0.5) * 0.9 AS x FROM (SELECT sample, quantile_cont(value, 0.5) AS m FROM matrix GROUP BY 1))),
    per AS (SELECT feature, batch, quantile_cont(value, 0.5) AS m FROM matrix GROUP BY 1, 2)
    SELECT feature FROM per, noise GROUP BY 1 HAVING count(*) FILTER (m > noise) >= 12""")
def f6(spark, d):
    return _names(X.in_batches(matrix(spark, d), 12, 0.9))


@R.add("F07_qc_rsd", f"""{_M} SELECT feature FROM matrix GROUP BY 1
    HAVING coalesce(stddev_samp(value) FILTER (is_qc) / avg(value) FILTER (is_qc) * 100, 0) <= CASE WHEN avg(value) FILTER (is_qc) < 150000 THEN 60 ELSE 45 END""")
def f7(spark, d):
    return _names(X.qc_rsd(matrix(spark, d), 60.0, 45.0, 150000.0))


@R.add("F08_qc_present", f"{_M} SELECT feature FROM matrix GROUP BY 1 HAVING count(DISTINCT sample) FILTER (is_qc AND value IS NOT NULL) = (SELECT count(DISTINCT sample) FROM matrix WHERE is_qc)")
def f8(spark, d):
    return _names(X.qc_present(matrix(spark, d)))


@R.add("F09_qc_intensity", f"{_M}, s AS (SELECT feature, avg(value) FILTER (is_qc) AS mean FROM matrix GROUP BY 1) SELECT feature FROM s WHERE mean >= (SELECT quantile_cont(mean, 0.4) FROM s)")
def f9(spark, d):
    return _names(X.qc_intensity(matrix(spark, d), 0.4))


@R.add("F10_chain", f"""{_M}, a AS (SELECT feature, avg(value) FILTER (NOT is_blank) AS mean FROM matrix GROUP BY 1), b AS (SELECT m.* FROM matrix m SEMI JOIN (SELECT feature FROM a WHERE mean >= (SELECT quantile_cont(mean, 0.3) FROM a)) USING (feature)),
    c AS (SELECT feature, var_samp(value) FILTER (NOT is_blank) AS var FROM b GROUP BY 1) SELECT feature FROM c WHERE var >= (SELECT quantile_cont(var, 0.25) FROM c)""")
def f10(spark, d):
    return _names(X.chain(matrix(spark, d), X.named, lambda m: X.low_intensity(m, 0, 0.3, "quantile"), lambda m: X.low_variance(m, quantile=0.25)))


_QUALITY = f"""{_L}, n AS (SELECT count(DISTINCT sample) AS n_all FROM cells WHERE is_qc), s AS (SELECT feature, count(value) FILTER (is_qc) AS n, avg(value) FILTER (is_qc) AS mean, stddev_samp(value) FILTER (is_qc) AS sd FROM cells GROUP BY 1),
    k AS (SELECT s.* FROM s, n WHERE regexp_matches(feature, 'acid', 'i') OR (n = n_all AND coalesce(sd / mean * 100, 100) <= 30 AND mean / sd >= 2))"""


@R.add("F11_qc_quality", f"{_QUALITY} SELECT feature FROM k WHERE mean >= (SELECT quantile_cont(mean, 0.3) FROM k) OR regexp_matches(feature, 'acid', 'i')")
def f11(spark, d):
    return _names(X.qc_quality(_cells(spark, d), 0.1, 30.0, 2.0, 0.3, "acid"))


@R.add("F13_biological_quality", f"""{_L}, n AS (SELECT count(DISTINCT sample) AS n_all FROM cells WHERE NOT is_qc), s AS (SELECT feature, count(value) FILTER (NOT is_qc) AS n, avg(value) FILTER (NOT is_qc) AS mean FROM cells GROUP BY 1),
    k AS (SELECT s.* FROM s, n WHERE 1 - n / n_all <= 0.2) SELECT feature FROM k WHERE mean >= (SELECT quantile_cont(mean, 0.3) FROM k)""")
def f13(spark, d):
    return _names(X.biological_quality(_cells(spark, d), 0.2, 0.3))


@R.add("F14_add_protected", f"{_M} SELECT feature FROM matrix GROUP BY 1 HAVING max(value) > 400000 OR regexp_matches(feature, '#22', 'i')")
def f14(spark, d):
    m = matrix(spark, d)
    return _names(X.add_protected(X.above_threshold(m, 400000), m, "#22"))


@R.add("F15_mostly_missing", f"{_M} SELECT feature FROM matrix GROUP BY 1 HAVING 1 - count(*) FILTER (value > 100000) / (SELECT count(DISTINCT sample) FROM matrix) <= 0.5")
def f15(spark, d):
    m = matrix(spark, d)
    return _names(X.mostly_missing(m, m, 100000, 0.5))


@R.add("F16_mask_low", f"{_M} SELECT feature, sample, CASE WHEN value > 100000 OR is_qc THEN value END AS value FROM matrix")
def f16(spark, d):
    return X.mask_low(matrix(spark, d), 100000, F.col("is_qc")).select("feature", "sample", "value")


@R.add("F18_drop_samples", f"{_L} SELECT DISTINCT sample_id FROM long WHERE NOT contains(lower(sample_id), 'qc') AND NOT contains(lower(sample_id), 'blanco')")
def f18(spark, d):
    return X.drop_samples(long_records(spark, d), "sample_id", ["QC", "blanco"]).select("sample_id").distinct()


@R.add("F19_batch_specific", f"{_M} SELECT feature FROM matrix WHERE value > 800000 GROUP BY 1 HAVING count(DISTINCT batch) = 1")
def f19(spark, d):
    return _names(X.batch_specific(matrix(spark, d).where("value > 800000"))[1])


@R.add("F20_exclude_names", f"{_M} SELECT DISTINCT feature FROM matrix WHERE upper(trim(feature)) NOT IN (SELECT DISTINCT upper(trim(p_brand || ' ' || p_type)) FROM part WHERE p_size > 48)")
def f20(spark, d):
    names = table(spark, d, "part").where("p_size > 48").select(F.lower(F.concat_ws(" ", "p_brand", "p_type")).alias("name"))
    return _names(X.exclude_names(matrix(spark, d), names, lambda c: F.upper(F.trim(c))))


@R.add("F21_exclude_containing", f"{_M} SELECT DISTINCT feature FROM matrix WHERE NOT contains(lower(feature), 'promo') AND NOT contains(lower(feature), '#33')")
def f21(spark, d):
    return _names(X.exclude_containing(matrix(spark, d), ["PROMO", "#33"]))


@R.add("F22_keep_listed", r"""WITH typed AS (SELECT DISTINCT feature FROM feature_to_hmdb WHERE regexp_full_match(feature, '[\x00-\x7f]*')), n AS (SELECT feature, upper(regexp_replace(regexp_replace(feature, '(\d)[wW](\d)', '\1OMEGA\2', 'g'), '^\s+|\s+$', '', 'g')) AS e FROM typed),
    c AS (SELECT upper(trim(name)) AS e FROM hmdb_metabolites), l AS (SELECT DISTINCT regexp_replace(e, '[^A-Z0-9]+', '', 'g') AS l FROM c)
    SELECT feature, CASE WHEN contains(feature, 'HMDB') THEN 'tag' WHEN e IN (SELECT e FROM c) THEN 'exact' ELSE 'loose' END AS matched FROM n
    WHERE contains(feature, 'HMDB') OR e IN (SELECT e FROM c) OR regexp_replace(e, '[^A-Z0-9]+', '', 'g') IN (SELECT l FROM l WHERE length(l) >= 3)""")
def f22(spark, d):
    typed = table(spark, d, "feature_to_hmdb").where(F.col("feature").rlike(r"^[\x00-\x7f]*$")).select("feature").distinct()
    return X.keep_listed(typed, table(spark, d, "hmdb_metabolites").select("name"), N.normal_name, N.loose_name).select("feature", "matched")


@R.add("F22_keep_listed_whole")
def f22w(spark, d):
    every = table(spark, d, "feature_to_hmdb").where("feature is not null").select("feature").distinct()
    return X.keep_listed(every, table(spark, d, "hmdb_metabolites").select("name"), N.normal_name, N.loose_name).select("feature", "matched")


@R.add("F28_split_constant", f"{_M}, b AS (SELECT feature, sample, batch, value FROM matrix WHERE value > 700000) SELECT feature FROM b GROUP BY 1 HAVING coalesce(var_pop(value), 0) > 0")
def f28(spark, d):
    return _names(X.split_constant(matrix(spark, d).where("value > 700000"))[0])


@R.add("F30_impute_mean", f"{_L} SELECT feature, sample, round(coalesce(value, avg(value) OVER (PARTITION BY feature, batch)), 8) AS value FROM cells")
def f30(spark, d):
    return X.impute_mean(_cells(spark, d), ["batch"]).select("feature", "sample", F.round("value", 8).alias("value"))


@R.add("F30_drop_incomplete", f"{_L} SELECT DISTINCT sample FROM cells WHERE sample NOT IN (SELECT sample FROM cells WHERE value IS NULL)")
def f30b(spark, d):
    return X.drop_incomplete(_cells(spark, d), "sample").select("sample").distinct()
