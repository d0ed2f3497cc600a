"""Queries of normalisation, drift, alignment and matching (A, Q, J, N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.common import latest_version, table
from assaylake.functions import names as N
from assaylake.operators import filters
from assaylake.operators import matching as M
from assaylake.operators import normalise as X
from assaylake.plans.registry import Registry
from assaylake.plans.views import SQL_LONG, SQL_MATRIX, SQL_RECORDS, long_records, matrix, records

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
_M = f"WITH {SQL_MATRIX}"
_L = f"WITH {SQL_LONG}"
_med = lambda c: f"quantile_cont({c}, 0.5)"


def _out(df: DataFrame, *keys: str, digits: int = 5) -> DataFrame:
    return df.select(*(keys or ("feature", "sample")), F.round("value", digits).alias("value"))


@R.add("A01_average_injections", f"{_L} SELECT feature, sample_id, round(avg(value), 8) AS value, count(*) AS n FROM long WHERE sample_id IS NOT NULL GROUP BY 1, 2")
def a1(spark, d):
    return long_records(spark, d).where("sample_id is not null").groupBy("feature", "sample_id").agg(F.round(F.avg("value"), 8).alias("value"), F.count(F.lit(1)).alias("n"))


@R.add("A01b_strict_average", f"{_L} SELECT feature, sample_id, CASE WHEN count(value) = count(*) THEN round(avg(value), 8) END AS value FROM long WHERE sample_id IS NOT NULL GROUP BY 1, 2")
def a1b(spark, d):
    return long_records(spark, d).where("sample_id is not null").groupBy("feature", "sample_id").agg(F.when(F.count("value") == F.count(F.lit(1)), F.round(F.avg("value"), 8)).alias("value"))


@R.add("A02_rotamer_sum", f"{_L}, named AS (SELECT split_part(feature, '_', 1) AS name, record_id, value FROM long) SELECT name, record_id, CASE WHEN count(*) = 1 THEN any_value(value) ELSE round(coalesce(sum(value), 0), 8) END AS value FROM named GROUP BY 1, 2")
def a2(spark, d):
    named = long_records(spark, d).select(F.split_part("feature", F.lit("_"), F.lit(1)).alias("name"), "record_id", "value")
    return filters.sum_same_named(named, "name", ["record_id"])


@R.add("A03_sample_median", f"{_M}, m AS (SELECT sample, {_med('value')} AS m FROM matrix GROUP BY 1) SELECT feature, sample, round(value * (SELECT {_med('m')} FROM m) / m, 5) AS value FROM matrix JOIN m USING (sample)")
def a3(spark, d):
    return _out(X.sample_median(matrix(spark, d)))


@R.add("A04_qc_median", f"{_M}, m AS (SELECT sample, {_med('value')} AS m, bool_or(is_qc) AS qc FROM matrix GROUP BY 1) SELECT feature, sample, round(value / (m / (SELECT {_med('m')} FROM m WHERE qc)), 5) AS value FROM matrix JOIN m USING (sample)")
def a4(spark, d):
    return _out(X.qc_median(matrix(spark, d)))


@R.add("A05_pqn", f"""{_M}, r AS (SELECT feature, {_med('value')} AS ref FROM matrix WHERE is_qc GROUP BY 1), q AS (SELECT sample, {_med('value / ref')} AS f FROM matrix JOIN r USING (feature) WHERE value > 0 AND ref > 0 GROUP BY 1)
    SELECT feature, sample, round(CASE WHEN f > 0 THEN value / f ELSE value END, 5) AS value FROM matrix LEFT JOIN q USING (sample)""")
def a5(spark, d):
    return _out(X.pqn(matrix(spark, d), by=()))


_BRIDGE = f"""{_M}, c AS (SELECT feature, batch, {_med('ln(value + 1)')} AS center FROM matrix WHERE is_bridge AND value > 0 GROUP BY 1, 2), g AS (SELECT feature, {_med('center')} AS grand FROM c GROUP BY 1),
    f AS (SELECT feature, batch, greatest(least(exp(grand - center), 2.0), 0.5) AS factor FROM c JOIN g USING (feature))"""


@R.add("A06_bridge_factors", f"{_BRIDGE} SELECT feature, batch, round(factor, 8) AS factor FROM f")
def a6(spark, d):
    return X.bridge_factors(matrix(spark, d), max_factor=2.0).select("feature", "batch", F.round("factor", 8).alias("factor"))


@R.add("A06_bridge_scale", f"{_BRIDGE} SELECT feature, sample, round(value * coalesce(factor, 1), 5) AS value FROM matrix LEFT JOIN f USING (feature, batch)")
def a6b(spark, d):
    return _out(X.bridge_scale(matrix(spark, d), max_factor=2.0))


@R.add("Q02_half_min_all", f"{_L} SELECT feature, record_id, round(CASE WHEN value IS NULL OR value = 0 THEN (SELECT min(value) / 2 FROM long WHERE value > 0) ELSE value END, 8) AS value FROM long")
def q2(spark, d):
    return _out(X.half_min_all(long_records(spark, d)), "feature", "record_id", digits=8)


@R.add("Q03_half_min_feature", f"{_M}, z AS (SELECT feature, sample, CASE WHEN value < 50000 THEN 0 ELSE value END AS value FROM matrix) SELECT feature, sample, CASE WHEN value = 0 THEN min(CASE WHEN value > 0 THEN value END) OVER (PARTITION BY feature) / 2 ELSE value END AS value FROM z")
def q3(spark, d):
    return X.half_min_feature(matrix(spark, d).withColumn("value", F.when(F.col("value") < 50000, 0.0).otherwise(F.col("value")))).select("feature", "sample", "value")


@R.add("Q04_robust_scale", f"""{_M}, s AS (SELECT feature, {_med('value')} AS mid, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM matrix GROUP BY 1)
    SELECT feature, sample, round((value - mid) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END, 8) AS value FROM matrix JOIN s USING (feature)""")
def q4(spark, d):
    return _out(X.scale(matrix(spark, d)), digits=8)


@R.add("Q04_standard_scale", f"""{_M}, s AS (SELECT feature, avg(value) FILTER (NOT is_qc) AS mid, stddev_pop(value) FILTER (NOT is_qc) AS sd FROM matrix GROUP BY 1)
    SELECT feature, sample, round((value - mid) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 8) AS value FROM matrix JOIN s USING (feature)""")
def q4b(spark, d):
    return _out(X.scale(matrix(spark, d), "standard", ~F.col("is_qc")), digits=8)


@R.add("Q18_log_ratio", f"""WITH {SQL_RECORDS} SELECT record_id, 'r' AS feature, round(neszumjoboside - log10(pow(10, gudsispetoside) + pow(10, gudbushotamide)), 8) AS value FROM records""")
def q18(spark, d):
    out = X.log_ratio(long_records(spark, d), "r", ["neszumjoboside"], ["gudsispetoside", "gudbushotamide"], "record_id")
    return out.select("record_id", "feature", F.round("value", 8).alias("value"))


@R.add("Q19_ratio_row", f"""WITH {SQL_RECORDS}, s AS (SELECT record_id, coalesce(pow(10, neszumjoboside), 0) + coalesce(pow(10, rolmabmuposide), 0) AS a, coalesce(pow(10, gudsispetoside), 0) AS b FROM records)
    SELECT record_id, 'r' AS feature, round(CASE WHEN a = 0 THEN NULL WHEN b = 0 THEN 'inf'::DOUBLE ELSE log10(a / b) END, 8) AS value FROM s""")
def q19(spark, d):
    out = X.log_ratio(long_records(spark, d), "r", ["neszumjoboside", "rolmabmuposide"], ["gudsispetoside"], "record_id", strict=False)
    return out.select("record_id", "feature", F.round("value", 8).alias("value"))


_POS = f"WITH {SQL_RECORDS}, pos AS (SELECT record_id, batch, coalesce(sample_type = 'qc', false) AS is_qc, row_number() OVER (PARTITION BY batch ORDER BY injection_order NULLS LAST, record_id) - 1 AS position FROM records)"


def _positions(spark, d) -> DataFrame:
    r = records(spark, d).withColumn("is_qc", F.coalesce(F.col("sample_type") == "qc", F.lit(False)))
    return X.positions(r, "injection_order", "record_id")


@R.add("N03_position", f"{_POS} SELECT record_id, batch, position FROM pos")
def n3(spark, d):
    return _positions(spark, d).select("record_id", "batch", F.col("position").cast("bigint").alias("position"))


_QC = """, q AS (SELECT batch, position AS qp, record_id AS qid FROM pos WHERE is_qc)"""


@R.add("J09_nearest_qc", f"""{_POS}{_QC}, c AS (SELECT p.record_id, qid, row_number() OVER (PARTITION BY p.record_id ORDER BY abs(p.position - qp), qp) AS r FROM pos p JOIN q ON p.batch IS NOT DISTINCT FROM q.batch)
    SELECT p.record_id, c.qid AS nearest FROM pos p LEFT JOIN c ON p.record_id = c.record_id AND r = 1""")
def j9(spark, d):
    p = _positions(spark, d).withColumn("q", F.when(F.col("is_qc"), F.col("record_id")))
    return X.nearest(p, ["batch"], "position", "q", "nearest").select("record_id", "nearest")


@R.add("J10_interpolate", f"""{_POS}{_QC}, a AS (SELECT p.record_id, max(qp) AS ap FROM pos p LEFT JOIN q ON p.batch IS NOT DISTINCT FROM q.batch AND qp <= p.position GROUP BY 1), b AS (SELECT p.record_id, min(qp) AS bp FROM pos p LEFT JOIN q ON p.batch IS NOT DISTINCT FROM q.batch AND qp >= p.position GROUP BY 1),
    j AS (SELECT p.*, ap, bp, qa.qid AS ay, qb.qid AS byy FROM pos p JOIN a USING (record_id) JOIN b USING (record_id) LEFT JOIN q qa ON qa.batch IS NOT DISTINCT FROM p.batch AND qa.qp = ap LEFT JOIN q qb ON qb.batch IS NOT DISTINCT FROM p.batch AND qb.qp = bp)
    SELECT record_id, round(CASE WHEN ay IS NULL THEN byy WHEN byy IS NULL OR ap = bp THEN ay ELSE ay + (byy - ay) * (position - ap) / (bp - ap) END, 6) AS y FROM j""")
def j10(spark, d):
    p = _positions(spark, d).withColumn("q", F.when(F.col("is_qc"), F.col("record_id").cast("double")))
    return X.interpolate(p, ["batch"], "position", "q", "y").select("record_id", F.round("y", 6).alias("y"))


def _ordered(spark, d) -> DataFrame:
    r = _positions(spark, d)
    out = r.unpivot(["record_id", "batch", "is_qc", "position"], ["neszumjoboside", "rolmabmuposide", "kashotpinic_acid", "gudsispetoside", "gudbushotamide", "garjevgaric_acid"], "feature", "value")
    return out.withColumn("value", F.pow(F.lit(10.0), "value"))


@R.add("Q01_drift_factors")
def q1(spark, d):
    return X.drift_factors(_ordered(spark, d))


@R.add("Q01_drift_correct")
def q1b(spark, d):
    return X.drift_correct(_ordered(spark, d)).select("batch", "record_id", "feature", "value")


@R.add("Q01c_drift_shared")
def q1c(spark, d):
    return X.drift_correct_shared(_ordered(spark, d)).select("batch", "record_id", "feature", "value")


@R.add("Q22_combat")
def q22(spark, d):
    return X.combat(matrix(spark, d).withColumn("value", F.log10("value")), floor_at_zero=False).select("feature", "sample", "batch", "value")


_RT = """WITH f AS (SELECT p_partkey AS row, p_brand AS base, p_size % 3 AS batch_pos, round(p_retailprice / 1000, 3) AS rt, p_brand || '_' || CAST(p_partkey AS VARCHAR) AS feature FROM part),
    g AS (SELECT *, sum(new) OVER (PARTITION BY base ORDER BY rt, batch_pos, row) AS grp FROM (SELECT *, CASE WHEN rt - lag(rt) OVER (PARTITION BY base ORDER BY rt, batch_pos, row) > 0.0035 THEN 1 ELSE 0 END AS new FROM f)),
    k AS (SELECT base, grp, arg_min(feature, (CASE WHEN batch_pos <> 0 THEN 1 ELSE 0 END, rt, batch_pos, row)) AS match_key FROM g GROUP BY 1, 2)"""


def _retention(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("row"), F.col("p_brand").alias("base"), (F.col("p_size") % 3).alias("batch_pos"), F.round(F.col("p_retailprice") / 1000, 3).alias("rt"), F.concat_ws("_", "p_brand", F.col("p_partkey").cast("string")).alias("feature"))


@R.add("J07_match_retention", f"{_RT} SELECT feature, match_key FROM g JOIN k USING (base, grp)")
def j7(spark, d):
    return M.match_retention(_retention(spark, d), 0.0035).select("feature", "match_key")


@R.add("J08_rename_average", f"{_RT}, v AS (SELECT p_brand || '_' || CAST(l_partkey AS VARCHAR) AS feature, l_suppkey AS sample, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT match_key AS feature, sample, round(avg(value), 6) AS value FROM v JOIN g USING (feature) JOIN k USING (base, grp) GROUP BY 1, 2")
def j8(spark, d):
    v = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.concat_ws("_", "p_brand", F.col("l_partkey").cast("string")).alias("feature"), F.col("l_suppkey").alias("sample")).agg(F.sum("l_quantity").alias("value"))
    return _out(M.rename_and_average(v, M.match_retention(_retention(spark, d), 0.0035), ("sample",)), digits=6)


@R.add("J01_labels", f"WITH {SQL_RECORDS}, lab AS (SELECT sample_id, max(classification) AS c FROM records WHERE classification IS NOT NULL AND sample_id IS NOT NULL GROUP BY 1) SELECT record_id, c FROM records LEFT JOIN lab USING (sample_id)")
def j1(spark, d):
    r = records(spark, d)
    lab = r.where("classification is not null and sample_id is not null").groupBy("sample_id").agg(F.max("classification").alias("c"))
    return r.join(lab, "sample_id", "left").select("record_id", "c")


@R.add("J02_injection_order", f"WITH {SQL_RECORDS}, o AS (SELECT record_id, injection_order AS o FROM records WHERE injection_order >= 0) SELECT record_id, coalesce(o, -1) AS o FROM records LEFT JOIN o USING (record_id)")
def j2(spark, d):
    r = records(spark, d)
    return r.select("record_id").join(r.where("injection_order >= 0").select("record_id", F.col("injection_order").alias("o")), "record_id", "left").select("record_id", F.coalesce("o", F.lit(-1)).alias("o"))


@R.add("J03_average_metadata", f"WITH {SQL_RECORDS} SELECT sample_id, arg_min(injection_order, (original_col, record_id)) AS injection_order, count(*) AS n FROM records WHERE sample_id IS NOT NULL GROUP BY 1")
def j3(spark, d):
    return records(spark, d).where("sample_id is not null").groupBy("sample_id").agg(F.min_by("injection_order", F.struct("original_col", "record_id")).alias("injection_order"), F.count(F.lit(1)).alias("n"))


@R.add("J04_align", f"WITH {SQL_RECORDS} SELECT DISTINCT sample_id FROM records WHERE sample_id IN (SELECT sample_id FROM pathway_stouffer_scores WHERE sample_id IS NOT NULL)")
def j4(spark, d):
    return records(spark, d).select("sample_id").join(table(spark, d, "pathway_stouffer_scores").select("sample_id"), "sample_id", "left_semi").distinct()


@R.add("J05_union_batches", f"{_M} SELECT feature, sample, value FROM matrix WHERE batch < 12 UNION ALL SELECT feature, sample, value FROM matrix WHERE batch >= 12")
def j5(spark, d):
    m = matrix(spark, d).select("feature", "sample", "batch", "value")
    return m.where("batch < 12").unionByName(m.where("batch >= 12")).drop("batch")


_TYPED = r"""WITH typed AS (SELECT DISTINCT feature FROM feature_to_hmdb WHERE regexp_full_match(feature, '[\x00-\x7f]*')), idx AS (SELECT DISTINCT upper(trim(n)) AS name, accession FROM (SELECT accession, unnest(list_concat([name, accession], coalesce(synonyms, []))) AS n FROM hmdb_metabolites) WHERE length(upper(trim(n))) >= 3),
    f AS (SELECT feature, upper(regexp_replace(regexp_replace(feature, '(\d)[wW](\d)', '\1OMEGA\2', 'g'), '^\s+|\s+$', '', 'g')) AS norm FROM typed), t AS (SELECT *, nullif(regexp_extract(norm, '(?:^|\.)(HMDB[0-9]{3,})$', 1), '') AS tag, regexp_replace(norm, '[^A-Z0-9]+', '', 'g') AS loose FROM f),
    lidx AS (SELECT DISTINCT regexp_replace(name, '[^A-Z0-9]+', '', 'g') AS loose, accession FROM idx), ex AS (SELECT feature, accession AS hmdb_id, 'name_exact' AS match_method FROM t JOIN idx ON norm = name WHERE tag IS NULL),
    lo AS (SELECT feature, accession AS hmdb_id, 'name_loose' AS match_method FROM t JOIN lidx USING (loose) WHERE tag IS NULL AND length(norm) >= 3 AND length(loose) >= 3 AND feature NOT IN (SELECT feature FROM ex)),
    found AS (SELECT feature, tag AS hmdb_id, 'hmdb_tag' AS match_method FROM t WHERE tag IS NOT NULL UNION SELECT * FROM ex UNION SELECT * FROM lo),
    matched AS (SELECT feature, hmdb_id, coalesce(match_method, 'unmatched') AS match_method, count(hmdb_id) OVER (PARTITION BY feature) AS n_hmdb_ids FROM t LEFT JOIN found USING (feature))"""


def _matched(spark, d) -> DataFrame:
    typed = table(spark, d, "feature_to_hmdb").where(F.col("feature").rlike(r"^[\x00-\x7f]*$")).select("feature")
    return M.match_features(typed, M.name_index(table(spark, d, "hmdb_metabolites")))


@R.add("J11_match_features", f"{_TYPED} SELECT feature, hmdb_id, match_method, n_hmdb_ids FROM matched")
def j11(spark, d):
    return _matched(spark, d)


def _matched_whole(spark, d) -> DataFrame:
    """All names; the twins of the queries on ``_matched`` stop at ASCII, as DuckDB has no NFKC."""
    every = table(spark, d, "feature_to_hmdb").where("feature is not null").select("feature")
    return M.match_features(every, M.name_index(table(spark, d, "hmdb_metabolites")))


@R.add("J11_match_features_whole")
def j11w(spark, d):
    return _matched_whole(spark, d)


_EDGES = """edges AS (SELECT DISTINCT smp_id, hmdb_id FROM biomarker_attachments WHERE smp_id LIKE 'SMP%' AND hmdb_id LIKE 'HMDB%')"""


def _edges(spark, d) -> DataFrame:
    return table(spark, d, "biomarker_attachments").where("smp_id like 'SMP%' and hmdb_id like 'HMDB%'").select("smp_id", "hmdb_id").distinct()


@R.add("J12_link_pathways", f"{_TYPED}, {_EDGES} SELECT DISTINCT feature, hmdb_id, smp_id FROM matched JOIN edges USING (hmdb_id)")
def j12(spark, d):
    return M.link_pathways(_matched(spark, d), _edges(spark, d))


@R.add("J12_link_pathways_whole")
def j12w(spark, d):
    return M.link_pathways(_matched_whole(spark, d), _edges(spark, d))


_COVER = f"""{_TYPED}, {_EDGES}, links AS (SELECT DISTINCT feature, hmdb_id, smp_id FROM matched JOIN edges USING (hmdb_id)), total AS (SELECT smp_id, count(DISTINCT hmdb_id) AS n FROM edges GROUP BY 1), hit AS (SELECT smp_id, count(DISTINCT hmdb_id) AS m, count(DISTINCT feature) AS f, array_to_string(list_sort(list(DISTINCT hmdb_id)), ';') AS ids FROM links GROUP BY 1),
    cover AS (SELECT smp_id, n AS n_metabolites, coalesce(m, 0) AS n_matched_metabolites, coalesce(f, 0) AS n_matched_features, coalesce(ids, '') AS ids, coalesce(m, 0) / n AS coverage FROM total LEFT JOIN hit USING (smp_id))"""


@R.add("J13_coverage", f"{_COVER} SELECT smp_id, n_metabolites, n_matched_metabolites, n_matched_features, ids, round(coverage, 8) AS coverage FROM cover WHERE coverage >= 0.2")
def j13(spark, d):
    return _coverage(_matched(spark, d), _edges(spark, d))


@R.add("J13_coverage_whole")
def j13w(spark, d):
    return _coverage(_matched_whole(spark, d), _edges(spark, d))


def _coverage(matched: DataFrame, e: DataFrame) -> DataFrame:
    c = M.coverage(M.link_pathways(matched, e), e, 0.2)
    return c.select("smp_id", "n_metabolites", "n_matched_metabolites", "n_matched_features", F.array_join("matched_metabolites", ";").alias("ids"), F.round("coverage", 8).alias("coverage"))


@R.add("J14_supersede", f"{_TYPED}, s AS (SELECT hmdb_id, min(feature) AS superseded_by FROM matched WHERE match_method IN ('override', 'hmdb_tag') AND hmdb_id IS NOT NULL GROUP BY 1) SELECT DISTINCT feature, hmdb_id, superseded_by FROM matched JOIN s USING (hmdb_id) WHERE match_method NOT IN ('override', 'hmdb_tag')")
def j14(spark, d):
    return M.supersede_plain(_matched(spark, d))[1]


@R.add("J14_supersede_whole")
def j14w(spark, d):
    return M.supersede_plain(_matched_whole(spark, d))[1]


_STORED = """stored AS (SELECT DISTINCT feature, upper(trim(hmdb_id)) AS hmdb_id FROM feature_to_hmdb WHERE feature IS NOT NULL AND trim(hmdb_id) <> ''), many AS (SELECT feature, hmdb_id, count(*) OVER (PARTITION BY feature) AS n_hmdb_ids FROM stored)"""


@R.add("J18_ambiguity_impact", f"""WITH {_STORED}, {_EDGES}, links AS (SELECT DISTINCT feature, hmdb_id, smp_id FROM many JOIN edges USING (hmdb_id)), n AS (SELECT feature, count(DISTINCT smp_id) AS n FROM links WHERE smp_id IN (SELECT pathway_id FROM pathway_names WHERE retired_at IS NULL) GROUP BY 1)
    SELECT feature, string_agg(hmdb_id, ',' ORDER BY hmdb_id) AS hmdb_ids, coalesce(max(n), 0) AS n_scored_pathways FROM many LEFT JOIN n USING (feature) WHERE n_hmdb_ids > 1 GROUP BY 1""")
def j18(spark, d):
    s = table(spark, d, "feature_to_hmdb").where("feature is not null and trim(hmdb_id) <> ''").select("feature", F.upper(F.trim("hmdb_id")).alias("hmdb_id")).distinct()
    s = s.withColumn("n_hmdb_ids", F.count(F.lit(1)).over(Window.partitionBy("feature")))
    live = table(spark, d, "pathway_names").where("retired_at is null").select(F.col("pathway_id").alias("smp_id"))
    return M.ambiguity_impact(s, M.link_pathways(s, _edges(spark, d)), live)


_ATT = "att AS (SELECT DISTINCT attachment_id, smp_id, pathway_name, hmdb_id FROM biomarker_attachments)"


@R.add("J15_attach", f"""WITH {_ATT}, kept AS (SELECT DISTINCT pathway_id AS smp_id, name AS pathway_name FROM pathway_names WHERE name IS NOT NULL), byname AS (SELECT lower(trim(pathway_name)) AS low, min(smp_id) AS named FROM kept GROUP BY 1 HAVING count(DISTINCT smp_id) = 1)
    SELECT attachment_id, hmdb_id, CASE WHEN smp_id IN (SELECT smp_id FROM kept) THEN smp_id WHEN smp_id IS NULL THEN named END AS pathway FROM att LEFT JOIN byname ON lower(trim(att.pathway_name)) = low
    WHERE CASE WHEN smp_id IN (SELECT smp_id FROM kept) THEN smp_id WHEN smp_id IS NULL THEN named END IS NOT NULL""")
def j15(spark, d):
    kept = table(spark, d, "pathway_names").where("name is not null").select(F.col("pathway_id").alias("smp_id"), F.col("name").alias("pathway_name")).distinct()
    att = table(spark, d, "biomarker_attachments").select("attachment_id", "smp_id", "pathway_name", "hmdb_id").distinct()
    return M.attach(att, kept).select("attachment_id", "hmdb_id", "pathway")


@R.add("J16_resolve_status", f"""WITH {_ATT} SELECT attachment_id, hmdb_id, smp_id, CASE WHEN smp_id IN (SELECT pathway_id FROM pathway_names) THEN 'kept' WHEN smp_id IS NOT NULL THEN 'not_in_kept_set' ELSE 'no_pathway' END AS pathway_status,
    CASE WHEN hmdb_id IN (SELECT hmdb_id FROM feature_to_hmdb WHERE hmdb_id IS NOT NULL) THEN 'scored' ELSE 'no_dataset_feature' END AS feature_status FROM (SELECT DISTINCT attachment_id, smp_id, hmdb_id FROM att)""")
def j16(spark, d):
    att = table(spark, d, "biomarker_attachments").select("attachment_id", "smp_id", "hmdb_id").distinct()
    return M.resolve_status(att, table(spark, d, "pathway_names").select(F.col("pathway_id").alias("smp_id")), table(spark, d, "feature_to_hmdb").select("hmdb_id").where("hmdb_id is not null")).select("attachment_id", "hmdb_id", "smp_id", "pathway_status", "feature_status")


@R.add("J17_unlinked", "SELECT DISTINCT hmdb_id FROM biomarker_attachments WHERE hmdb_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hmdb_metabolites WHERE accession = hmdb_id)")
def j17(spark, d):
    return table(spark, d, "biomarker_attachments").where("hmdb_id is not null").select("hmdb_id").join(table(spark, d, "hmdb_metabolites").select(F.col("accession").alias("hmdb_id")), "hmdb_id", "left_anti").distinct()


@R.add("J17_unlinked_audit")
def j17b(spark, d):
    """Metabolites as markers that no feature is linked to, and the features that have their name all the same."""
    f, entries = table(spark, d, "feature_to_hmdb"), table(spark, d, "hmdb_metabolites")
    markers = entries.select(F.upper(F.trim("accession")).alias("hmdb_id"), F.col("name").alias("marker"))
    return M.audit_unlinked(markers, f.select(F.upper(F.trim("hmdb_id")).alias("hmdb_id")), f, M.name_index(entries))


_COVSETS = f"cov AS (SELECT coverage_id, matched_metabolites FROM (SELECT *, row_number() OVER (PARTITION BY coverage_id ORDER BY loaded_at DESC) AS v FROM pathway_coverage WHERE coverage_id IS NOT NULL) WHERE v = 1), sets AS (SELECT DISTINCT coverage_id AS k, m FROM (SELECT coverage_id, unnest(matched_metabolites) AS m FROM cov) WHERE m IS NOT NULL)"


def _cover_sets(spark, d) -> DataFrame:
    c = latest_version(table(spark, d, "pathway_coverage"), "coverage_id", "loaded_at", ["coverage_id", "matched_metabolites"])
    return c.select(F.col("coverage_id").alias("k"), F.explode("matched_metabolites").alias("m"))


_JACC = """n AS (SELECT k, count(*) AS n FROM sets GROUP BY 1), pairs AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM sets a JOIN sets b ON a.m = b.m AND a.k < b.k GROUP BY 1, 2),
    similar_pairs AS (SELECT a, b, c AS "both", c / (x.n + y.n - c) AS jaccard FROM pairs JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE c / (x.n + y.n - c) >= 0.8)"""


@R.add("J23_similar_sets", f'WITH {_COVSETS}, {_JACC} SELECT a, b, "both", round(jaccard, 8) AS jaccard FROM similar_pairs')
def j23(spark, d):
    return M.similar_sets(_cover_sets(spark, d), "k", "m", 0.8).select("a", "b", "both", F.round("jaccard", 8).alias("jaccard"))


@R.add("Q20_components", f"""WITH RECURSIVE {_COVSETS}, {_JACC}, e AS (SELECT a AS u, b AS v FROM similar_pairs UNION SELECT b, a FROM similar_pairs), reach AS (SELECT DISTINCT k AS key, k AS pt FROM sets UNION SELECT key, v FROM reach JOIN e ON pt = u)
    SELECT key, min(pt) AS component FROM reach GROUP BY 1""")
def q20(spark, d):
    s = _cover_sets(spark, d)
    return M.components(s.select(F.col("k").alias("key")).distinct(), M.similar_sets(s, "k", "m", 0.8).select("a", "b"))


@R.add("N01_injection_order", f"WITH {SQL_RECORDS}, f AS (SELECT sample_id AS name, min(acquired_at) AS at_ FROM records WHERE sample_id IS NOT NULL GROUP BY 1) SELECT name, row_number() OVER (ORDER BY at_ NULLS LAST, name) - 1 AS injection_order FROM f")
def n1(spark, d):
    return M.injection_order(records(spark, d).where("sample_id is not null"), F.col("sample_id"), "acquired_at").select("name", F.col("injection_order").cast("bigint").alias("injection_order"))


@R.add("N02_occurrence", "SELECT attachment_id, loaded_at, source, row_number() OVER (PARTITION BY attachment_id ORDER BY loaded_at, source NULLS FIRST) AS occurrence FROM biomarker_attachments")
def n2(spark, d):
    w = Window.partitionBy("attachment_id").orderBy("loaded_at", F.asc_nulls_first("source"))
    return table(spark, d, "biomarker_attachments").select("attachment_id", "loaded_at", "source", F.row_number().over(w).cast("bigint").alias("occurrence"))


@R.add("N05_keep_first", f"WITH {SQL_RECORDS} SELECT sample_id, arg_min(record_id, (acquired_at, record_id)) AS record_id FROM records WHERE sample_id IS NOT NULL GROUP BY 1")
def n5(spark, d):
    return records(spark, d).where("sample_id is not null").groupBy("sample_id").agg(F.min_by("record_id", F.struct("acquired_at", "record_id")).alias("record_id"))


@R.add("N07_rank", "SELECT c_custkey, 1 + (SELECT count(*) FROM customer d WHERE d.c_mktsegment = c.c_mktsegment AND d.c_acctbal > c.c_acctbal) AS rank FROM customer c")
def n7(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.rank().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"))).cast("bigint").alias("rank"))


@R.add("U01_intersect", "SELECT DISTINCT hmdb_id FROM feature_to_hmdb WHERE hmdb_id IS NOT NULL INTERSECT SELECT accession FROM hmdb_metabolites")
def u1(spark, d):
    return table(spark, d, "feature_to_hmdb").where("hmdb_id is not null").select("hmdb_id").intersect(table(spark, d, "hmdb_metabolites").select("accession"))


@R.add("U02_except", "SELECT accession FROM hmdb_metabolites EXCEPT SELECT hmdb_id FROM biomarker_attachments")
def u2(spark, d):
    return table(spark, d, "hmdb_metabolites").select("accession").subtract(table(spark, d, "biomarker_attachments").select("hmdb_id"))


@R.add("U03_union", "SELECT smp_id FROM biomarker_attachments UNION SELECT smp_id FROM pathway_coverage")
def u3(spark, d):
    return table(spark, d, "biomarker_attachments").select("smp_id").union(table(spark, d, "pathway_coverage").select("smp_id")).distinct()
