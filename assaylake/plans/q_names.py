"""Queries of the name functions (T) and label rules (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.common import table
from assaylake.functions import names as N
from assaylake.operators import labels as L
from assaylake.plans.registry import Registry
from assaylake.plans.views import SQL_RECORDS, records

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
_COLS = f"WITH {SQL_RECORDS}, cols AS (SELECT record_id, original_col, sample_id, sample_type FROM records)"
_BASE = r"regexp_replace(original_col, '^.*[\\/]', '')"
_STEM = rf"trim(regexp_replace(regexp_replace({_BASE}, '\.raw.*$', ''), ' \(.*$', ''))"


@R.add("T01_clean_name", f"{_COLS} SELECT record_id, regexp_replace({_STEM}, '_[12]$', '') AS name FROM cols")
def t1(spark, d):
    return records(spark, d).select("record_id", N.clean_name(F.col("original_col")).alias("name"))


@R.add("T02_clean_name_anywhere", f"{_COLS} SELECT record_id, CASE WHEN lower({_STEM}) LIKE '%expqc%' THEN {_STEM} ELSE replace(replace({_STEM}, '_1', ''), '_2', '') END AS name FROM cols")
def t2(spark, d):
    return records(spark, d).select("record_id", N.clean_name_keep_qc(F.col("original_col"), as_written=True).alias("name"))


@R.add("T02_clean_name_keep_qc", f"{_COLS} SELECT record_id, CASE WHEN lower({_STEM}) LIKE '%expqc%' THEN {_STEM} ELSE regexp_replace({_STEM}, '_[12]$', '') END AS name FROM cols")
def t2b(spark, d):
    return records(spark, d).select("record_id", N.clean_name_keep_qc(F.col("original_col")).alias("name"))


@R.add("T03_batch", rf"""{_COLS} SELECT record_id, coalesce(nullif(regexp_extract({_BASE}, 'posneg_([A-Z]+\d+_\d+)', 1), ''), nullif(regexp_extract({_BASE}, 'Posneg_([A-Z]+\d+_\d+)', 1), ''),
    nullif(regexp_extract({_BASE}, '([A-Z]+\d+_\d+)', 1), ''), 'UNKNOWN') AS batch_name FROM cols""")
def t3(spark, d):
    return records(spark, d).select("record_id", N.batch_of(F.col("original_col")).alias("batch_name"))


_SAMPLE = r"regexp_replace(trim(split_part(trim(split_part(split_part(original_col, 'Area: ', 2), ' (', 1)), '.raw', 1)), '_[12]$', '')"


@R.add("T04_sample_id", f"{_COLS} SELECT record_id, CASE WHEN original_col LIKE '%Area: %' THEN trim({_SAMPLE}) END AS sample FROM cols")
def t4(spark, d):
    return records(spark, d).select("record_id", N.sample_of(F.col("original_col")).alias("sample"))


@R.add("T05_sample_type", f"""{_COLS} SELECT record_id, CASE WHEN lower(sample_id) LIKE '%expqc%' THEN 'QC' WHEN lower(sample_id) LIKE '%blanco%' THEN 'blanco' WHEN lower(sample_id) LIKE '%blauw%' THEN 'blauw'
    WHEN lower(sample_id) LIKE '%mix%' THEN 'Mix' ELSE 'Sample' END AS kind FROM cols""")
def t5(spark, d):
    return records(spark, d).select("record_id", N.sample_type_of(F.col("sample_id")).alias("kind"))


@R.add("T06_numeric_id", f"{_COLS} SELECT record_id, coalesce(list_filter(string_split(sample_id, '_'), lambda x: regexp_full_match(x, '[0-9]+'))[-1], string_split(sample_id, '_')[-1]) AS number FROM cols")
def t6(spark, d):
    return records(spark, d).select("record_id", N.numeric_id(F.col("sample_id")).alias("number"))


@R.add("T08_strip_area", rf"{_COLS} SELECT record_id, regexp_replace(regexp_replace(original_col, '^Area:\s*', '', 'i'), '\.raw$', '', 'i') AS name FROM cols")
def t8(spark, d):
    return records(spark, d).select("record_id", N.strip_area(F.col("original_col")).alias("name"))


@R.add("T09_feature_key", r"""WITH keys AS (SELECT p_partkey, p_brand || '_' || CAST(p_size AS VARCHAR) || '.5' || CASE WHEN p_partkey % 3 = 0 THEN ' ' || CAST(p_partkey % 4 AS VARCHAR) ELSE '' END AS key FROM part),
    cut AS (SELECT *, nullif(regexp_extract(key, ' (\d+)$', 1), '') AS n, regexp_replace(key, ' \d+$', '') AS rest FROM keys)
    SELECT p_partkey, regexp_extract(rest, '^(.*)_[^_]*$', 1) AS base, coalesce(try_cast(regexp_extract(rest, '_([^_]*)$', 1) AS DOUBLE), 0.0) AS rt, coalesce(n, '1') AS n FROM cut""")
def t9(spark, d):
    key = F.concat(F.col("p_brand"), F.lit("_"), F.col("p_size").cast("string"), F.lit(".5"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), (F.col("p_partkey") % 4).cast("string"))).otherwise(""))
    return table(spark, d, "part").select("p_partkey", *[c.alias(k) for k, c in N.feature_key_parts(key).items()])


_ASCII = "feature IS NOT NULL AND regexp_full_match(feature, '[\\x00-\\x7f]*')"
_NORMAL = r"upper(regexp_replace(regexp_replace(feature, '(\d)[wW](\d)', '\1OMEGA\2', 'g'), '^\s+|\s+$', '', 'g'))"


def _typed(spark, d):
    return table(spark, d, "feature_to_hmdb").where(F.col("feature").rlike(r"^[\x00-\x7f]*$")).select("feature").distinct()


@R.add("T10_normal_name", f"SELECT DISTINCT feature, {_NORMAL} AS name FROM feature_to_hmdb WHERE {_ASCII}")
def t10(spark, d):
    return _typed(spark, d).select("feature", N.normal_name(F.col("feature")).alias("name"))


@R.add("T11_loose_name", f"SELECT DISTINCT feature, regexp_replace({_NORMAL}, '[^A-Z0-9]+', '', 'g') AS name FROM feature_to_hmdb WHERE {_ASCII}")
def t11(spark, d):
    return _typed(spark, d).select("feature", N.loose_name(F.col("feature")).alias("name"))


@R.add("T12_accession_tag", f"SELECT DISTINCT feature, nullif(regexp_extract({_NORMAL}, '(?:^|\\.)(HMDB[0-9]{{3,}})$', 1), '') AS tag FROM feature_to_hmdb WHERE {_ASCII}")
def t12(spark, d):
    return _typed(spark, d).select("feature", N.accession_tag(N.normal_name(F.col("feature"))).alias("tag"))


# DuckDB has no NFKC, so the twins above hold for ASCII names only; these three run on every name and have no twin.
def _every(spark, d):
    return table(spark, d, "feature_to_hmdb").where("feature is not null").select("feature").distinct()


@R.add("T10_normal_name_whole")
def t10w(spark, d):
    return _every(spark, d).select("feature", N.normal_name(F.col("feature")).alias("name"))


@R.add("T11_loose_name_whole")
def t11w(spark, d):
    return _every(spark, d).select("feature", N.loose_name(F.col("feature")).alias("name"))


@R.add("T12_accession_tag_whole")
def t12w(spark, d):
    return _every(spark, d).select("feature", N.accession_tag(N.normal_name(F.col("feature"))).alias("tag"))


@R.add("T13_split_outside", "SELECT DISTINCT accession, list_filter([trim(name), trim(coalesce(formula, ''))], lambda x: x <> '') AS parts FROM hmdb_metabolites WHERE name IS NOT NULL AND name NOT LIKE '%;%'")
def t13(spark, d):
    text = F.concat(F.col("name"), F.lit(" ; "), F.coalesce("formula", F.lit("")), F.lit(";"))
    return table(spark, d, "hmdb_metabolites").where("name is not null and name not like '%;%'").select("accession", N.split_outside(text).alias("parts")).distinct()


@R.add("T14_marker", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'up' WHEN p_partkey % 3 = 1 THEN 'down' ELSE '' END AS direction, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS marker FROM part""")
def t14(spark, d):
    arrow = F.when(F.col("p_partkey") % 3 == 0, " ↑").when(F.col("p_partkey") % 3 == 1, "* ↓").otherwise("  ")
    text = F.concat("p_name", arrow)
    return table(spark, d, "part").select("p_partkey", N.marker_direction(text).alias("direction"), N.marker_name(text).alias("marker"))


@R.add("T15_plain_pathway", "SELECT DISTINCT pathway_id, trim(name) AS pathway FROM pathway_names WHERE name IS NOT NULL")
def t15(spark, d):
    text = F.concat(F.col("name"), F.lit(" (PathBank PW"), F.regexp_extract("pathway_id", r"(\d+)", 1), F.lit(")"))
    return table(spark, d, "pathway_names").where("name is not null").select("pathway_id", N.plain_pathway(text).alias("pathway")).distinct()


@R.add("T17_slug", r"SELECT DISTINCT name, coalesce(nullif(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'disease') AS slug FROM pathway_names WHERE name IS NOT NULL")
def t17(spark, d):
    return table(spark, d, "pathway_names").where("name is not null").select("name", N.slug(F.col("name")).alias("slug")).distinct()


@R.add("T18_qc_union", f"{_COLS} SELECT record_id, (coalesce(sample_type = 'QC', false) OR coalesce(contains(sample_id, 'expQC') OR contains(sample_id, 'QC3'), false)) AS is_qc FROM cols")
def t18(spark, d):
    return records(spark, d).select("record_id", N.is_qc_union(F.col("sample_id"), F.col("sample_type"), "expQC", "QC3").alias("is_qc"))


@R.add("T19_qc_fold", f"{_COLS} SELECT record_id, (coalesce(lower(sample_type) = 'qc', false) OR coalesce(contains(lower(original_col), 'expqc') OR contains(lower(original_col), 'qc3'), false)) AS is_qc FROM cols")
def t19(spark, d):
    return records(spark, d).select("record_id", N.is_qc_fold(F.col("original_col"), F.col("sample_type"), "expQC", "QC3").alias("is_qc"))


@R.add("T20_qc_fallback", f"""{_COLS}, f AS (SELECT record_id, contains(lower(original_col), 'expqc') AS a, contains(lower(original_col), 'qc3') AS b FROM cols)
    SELECT record_id, CASE WHEN (SELECT bool_or(a) FROM f) THEN coalesce(a, false) ELSE coalesce(b, false) END AS is_qc FROM f""")
def t20(spark, d):
    rows = records(spark, d)
    return L.qc_with_fallback(rows, "original_col", "expQC", "QC3").select("record_id", "is_qc")


@R.add("T21_blank", f"{_COLS} SELECT record_id, (coalesce(lower(sample_type) = 'blank', false) OR coalesce(contains(lower(original_col), 'blanco') OR contains(lower(original_col), 'blank'), false)) AS is_blank FROM cols")
def t21(spark, d):
    c = F.coalesce(F.lower("sample_type") == "blank", F.lit(False)) | N.contains_any(F.col("original_col"), ["blanco", "blank"])
    return records(spark, d).select("record_id", c.alias("is_blank"))


@R.add("T22_select_columns", f"{_COLS} SELECT DISTINCT original_col FROM cols WHERE contains(lower(original_col), 'mz31') AND NOT starts_with(original_col, 'QC')")
def t22(spark, d):
    c = F.col("original_col")
    return records(spark, d).where(N.contains_any(c, ["MZ31"]) & ~c.startswith("QC")).select(c).distinct()


@R.add("T23_group_code", f"{_COLS} SELECT record_id, CASE WHEN contains(lower(sample_id), 'qc3') AND NOT contains(lower(sample_id), 'expqc_3') THEN 1 WHEN contains(lower(sample_id), 'qc4') THEN 2 ELSE 0 END AS code FROM cols")
def t23(spark, d):
    return records(spark, d).select("record_id", N.group_code(F.col("sample_id")).alias("code"))


@R.add("T24_truth", f"WITH {SQL_RECORDS} SELECT record_id, coalesce(classification = 1, false) AS flag FROM records")
def t24(spark, d):
    return records(spark, d).select("record_id", N.truth(F.col("classification")).alias("flag"))


@R.add("T26_scalars", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(log10(l_extendedprice), 9) AS lg, round(ln(l_extendedprice + 1), 9) AS l1, round(exp(l_discount), 9) AS ex, round(pow(10, l_tax), 9) AS pw,
    least(greatest(l_quantity, 5.0), 40.0) AS clipped FROM lineitem""")
def t26(spark, d):
    x = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.log10(x), 9).alias("lg"), F.round(F.log1p(x), 9).alias("l1"), F.round(F.exp("l_discount"), 9).alias("ex"), F.round(F.pow(F.lit(10.0), "l_tax"), 9).alias("pw"), L.clip(F.col("l_quantity"), 5.0, 40.0).alias("clipped"))


_LAB = f"WITH {SQL_RECORDS}"


@R.add("L01_confident_normals", f"{_LAB} SELECT record_id, CASE WHEN classification = 0 AND oordeel_targeted = 0 THEN 0 ELSE 1 END AS label FROM records WHERE classification IS NOT NULL AND oordeel_targeted IS NOT NULL")
def l1(spark, d):
    return L.label_rows(records(spark, d), "confident_normals").select("record_id", "label")


@R.add("L02_oordeel", f"{_LAB} SELECT record_id, CAST(oordeel_targeted AS INTEGER) AS label FROM records WHERE classification IS NOT NULL AND oordeel_targeted IN (0, 1)")
def l2(spark, d):
    return L.label_rows(records(spark, d), "oordeel").select("record_id", "label")


@R.add("L03_binary_simplified", f"{_LAB} SELECT record_id, CASE WHEN classification = 1 THEN 1 ELSE 0 END AS label FROM records WHERE classification IN (0, 1, 3) AND oordeel_targeted IS NOT NULL")
def l3(spark, d):
    return L.label_rows(records(spark, d), "binary_simplified").select("record_id", "label")


@R.add("L04_default", f"""{_LAB} SELECT record_id, CASE WHEN classification = 0 AND oordeel_targeted = 0 THEN 0 ELSE 1 END AS label FROM records
    WHERE classification IS NOT NULL AND oordeel_targeted IS NOT NULL AND NOT (classification IN (2, 3) AND oordeel_targeted = 0)""")
def l4(spark, d):
    return L.label_rows(records(spark, d), "default").select("record_id", "label")


@R.add("L06_lab_roles", f"""{_LAB} SELECT record_id, CASE WHEN classification IS NULL OR oordeel_targeted IS NULL THEN NULL WHEN classification = 0 AND oordeel_targeted = 0 THEN 'inlier'
    WHEN classification = 1 AND oordeel_targeted = 1 AND coalesce(non_treated = 1, false) THEN 'outlier' ELSE 'gray' END AS role FROM records""")
def l6(spark, d):
    return records(spark, d).select("record_id", L.lab_role(F.col("classification"), F.col("oordeel_targeted"), F.col("non_treated")).alias("role"))


@R.add("L07_normal_reference", f"{_LAB} SELECT record_id, coalesce(classification = 0 AND oordeel_targeted = 0, false) AS is_normal FROM records")
def l7(spark, d):
    return records(spark, d).select("record_id", L.is_normal(F.col("classification"), F.col("oordeel_targeted")).alias("is_normal"))


@R.add("L08_groups", f"{_LAB} SELECT record_id, CASE WHEN coalesce(classification = 0 AND oordeel_targeted = 0, false) THEN 'normal' WHEN coalesce(classification = 1, false) THEN 'imd' ELSE 'other' END AS grp FROM records")
def l8(spark, d):
    return records(spark, d).select("record_id", L.group_of(F.col("classification"), F.col("oordeel_targeted")).alias("grp"))


@R.add("L09_kfold", f"""{_LAB}, o AS (SELECT sample_id, max(coalesce(classification, -1)) AS c FROM records WHERE sample_id IS NOT NULL GROUP BY 1)
    SELECT sample_id, CAST((row_number() OVER (PARTITION BY c ORDER BY md5(sample_id || ':7'), sample_id) - 1) % 5 AS INTEGER) AS fold FROM o""")
def l9(spark, d):
    o = records(spark, d).where("sample_id is not null").groupBy("sample_id").agg(F.max(F.coalesce("classification", F.lit(-1.0))).alias("c"))
    return L.stratified_folds(o, "sample_id", "c", 5, 7).select("sample_id", "fold")


@R.add("Q15_stratified_split", f"""{_LAB}, o AS (SELECT sample_id, max(coalesce(classification, -1)) AS c FROM records WHERE sample_id IS NOT NULL GROUP BY 1),
    r AS (SELECT sample_id, row_number() OVER (PARTITION BY c ORDER BY md5(sample_id || ':11'), sample_id) AS r, count(*) OVER (PARTITION BY c) AS n FROM o)
    SELECT sample_id, r <= round_even(n * 0.5, 0) AS is_validation FROM r""")
def q15(spark, d):
    o = records(spark, d).where("sample_id is not null").groupBy("sample_id").agg(F.max(F.coalesce("classification", F.lit(-1.0))).alias("c"))
    return L.stratified_split(o, "sample_id", "c", 0.5, 11).select("sample_id", "is_validation")


@R.add("L10_error_lists", f"""{_LAB}, r AS (SELECT record_id, CASE WHEN classification IS NULL OR oordeel_targeted IS NULL THEN NULL WHEN classification = 0 AND oordeel_targeted = 0 THEN 'inlier'
    WHEN classification = 1 AND oordeel_targeted = 1 AND coalesce(non_treated = 1, false) THEN 'outlier' ELSE 'gray' END AS role, coalesce(neszumjoboside > 5.2, false) AS flagged FROM records)
    SELECT record_id, CASE WHEN role = 'outlier' AND NOT flagged THEN 'fn' WHEN role = 'inlier' AND flagged THEN 'fp' WHEN role = 'gray' AND flagged THEN 'gray' END AS list FROM r
    WHERE (role = 'outlier' AND NOT flagged) OR (role = 'inlier' AND flagged) OR (role = 'gray' AND flagged)""")
def l10(spark, d):
    r = records(spark, d).select("record_id", L.lab_role(F.col("classification"), F.col("oordeel_targeted"), F.col("non_treated")).alias("role"), F.coalesce(F.col("neszumjoboside") > 5.2, F.lit(False)).alias("flagged"))
    return L.error_lists(r).select("record_id", "list")


@R.add("L11_missed_by_both", f"""{_LAB} SELECT record_id FROM records WHERE classification = 1 AND oordeel_targeted = 1 AND non_treated = 1 AND NOT coalesce(neszumjoboside > 5.2, false) AND NOT coalesce(rolmabmuposide > 5.2, false)""")
def l11(spark, d):
    r = records(spark, d).select("record_id", L.lab_role(F.col("classification"), F.col("oordeel_targeted"), F.col("non_treated")).alias("role"), F.coalesce(F.col("neszumjoboside") > 5.2, F.lit(False)).alias("a"), F.coalesce(F.col("rolmabmuposide") > 5.2, F.lit(False)).alias("b"))
    return r.where("role = 'outlier' and not a and not b").select("record_id")


@R.add("M20_class_distribution", f"{_LAB} SELECT classification, count(*) AS n FROM records GROUP BY 1")
def m20(spark, d):
    return records(spark, d).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))
