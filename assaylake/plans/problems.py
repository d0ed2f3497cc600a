"""The pN_ queries of the core operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.common import clean, latest_version, table
from assaylake.operators.impute import fill_from_donors, nearest_donors, with_prediction
from assaylake.operators.references import normal_key, orphan_references, orphan_report
from assaylake.session import Scratch

#: Valid labels by field; anything else is missing.
VALID = {"classification": (0, 1, 2, 3), "oordeel_targeted": (0, 1)}
FEATURES = ("neszumjoboside", "rolmabmuposide", "kashotpinic_acid", "gudsispetoside", "gudbushotamide", "garjevgaric_acid")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest records with their valid labels and the time in microseconds, as a written table: every field reads it several times."""
    merged = table(spark, sf_dir, "merged_data_with_classification")
    rows = latest_version(merged, "record_id", "loaded_at", ["record_id", "sample_id", *VALID, "acquired_at"])
    valid = [F.when(F.col(f).isin(*map(float, ok)), F.col(f).cast("int")).alias(f) for f, ok in VALID.items()]
    return Scratch(spark).write(rows.select("record_id", "sample_id", F.unix_micros(F.col("acquired_at").cast("timestamp")).alias("t"), *valid), "labels")


def p4_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing labels by predictive mean matching: each field is fitted on time within the samples, and the record of the sample with the nearest prediction gives its value."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("v")) for f in VALID])).alias("f")
    rows = _labels(spark, sf_dir).select("record_id", "sample_id", "t", cells).select("record_id", "sample_id", "t", "f.*")
    fitted = with_prediction(rows, ["sample_id", "field_name"], "v", ["t"], fit_by="field_name")
    return nearest_donors(fitted, "record_id", ["sample_id", "field_name"], "v", "prediction", along="t")


def p4_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records with both labels filled where a donor exists, and the mark and donor of every filled cell; -1 stands for none."""
    rows = _labels(spark, sf_dir)
    for f in VALID:
        rows = fill_from_donors(with_prediction(rows, ["sample_id"], f, ["t"]), "record_id", ["sample_id"], f, "prediction", along="t").drop("prediction")
    none = [F.coalesce(c, F.lit(-1)).alias(c) for f in VALID for c in (f, f"{f}_donor")]
    return rows.select("record_id", "sample_id", *none, *[f"{f}_filled" for f in VALID])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_donors(spark, sf_dir).select("record_id", "field_name", "filled")


def p4_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing feature cells from the record of the same batch with the nearest predicted value."""
    merged = table(spark, sf_dir, "merged_data_with_classification")
    rows = latest_version(merged, "record_id", "loaded_at", ["record_id", "batch", *FEATURES])
    rows = Scratch(spark).write(rows.select("record_id", "batch", *[clean(F.col(f)).alias(f) for f in FEATURES]), "features")
    out = []
    for f in FEATURES:
        fitted = with_prediction(rows, ["batch"], f, [x for x in FEATURES if x != f])
        out.append(nearest_donors(fitted, "record_id", ["batch"], f, "prediction").select("record_id", F.lit(f).alias("feature"), "filled", "donor_id"))
    return reduce(DataFrame.unionByName, out)


def p5_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    attached = latest_version(table(spark, sf_dir, "biomarker_attachments"), "attachment_id", "loaded_at", ["attachment_id", "smp_id", "hmdb_id", "attached_at"])
    coverage = latest_version(table(spark, sf_dir, "pathway_coverage"), "coverage_id", "loaded_at", ["coverage_id", "smp_id", "computed_at"])
    ref = lambda df, name, row, field, parent, at: df.select(F.lit(name).alias("table_name"), F.col(row).alias("row_id"), F.lit(field).alias("field_name"), F.lit(parent).alias("parent"), normal_key(F.col(field)).alias("key"), F.col(at).alias("at"))
    refs = (
        ref(attached, "biomarker_attachments", "attachment_id", "smp_id", "pathway", "attached_at")
        .unionByName(ref(attached, "biomarker_attachments", "attachment_id", "hmdb_id", "metabolite", "attached_at"))
        .unionByName(ref(coverage, "pathway_coverage", "coverage_id", "smp_id", "pathway", "computed_at"))
    )
    pathways = table(spark, sf_dir, "pathway_names").select(F.lit("pathway").alias("parent"), normal_key(F.col("pathway_id")).alias("key"), F.col("added_at").alias("live_from"), F.col("retired_at").alias("live_to"))
    metabolites = table(spark, sf_dir, "hmdb_metabolites").select(F.lit("metabolite").alias("parent"), normal_key(F.col("accession")).alias("key"), F.col("added_at").alias("live_from"), F.col("withdrawn_at").alias("live_to"))
    return orphan_references(refs, pathways.unionByName(metabolites))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_orphans(spark, sf_dir).select("table_name", "row_id", "field_name")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p5_orphans(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p4_found, p4_donors, p4_filled, p4_features, p5_found, p5_report)}


def _latest(name: str, key: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC) AS version FROM {name} WHERE {key} IS NOT NULL) WHERE version = 1)"


_CELLS = f"""WITH cells AS (
    SELECT record_id, sample_id, 'classification' AS field_name, acquired_at, CASE WHEN classification IN (0, 1, 2, 3) THEN CAST(classification AS INTEGER) END AS v
    FROM {_latest("merged_data_with_classification", "record_id")} m UNION ALL
    SELECT record_id, sample_id, 'oordeel_targeted', acquired_at, CASE WHEN oordeel_targeted IN (0, 1) THEN CAST(oordeel_targeted AS INTEGER) END
    FROM {_latest("merged_data_with_classification", "record_id")} m),
    ranked AS (SELECT a.record_id, a.sample_id, a.field_name, b.v AS filled, b.record_id AS donor_id, abs(epoch_us(a.acquired_at) - epoch_us(b.acquired_at)) AS distance,
    row_number() OVER (PARTITION BY a.record_id, a.field_name ORDER BY abs(epoch_us(a.acquired_at) - epoch_us(b.acquired_at)), b.acquired_at, b.record_id) AS r
    FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND a.field_name = b.field_name AND a.v IS NULL AND b.v IS NOT NULL)"""
_key = lambda c: f"nullif(upper(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"
_REFS = f"""WITH refs AS (
    SELECT 'biomarker_attachments' AS table_name, attachment_id AS row_id, 'smp_id' AS field_name, 'pathway' AS parent, {_key("smp_id")} AS key, attached_at AS at FROM {_latest("biomarker_attachments", "attachment_id")} a
    UNION ALL SELECT 'biomarker_attachments', attachment_id, 'hmdb_id', 'metabolite', {_key("hmdb_id")}, attached_at FROM {_latest("biomarker_attachments", "attachment_id")} a
    UNION ALL SELECT 'pathway_coverage', coverage_id, 'smp_id', 'pathway', {_key("smp_id")}, computed_at FROM {_latest("pathway_coverage", "coverage_id")} c),
    parents AS (SELECT 'pathway' AS parent, {_key("pathway_id")} AS key, added_at AS a, retired_at AS z FROM pathway_names
    UNION ALL SELECT 'metabolite', {_key("accession")}, added_at, withdrawn_at FROM hmdb_metabolites),
    orphans AS (SELECT * FROM refs r WHERE key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM parents p WHERE p.parent = r.parent AND p.key = r.key AND p.a <= r.at AND (p.z IS NULL OR p.z > r.at)))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"{_CELLS} SELECT record_id, field_name, filled FROM ranked WHERE r = 1",
        "p4_donors": f"{_CELLS} SELECT record_id, sample_id, field_name, filled, donor_id, distance FROM ranked WHERE r = 1",
        "p4_filled": f"""{_CELLS}, best AS (SELECT * FROM ranked WHERE r = 1), c AS (SELECT * FROM best WHERE field_name = 'classification'), o AS (SELECT * FROM best WHERE field_name = 'oordeel_targeted')
            SELECT a.record_id, a.sample_id, coalesce(a.v, c.filled, -1) AS classification, c.record_id IS NOT NULL AS classification_filled, coalesce(c.donor_id, -1) AS classification_donor,
            coalesce(b.v, o.filled, -1) AS oordeel_targeted, o.record_id IS NOT NULL AS oordeel_targeted_filled, coalesce(o.donor_id, -1) AS oordeel_targeted_donor
            FROM cells a JOIN cells b ON a.record_id = b.record_id AND a.field_name = 'classification' AND b.field_name = 'oordeel_targeted'
            LEFT JOIN c ON c.record_id = a.record_id LEFT JOIN o ON o.record_id = a.record_id""",
        "p5_found": f"{_REFS} SELECT table_name, row_id, field_name FROM orphans",
        "p5_report": f"""{_REFS} SELECT table_name, field_name, strftime(o.at, '%Y-%m') AS month, CASE
            WHEN NOT EXISTS (SELECT 1 FROM parents p WHERE p.parent = o.parent AND p.key = o.key AND p.a IS NOT NULL) THEN 'missing'
            WHEN o.at IS NULL THEN 'undated'
            WHEN NOT EXISTS (SELECT 1 FROM parents p WHERE p.parent = o.parent AND p.key = o.key AND p.a <= o.at) THEN 'late'
            ELSE 'deleted' END AS status, count(*) AS n FROM orphans o GROUP BY ALL""",
    }
