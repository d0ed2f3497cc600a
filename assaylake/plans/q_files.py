"""Queries of readers and writers: whole tables are written in the format of a reader and read back."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.common import table
from assaylake.functions import names as N
from assaylake.plans.registry import Registry
from assaylake.plans.views import SQL_LONG, SQL_MATRIX, SQL_RECORDS, long_records, matrix, records
from assaylake.session import Scratch
from assaylake.sources import readers, writers

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
_R, _M, _L = f"WITH {SQL_RECORDS}", f"WITH {SQL_MATRIX}", f"WITH {SQL_LONG}"
#: Text without surrounding white space, NULL if nothing is left, in SQL and in Spark.
_text = lambda c: f"nullif(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '')"
_plain = lambda c: F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
SEPARATORS = (";", "|", ",", "\t")


@R.add("R02_sniffed_delimiter", "SELECT accession, coalesce(nullif(formula, ''), '-') AS formula, kind FROM hmdb_metabolites, (SELECT unnest([0, 1, 2, 3]) AS kind)")
def r2(spark, d):
    t = table(spark, d, "hmdb_metabolites").select("accession", F.coalesce(F.nullif("formula", F.lit("")), F.lit("-")).alias("formula"))
    out, scratch = [], Scratch(spark)
    for k, sep in enumerate(SEPARATORS):
        writers.write_delimited(t, scratch.path(f"sniff{k}"), sep)
        out.append(readers.read_text_table(spark, scratch.path(f"sniff{k}")).select("accession", "formula", F.lit(k).alias("kind")))
    return reduce(DataFrame.unionByName, out)


@R.add("R03_batch_file", f"{_M} SELECT feature || '_C6H12_1.5' AS feature, 'Area: S' || sample AS original_col, value FROM matrix")
def r3(spark, d):
    m = matrix(spark, d).select(F.col("feature").alias("Name"), F.lit("C6H12").alias("Formula"), F.lit("1.5").alias("RT [min]"), F.concat(F.lit("Area: S"), F.col("sample").cast("string")).alias("c"), "value")
    scratch = Scratch(spark)
    path = scratch.path("batch.csv")
    # The writer reads it twice, for the columns and for the cells.
    writers.write_wide(scratch.write(m, "batch"), ["Name", "Formula", "RT [min]"], "c", "value", path)
    return readers.read_batch_file(spark, path).where("value is not null").select("feature", "original_col", "value")


@R.add("R04_run_metadata", f"{_R}, f AS (SELECT 'S' || record_id AS name, date_trunc('second', acquired_at) AS created FROM records) SELECT name, created, CAST(row_number() OVER (ORDER BY created NULLS LAST, name) - 1 AS INTEGER) AS injection_order FROM f")
def r4(spark, d):
    runs = records(spark, d).select(F.concat(F.lit("S"), F.col("record_id").cast("string")).alias("File Name"), F.date_format("acquired_at", "dd-MM-yyyy HH:mm:ss").alias("Creation Date"))
    path = Scratch(spark).path("runs.tsv")
    writers.write_delimited(runs, path, "\t")
    return readers.read_run_metadata(spark, path).withColumn("created", F.col("created").cast("timestamp_ntz"))


@R.add("R06_batch_folders", f"{_R} SELECT DISTINCT 'batch=' || batch AS batch FROM records WHERE batch IS NOT NULL")
def r6(spark, d):
    path = Scratch(spark).path("batches")
    records(spark, d).where("batch is not null").select("batch", "record_id").write.partitionBy("batch").csv(path)
    return readers.batch_files(spark, path, (".csv",)).select("batch").distinct()


@R.add("R09_label_file", f"{_R} SELECT sample_id, oordeel_targeted AS oordeel, classification, non_treated FROM records WHERE sample_id IS NOT NULL")
def r9(spark, d):
    t = records(spark, d).where("sample_id is not null").select(F.col("sample_id").alias("Monster"), F.col("oordeel_targeted").alias("Oordeel targeted"), F.col("classification").alias("Classification"), F.col("non_treated").alias("Non-treated"))
    path = Scratch(spark).path("labels.csv")
    writers.write_delimited(t, path, ";")
    return readers.read_labels(spark, path)


@R.add("R10_pathway_metabolites", f"SELECT DISTINCT {_text('smp_id')} AS smp_id, {_text('smp_id')} AS pathway_name, upper({_text('hmdb_id')}) AS hmdb_id, source AS metabolite_name FROM biomarker_attachments WHERE {_text('hmdb_id')} IS NOT NULL")
def r10(spark, d):
    t = table(spark, d, "biomarker_attachments").select(_plain("smp_id").alias("pathway_id"), _plain("hmdb_id").alias("hmdb_id"), F.lit("Homo sapiens").alias("species"), F.col("source").alias("metabolite_name"))
    path = Scratch(spark).path("pathways.csv")
    writers.write_delimited(t.unionByName(t.withColumn("species", F.lit("Mus musculus"))), path)
    return readers.read_pathway_metabolites(spark, path, "Homo sapiens")


@R.add("R11_pathway_names_file", f"SELECT {_text('pathway_id')} AS smp_id, min({_text('name')}) AS pathway_name, min({_text('category')}) AS category, min({_text('species')}) AS species FROM pathway_names WHERE {_text('pathway_id')} IS NOT NULL GROUP BY 1")
def r11(spark, d):
    t = table(spark, d, "pathway_names").groupBy(_plain("pathway_id").alias("SMPDB ID")).agg(*[F.min(_plain(c)).alias(n) for c, n in (("name", "Pathway Name"), ("category", "Subject"), ("species", "Species"))])
    path = Scratch(spark).path("names.csv")
    writers.write_delimited(t, path)
    return readers.read_pathway_names(spark, path)


@R.add("R12_pathway_lists", f"""SELECT {_text('smp_id')} AS smp_id, 'P' AS pathway_name, CAST(count(DISTINCT {_text('hmdb_id')}) AS INTEGER) AS n_compounds,
    coalesce(string_agg(DISTINCT {_text('hmdb_id')}, ';' ORDER BY {_text('hmdb_id')}), '') AS ids FROM biomarker_attachments WHERE {_text('smp_id')} IS NOT NULL GROUP BY 1""")
def r12(spark, d):
    t = table(spark, d, "biomarker_attachments").where(_plain("smp_id").isNotNull()).groupBy(_plain("smp_id").alias("smp_id")).agg(F.sort_array(F.collect_set(_plain("hmdb_id"))).alias("hmdb_ids"))
    path = Scratch(spark).path("lists.tsv")
    writers.write_delimited(t.select("smp_id", F.lit("P").alias("pathway_name"), F.size("hmdb_ids").alias("n_compounds"), "hmdb_ids"), path, "\t")
    return readers.read_pathway_lists(spark, path).select("smp_id", "pathway_name", "n_compounds", F.array_join("hmdb_ids", ";").alias("ids"))


@R.add("R14_compound_xml", r"SELECT trim(accession) AS accession, trim(name) AS name, coalesce(array_to_string(synonyms, '|'), '') AS synonyms FROM hmdb_metabolites WHERE regexp_full_match(trim(accession), 'HMDB\d+')")
def r14(spark, d):
    t = table(spark, d, "hmdb_metabolites").select("accession", "name", F.struct(F.col("synonyms").alias("synonym")).alias("synonyms"))
    path = Scratch(spark).path("compounds.xml")
    t.write.format("xml").option("rootTag", "hmdb").option("rowTag", "metabolite").save(path)
    return readers.read_compound_xml(spark, path).withColumn("synonyms", F.array_join("synonyms", "|"))


@R.add("R15_disease_table", rf"""SELECT 'D' || attachment_id AS disease, regexp_extract(hmdb_id, '(HMDB\d+)', 1) AS ids, nullif(regexp_extract(coalesce(smp_id, ''), '(SMP\d+)', 1), '') AS smp_id
    FROM biomarker_attachments WHERE regexp_extract(hmdb_id, '(HMDB\d+)', 1) <> ''""")
def r15(spark, d):
    t = table(spark, d, "biomarker_attachments").select(F.concat(F.lit("D"), F.col("attachment_id").cast("string")).alias("Disease"), F.lit("Marker").alias("Biochemical markers"), F.col("hmdb_id").alias("HMDB codes"), F.col("smp_id").alias("SMPDB code"))
    path = Scratch(spark).path("diseases.csv")
    writers.write_delimited(t, path, "\t")
    return readers.parse_diseases(readers.read_text_table(spark, path)).select("disease", F.array_join("hmdb_ids", ";").alias("ids"), "smp_id")


@R.add("R16_attachment_file", f"""SELECT {_text('smp_id')} AS smp_id, {_text('pathway_name')} AS pathway_name, upper({_text('hmdb_id')}) AS hmdb_id, {_text('source')} AS source FROM biomarker_attachments
    WHERE {_text('hmdb_id')} IS NOT NULL AND ({_text('smp_id')} IS NOT NULL OR {_text('pathway_name')} IS NOT NULL)""")
def r16(spark, d):
    path = Scratch(spark).path("attachments.csv")
    writers.write_delimited(table(spark, d, "biomarker_attachments").select("smp_id", "pathway_name", "hmdb_id", "source"), path)
    return readers.read_attachments(spark, path)


@R.add("R18_latin1_text", "SELECT accession, 'café ' || accession AS note FROM hmdb_metabolites")
def r18(spark, d):
    path = Scratch(spark).path("latin1.csv")
    t = table(spark, d, "hmdb_metabolites").select("accession", F.concat(F.lit("café "), F.col("accession")).alias("note"))
    t.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.read_text_table(spark, path)


@R.add("R19_parse_cache", f"{_R} SELECT record_id, batch, 2 AS reads, 1 AS builds FROM records")
def r19(spark, d):
    scratch, built = Scratch(spark), []
    source, kept = scratch.path("source"), scratch.path("kept")
    records(spark, d).select("record_id", "batch").write.parquet(source)

    def build():
        built.append(1)
        return spark.read.parquet(source)

    readers.cached(spark, build, source, kept)
    return readers.cached(spark, build, source, kept).select("record_id", "batch", F.lit(2).alias("reads"), F.lit(len(built)).alias("builds"))


@R.add("R20_settings", "SELECT * FROM (VALUES ('paths.data', '/data'), ('limits.high', '2.5'), ('limits.low', 'default'), ('names', 'a;b'), ('missing', '')) AS t(setting, value)")
def r20(spark, d):
    c = readers.Config({"paths": {"data": "/data"}, "limits": {"low": None}, "names": ["a", "b"]})
    c.set("limits.high", "2.5")
    rows = [("paths.data", c.get("paths.data")), ("limits.high", str(c.get_float("limits.high", 0.0))), ("limits.low", c.get("limits.low", "default")), ("names", ";".join(c.get_list("names"))), ("missing", ";".join(c.get_list("missing")))]
    return spark.createDataFrame(rows, "setting string, value string")


@R.add("T16_header_roles", "SELECT * FROM (VALUES ('sample', ' Monster '), ('label', 'Oordeel_Targeted')) AS t(role, header)")
def t16(spark, d):
    roles = N.header_role([" Monster ", "Oordeel_Targeted", "x"], {"sample": ["monster"], "label": ["oordeel targeted", "oordeel"], "none": ["absent"]})
    return spark.createDataFrame(sorted(roles.items()), "role string, header string")


@R.add("T25_scorer_options", "SELECT * FROM (VALUES ('a', '1'), ('b', '0.5'), ('c', 'True'), ('d', 'None'), ('e', 'x y')) AS t(name, value)")
def t25(spark, d):
    return spark.createDataFrame([(k, str(v)) for k, v in readers.scorer_options("a=1, b=0.5, c=true, d=null, e=x y").items()], "name string, value string")


@R.add("W01_partitioned_table", f"{_L} SELECT batch, feature, count(*) AS n, count(value) AS present FROM long GROUP BY 1, 2")
def w1(spark, d):
    path = Scratch(spark).path("w1")
    writers.write_table(long_records(spark, d), path, ["batch"], ["feature"])
    return spark.read.parquet(path).groupBy("batch", "feature").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("present"))


@R.add("W03_final_table", f"{_M} SELECT 'S' || sample AS sample, feature, value FROM matrix")
def w3(spark, d):
    wide = writers.widen(matrix(spark, d).withColumn("sample", F.concat(F.lit("S"), F.col("sample").cast("string"))), "sample", "feature", "value")
    path = Scratch(spark).path("w3.csv")
    writers.write_delimited(wide, path)
    return readers.wide_to_long(readers.read_text_table(spark, path), "sample", [c for c in wide.columns if c != "sample"], "f").where("value is not null").select(F.col("feature").alias("sample"), F.col("f").alias("feature"), "value")


@R.add("W04_batch_specific_files", f"{_M} SELECT batch, feature FROM matrix GROUP BY 1, 2")
def w4(spark, d):
    path = Scratch(spark).path("w4")
    writers.write_table(matrix(spark, d).select("batch", "feature").distinct(), path, ["batch"])
    return spark.read.parquet(path).select("batch", "feature")


@R.add("W05_lists_joined", "SELECT coverage_id, coalesce(array_to_string(matched_metabolites, ';'), '') AS ids FROM pathway_coverage")
def w5(spark, d):
    path = Scratch(spark).path("w5")
    writers.write_delimited(table(spark, d, "pathway_coverage").select("coverage_id", "matched_metabolites"), path, "\t")
    out = readers.read_text_table(spark, path, "\t")
    return out.select(F.col("coverage_id").cast("bigint").alias("coverage_id"), F.coalesce("matched_metabolites", F.lit("")).alias("ids"))


@R.add("W07_markdown_report", f"{_R} SELECT 5 + count(DISTINCT batch) AS lines, 3 AS bars FROM records")
def w7(spark, d):
    t = records(spark, d).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).where("batch is not null").orderBy("batch")
    text = writers.markdown_report("Batches", {"Sizes": t}, rows=100_000).rstrip("\n").split("\n")
    return spark.createDataFrame([(len(text) - 1, text[-1].count("|"))], "lines bigint, bars int")


@R.add("W09_model_round_trip", "SELECT * FROM (VALUES ('pca', 'axes', 2, 3, 15.0), ('pca', 'mean', 1, 3, 6.0)) AS t(kind, name, dimensions, last_size, total)")
def w9(spark, d):
    path = Scratch(spark).path("model")
    writers.save_model(spark, path, "pca", mean=np.array([1.0, 2.0, 3.0]), axes=np.arange(6.0).reshape(2, 3))
    kind, arrays = writers.load_model(spark, path)
    return spark.createDataFrame([(kind, n, a.ndim, a.shape[-1], float(a.sum())) for n, a in sorted(arrays.items())], "kind string, name string, dimensions int, last_size int, total double")
