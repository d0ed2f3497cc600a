"""Queries of the whole pipelines (E)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assaylake.common import table
from assaylake.operators import labels as L
from assaylake.plans.pipelines import CleanSettings, ScreenSettings, clean_matrix, detect_outliers, screen_pathways
from assaylake.plans.registry import Registry
from assaylake.plans.views import matrix

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


@R.add("E1_clean_matrix")
def e1(spark, d):
    m = matrix(spark, d).withColumn("injection_order", F.col("sample").cast("int"))
    return clean_matrix(m, CleanSettings(blank_ratio=0.5))


@R.add("E2_screen_pathways")
def e2(spark, d):
    m = matrix(spark, d)
    # Features get the names of listed compounds, in order, so that names, accessions and pathways chain.
    f = m.select("feature").distinct().withColumn("i", F.row_number().over(Window.orderBy("feature")))
    listed = table(spark, d, "hmdb_metabolites").select("accession", "name", "synonyms")
    n = listed.select("accession", "name", (F.row_number().over(Window.orderBy("accession"))).alias("i"))
    cells = m.join(f.join(n, "i").select("feature", "name"), "feature").select(F.col("name").alias("feature"), "sample", F.log10("value").alias("value"))
    labels = m.select("sample").distinct().withColumn("classification", F.when(F.col("sample") % 4 == 0, 1.0).otherwise(0.0)).withColumn("oordeel", F.col("classification"))
    edges = n.select("accession", F.explode(F.array(F.concat(F.lit("S"), (F.col("i") % 12).cast("string")), F.concat(F.lit("T"), F.floor(F.col("i") / 15).cast("string")))).alias("smp_id")).select("smp_id", F.col("smp_id").alias("pathway_name"), F.col("accession").alias("hmdb_id"))
    return screen_pathways(cells, labels, listed, edges, ScreenSettings(least_coverage=0.0))["decisions"]


@R.add("E3_detect_outliers")
def e3(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.when(F.col("label") < 8, "inlier").otherwise("outlier").alias("role"))
    return detect_outliers(L.stratified_split(e, "id", "role", 0.5, 3).withColumnRenamed("is_validation", "is_training"), "mahalanobis")["scores"]
