"""The pN_ queries of the operators in this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.common import clean, latest_version, table
from assaylake.llm.mapping import map_to_canonical
from assaylake.llm.mixing import mix_sources, share_report, sized_documents
from assaylake.llm.packing import CAPACITY, fill_report, pack
from assaylake.llm.percentiles import group_percentiles, percentiles_from_counts, period_counts
from assaylake.llm.spans import LEAST, shared_classes, shared_coverage, shared_members, shared_pairs
from assaylake.llm.tokens import with_token_counts
from assaylake.llm.topn import top_n_per_group
from assaylake.session import Scratch

TOP = 5
TOLERANCE = 0.06
CELL = 1 / 64


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = latest_version(table(spark, sf_dir, "feature_to_hmdb"), "entry_id", "loaded_at", ["entry_id", "feature", "hmdb_id"])
    listed = table(spark, sf_dir, "hmdb_metabolites")
    return map_to_canonical(entries, "entry_id", "feature", "hmdb_id", listed, "accession", "name", "synonyms").select("entry_id", F.col("accession").alias("hmdb_id"))


def p2_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "pathway_stouffer_scores")
    rows = latest_version(scores, "score_id", "loaded_at", ["score_id", "sample_id", "smp_id", "z_stouffer_abs"])
    return top_n_per_group(rows, "sample_id", "z_stouffer_abs", ["smp_id", "score_id"], TOP, band_source=scores)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_topn(spark, sf_dir).select("sample_id", "score_id")


def _normals(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    scores = table(spark, sf_dir, "pathway_stouffer_scores")
    rows = latest_version(scores, "score_id", "loaded_at", ["score_id", "smp_id", "cohort", "sample_group", "z_stouffer_abs", *more])
    return rows.where("sample_group = 'normal'")


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group_percentiles(_normals(spark, sf_dir), ["smp_id", "cohort"], "z_stouffer_abs", [0.5, 0.95, 0.99])
    return out.select("smp_id", "cohort", "n", *[F.round(f"p{k}", 6).alias(name) for k, name in enumerate(("p50", "p95", "p99"))])


def p3_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from daily states, each within half a cell of the lower order statistic."""
    rows = _normals(spark, sf_dir, "scored_at").withColumn("day", F.to_date("scored_at"))
    state = period_counts(rows, ["smp_id", "cohort"], "z_stouffer_abs", "day", CELL)
    out = percentiles_from_counts(state, ["smp_id", "cohort"], [0.5, 0.95, 0.99], CELL)
    return out.select("smp_id", "cohort", "n", *[F.round(f"p{k}", 6).alias(name) for k, name in enumerate(("p50", "p95", "p99"))])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = group_percentiles(_normals(spark, sf_dir), ["smp_id", "cohort"], "z_stouffer_abs", [0.95])
    published = table(spark, sf_dir, "pathway_stouffer_reference").select("smp_id", "cohort", clean(F.col("normal_z_stouffer_abs_p95")).alias("p95")).where("p95 is not null").distinct()
    off = F.abs(F.col("p95") - F.col("p0")) > TOLERANCE * F.abs(F.col("p0"))
    return published.join(actual, ["smp_id", "cohort"]).where(off).select("smp_id", "cohort").distinct()


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_packed(spark, sf_dir).where("n_parts > 1 and part = 0").select("doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p6_packed(spark, sf_dir))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sized_documents(with_token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_sized(spark, sf_dir), table(spark, sf_dir, "source_weights"), "doc_id")[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of every listed and every occurring source."""
    sized, weights = _sized(spark, sf_dir), table(spark, sf_dir, "source_weights")
    mix, rates = mix_sources(sized, weights, "doc_id")
    return share_report(mix, rates, "source", sized, weights)


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: what must hold of the mix. Copies are counted from 1 without gaps, none exceeds its cap, and rows are documents of their source."""
    sized, weights = _sized(spark, sf_dir), table(spark, sf_dir, "source_weights")
    mix, rates = mix_sources(sized, weights, "doc_id")
    per = mix.groupBy("doc_id", "source").agg(F.max("copy").alias("most"), F.count(F.lit(1)).alias("n"), F.countDistinct("copy").alias("kinds"))
    capped = per.join(rates.select("source", "max_repeats", "rate"), "source")
    bad = (F.col("most") > F.col("max_repeats")) | (F.col("n") != F.col("kinds")) | (F.col("n") != F.col("most")) | (F.col("n") < F.floor("rate")) | (F.col("n") > F.ceil("rate"))
    strays = mix.select("doc_id", "source", "n_tokens").distinct().join(sized, ["doc_id", "source", "n_tokens"], "left_anti").agg(F.count(F.lit(1)).alias("strays"))
    sources = rates.agg(F.count(F.lit(1)).alias("drawn_sources"))
    return capped.agg(F.count(F.when(bad, 1)).alias("broken")).crossJoin(strays).crossJoin(sources)


def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents, and what must hold of the packing: no container is too full, none is empty, and the parts of a document join without gaps."""
    parts = Scratch(spark).write(p6_packed(spark, sf_dir), "packed")
    full = parts.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count(F.when((F.col("n") > CAPACITY) | (F.col("n") <= 0), 1)).alias("bad_containers"))
    docs = parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("n_parts").alias("n_parts"), F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.countDistinct("part").alias("parts"))
    bad = (F.col("rows") != F.col("n_parts")) | (F.col("parts") != F.col("n_parts")) | (F.col("n") != F.col("end")) | ((F.col("n") <= CAPACITY) & (F.col("n_parts") > 1))
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(bad, 1)).alias("bad_documents")).crossJoin(full)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_coverage(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.withColumn("shared_share", F.round("shared_share", 6))


def p8_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per shared span; two documents share text exactly if they are members of one span."""
    return shared_members(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per shared span with its number of documents."""
    return shared_classes(p8_members(spark, sf_dir), "doc_id").select("doc_id", "start", "n_documents")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_topn, p3_found, p3_percentiles, p3_daily, p6_found, p6_packed, p6_fill, p6_checked, p7_mix, p7_shares, p7_checked, p8_found, p8_members, p8_classes, p8_coverage)}


_SCORES = """scores AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY loaded_at DESC, sample_id DESC NULLS LAST,
    smp_id DESC NULLS LAST) AS version FROM pathway_stouffer_scores WHERE score_id IS NOT NULL) WHERE version = 1)"""
_TOP = f"""WITH {_SCORES}, ranked AS (SELECT sample_id, smp_id, score_id, z_stouffer_abs,
    row_number() OVER (PARTITION BY sample_id ORDER BY z_stouffer_abs DESC, smp_id NULLS LAST, score_id) AS rank FROM scores
    WHERE sample_id IS NOT NULL AND z_stouffer_abs IS NOT NULL AND NOT isnan(z_stouffer_abs))"""
_NORMALS = f"""WITH {_SCORES}, normals AS (SELECT smp_id, cohort, z_stouffer_abs AS z FROM scores
    WHERE sample_group = 'normal' AND z_stouffer_abs IS NOT NULL AND NOT isnan(z_stouffer_abs)),
    actual AS (SELECT smp_id, cohort, count(*) AS n, quantile_cont(z, 0.5) AS p50, quantile_cont(z, 0.95) AS p95, quantile_cont(z, 0.99) AS p99
    FROM normals GROUP BY smp_id, cohort)"""


# Every run of characters, by brute force.
_SPANS = f"""WITH starts AS (SELECT doc_id AS id, text, unnest(range(length(text) - {LEAST} + 1)) AS s FROM documents WHERE length(text) >= {LEAST}),
    w AS (SELECT id, s, md5(substring(text, CAST(s + 1 AS BIGINT), {LEAST})) AS run FROM starts)"""


def oracle_sql() -> dict[str, str]:
    cell = lambda p: f"min(CASE WHEN upto > floor({p} * (total - 1)) THEN round((cell + 0.5) / 64, 6) END)"
    return {
        # What must hold of any packing and any mix.
        "p6_checked": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS bad_documents, CAST(0 AS BIGINT) AS bad_containers FROM documents",
        "p7_checked": """SELECT CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS strays, count(*) AS drawn_sources FROM source_weights w
            WHERE target_share > 0 AND max_repeats >= 1 AND EXISTS (SELECT 1 FROM documents d WHERE d.source = w.source AND length(d.text) > 0)""",
        "p8_found": f"{_SPANS} SELECT DISTINCT a.id AS doc_id_a, b.id AS doc_id_b FROM w a JOIN w b ON a.run = b.run AND a.id < b.id",
        "p8_coverage": f"""{_SPANS}, shared AS (SELECT run FROM w GROUP BY run HAVING min(id) <> max(id)),
            held AS (SELECT DISTINCT w.id, s FROM w JOIN shared USING (run)),
            steps AS (SELECT id, least(s - lag(s, 1, s - {LEAST}) OVER (PARTITION BY id ORDER BY s), {LEAST}) AS new FROM held),
            per AS (SELECT id, CAST(sum(new) AS BIGINT) AS n FROM steps GROUP BY id)
            SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(n, 0) AS shared_chars,
            CASE WHEN coalesce(length(text), 0) > 0 THEN round(coalesce(n, 0) / length(text), 6) ELSE 0.0 END AS shared_share FROM documents d LEFT JOIN per ON per.id = d.doc_id""",
        "p2_found": f"{_TOP} SELECT sample_id, score_id FROM ranked WHERE rank <= {TOP}",
        "p2_topn": f"{_TOP} SELECT sample_id, smp_id, score_id, z_stouffer_abs, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {TOP}",
        "p3_found": f"""{_NORMALS} SELECT DISTINCT r.smp_id, r.cohort FROM pathway_stouffer_reference r JOIN actual a USING (smp_id, cohort)
            WHERE r.normal_z_stouffer_abs_p95 IS NOT NULL AND NOT isnan(r.normal_z_stouffer_abs_p95)
            AND abs(r.normal_z_stouffer_abs_p95 - a.p95) > {TOLERANCE} * abs(a.p95)""",
        "p3_percentiles": f"{_NORMALS} SELECT smp_id, cohort, n, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM actual",
        "p3_daily": f"""{_NORMALS}, cells AS (SELECT smp_id, cohort, floor(z * 64) AS cell, count(*) AS c FROM normals GROUP BY ALL),
            run AS (SELECT *, sum(c) OVER (PARTITION BY smp_id, cohort ORDER BY cell) AS upto, sum(c) OVER (PARTITION BY smp_id, cohort) AS total FROM cells)
            SELECT smp_id, cohort, CAST(max(total) AS BIGINT) AS n, {cell(0.5)} AS p50, {cell(0.95)} AS p95, {cell(0.99)} AS p99 FROM run GROUP BY smp_id, cohort""",
    }
