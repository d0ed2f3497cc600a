"""The three pipelines as compositions of operators; what several steps read is written once to the shared folder."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators import evaluate as E
from assaylake.operators import filters as X
from assaylake.operators import labels as L
from assaylake.operators import matching as M
from assaylake.operators import normalise as N
from assaylake.operators import pathways as P
from assaylake.operators.scorers import scorer
from assaylake.session import Scratch


@dataclass
class CleanSettings:
    minimum: float = 0.0
    blank_ratio: float = 2.0
    variance_quantile: float | None = None
    drift: bool = True
    pqn: bool = True
    bridge: bool = False
    combat: bool = True
    combat_gamma: float = 1.0
    ratios: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)


def clean_matrix(cells: DataFrame, s: CleanSettings | None = None) -> DataFrame:
    """Filter, correct drift, normalise, align batches and scale: (feature, sample, batch, value).

    ``cells`` has (feature, sample, batch, injection_order, is_qc, is_blank, is_bridge, value), one row per cell.
    """
    s = s or CleanSettings()
    scratch = Scratch(cells.sparkSession)
    # Each step reads its input for the statistics and again for the rows, so every step's result is written once.
    d = X.chain(scratch.write(cells, "cells"), X.named, lambda m: X.low_intensity(m, s.minimum), lambda m: X.blank_contaminant(m, s.blank_ratio), lambda m: X.low_variance(m, quantile=s.variance_quantile), cut=scratch)
    d = d.where(~F.col("is_blank"))
    if s.drift:
        d = scratch.write(N.drift_correct(scratch.write(N.positions(d, "injection_order", "sample", ("batch", "feature")), "positions")), "drift")
    if s.pqn:
        d = scratch.write(N.pqn(d), "pqn")
    if s.bridge:
        d = scratch.write(N.bridge_scale(d), "bridge")
    if s.combat:
        d = scratch.write(N.combat(scratch.write(N.half_min_all(d), "imputed"), s.combat_gamma), "combat")
    d = N.half_min_feature(d.where(~F.col("is_qc")).select("feature", "sample", "batch", "value"))
    d = scratch.write(d.withColumn("value", F.log10(F.when(F.col("value") > 0, F.col("value")))), "logs")
    for name, (num, den) in s.ratios.items():
        r = N.log_ratio(d, name, num, den, strict=False).join(d.select("sample", "batch").distinct(), "sample")
        d = d.where(F.col("feature") != name).unionByName(r.select("feature", "sample", "batch", "value"))
    return N.scale(d)


@dataclass
class ScreenSettings:
    least_metabolites: int = 3
    cap: float | None = 10.0
    threshold: float = 0.95
    rule: str = "max_excess"
    most_p: float = 0.05
    least_coverage: float = 0.2
    similar: float = 0.8
    fraction: float = 0.5
    seed: int = 20260923


def screen_pathways(cells: DataFrame, labels: DataFrame, names: DataFrame, edges: DataFrame, s: ScreenSettings | None = None) -> dict[str, DataFrame]:
    """Match names, score pathways against development normals, flag and decide.

    ``cells`` has (feature, sample, value), ``labels`` (sample, classification, oordeel), ``names``
    (accession, name, synonyms), ``edges`` (smp_id, pathway_name, hmdb_id).
    """
    s = s or ScreenSettings()
    scratch = Scratch(cells.sparkSession)
    groups = L.stratified_split(labels.withColumn("grp", L.group_of(F.col("classification"), F.col("oordeel"))), "sample", "grp", s.fraction, s.seed)
    groups = scratch.write(groups.withColumn("is_normal", (F.col("grp") == "normal") & ~F.col("is_validation")), "groups")
    called = scratch.write((edges.select(F.col("smp_id").alias("key"), F.col("pathway_name").alias("name")) if "pathway_name" in edges.columns else edges.select(F.col("smp_id").alias("key"), F.col("smp_id").alias("name"))).distinct(), "called")
    edges = scratch.write(edges.select("smp_id", "hmdb_id").distinct(), "edges")
    matched = scratch.write(M.match_features(cells.select("feature"), M.name_index(names)), "matched")
    kept, dropped = M.supersede_plain(matched)
    links = scratch.write(M.link_pathways(kept, edges), "links")
    cover = M.coverage(links, edges, s.least_coverage)
    links = scratch.write(links.join(cover.select("smp_id"), "smp_id", "left_semi"), "covered")
    v = cells.join(links.select("feature").distinct(), "feature", "left_semi").join(groups.select("sample", "is_normal"), "sample")
    v = scratch.write(v, "values")
    stats = scratch.write(P.reference_stats(v), "reference")
    z = scratch.write(P.robust_z(v, stats), "z")
    scored = scratch.write(P.usable_pathways(links, z, s.least_metabolites), "scored")
    members = links.join(scored.select("smp_id"), "smp_id", "left_semi")
    groups_of = M.components(scored.select(F.col("smp_id").alias("key")), M.similar_sets(members, "smp_id", "hmdb_id", s.similar).select("a", "b"))
    chosen = M.representatives(groups_of, scored.select(F.col("smp_id").alias("key"), F.col("n_usable").alias("n")), called).select(F.col("represented_by").alias("smp_id")).distinct()
    members = scratch.write(members.join(chosen.select("smp_id"), "smp_id", "left_semi"), "members")
    w = stats.select("feature", (F.col("scale") * F.col("scale")).alias("weight"))
    scores = P.stouffer(z, members, v.select("sample"), s.least_metabolites, w, s.cap).join(groups.select("sample", "is_normal"), "sample")
    scores = scratch.write(scores, "scores")
    flags = P.threshold_flags(scores, ["smp_id"], "z_stouffer_abs", "is_normal", s.threshold)
    flags = scratch.write(flags, "flags")
    summary = scratch.write(P.sample_summary(flags, "sample", "smp_id", "z_stouffer_abs").join(groups.select("sample", "grp", "is_normal", "is_validation"), "sample"), "summary")
    decisions = P.decide(summary, "is_normal", s.rule, most_p=s.most_p, rate=1 - s.threshold)
    return {"matched": matched, "superseded": dropped, "coverage": cover, "reference": stats, "scores": scores, "flags": flags, "decisions": decisions, "groups": E.breakdown(decisions, ["grp", "is_validation"], "decision")}


def detect_outliers(vectors: DataFrame, name: str, prevalence: float = 0.05, share: float = 0.05, **options: object) -> dict[str, DataFrame]:
    """Fit a scorer on training normals, score all, set the threshold on held-out normals and evaluate.

    ``vectors`` has (id, vector, role, is_training); roles are inlier, outlier, gray or NULL.
    """
    scored = scorer(name)(vectors, (F.col("role") == "inlier") & F.col("is_training"), **options)
    rows = scored.join(vectors.select("id", "role", "is_training"), "id")
    role = lambda r: F.coalesce(F.col("role") == r, F.lit(False)) & ~F.col("is_training")
    metrics = E.realistic(rows, "score", role("inlier"), role("outlier"), role("inlier"), share, prevalence)
    flags = rows.crossJoin(F.broadcast(metrics.select("threshold"))).withColumn("flagged", F.col("score") <= F.col("threshold"))
    return {"scores": flags, "metrics": metrics, "errors": L.error_lists(flags.where(~F.col("is_training")))}
