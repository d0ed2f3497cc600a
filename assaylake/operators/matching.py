"""Joins and matching: retention times, names, sets, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.names import accession_tag, loose_name, normal_name
from assaylake.operators.ordered import numbered, ranges_of
from assaylake.session import Scratch


def match_retention(features: DataFrame, threshold: float = 0.02) -> DataFrame:
    """Add ``match_key`` to (batch_pos, feature, base, rt, row): one key for features of a base whose times chain.

    A group goes on while the gap to the previous member is at most the threshold; the key is the first
    member of the first batch, else the member with the lowest time. Equal times keep the order of batch and row.
    """
    order = Window.partitionBy("base").orderBy("rt", "batch_pos", "row")
    f = features.withColumn("_new", F.coalesce((F.col("rt") - F.lag("rt").over(order) > threshold).cast("int"), F.lit(0)))
    f = f.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct((F.col("batch_pos") != 0).cast("int").alias("late"), "rt", "batch_pos", "row")
    keys = f.groupBy("base", "_group").agg(F.min_by("feature", at).alias("match_key"))
    return f.join(keys, ["base", "_group"]).drop("_new", "_group")


def rename_and_average(df: DataFrame, keys: DataFrame, by: Sequence[str] = ("sample", "batch")) -> DataFrame:
    """Values under their match key, those of one sample averaged; features without a key keep their name."""
    named = df.join(keys.select("feature", "match_key").distinct(), "feature", "left").withColumn("feature", F.coalesce("match_key", "feature"))
    return named.groupBy("feature", *by).agg(F.avg("value").alias("value"))


def name_index(entries: DataFrame, least: int = 3) -> DataFrame:
    """Distinct (name, accession) of normalised names and synonyms; ``entries`` has (accession, name, synonyms)."""
    empty = F.array().cast("array<string>")
    names = entries.select("accession", F.explode(F.array_union(F.array("name", "accession"), F.coalesce("synonyms", empty))).alias("name"))
    return names.select(normal_name(F.col("name")).alias("name"), "accession").where(F.length("name") >= least).distinct()


def match_features(features: DataFrame, index: DataFrame, overrides: DataFrame | None = None, least: int = 3) -> DataFrame:
    """(feature, hmdb_id, match_method, n_hmdb_ids) by override, tag, exact name, loose name; unmatched features stay with NULL."""
    f = features.select("feature").distinct().withColumn("norm", normal_name(F.col("feature")))
    f = f.withColumn("tag", accession_tag(F.col("norm"))).withColumn("loose", F.regexp_replace("norm", "[^A-Z0-9]+", ""))
    loose = index.select(F.regexp_replace("name", "[^A-Z0-9]+", "").alias("loose"), "accession").where(F.length("loose") >= least).distinct()
    if overrides is not None:
        f = f.join(overrides.select("feature", F.upper(F.trim("hmdb_id")).alias("override")), "feature", "left")
    else:
        f = f.withColumn("override", F.lit(None).cast("string"))
    direct = f.where("override is not null or tag is not null").select("feature", F.coalesce("override", "tag").alias("hmdb_id"), F.when(F.col("override").isNotNull(), "override").otherwise("hmdb_tag").alias("match_method"))
    open_ = f.where("override is null and tag is null")
    exact = open_.join(index.withColumnRenamed("name", "norm"), "norm").select("feature", F.col("accession").alias("hmdb_id"), F.lit("name_exact").alias("match_method"))
    rest = open_.join(exact.select("feature").distinct(), "feature", "left_anti")
    near = rest.where(F.length("norm") >= least).join(loose, "loose").select("feature", F.col("accession").alias("hmdb_id"), F.lit("name_loose").alias("match_method"))
    found = direct.unionByName(exact).unionByName(near).distinct()
    out = f.select("feature").join(found, "feature", "left")
    return out.select("feature", "hmdb_id", F.coalesce("match_method", F.lit("unmatched")).alias("match_method"), F.count("hmdb_id").over(Window.partitionBy("feature")).alias("n_hmdb_ids"))


def audit_unlinked(markers: DataFrame, linked: DataFrame, features: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The rows of ``markers`` (marker, hmdb_id, ...) without a code, or with one that is not ``linked`` (hmdb_id), and what their names match.

    Adds ``matched_features``, the features of the same exact, else loose, name, each compared with and without its
    accession tag, and ``name_index_accessions``, the accessions of that name in the index; joined by semicolons,
    sorted, '' for none. Markers whose code is NULL are never linked.
    """
    rows = markers.join(linked.select("hmdb_id").where("hmdb_id is not null").distinct(), "hmdb_id", "left_anti")
    bare = lambda c: F.regexp_replace(c, "[^A-Z0-9]+", "")
    f = features.where("feature is not null").select("feature").distinct().withColumn("norm", normal_name(F.col("feature")))
    tag = accession_tag(F.col("norm"))
    short = F.when(tag.isNotNull(), F.regexp_replace("norm", r"\.*HMDB[0-9]+$", "")).otherwise(F.col("norm"))
    exact = f.select("feature", F.explode(F.array_distinct(F.array("norm", short))).alias("norm")).where("norm <> ''")
    near = f.select("feature", F.explode(F.array_distinct(F.array(bare(F.col("norm")), bare(short)))).alias("loose")).where("loose <> ''")
    n = rows.where("marker is not null").select("marker").distinct().withColumn("norm", normal_name(F.col("marker"))).withColumn("loose", bare(F.col("norm")))
    listed = lambda df, c: df.groupBy("marker").agg(F.array_join(F.array_sort(F.collect_set(c)), ";").alias("_" + c))
    hit = n.join(exact, "norm").select("marker", "feature")
    rest = n.join(hit.select("marker").distinct(), "marker", "left_anti").join(near, "loose").select("marker", "feature")
    out = rows.join(listed(hit.unionByName(rest), "feature"), "marker", "left")
    if index is None:
        out = out.withColumn("_accession", F.lit(""))
    else:
        out = out.join(listed(n.where("norm <> ''").join(index.withColumnRenamed("name", "norm"), "norm").select("marker", "accession"), "accession"), "marker", "left")
    return out.select(*markers.columns, F.coalesce("_feature", F.lit("")).alias("matched_features"), F.coalesce("_accession", F.lit("")).alias("name_index_accessions"))


def link_pathways(matched: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, hmdb_id, smp_id) over accession edges (smp_id, hmdb_id)."""
    return matched.where("hmdb_id is not null").select("feature", "hmdb_id").join(edges.select("smp_id", "hmdb_id").distinct(), "hmdb_id").select("feature", "hmdb_id", "smp_id").distinct()


def coverage(links: DataFrame, edges: DataFrame, minimum: float = 0.0) -> DataFrame:
    """Per pathway the matched metabolites and features and their share of all metabolites."""
    total = edges.groupBy("smp_id").agg(F.count_distinct("hmdb_id").alias("n_metabolites"))
    hit = links.groupBy("smp_id").agg(F.array_sort(F.collect_set("hmdb_id")).alias("matched_metabolites"), F.array_sort(F.collect_set("feature")).alias("matched_features"))
    out = total.join(hit, "smp_id", "left")
    for c in ("matched_metabolites", "matched_features"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    out = out.withColumn("n_matched_metabolites", F.size("matched_metabolites")).withColumn("n_matched_features", F.size("matched_features"))
    return out.withColumn("coverage", F.col("n_matched_metabolites") / F.col("n_metabolites")).where(F.col("coverage") >= minimum)


def supersede_plain(matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, dropped (feature, hmdb_id, superseded_by)): plain features give way to confirmed ones of their accession, everywhere."""
    m = matched.where("hmdb_id is not null").withColumn("sure", F.col("match_method").isin("override", "hmdb_tag"))
    best = m.where("sure").groupBy("hmdb_id").agg(F.min("feature").alias("superseded_by"))
    dropped = m.where("not sure").join(best, "hmdb_id").select("feature", "hmdb_id", "superseded_by").distinct()
    return matched.join(dropped.select("feature").distinct(), "feature", "left_anti"), dropped


def ambiguity_impact(matched: DataFrame, links: DataFrame, scored: DataFrame) -> DataFrame:
    """Features with several accessions and the number of scored pathways that they reach."""
    many = matched.where("n_hmdb_ids > 1").groupBy("feature").agg(F.array_join(F.array_sort(F.collect_set("hmdb_id")), ",").alias("hmdb_ids"))
    n = links.join(scored.select("smp_id").distinct(), "smp_id", "left_semi").groupBy("feature").agg(F.count_distinct("smp_id").alias("n_scored_pathways"))
    return many.join(n, "feature", "left").withColumn("n_scored_pathways", F.coalesce("n_scored_pathways", F.lit(0)))


def attach(attachments: DataFrame, kept: DataFrame) -> DataFrame:
    """Attachments with their kept pathway, by id or else by name (case ignored, ambiguous names dropped)."""
    by_name = kept.groupBy(F.lower(F.trim("pathway_name")).alias("low")).agg(F.count_distinct("smp_id").alias("n"), F.min("smp_id").alias("named")).where("n = 1")
    a = attachments.withColumn("low", F.lower(F.trim("pathway_name"))).join(kept.select(F.col("smp_id").alias("known")).distinct(), F.col("smp_id") == F.col("known"), "left")
    a = a.join(by_name.select("low", "named"), "low", "left")
    return a.withColumn("pathway", F.coalesce("known", F.when(F.col("smp_id").isNull(), F.col("named")))).where("pathway is not null").drop("low", "known", "named")


def resolve_status(rows: DataFrame, kept: DataFrame, features: DataFrame) -> DataFrame:
    """Add pathway_status (kept, not_in_kept_set, no_pathway) and feature_status (scored, no_dataset_feature)."""
    out = rows.join(kept.select("smp_id", F.lit(True).alias("_k")).distinct(), "smp_id", "left").join(features.select("hmdb_id", F.lit(True).alias("_f")).distinct(), "hmdb_id", "left")
    path = F.when(F.col("_k"), "kept").when(F.col("smp_id").isNotNull(), "not_in_kept_set").otherwise("no_pathway")
    return out.withColumn("pathway_status", path).withColumn("feature_status", F.when(F.col("_f"), "scored").otherwise("no_dataset_feature")).drop("_k", "_f")


def similar_sets(members: DataFrame, key: str, member: str, least: float) -> DataFrame:
    """(a, b, both, jaccard) of pairs of sets with Jaccard similarity at least ``least`` > 0, a < b.

    Pairs meet at shared members by the prefix filter: with members ordered from rare to common, two similar sets
    share one within the first n - ceil(least * n) + 1 of each, so common members pair nothing.
    """
    m = members.select(F.col(key).alias("k"), F.col(member).alias("m")).where("k is not null and m is not null").distinct()
    often = m.groupBy("m").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("k")
    r = m.join(often, "m").withColumn("n", F.count(F.lit(1)).over(w)).withColumn("at", F.row_number().over(w.orderBy("df", "m")))
    head = r.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * least - F.lit(1e-9)) + 1).select("k", "m", "n")
    a, b = head.alias("a"), head.alias("b")
    near = a.join(b, (F.col("a.m") == F.col("b.m")) & (F.col("a.k") < F.col("b.k")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * least - 1e-9))
    pairs = near.select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).distinct()
    both = pairs.join(m.select(F.col("k").alias("a"), "m"), "a").join(m.select(F.col("k").alias("b"), "m"), ["b", "m"]).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("both"))
    return both.withColumn("jaccard", F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).where(F.col("jaccard") >= least).select("a", "b", "both", "jaccard")


def components(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """Q20: (key, component) of the graph with the edges (a, b): the smallest key that is reachable.

    Large and small star steps (Kiveris et al. 2014) end after few rounds also on long chains; each round is
    written to the shared folder, so lineage stays short.
    """
    scratch = Scratch(vertices.sparkSession)
    edges = scratch.write(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges0")
    step = 0
    while True:
        step += 1
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        new = scratch.write(small.where("u <> v"), f"edges{step}")
        stable = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
        scratch.drop(f"edges{step - 1}") if not stable else None
        edges = new
        if stable:
            break
    return vertices.join(edges.withColumnsRenamed({"u": "key", "v": "component"}), "key", "left").withColumn("component", F.coalesce("component", "key"))


def injection_order(runs: DataFrame, clean: Column, date: str, keep_date: bool = False, kind: str = "int") -> DataFrame:
    """(name, injection_order): 0.. by the earliest date of each cleaned name, unknown dates last; ordered inside ranges of time."""
    first = Scratch(runs.sparkSession).write(runs.groupBy(clean.alias("name")).agg(F.min(date).alias("at")), "first")
    timed = first.withColumn("_t", F.unix_micros(F.col("at").cast("timestamp")))
    out = numbered(timed, [], ranges_of(timed, "_t"), [F.asc_nulls_last("_t"), F.col("name")], "_n")
    return out.select("name", (F.col("_n") - 1).cast(kind).alias("injection_order"), *(["at"] if keep_date else []))


# Words in the names of pathways that describe one disease.
SPECIFIC = ("deficiency", "disease", "aciduria")


def representatives(groups: DataFrame, sizes: DataFrame, names: DataFrame, specific: Sequence[str] = SPECIFIC) -> DataFrame:
    """Q20: (key, represented_by): of each component the general name first, then the larger set, then the first name, then the first key.

    ``groups`` has (key, component), ``sizes`` (key, n), ``names`` (key, name); a missing name is the key itself.
    """
    g = groups.join(sizes, "key", "left").join(names.groupBy("key").agg(F.min("name").alias("name")), "key", "left")
    name = F.coalesce("name", F.col("key").cast("string"))
    special = F.exists(F.array(*map(F.lit, specific)), lambda w: F.contains(F.lower(name), w))
    best = g.groupBy("component").agg(F.min(F.struct(special.cast("int").alias("s"), (-F.coalesce("n", F.lit(0))).alias("n"), name.alias("name"), F.col("key").alias("key"))).alias("best"))
    return groups.join(best.select("component", F.col("best.key").alias("represented_by")), "component").select("key", "represented_by")


def merge_batches(cells: DataFrame, features: DataFrame, threshold: float = 0.02, drop: Sequence[str] = ("expqc",), sample_name: str = "sample_name") -> tuple[DataFrame, DataFrame]:
    """M7, M8: (values of features in several batches, values of features in one batch only) of batches put together.

    ``cells`` has (feature, sample, batch, sample_name, value), ``features`` (batch_pos, feature, base, rt, row) of all batches. Features whose
    retention times chain get one name (J7), their values are averaged within a sample (J8), samples whose name holds one of ``drop`` are
    left out (F18), and features of a single batch are split off (F19). Any number of batches takes the same few shuffles.
    """
    from assaylake.operators.filters import batch_specific, drop_samples

    named = rename_and_average(cells, match_retention(features, threshold), ("sample", "batch", sample_name))
    return batch_specific(drop_samples(named, sample_name, drop))


def align(values: DataFrame, metadata: DataFrame, key: str = "sample") -> tuple[DataFrame, DataFrame]:
    """Both tables reduced to the samples that both hold."""
    return values.join(metadata.select(key).distinct(), key, "left_semi"), metadata.join(values.select(key).distinct(), key, "left_semi")


def scored_links(links: DataFrame, scored: DataFrame) -> DataFrame:
    """(smp_id, hmdb_id, n) of links to scored pathways with the number of scores."""
    return links.join(scored.groupBy("smp_id").agg(F.count(F.lit(1)).alias("n")), "smp_id").select("smp_id", "hmdb_id", "n")


def replace_by_panels(scores: DataFrame, panels: DataFrame) -> DataFrame:
    """Scores of pathways that no panel replaces."""
    return scores.join(panels.where("smp_id is not null").select("smp_id").distinct(), "smp_id", "left_anti")
