"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.common import clean, col
from assaylake.session import Scratch

#: Rates are broadcast to the documents up to this many sources; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 100_000
SEED = 20240611


def repetition_rates(sized: DataFrame, weights: DataFrame, source: str = "source", total_tokens: int | None = None) -> DataFrame:
    """(source, tokens, target_share, share, rate, max_repeats) of every source that can be drawn from.

    ``sized`` has (source, n_tokens), ``weights`` (source, target_share, max_repeats). A listed source
    without tokens can't contribute: its share is spread over the others in proportion (``share``).
    Without ``total_tokens`` the mix is as large as the repetition caps allow at exact shares; a larger
    total runs into the caps and the actual shares tell. Sources that aren't listed, have a NULL name, a
    missing or non-positive share or a cap below 1 are left out; of repeated weights of a source the largest counts.
    """
    totals = sized.where(col(source).isNotNull()).groupBy(col(source).alias("source")).agg(F.sum("n_tokens").alias("tokens"))
    wanted = weights.select(col(source).alias("source"), clean(F.col("target_share").cast("double")).alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    wanted = wanted.where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = totals.where("tokens > 0").join(wanted, "source")
    all_ = both.agg(F.sum("target_share").alias("s"), F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).alias("t")).first()
    whole = all_.s or 1.0
    total = float(total_tokens) if total_tokens is not None else (all_.t or 0.0) * whole
    share = F.col("target_share") / F.lit(whole)
    rate = F.least(share * F.lit(total) / F.col("tokens"), F.col("max_repeats").cast("double"))
    return both.select("source", "tokens", "target_share", share.alias("share"), rate.alias("rate"), "max_repeats")


def draw_mix(sized: DataFrame, rates: DataFrame, row_id: str, source: str = "source", seed: int = SEED, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """(row id, source, copy, n_tokens): each document floor(rate) times, and once more with the rest as probability.

    The draw is a hash of seed and id, so it is the same on every run and in every task, and no document
    comes out more than ``max_repeats`` times. Documents of sources without a rate aren't drawn; rows without
    tokens are drawn like others; repeated ids share their draw; the empty table gives an empty mix.
    """
    small = rates.limit(broadcast_sources + 1).count() <= broadcast_sources
    r = rates.select(F.col("source"), "rate")
    rows = sized.select(col(row_id).alias("id"), col(source).alias("source"), "n_tokens").join(F.broadcast(r) if small else r, "source")
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id")), 11) / F.lit(float(1 << 53))
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    out = rows.withColumn("n", copies).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return out.select(F.col("id").alias(row_id), F.col("source").alias(source), "copy", "n_tokens")


def share_report(mix: DataFrame, rates: DataFrame, source: str = "source", sized: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Actual shares of a mix next to the targets, one row per source that can be drawn from.

    With ``sized`` and ``weights`` also one row for every other source: listed without tokens, listed with a share or cap that
    draws nothing, not listed, or NULL. ``status`` tells which; ``share`` is the target spread over the sources that can be drawn from.
    """
    drawn = mix.groupBy(col(source).alias("source")).agg(F.sum("n_tokens").alias("drawn_tokens"), F.max("copy").alias("most_copies"))
    both = rates.join(drawn, "source", "left").withColumn("status", F.lit("drawn"))
    if sized is not None and weights is not None:
        have = sized.groupBy(col(source).alias("source")).agg(F.sum("n_tokens").alias("tokens"))
        want = weights.groupBy(col(source).alias("source")).agg(F.max(clean(F.col("target_share").cast("double"))).alias("target_share"), F.max(F.col("max_repeats").cast("int")).alias("max_repeats"), F.lit(True).alias("listed"))
        names = have.select("source").unionByName(want.select("source")).distinct().alias("n")
        rest = names.join(rates.alias("r"), F.col("n.source") == F.col("r.source"), "left_anti")
        h, w = have.alias("h"), want.alias("w")
        rest = rest.join(h, F.col("n.source").eqNullSafe(F.col("h.source")), "left").join(w, F.col("n.source").eqNullSafe(F.col("w.source")), "left")
        status = F.when(F.col("n.source").isNull(), "no source").when(F.col("listed").isNull(), "not listed").when(F.coalesce(F.col("h.tokens"), F.lit(0)) == 0, "no tokens").otherwise("share or cap draws nothing")
        none = lambda name, kind: F.lit(None).cast(kind).alias(name)
        rest = rest.select("n.source", F.coalesce("h.tokens", F.lit(0).cast("long")).alias("tokens"), F.col("w.target_share"), none("share", "double"), F.lit(0.0).alias("rate"), F.col("w.max_repeats"), none("drawn_tokens", "long"), none("most_copies", "int"), status.alias("status"))
        both = both.unionByName(rest)
    both = both.withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0)))
    total = both.agg(F.sum("drawn_tokens").alias("_total"))
    return both.crossJoin(F.broadcast(total)).withColumn("actual_share", F.col("drawn_tokens") / F.greatest("_total", F.lit(1))).drop("_total")


def mix_sources(sized: DataFrame, weights: DataFrame, row_id: str, source: str = "source", total_tokens: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(mix, rates); both read ``sized`` several times, so it is best a written table, as ``sized_documents`` gives it."""
    rates = repetition_rates(sized, weights, source, total_tokens)
    return draw_mix(sized, rates, row_id, source, seed), rates


def sized_documents(sized: DataFrame) -> DataFrame:
    """Token counts as a written table: totals, draw and report read it, and counting tokens is dear."""
    return Scratch(sized.sparkSession).write(sized, "sized")
