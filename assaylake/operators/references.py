"""References to keys that were not listed as live when the referring row was made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.common import hot_keys

#: References to one key that one task merges; a key with more that also holds HOT_SHARE of all references is split by their number.
HOT_LEAST = 100_000


def normal_key(c: Column) -> Column:
    """Without surrounding white space, in upper case; NULL if nothing is left."""
    k = F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(k != "", k)


def orphan_references(refs: DataFrame, parents: DataFrame, hot_least: int = HOT_LEAST) -> DataFrame:
    """References without a live parent at their time, with the reason.

    ``refs`` has (table_name, row_id, field_name, parent, key, at), ``parents`` has (parent, key,
    live_from, live_to); a parent row is live from ``live_from`` (inclusive) to ``live_to`` (exclusive,
    NULL: still live), and a key may have several periods. The result adds ``status``: *missing* (the
    key is never listed), *late* (listed only later), *deleted* (listed before, not any more),
    *undated* (the key is listed, but the reference has no time to compare).

    References with a NULL key are none and left out; keys are compared exactly, so normalise them first;
    parent rows with a NULL key or start, or an empty period, list nothing; repeated parent rows and overlapping
    periods count as listed; repeated references each come out. Empty references give an empty result, without
    parents everything is missing.

    Both streams are partitioned by key, sorted by time and merged once: a running count of
    periods opened minus periods closed tells how many are live at each reference. References to
    hot keys are salted by their number, and only the parents of those few keys are repeated per salt.
    """
    refs = refs.where("key is not null")
    hot = F.broadcast(hot_keys(refs, ["parent", "key"], hot_least).select("parent", "key", "salts"))
    periods = parents.where("key is not null and live_from is not null and (live_to is null or live_to > live_from)").select("parent", "key", "live_from", "live_to").distinct()
    salts = F.coalesce("salts", F.lit(1))
    r = refs.join(hot, ["parent", "key"], "left").withColumn("salt", F.pmod(F.xxhash64("table_name", "row_id", "field_name"), salts).cast("int"))
    p = periods.join(hot, ["parent", "key"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    none = [F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in ("table_name", "row_id", "field_name")]
    opened = p.select("parent", "key", "salt", F.col("live_from").alias("at"), F.lit(0).alias("kind"), *none)
    closed = p.where("live_to is not null").select("parent", "key", "salt", F.col("live_to").alias("at"), F.lit(1).alias("kind"), *none)
    asked = r.select("parent", "key", "salt", "at", F.lit(2).alias("kind"), "table_name", "row_id", "field_name")
    events = opened.unionByName(closed).unionByName(asked)
    part = Window.partitionBy("parent", "key", "salt")
    upto = part.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    is_open, is_close = (F.col("kind") == 0).cast("long"), (F.col("kind") == 1).cast("long")
    merged = events.select("*", F.sum(is_open).over(upto).alias("opened"), F.sum(is_close).over(upto).alias("closed"), F.sum(is_open).over(part).alias("ever"))
    status = (
        F.when(F.col("ever") == 0, "missing").when(F.col("at").isNull(), "undated").when(F.col("opened") == 0, "late").when(F.col("opened") == F.col("closed"), "deleted")
    )
    return merged.where("kind = 2").withColumn("status", status).where("status is not null").select("table_name", "row_id", "field_name", "key", "at", "status")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, month and status; references without a time are in the month NULL."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return orphans.groupBy("table_name", "field_name", month, "status").agg(F.count(F.lit(1)).alias("n"))
