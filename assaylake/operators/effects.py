"""Batch effects and geometry of sample vectors.

Distances are computed exactly, as numpy blocks: one block of vectors at a time is sent to all tasks, each of
which compares its own rows with it. A block has a bounded size, so any number of vectors can be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators.draws import mix
from assaylake.session import Scratch

#: Numbers in a block of vectors that is sent to the tasks: 32 MB.
BLOCK_NUMBERS = 4_000_000


def batch_medians(df: DataFrame) -> DataFrame:
    """(batch, median, cv) from the medians of the batch's samples; cv with the population sd."""
    m = df.groupBy("batch", "sample").agg(F.percentile("value", F.lit(0.5)).alias("m"))
    return m.groupBy("batch").agg(F.percentile("m", F.lit(0.5)).alias("median"), F.try_divide(F.stddev_pop("m"), F.avg("m")).alias("cv"))


def variance_ratio(df: DataFrame) -> DataFrame:
    """Per feature variance of batch means over mean variance within batches of more than one value; 0 if the latter isn't positive."""
    b = df.groupBy("feature", "batch").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"), F.count("value").alias("n"))
    s = b.groupBy("feature").agg(F.var_pop("mean").alias("between"), F.avg(F.when(F.col("n") > 1, F.col("var"))).alias("within"))
    return s.select("feature", F.when(F.col("within") > 0, F.col("between") / F.col("within")).otherwise(0.0).alias("ratio"))


def batch_r2(df: DataFrame, weights: str = "anova") -> DataFrame:
    """A10: per feature the share of its sum of squares that lies between batches; ``as_written`` weights each batch by the number of batches."""
    b = df.where("value is not null").groupBy("feature", "batch").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    s = b.withColumn("grand", F.sum(F.col("n") * F.col("mean")).over(Window.partitionBy("feature")) / F.sum("n").over(Window.partitionBy("feature"))).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("feature")))
    w = F.col("n") if weights == "anova" else F.col("k")
    r = s.groupBy("feature").agg(F.sum(w * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ssb"), F.sum(F.col("n") * F.col("var")).alias("ssw"))
    return r.select("feature", F.try_divide("ssb", F.col("ssb") + F.col("ssw")).alias("r2"))


def _blocks(vectors: DataFrame, columns: list[str], numbers: int) -> Iterator[pd.DataFrame]:
    """The table in bounded blocks: dealt by a hash of the id, each block is read on its own."""
    scratch = Scratch(vectors.sparkSession)
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    blocks = max(1, -(-(size.n * (size.d or 1)) // numbers))
    if blocks == 1:
        yield vectors.select(*columns).toPandas()
        return
    dealt = scratch.write(vectors.select(*columns, F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("_block")), "blocks", ["_block"])
    for k in range(blocks):
        yield dealt.where(F.col("_block") == k).select(*columns).toPandas()


def nearest_neighbours(vectors: DataFrame, k: int, queries: DataFrame | None = None, with_self: bool = False, numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """(id, neighbour, distance, rank) of the k nearest vectors by Euclidean distance, exact; ties by id.

    ``vectors`` and ``queries`` have (id, vector); NULL vectors take no part.
    """
    q = (queries if queries is not None else vectors).where("vector is not null").select("id", "vector")
    id_type = dict(vectors.dtypes)["id"]
    out = None
    for block in _blocks(vectors.where("vector is not null"), ["id", "vector"], numbers):
        if not len(block):
            continue
        shipped = vectors.sparkSession.sparkContext.broadcast((block["id"].to_numpy(), np.stack(block["vector"].to_numpy()).astype(np.float64)))

        def run(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            ids, m = shipped.value
            norms = (m * m).sum(axis=1)
            for pdf in batches:
                for s in range(0, len(pdf), 256):
                    own = pdf["id"].to_numpy()[s : s + 256]
                    v = np.stack(pdf["vector"].to_numpy()[s : s + 256]).astype(np.float64)
                    dist = np.sqrt(np.maximum(norms[None, :] + (v * v).sum(axis=1)[:, None] - 2 * v @ m.T, 0.0))
                    if not with_self:
                        dist[own[:, None] == ids[None, :]] = np.inf
                    most = min(k, len(ids))
                    cut = np.partition(dist, most - 1, axis=1)[:, most - 1]
                    r, c = np.nonzero((dist <= cut[:, None] + 1e-9) & np.isfinite(dist))
                    # The expanded square loses digits; the few candidates are measured again.
                    exact = np.sqrt(((v[r] - m[c]) ** 2).sum(axis=1))
                    yield pd.DataFrame({"id": own[r], "neighbour": ids[c], "distance": exact})

        part = q.mapInPandas(run, f"id {id_type}, neighbour {id_type}, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"id {id_type}, neighbour {id_type}, distance double, rank int")
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mixing_entropy(vectors: DataFrame, k: int = 10, base: float = 2.0, with_self: bool = True) -> DataFrame:
    """One row with the mean entropy of the batch labels of the k nearest; ``vectors`` has (id, vector, label)."""
    n = nearest_neighbours(vectors, k, with_self=with_self).join(vectors.select(F.col("id").alias("neighbour"), "label"), "neighbour")
    p = n.groupBy("id", "label").agg(F.count(F.lit(1)).alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("id")))
    e = p.groupBy("id").agg((-F.sum(F.col("p") * F.log(F.col("p"))) / F.lit(float(np.log(base)))).alias("entropy"))
    return e.agg(F.avg("entropy").alias("entropy"))


def distance_sums(vectors: DataFrame, numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """(id, label, other, n, total, most): count, sum and maximum of the distances from each vector to the others of each label."""
    id_type, label_type = dict(vectors.dtypes)["id"], dict(vectors.dtypes)["label"]
    rows = vectors.where("vector is not null and label is not null")
    out = None
    for block in _blocks(rows, ["id", "vector", "label"], numbers):
        if not len(block):
            continue
        codes, names = pd.factorize(block["label"], sort=True)
        order = np.argsort(codes, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
        shipped = vectors.sparkSession.sparkContext.broadcast((block["id"].to_numpy()[order], np.stack(block["vector"].to_numpy()).astype(np.float64)[order], first, np.asarray(names)))

        def run(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            ids, m, first, names = shipped.value
            norms, sizes = (m * m).sum(axis=1), np.diff(np.r_[first, len(ids)])
            for pdf in batches:
                for s in range(0, len(pdf), 64):
                    own, labels = pdf["id"].to_numpy()[s : s + 64], pdf["label"].to_numpy()[s : s + 64]
                    v = np.stack(pdf["vector"].to_numpy()[s : s + 64]).astype(np.float64)
                    squares = norms[None, :] + (v * v).sum(axis=1)[:, None] - 2 * v @ m.T
                    # The expanded square loses digits where vectors are near; these are measured again.
                    r, c = np.nonzero(squares < 1e-3 * norms[None, :])
                    squares[r, c] = ((v[r] - m[c]) ** 2).sum(axis=1)
                    same = own[:, None] == ids[None, :]
                    d = np.where(same, 0.0, np.sqrt(squares))
                    n = sizes[None, :] - np.add.reduceat(same.astype(np.int64), first, axis=1)
                    total, most = np.add.reduceat(d, first, axis=1), np.maximum.reduceat(d, first, axis=1)
                    k = len(names)
                    yield pd.DataFrame({"id": np.repeat(own, k), "label": np.repeat(labels, k), "other": np.tile(names, len(own)), "n": n.ravel(), "total": total.ravel(), "most": most.ravel()})

        part = rows.mapInPandas(run, f"id {id_type}, label {label_type}, other {label_type}, n bigint, total double, most double")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id", "label", "other").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"))


def silhouette(vectors: DataFrame) -> DataFrame:
    """One row with the mean Euclidean silhouette; a vector alone in its cluster counts 0; NULL for fewer than two clusters."""
    s = distance_sums(vectors)
    own, other = F.col("label") == F.col("other"), F.col("label") != F.col("other")
    mean = F.try_divide("total", "n")
    p = s.groupBy("id").agg(F.max(F.when(own, mean)).alias("a"), F.min(F.when(other, mean)).alias("b"))
    v = F.when(F.col("b").isNull(), F.lit(None)).when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return p.agg(F.avg(v).alias("silhouette"))


def cluster_spread(vectors: DataFrame) -> DataFrame:
    """Per label the mean and largest distance between its vectors."""
    s = distance_sums(vectors).where("label = other")
    return s.groupBy("label").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("mean_distance"), F.max("most").alias("max_distance"))


def permanova(vectors: DataFrame, permutations: int = 1000, seed: int = 7) -> DataFrame:
    """One row (pseudo_f, p_value) for Euclidean distances.

    With Euclidean distances the sums of squares follow from group means, so a permutation needs one pass of
    sums instead of all pairs. It deals the labels by the rank of a hash of the id; only the hashes where one
    group ends and the next begins are needed. Counts per bucket of hashes say in which buckets these lie,
    and only the hashes of those buckets are sorted, so no task holds all ids of a permutation.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vector is not null and label is not null").select(F.xxhash64(F.lit(seed), "id").alias("h"), "label", F.col("vector").cast("array<double>").alias("vector"))
    groups = rows.groupBy("label").agg(F.count(F.lit(1)).alias("size")).orderBy("label").collect()
    k, n = len(groups), sum(g["size"] for g in groups)
    if k < 2 or n <= k:
        return spark.createDataFrame([(None, None)], "pseudo_f double, p_value double")
    names, ends = [g["label"] for g in groups], np.cumsum([g["size"] for g in groups])[:-1]
    buckets = min(256, max(1, n // 64))

    def hashes(h: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of permutations, the hashes (ids x permutations) as positive numbers, and their buckets."""
        for at in range(1, permutations + 1, 100):
            reps = np.arange(at, min(at + 100, permutations + 1))
            z = (mix(h.to_numpy(), reps) >> np.uint64(1)).view(np.int64)
            yield reps, z, ((z >> 31) * buckets) >> 32

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((permutations + 1, buckets), dtype=np.int64)
        for pdf in batches:
            for reps, _, b in hashes(pdf["h"]):
                total[reps] += np.bincount((np.arange(len(reps)) * buckets + b).ravel(), minlength=len(reps) * buckets).reshape(len(reps), buckets)
        yield pd.DataFrame({"rep": np.repeat(np.arange(1, permutations + 1), buckets), "b": np.tile(np.arange(buckets), permutations), "n": total[1:].ravel()})

    seen = rows.select("h").mapInPandas(count, "rep int, b int, n bigint").groupBy("rep", "b").agg(F.sum("n").alias("n")).toPandas()
    sizes = np.zeros((permutations + 1, buckets), dtype=np.int64)
    sizes[seen["rep"], seen["b"]] = seen["n"]
    upto = sizes.cumsum(axis=1)
    # The last id of a group is number ``rank`` in the bucket ``where``.
    where = np.stack([(upto < e).sum(axis=1) for e in ends], axis=1).clip(max=buckets - 1)
    rank = ends[None, :] - np.take_along_axis(upto - sizes, where, axis=1)

    def near_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for reps, z, b in hashes(pdf["h"]):
                for j in range(k - 1):
                    i, r = np.nonzero(b == where[reps, j])
                    yield pd.DataFrame({"rep": reps[r], "j": j, "z": z[i, r], "rank": rank[reps[r], j]})

    cut = rows.select("h").mapInPandas(near_ends, "rep int, j int, z bigint, rank bigint").groupBy("rep", "j").agg(F.element_at(F.sort_array(F.collect_list("z")), F.first("rank").cast("int")).alias("z")).toPandas()
    cuts = np.zeros((permutations + 1, k - 1), dtype=np.int64)
    cuts[cut["rep"], cut["j"]] = cut["z"]
    # Sums around the mean keep the digits that large common values would take.
    mean = np.array([r.m for r in rows.select(F.posexplode("vector").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m")).orderBy("dim").collect()])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["vector"].to_numpy()).astype(np.float64) - mean
            codes = pdf["label"].map({v: i for i, v in enumerate(names)}).to_numpy()
            yield pd.DataFrame({"rep": -1, "g": 0, "s": [[float((x * x).sum())]]})
            yield pd.DataFrame({"rep": 0, "g": np.arange(k), "s": [x[codes == g].sum(axis=0) for g in range(k)]})
            for reps, z, _ in hashes(pdf["h"]):
                dealt = sum((z > cuts[reps, j]).astype(np.int64) for j in range(k - 1))
                for g in range(k):
                    yield pd.DataFrame({"rep": reps, "g": g, "s": list((dealt == g).T.astype(np.float64) @ x)})

    per = rows.mapInPandas(sums, "rep int, g int, s array<double>").select("rep", "g", F.posexplode("s").alias("dim", "s")).groupBy("rep", "g", "dim").agg(F.sum("s").alias("s"))
    size = F.element_at(F.array(*[F.lit(g["size"]) for g in groups]), F.col("g") + 1)
    f = per.groupBy("rep").agg(F.sum(F.when(F.col("rep") < 0, F.col("s")).otherwise(F.col("s") * F.col("s") / size)).alias("v"))
    f = Scratch(spark).write(f, "permuted")
    fixed = f.agg(F.max(F.when(F.col("rep") < 0, F.col("v"))).alias("every"), F.max(F.when(F.col("rep") == 0, F.col("v"))).alias("own"))
    ratio = lambda c: F.try_divide(F.col(c) / (k - 1), (F.col("every") - F.col(c)) / (n - k))
    f = f.where("rep > 0").crossJoin(F.broadcast(fixed)).select(ratio("v").alias("f"), ratio("own").alias("pseudo_f"))
    return f.groupBy("pseudo_f").agg(((F.count_if(F.col("f") >= F.col("pseudo_f")) + 1) / F.lit(permutations + 1)).alias("p_value"))
