"""One-class anomaly scorers on sample vectors (id, vector); a lower score is more anomalous.

Models are fitted on the rows where ``fit`` holds and are small: moments of the vectors, trees of a bounded
sample. Scoring streams the rows through numpy batches.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators.effects import nearest_neighbours

#: Rows that a tree of the isolation forest is grown on, as in the paper; trees times this bounds what reaches the driver.
TREE_ROWS = 256


def moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and population covariance; every task sends one sum of d * d numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, o = 0, None, None
        for pdf in batches:
            m = np.stack(pdf["vector"].to_numpy()).astype(np.float64) if len(pdf) else None
            if m is not None:
                n, s, o = n + len(m), (0 if s is None else s) + m.sum(axis=0), (0 if o is None else o) + m.T @ m
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "o": [o.ravel().tolist()]})

    parts = vectors.where("vector is not null").select("vector").mapInPandas(run, "n bigint, s array<double>, o array<double>")
    pos = parts.select("n", F.posexplode(F.concat("s", "o")).alias("i", "x"))
    sums = pos.groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()
    if not sums:
        raise ValueError("no vectors to fit")
    d = int((math.isqrt(4 * len(sums) + 1) - 1) // 2)
    n = sums[0].n
    x = np.array([r.x for r in sums])
    mean = x[:d] / n
    return n, mean, x[d:].reshape(d, d) / n - np.outer(mean, mean)


def _score(vectors: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "score": f(np.stack(pdf["vector"].to_numpy()).astype(np.float64))})

    return vectors.where("vector is not null").select("id", "vector").mapInPandas(run, f"id {dict(vectors.dtypes)['id']}, score double")


def _asked(vectors: DataFrame, of: DataFrame | None) -> DataFrame:
    """The rows to score: ``of``, or all vectors."""
    return vectors if of is None else of


def shrunk_covariance(n: int, cov: np.ndarray) -> np.ndarray:
    """Oracle approximating shrinkage (Chen et al. 2010) towards a multiple of the identity."""
    d = len(cov)
    mu, alpha = np.trace(cov) / d, (cov**2).mean()
    den = (n + 1.0) * (alpha - mu**2 / d)
    rho = 1.0 if den == 0 else min(1.0, (alpha + mu**2) / den)
    return (1 - rho) * cov + rho * mu * np.eye(d)


def mahalanobis(vectors: DataFrame, fit: Column | str, of: DataFrame | None = None) -> DataFrame:
    """Minus the squared Mahalanobis distance with shrunk covariance."""
    n, mean, cov = moments(vectors.where(fit))
    inverse = np.linalg.pinv(shrunk_covariance(n, cov))
    return _score(_asked(vectors, of), lambda m: -np.einsum("ij,jk,ik->i", m - mean, inverse, m - mean))


def components(vectors: DataFrame, fit: Column | str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Q23: (mean, axes, explained share) of the first k principal components; each axis points where its largest entry is positive."""
    _, mean, cov = moments(vectors.where(fit))
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    axes = axes[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return mean, axes, values[order] / max(values.sum(), 1e-300)


def project(vectors: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(id, vector) in the space of the components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m = (np.stack(pdf["vector"].to_numpy()).astype(np.float64) - mean) @ axes.T
                yield pd.DataFrame({"id": pdf["id"], "vector": list(m)})

    return vectors.where("vector is not null").select("id", "vector").mapInPandas(run, f"id {dict(vectors.dtypes)['id']}, vector array<double>")


def reconstruction(vectors: DataFrame, fit: Column | str, k: int, of: DataFrame | None = None) -> DataFrame:
    """S3: minus the squared distance to the space of the first k components."""
    mean, axes, _ = components(vectors, fit, k)
    return _score(_asked(vectors, of), lambda m: -((((m - mean) - (m - mean) @ axes.T @ axes)) ** 2).sum(axis=1))


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful search in a binary search tree of n rows."""
    n = np.asarray(n, dtype=float)
    with np.errstate(all="ignore"):
        return np.where(n > 2, 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def tree_rows(vectors: DataFrame, trees: int, rows: int = TREE_ROWS, seed: int = 42) -> DataFrame:
    """(tree, rank, id, vector): per tree the ``rows`` rows with the smallest hashes of tree and id among all."""
    # A share that holds the smallest ``rows`` hashes with ten standard deviations to spare bounds what is ranked.
    share = (rows + 10 * math.sqrt(rows) + 100) / max(1, vectors.count())
    u = lambda t: F.shiftrightunsigned(F.xxhash64(F.lit(seed), t, "id"), 11) / F.lit(float(1 << 53))
    near = vectors.select("id", "vector", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: u(t) <= share)).alias("tree"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(u(F.col("tree")), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= rows).select("tree", "rank", "id", "vector")


def isolation_forest(vectors: DataFrame, fit: Column | str, trees: int = 200, rows: int = TREE_ROWS, seed: int = 42, of: DataFrame | None = None) -> DataFrame:
    """Minus 2 ** (- mean path / expected path) (Liu, Ting and Zhou 2008).

    Each tree is grown on its own ``rows`` rows, those with the smallest hashes of tree and id among all fitted rows;
    trees * rows vectors at most reach the driver, whatever the size of the table.
    """
    draw = tree_rows(vectors.where(fit).where("vector is not null"), trees, rows, seed).orderBy("tree", "rank").select("tree", "vector").toPandas()
    if not len(draw):
        raise ValueError("no vectors to fit")
    data, rng = np.stack(draw["vector"].to_numpy()).astype(np.float64), np.random.default_rng(seed)
    own = [np.flatnonzero(draw["tree"].to_numpy() == t) for t in range(trees)]
    size = len(own[0])
    depth = max(1, math.ceil(math.log2(max(size, 2))))
    forest = []
    for t in range(trees):
        nodes: list[tuple[int, float, int, int, float]] = []
        todo = [(own[t], 0, -1, 0)]
        while todo:
            at, level, parent, side = todo.pop()
            me = len(nodes)
            if parent >= 0:
                f, c, a, b, v = nodes[parent]
                nodes[parent] = (f, c, me, b, v) if side == 0 else (f, c, a, me, v)
            part = data[at]
            wide = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(at) > 1 else []
            if level >= depth or not len(wide):
                nodes.append((-1, 0.0, 0, 0, level + float(_mean_path(len(at)))))
                continue
            f = int(rng.choice(wide))
            c = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            nodes.append((f, c, 0, 0, 0.0))
            left = part[:, f] < c
            todo.extend([(at[left], level + 1, me, 0), (at[~left], level + 1, me, 1)])
        forest.append(tuple(np.array(x) for x in zip(*nodes, strict=True)))
    expected = max(float(_mean_path(size)), 1e-12)

    def path(m: np.ndarray) -> np.ndarray:
        total = np.zeros(len(m))
        for f, c, a, b, v in forest:
            at = np.zeros(len(m), dtype=np.int64)
            while (inner := f[at] >= 0).any():
                i = np.flatnonzero(inner)
                n = at[i]
                at[i] = np.where(m[i, f[n]] < c[n], a[n], b[n])
            total += v[at]
        return -(2.0 ** (-(total / len(forest)) / expected))

    return _score(_asked(vectors, of), path)


def kth_distance(vectors: DataFrame, fit: Column | str, k: int = 5, of: DataFrame | None = None) -> DataFrame:
    """Minus the distance to the k-th nearest fitted vector; a fitted row meets itself first."""
    n = nearest_neighbours(vectors.where(fit), k, _asked(vectors, of), with_self=True)
    return n.groupBy("id").agg((-F.max("distance")).alias("score"))


def local_outlier_factor(vectors: DataFrame, fit: Column | str, k: int = 20, of: DataFrame | None = None) -> DataFrame:
    """Minus the local outlier factor of each row against the fitted rows (Breunig et al. 2000), by two joins over the neighbour lists."""
    base = vectors.where(fit)
    inner = nearest_neighbours(base, k)
    reach = inner.groupBy("id").agg(F.max("distance").alias("kdist"))
    rd = lambda n: n.join(reach.select(F.col("id").alias("neighbour"), "kdist"), "neighbour").groupBy("id").agg((1 / (F.avg(F.greatest("distance", "kdist")) + 1e-10)).alias("lrd"))
    density = rd(inner)
    outer = nearest_neighbours(base, k, _asked(vectors, of))
    own = rd(outer)
    lof = outer.join(density.select(F.col("id").alias("neighbour"), F.col("lrd").alias("near")), "neighbour").join(own, "id").groupBy("id").agg((-F.avg(F.col("near") / F.col("lrd"))).alias("score"))
    return lof


def ensemble(scores: list[DataFrame], fit_ids: DataFrame) -> DataFrame:
    """Mean of scores that are standardised by mean and population sd of the fitted rows."""
    out = None
    for i, s in enumerate(scores):
        m = s.join(fit_ids.select("id"), "id", "left_semi").agg(F.avg("score").alias("mu"), F.stddev_pop("score").alias("sd"))
        z = s.crossJoin(F.broadcast(m)).select("id", ((F.col("score") - F.col("mu")) / (F.col("sd") + 1e-12)).alias(f"z{i}"))
        out = z if out is None else out.join(z, "id")
    total = sum((F.col(f"z{i}") for i in range(1, len(scores))), F.col("z0"))
    return out.select("id", (total / len(scores)).alias("score"))


def one_class_svm(vectors: DataFrame, fit: Column | str, nu: float = 0.05, gamma: float | None = None, most_rows: int = 2000, steps: int = 20_000, seed: int = 42, of: DataFrame | None = None) -> DataFrame:
    """Decision value of a one-class SVM with RBF kernel (Schoelkopf et al. 2001).

    The dual is solved by exchanges of the most violating pair on a hash-drawn sample of at most ``most_rows`` rows,
    which is all that reaches the driver; a warning tells if ``steps`` exchanges were not enough. gamma defaults to 1 / (dimensions * variance).
    """
    draw = vectors.where(fit).where("vector is not null").orderBy(F.xxhash64(F.lit(seed), "id")).limit(most_rows).select("vector").toPandas()
    if not len(draw):
        raise ValueError("no vectors to fit")
    x = np.stack(draw["vector"].to_numpy()).astype(np.float64)
    g = gamma if gamma is not None else 1 / (x.shape[1] * max(x.var(), 1e-12))
    square = (x * x).sum(axis=1)
    kernel = np.exp(-g * np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0))
    n, most = len(x), 1 / (nu * len(x))
    a = np.zeros(n)
    full = min(int(nu * n), n)
    a[:full] = most
    if full < n:
        a[full] = 1 - full * most
    grad = kernel @ a
    gap = np.inf
    for _ in range(steps):
        up, down = np.where(a < most - 1e-12, grad, np.inf), np.where(a > 1e-12, grad, -np.inf)
        i, j = int(np.argmin(up)), int(np.argmax(down))
        gap = down[j] - up[i]
        if gap < 1e-6:
            break
        step = min((grad[j] - grad[i]) / max(2 - 2 * kernel[i, j], 1e-12), most - a[i], a[j])
        a[i], a[j] = a[i] + step, a[j] - step
        grad += step * (kernel[:, i] - kernel[:, j])
    else:
        warnings.warn(f"one-class SVM not converged after {steps} exchanges: violation {gap:.3g} of 1e-6 allowed", RuntimeWarning, stacklevel=2)
    inner = (a > 1e-9) & (a < most - 1e-9)
    rho = float(grad[inner].mean()) if inner.any() else float((grad[a > 1e-9].max() + grad[a < most - 1e-9].min()) / 2) if (a < most - 1e-9).any() else float(grad.max())
    sv = a > 1e-9
    xs, ws, ss = x[sv], a[sv], square[sv]
    return _score(_asked(vectors, of), lambda m: np.exp(-g * np.maximum((m * m).sum(axis=1)[:, None] + ss[None, :] - 2 * m @ xs.T, 0)) @ ws - rho)


SCORERS: dict[str, Callable[..., DataFrame]] = {"isolation_forest": isolation_forest, "mahalanobis": mahalanobis, "pca_reconstruction": reconstruction, "one_class_svm": one_class_svm, "lof": local_outlier_factor, "knn": kth_distance}


def scorer(name: str) -> Callable[..., DataFrame]:
    """A scorer by name."""
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; known: {', '.join(SCORERS)}")
    return SCORERS[name]
