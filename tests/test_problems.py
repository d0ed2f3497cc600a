import datetime as dt
import random

import numpy as np
import pytest

from assaylake.common import latest_version
from assaylake.operators.impute import fill_from_donors, nearest_donors, with_prediction
from assaylake.operators.references import normal_key, orphan_references
from pyspark.sql import functions as F


def test_latest_version(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (2, None, "x"), (2, 0, "y"), (None, 5, "n")]
    df = spark.createDataFrame(rows, "id int, at int, v string")
    assert sorted(map(tuple, latest_version(df, "id", "at", ["id", "v"]).collect())) == [(1, "b"), (2, "y")]
    assert latest_version(df.limit(0), "id", "at", ["id", "v"]).count() == 0


def brute_donors(rows):
    out = set()
    for i, g, v, p in rows:
        if v is None and p is not None and g is not None:
            d = [(abs(p - q), q, j, w) for j, h, w, q in rows if w is not None and q is not None and h == g]
            if d:
                best = min(d)
                out.add((i, best[3], best[2]))
    return out


@pytest.mark.parametrize("range_rows", [3, 7, 100_000])
def test_nearest_donors_equal_brute_force(spark, range_rows):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, None, 1, 2, 3]), rng.choice([None, *range(40)])) for i in range(400)]
    rows += [(1000 + i, "hot", 7 if i in (3, 150) else None, i) for i in range(200)] + [(2000 + i, "same", None if i % 2 else i, 5) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, g string, v int, p int").withColumn("bucket", F.lit(1)).withColumn("d", F.lit("x"))
    got = {(r.id, r.filled, r.donor_id) for r in nearest_donors(df, "id", ["g"], "v", "p", range_rows).collect()}
    assert got == brute_donors(rows)
    assert nearest_donors(df.limit(0), "id", ["g"], "v", "p").count() == 0


@pytest.mark.parametrize("slope", [0.0, 1.5, -2.0])
def test_donors_by_a_fit_on_time_are_the_nearest_in_time(spark, slope):
    rng = random.Random(11)
    rows = [(i, rng.choice("abc"), (None if rng.random() < 0.4 else float(round(slope * t + rng.random()))), 10**15 + t * 1_000_000) for i, t in enumerate(rng.choices(range(60), k=240))]
    df = spark.createDataFrame(rows, "id int, g string, v double, t long")
    fitted = with_prediction(df, ["g"], "v", ["t"])
    got = {(r.id, r.filled, r.donor_id) for r in nearest_donors(fitted, "id", ["g"], "v", "prediction", 50, along="t").collect()}
    assert got == brute_donors(rows)


def test_feature_donors_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 2))
    g = rng.integers(0, 3, 120)
    y = np.array([0.0, 5.0, -2.0])[g] + x @ [1.5, -0.5] + rng.normal(scale=0.1, size=120)
    missing = rng.random(120) < 0.3
    df = spark.createDataFrame([(i, int(g[i]), None if missing[i] else float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(120)], "id int, g int, y double, a double, b double")
    seen = ~missing
    mean = lambda v: np.array([v[seen & (g == k)].mean(axis=0) for k in range(3)])[g]
    dx, dy = x - mean(x), y - mean(y)
    pred = mean(y) + dx @ np.linalg.lstsq(dx[seen], dy[seen], rcond=None)[0]
    want = {}
    for i in np.flatnonzero(missing):
        own = np.flatnonzero(seen & (g == g[i]))
        want[int(i)] = int(own[np.argmin(np.abs(pred[own] - pred[i]))])
    fitted = with_prediction(df, ["g"], "y", ["a", "b"])
    assert np.allclose([r.prediction for r in fitted.orderBy("id").collect()], pred)
    assert {r.id: r.donor_id for r in nearest_donors(fitted, "id", ["g"], "y", "prediction").collect()} == want


def test_fill_marks_cells(spark):
    df = spark.createDataFrame([(1, "a", 5.0, 1.0), (2, "a", None, 2.0), (3, "b", None, 1.0)], "id int, g string, v double, p double")
    got = {r.id: (r.v, r.v_filled, r.v_donor) for r in fill_from_donors(df, "id", ["g"], "v", "p").collect()}
    assert got == {1: (5.0, False, None), 2: (5.0, True, 1), 3: (None, False, None)}


def test_group_aware_prediction(spark):
    rows = [(i, g, 2.0 * i + s, float(i)) for g, s in (("a", 10.0), ("b", -3.0)) for i in range(6)] + [(9, "a", None, 9.0), (7, "c", None, None)]
    df = spark.createDataFrame(rows, "i int, g string, y double, x double")
    got = {(r.i, r.g): r.prediction for r in with_prediction(df, ["g"], "y", ["x"]).collect()}
    assert abs(got[(9, "a")] - 28.0) < 1e-9 and got[(7, "c")] is not None
    assert abs(got[(3, "b")] - 3.0) < 1e-9


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("hot_least", [3, 100_000])
def test_orphans(spark, hot_least):
    parents = [("t", "A", day(0), day(10)), ("t", "A", day(20), None), ("t", "A", day(20), None), ("t", "B", day(5), None), ("t", "C", None, None), ("t", "D", day(9), day(9)), ("u", "Z", day(0), None)]
    at = [-1, 0, 9, 10, 15, 20, 30, None]
    refs = [("r", i * 10 + j, "f", "t", k, None if a is None else day(a)) for i, k in enumerate("ABCDZ") for j, a in enumerate(at)] + [("r", 99, "f", "t", None, day(1))]
    want = {}
    for _, row, _, _, k, a in refs:
        if k is None:
            continue
        own = {(f, t) for p, q, f, t in parents if p == "t" and q == k and f is not None and (t is None or t > f)}
        if a is not None and any(f <= a and (t is None or t > a) for f, t in own):
            continue
        want[row] = "missing" if not own else "undated" if a is None else "late" if all(f > a for f, _ in own) else "deleted"
    r = spark.createDataFrame(refs, "table_name string, row_id int, field_name string, parent string, key string, at timestamp")
    p = spark.createDataFrame(parents, "parent string, key string, live_from timestamp, live_to timestamp")
    assert {x.row_id: x.status for x in orphan_references(r, p, hot_least).collect()} == want
    assert orphan_references(r.limit(0), p).count() == 0
    assert {x.status for x in orphan_references(r, p.limit(0)).collect()} == {"missing"}


def test_normal_key(spark):
    df = spark.createDataFrame([(" smp1 ",), ("\tSMP1\n",), ("  ",), ("",), (None,)], "k string")
    assert [r[0] for r in df.select(normal_key(F.col("k"))).collect()] == ["SMP1", "SMP1", None, None, None]
