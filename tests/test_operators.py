import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.functions import names as N
from assaylake.operators import effects, evaluate, filters, labels, matching, normalise, ordered, pathways, scorers


def column(spark, c, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(c(F.col("x"))).collect()]


def test_injection_names(spark):
    files = [r"C:\data\posneg_MZ25_36_25230101131_1.raw", "expQC_MZ25_36_1.raw", "QC3_2.raw", "SampleB (replicate).raw", None, ""]
    assert column(spark, N.clean_name_keep_qc, files) == ["posneg_MZ25_36_25230101131", "expQC_MZ25_36_1", "QC3", "SampleB", None, ""]
    assert column(spark, N.batch_of, files[:3]) == ["MZ25_36", "MZ25_36", "QC3_2"]
    assert column(spark, N.clean_name, ["a_10.raw", "a_1.raw"]) == ["a_10", "a"]


def test_names(spark):
    assert column(spark, N.normal_name, ["\ufeffα-D-Glucose", "ω3", "20:3W6", "1W2", None, " x "]) == ["ALPHA-D-GLUCOSE", "OMEGA3", "20:3OMEGA6", "1OMEGA2", None, "X"]
    assert column(spark, N.loose_name, ["Coproporphyrin-III", "coproporphyrin iii"]) == ["COPROPORPHYRINIII"] * 2
    assert column(spark, N.split_outside, ["a (b; c); d;; [e;f]"]) == [["a (b; c)", "d", "[e;f]"]]
    assert column(spark, N.marker_direction, ["Octanoylcarnitine ↑", "Glucose ↓", "x"]) == ["up", "down", ""]
    assert column(spark, N.slug, ["A & B (x)", "--"]) == ["a-b-x", "disease"]


def test_feature_matching(spark):
    index = matching.name_index(spark.createDataFrame([("HMDB0000161", "L-Alanine", ["Alanine"]), ("HMDB0000538", "ATP", None)], "accession string, name string, synonyms array<string>"))
    f = spark.createDataFrame([(x,) for x in ("Cortisol.HMDB0000161", "HMDB0000538", "L-Alanine", "l alanine", "Unknown compound")], "feature string")
    got = {r.feature: (r.hmdb_id, r.match_method, r.n_hmdb_ids) for r in matching.match_features(f, index).collect()}
    assert got == {"Cortisol.HMDB0000161": ("HMDB0000161", "hmdb_tag", 1), "HMDB0000538": ("HMDB0000538", "hmdb_tag", 1), "L-Alanine": ("HMDB0000161", "name_exact", 1), "l alanine": ("HMDB0000161", "name_loose", 1), "Unknown compound": (None, "unmatched", 0)}


def test_stouffer(spark):
    values = {"f1": [1, 0, 0.5, 0], "f2": [1, 0, 0.5, 0], "f3": [1, 0, 0.5, 0], "f4": [None, 0, 0, 0]}
    z = spark.createDataFrame([(f, f"s{i + 1}", None if x is None else float(x)) for f, v in values.items() for i, x in enumerate(v)], "feature string, sample string, z double")
    links = spark.createDataFrame([("f1", "H1", "P"), ("f2", "H2", "P"), ("f3", "H3", "P"), ("f4", "H1", "P")], "feature string, hmdb_id string, smp_id string")
    got = {r.sample: (r.n_metabolites_used, r.z_stouffer, r.z_stouffer_abs) for r in pathways.stouffer(z, links, z.select("sample")).collect()}
    assert got["s1"] == (3, pytest.approx(3 / math.sqrt(3)), pytest.approx(3 / math.sqrt(3))) and got["s2"] == (3, 0.0, 0.0)
    assert pathways.stouffer(z, links.where("feature = 'f1'"), z.select("sample")).count() == 0


def test_weighted_metabolite(spark):
    z = spark.createDataFrame([("wide", "s", 1.0), ("thin", "s", 15.0), ("gone", "s", None)], "feature string, sample string, z double")
    ids = spark.createDataFrame([("wide", "H"), ("thin", "H"), ("gone", "H")], "feature string, hmdb_id string")
    w = spark.createDataFrame([("wide", 0.09), ("thin", 0.0025), ("gone", 1.0)], "feature string, weight double")
    assert pathways.metabolite_z(z, ids, w).first().z == pytest.approx((0.09 + 0.0375) / 0.0925)


def test_panel_directions(spark):
    z = spark.createDataFrame([(s, h, v) for h, vs in (("A", [5.0, -5.0, 5.0]), ("B", [1.0, 1.0, -4.0])) for s, v in zip("abc", vs)], "sample string, hmdb_id string, z double")
    m = spark.createDataFrame([("p", "A", "up"), ("p", "B", "down")], "panel string, hmdb_id string, direction string")
    got = {r.sample: (r.k, r.score) for r in pathways.panel_scores(z, m).collect()}
    assert got == {"a": (2, pytest.approx(5 / math.sqrt(2))), "b": (2, 0.0), "c": (2, pytest.approx(9 / math.sqrt(2)))}


def test_binomial_tail(spark):
    df = spark.createDataFrame([(2, 4, 0.25), (0, 4, 0.2), (5, 4, 0.2), (1, 234, 0.01)], "k int, n int, p double")
    got = [r[0] for r in df.select(pathways.binomial_sf(F.col("k"), F.col("n"), F.col("p"))).collect()]
    assert got == [pytest.approx(1 - 0.75**4 - 4 * 0.25 * 0.75**3), 1.0, 0.0, pytest.approx(1 - 0.99**234)]


def test_flags_at_zero_threshold(spark):
    df = spark.createDataFrame([("p", 0.0, True), ("p", 0.0, True), ("p", 2.0, False), ("p", None, False), ("q", 1.0, False)], "k string, s double, normal boolean")
    got = [(r.s, r.excess, r.flagged) for r in pathways.threshold_flags(df, ["k"], "s", "normal").orderBy("k", "s", "flagged").collect()]
    assert got == [(None, None, False), (0.0, None, False), (0.0, None, False), (2.0, math.inf, True), (1.0, 0.0, False)]


def test_hygiene_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 0.2, (40, 3))
    v[7, 1] += 6
    v[8, 2] = v[9, 2] = 12
    df = spark.createDataFrame([(f"f{j}", i, float(v[i, j])) for i in range(40) for j in range(3)], "feature string, sample int, value double")
    left, out = set(range(40)), set()
    for _ in range(10):
        bad = set()
        for i in left:
            o = v[sorted(left - {i})]
            q = np.percentile(o, [25, 50, 75], axis=0)
            if np.max(np.abs(v[i] - q[1]) / (q[2] - q[0])) > 10:
                bad.add(i)
        if not bad:
            break
        out |= bad
        left -= bad
    assert {r.sample for r in pathways.hygiene(df, 10.0).collect()} == out and out


def test_clopper_pearson():
    low, high = evaluate.clopper_pearson(8, 10)
    assert 0.44 < low < 0.52 and 0.94 < high < 0.99
    assert evaluate.clopper_pearson(0, 5)[0] == 0 and evaluate.clopper_pearson(5, 5)[1] == 1


def test_roles(spark):
    rows = [(1.0, 1.0, 1.0, "outlier"), (1.0, 1.0, 0.0, "gray"), (1.0, 1.0, None, "gray"), (0.0, 0.0, None, "inlier"), (2.0, 1.0, 1.0, "gray"), (3.0, 0.0, 0.0, "gray"), (0.0, 1.0, 1.0, "gray"), (None, 1.0, 1.0, None), (1.0, None, 1.0, None)]
    df = spark.createDataFrame(rows, "c double, o double, n double, want string")
    assert all(r.got == r.want for r in df.select("want", labels.lab_role(F.col("c"), F.col("o"), F.col("n")).alias("got")).collect())


def test_combined_flags(spark):
    m = spark.createDataFrame([("N1", False), ("A1", True), ("A2", False), ("A3", True)], "id string, flagged boolean")
    got = {r.id: (r.guardrail, r.combined) for r in evaluate.combine(m, spark.createDataFrame([("A2",)], "id string"), "id").collect()}
    assert got == {"N1": (False, False), "A1": (False, True), "A2": (True, True), "A3": (False, True)}


def test_ratios(spark):
    df = spark.createDataFrame([("s", "a", 2.0), ("s", "b", 1.0), ("t", "a", 1.0), ("t", "b", None)], "sample string, feature string, value double")
    got = {r["sample"]: r.value for r in normalise.log_ratio(df, "r", ["a"], ["b"]).collect()}
    assert got == {"s": pytest.approx(1.0), "t": None}
    assert normalise.log_ratio(df, "r", ["a"], ["zz"]).count() == 0


def test_pqn_undoes_dilution(spark):
    rng = np.random.default_rng(1)
    base = rng.uniform(1, 100, 25)
    rows = [(f"f{j}", i, i < 3, float(base[j] * (1 if i < 3 else i))) for i in range(6) for j in range(25)]
    df = spark.createDataFrame(rows, "feature string, sample int, is_qc boolean, value double")
    assert all(abs(r.value - base[int(r.feature[1:])]) < 1e-6 for r in normalise.pqn(df, ()).collect())


def test_lowess_follows_a_line_and_ignores_outliers():
    x = np.arange(20, dtype=float)
    y = 3 + 2 * x
    assert np.allclose(normalise.lowess(x, y, 0.5), y)
    y2 = y + np.random.default_rng(0).normal(0, 0.1, 20)
    y2[10] += 50
    assert np.abs(normalise.lowess(x, y2, 0.6) - y)[10] < 1


def test_drift_is_removed(spark):
    rows = [("f", 1, i, i % 4 == 0, 100.0 * (1 + 0.02 * i)) for i in range(24)] + [("few", 2, i, i == 0, 5.0) for i in range(4)]
    df = spark.createDataFrame(rows, "feature string, batch int, position int, is_qc boolean, value double")
    out = normalise.drift_correct(df).toPandas()
    # Behind the last control the factor stays, so the drift goes on there.
    f = out[(out.feature == "f") & (out.position <= 20)].value
    assert f.std() / f.mean() < 0.02 and (out[out.feature == "few"].value == 5).all()


def test_combat_removes_batch_effects(spark):
    rng = np.random.default_rng(2)
    rows = [(f"f{j}", i, i % 2, float(rng.normal(10 + j % 5, 1) + 3 * (i % 2))) for j in range(40) for i in range(40)] + [("flat", i, i % 2, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "feature string, sample int, batch int, value double")
    out = normalise.combat(df).toPandas()
    m = out[out.feature != "flat"].groupby("batch").value.mean()
    assert abs(m[0] - m[1]) < 0.05 and (out[out.feature == "flat"].value == 1).all()


def test_components_of_a_chain(spark):
    n = 60
    v = spark.createDataFrame([(i,) for i in range(n + 3)], "key int")
    e = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(n, n + 1)], "a int, b int")
    got = {r.key: r.component for r in matching.components(v, e).collect()}
    assert got == {**{i: 0 for i in range(n)}, n: n, n + 1: n, n + 2: n + 2}


def test_empty_and_tied_order(spark):
    df = spark.createDataFrame([(1.0, True), (1.0, False), (2.0, True), (None, True)], "x double, nul boolean")
    got = sorted((r.x is None, r.x, r.p_value) for r in ordered.empirical_p(df, "x", "nul").collect() if r.x is not None)
    assert got == [(False, 1.0, 1.0), (False, 1.0, 1.0), (False, 2.0, 0.5)]
    assert ordered.auc(df.where("x > 5"), "x", "nul").first().auc is None


def test_blocks_give_the_same_neighbours(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, m[i].tolist(), i % 3) for i in range(60)], "id int, vector array<double>, label int")
    one, many = (sorted(map(tuple, effects.nearest_neighbours(df, 4, numbers=n).select("id", "neighbour", "rank").collect())) for n in (10**6, 70))
    assert one == many and len(one) == 240
    d = np.linalg.norm(m[:, None] - m[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert {(i, n) for i, n, _ in one} == {(i, int(n)) for i in range(60) for n in np.argsort(d[i])[:4]}


def test_scorers_find_the_outlier(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(120, 6))
    m[0] = 9
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(120)], "id int, vector array<double>")
    fit = "id % 4 <> 0"
    for name, options in (("isolation_forest", {}), ("mahalanobis", {}), ("one_class_svm", {}), ("lof", {"k": 8}), ("knn", {"k": 3})):
        assert scorers.scorer(name)(df, fit, **options).orderBy("score").first().id == 0, name
    n, mean, cov = scorers.moments(df)
    assert n == 120 and np.allclose(mean, m.mean(axis=0)) and np.allclose(cov, np.cov(m.T, ddof=0))
    with pytest.raises(ValueError):
        scorers.scorer("nothing")


def test_permanova_tells_groups_apart(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, (rng.normal(size=3) + 4 * (i % 2)).tolist(), i % 2) for i in range(40)], "id int, vector array<double>, label int")
    assert effects.permanova(df, 19).first().p_value == pytest.approx(0.05)


def test_filters_on_empty_input(spark):
    df = spark.createDataFrame([], "feature string, sample int, batch int, is_qc boolean, is_blank boolean, is_bridge boolean, value double")
    for f in (lambda d: filters.low_intensity(d, 1.0), filters.blank_contaminant, lambda d: filters.low_variance(d, quantile=0.5), filters.in_batches, filters.qc_rsd, filters.qc_present, filters.qc_quality):
        assert f(df).count() == 0


def test_retention_chains(spark):
    rows = [(0, "a_1", "a", 1.00, 0), (1, "a_2", "a", 1.015, 1), (1, "a_3", "a", 1.03, 2), (0, "a_4", "a", 1.10, 3), (1, "b_1", "b", 1.0, 4)]
    df = spark.createDataFrame(rows, "batch_pos int, feature string, base string, rt double, row int")
    assert {r.feature: r.match_key for r in matching.match_retention(df).collect()} == {"a_1": "a_1", "a_2": "a_1", "a_3": "a_1", "a_4": "a_4", "b_1": "b_1"}


def test_one_class_svm_keeps_its_share(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "id int, vector array<double>")
    s = scorers.one_class_svm(df, "true", nu=0.1).toPandas().score
    assert 0.03 < (s < -1e-4).mean() < 0.13


def test_grid_search(spark):
    from assaylake.operators import tuning

    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(i, (rng.normal(size=3) + (6 if i % 10 == 0 else 0)).tolist(), i % 10 != 0) for i in range(100)], "id int, vector array<double>, is_normal boolean")
    out = tuning.grid_search(tuning.with_folds(df, 2), "knn", tuning.grid(k=[2, 3]), 2).collect()
    assert len(out) == 2 and out[0].auc > 0.99


def test_near_misses_equal_brute_force(spark):
    import re

    from assaylake.operators.filters import FRAGMENTS, near_misses

    names = ["Cortisol", "Citric acid", "N-Acetylglycine", "Sulfate", "short", "2-Oxo-3-methylvalerate", None]
    dropped = ["cortisol sulfate", "cortisolone", "plain citric acid (x)", "acetylglycine", "3-methylvalerate", "methylvaleratex", "sulfate", "citric  acid", None, "z" * 100 + " cortisol"]
    d, n = spark.createDataFrame([(x,) for x in dropped], "feature string"), spark.createDataFrame([(x,) for x in names], "name string")
    want = set()
    for f in filter(None, dropped):
        for e in (x.upper() for x in names if x and len(x) >= 6 and x.upper() not in FRAGMENTS):
            short, long = sorted((f.upper(), e), key=len)
            if len(f) <= 80 and len(short) >= 6 and re.search(r"(?<![A-Z0-9])" + re.escape(short) + r"(?![A-Z0-9])", long):
                want.add((f, e))
    assert {(r.feature, r.name) for r in near_misses(d, n, F.upper).collect()} == want and len(want) == 4


def test_combat_does_not_depend_on_arrow_batches(spark):
    import numpy as np

    from assaylake.operators.normalise import combat

    rng = np.random.default_rng(2)
    rows = [(f"f{i}", s, s % 3, float(rng.normal(i, 1 + s % 3))) for i in range(40) for s in range(30)]
    df = spark.createDataFrame(rows, "feature string, sample int, batch int, value double")
    name, got = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    for size in ("1", "10000"):
        spark.conf.set(name, size)
        got.append({(r.feature, r.sample): r.value for r in combat(df, floor_at_zero=False).collect()})
    spark.conf.set(name, before)
    assert got[0].keys() == got[1].keys() and all(abs(v - got[1][k]) <= 1e-11 * abs(v) for k, v in got[0].items())


def test_lowess_by_blocks_is_the_same(spark):
    import numpy as np

    from assaylake.operators.normalise import lowess

    rng = np.random.default_rng(4)
    x = np.sort(rng.integers(0, 90, 60)).astype(float)
    y = np.sin(x / 9) + rng.normal(scale=0.2, size=60)
    assert np.allclose(lowess(x, y, 0.4), lowess(x, y, 0.4, numbers=420), rtol=1e-12)


@pytest.mark.parametrize("hot_rows", [40, 10**6])
def test_group_percentiles_of_hot_groups(spark, hot_rows):
    rng = np.random.default_rng(9)
    data = {"a": rng.normal(size=900), "same": np.full(400, 2.5), "small": rng.normal(size=5), None: rng.integers(0, 4, 300).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x] + [("a", None), ("none", None)], "g string, v double").repartition(5)
    got = {r.g: r for r in ordered.group_percentiles(df, ["g"], F.col("v"), [0.0, 0.5, 0.95, 1.0], ["a", "b", "c", "d"], hot_rows).collect()}
    assert set(got) == {*data, "none"} and got["none"].b is None
    for k, x in data.items():
        assert np.allclose([got[k][c] for c in "abcd"], np.quantile(x, [0, 0.5, 0.95, 1]), rtol=1e-12), k


def test_join_frequent_keeps_rows(spark):
    from assaylake.common import hot_keys, join_frequent

    df = spark.createDataFrame([(i, None if i % 7 == 0 else "hot" if i % 2 else f"k{i % 5}") for i in range(500)], "i int, k string")
    keyed = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("m"))
    want = {r.k: r.m for r in keyed.collect()}
    for least in (10**6, 50, 1):
        rows = join_frequent(df, keyed, ["k"], least).collect()
        assert sorted(r.i for r in rows) == list(range(500)) and all(r.m == want[r.k] for r in rows)
    assert {(r.k, r.salts) for r in hot_keys(df, ["k"], 100).collect()} == {("hot", 3)}
    assert hot_keys(df.limit(0), ["k"], 1).count() == 0


def test_numbers_and_percentiles_without_one_task(spark):
    import numpy as np

    from assaylake.operators.ordered import numbered, percentiles, ranges_of

    x = np.random.default_rng(6).integers(0, 40, 500).astype(float)
    df = spark.createDataFrame([(i, None if i % 50 == 0 else float(v)) for i, v in enumerate(x)], "id int, x double").repartition(4)
    rows = numbered(df, [], ranges_of(df, "x", 7), [F.asc_nulls_last("x"), F.col("id")], "n", "all").collect()
    want = sorted(range(500), key=lambda i: (i % 50 == 0, x[i] if i % 50 else 0, i))
    assert [r.id for r in sorted(rows, key=lambda r: r.n)] == want and {r["all"] for r in rows} == {500}
    one = percentiles(df, "x", [0.0, 0.33, 1.0], ["a", "b", "c"]).first()
    assert np.allclose(one, np.quantile(x[np.arange(500) % 50 != 0], [0, 0.33, 1]))
    assert tuple(percentiles(df.where("false"), "x", [0.5], ["m"]).first()) == (None,)
