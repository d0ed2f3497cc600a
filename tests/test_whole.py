"""Queries that have no SQL twin, or one that holds for a part of their input only, against brute force."""

import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import draws, effects, evaluate, matching, normalise, scorers
from assaylake.plans import q_evaluate, q_filters, q_matrix, q_more, q_names
from assaylake.sources import readers
from oracle import assert_same

NAMES = ["α-D-Glucose", "alpha-D-Glucose", "Citrulline ", "4‑hydroxy–X", "γ‐GABA", "Ｃortisol.HMDB0000063", "µ-Thing.HMDB0000099", "20:3ω6", "20:3W6", "ϑ-acid", "plain", "Δ", None]
ENTRIES = [("HMDB0000001", "Alpha-D-Glucose", None), ("HMDB0000002", "Citrulline", None), ("HMDB0000003", "4-Hydroxy-X", ["4HX"]), ("HMDB0000004", "gamma GABA", None), ("HMDB0000005", "Theta-acid", ["20:3omega6"])]


def brute_normal(s):
    t = "".join(unicodedata.name(c).rsplit(" ", 1)[-1].replace("LAMDA", "LAMBDA") if unicodedata.name(c, "").startswith("GREEK") else c for c in unicodedata.normalize("NFKC", s))
    return re.sub(r"(?i)(?<=\d)W(?=\d)", "OMEGA", t).strip().upper()


def brute_loose(s):
    return re.sub("[^A-Z0-9]+", "", brute_normal(s))


def folder(spark, tmp_path):
    spark.createDataFrame([(n,) for n in NAMES], "feature string").write.parquet(f"{tmp_path}/feature_to_hmdb.parquet")
    spark.createDataFrame(ENTRIES, "accession string, name string, synonyms array<string>").write.parquet(f"{tmp_path}/hmdb_metabolites.parquet")
    return str(tmp_path)


def test_names_beyond_ascii(spark, tmp_path):
    d, every, q = folder(spark, tmp_path), [n for n in NAMES if n], q_names.queries()
    tag = lambda n: (m := re.search(r"(?:^|\.)(HMDB[0-9]{3,})$", brute_normal(n))) and m[1]
    assert {tuple(r) for r in q["T10_normal_name_whole"](spark, d).collect()} == {(n, brute_normal(n)) for n in every}
    assert {tuple(r) for r in q["T11_loose_name_whole"](spark, d).collect()} == {(n, brute_loose(n)) for n in every}
    assert {tuple(r) for r in q["T12_accession_tag_whole"](spark, d).collect()} == {(n, tag(n)) for n in every}
    exact, loose = ({f(n) for _, n, _ in ENTRIES} for f in (brute_normal, brute_loose))
    want = {(n, "tag" if "HMDB" in n else "exact" if brute_normal(n) in exact else "loose") for n in every if "HMDB" in n or brute_normal(n) in exact or brute_loose(n) in {x for x in loose if len(x) >= 3}}
    assert {tuple(r) for r in q_filters.queries()["F22_keep_listed_whole"](spark, d).select("feature", "matched").collect()} == want
    index = [(a, x) for a, n, more in ENTRIES for x in (a, n, *(more or []))]
    want = set()
    for n in every:
        hits, how = {tag(n)} - {None}, "hmdb_tag"
        if not hits:
            hits, how = {a for a, x in index if brute_normal(x) == brute_normal(n)}, "name_exact"
        if not hits and len(brute_loose(n)) >= 3:
            hits, how = {a for a, x in index if brute_loose(x) == brute_loose(n)}, "name_loose"
        want |= {(n, h, how, len(hits)) for h in hits} or {(n, None, "unmatched", 0)}
    assert {tuple(r) for r in q_matrix.queries()["J11_match_features_whole"](spark, d).collect()} == want


def test_whole_width_round_trip(spark, sf):
    name = "R01_wide_round_trip_whole"
    assert_same(spark, sf, q_more.queries()[name], q_more.oracle_sql()[name])
    n = {r.sample_id for r in q_more.queries()[name](spark, sf).select("sample_id").distinct().collect()}
    assert len(n) == spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey").distinct().count()


def test_bootstrap_of_the_auc(spark, sf):
    rng = np.random.default_rng(12)
    # Ties, also over the 512 rows that are read at once.
    x = np.r_[np.round(rng.normal(size=900), 1), np.full(700, 0.3)]
    y = rng.random(1600) < 1 / (1 + np.exp(-x))
    df = spark.createDataFrame([(i, float(x[i]), bool(y[i])) for i in range(1600)], "id long, x double, y boolean")
    keys = np.array([r[0] for r in df.orderBy("id").select(F.xxhash64(F.lit(5), "id")).collect()])
    w = np.c_[np.ones(1600), draws.poisson(keys, 60)]
    assert abs(w[:, 1:].mean() - 1) < 0.01 and abs(w[:, 1:].var() - 1) < 0.02
    order = (x[:, None] > x[None, :]) + (x[:, None] == x[None, :]) / 2
    brute = [(w[:, r] * y) @ order @ (w[:, r] * ~y) / ((w[:, r] * y).sum() * (w[:, r] * ~y).sum()) for r in range(61)]
    want = (brute[0], *np.percentile(brute[1:], [2.5, 97.5]), 60)
    for parts in (1, 7):
        assert tuple(evaluate.bootstrap_auc(df, "id", "x", "y", 60, 5, parts=parts).first()) == pytest.approx(want)
    assert tuple(evaluate.bootstrap_auc(df.where("y"), "id", "x", "y", 20).first()) == (None, None, None, 0)
    assert q_evaluate.queries()["Q14_bootstrap"](spark, sf).first().n == 2000


def test_permanova_equals_brute_force(spark, sf):
    rng = np.random.default_rng(13)
    n, reps = 150, 99
    label, m = np.sort(rng.integers(0, 3, n)), rng.normal(size=(n, 4)) + 5
    m[:, 0] += 0.25 * label
    df = spark.createDataFrame([(i, m[i].tolist(), int(label[i])) for i in range(n)], "id int, vector array<double>, label int").repartition(5)
    keys = np.array([r[0] for r in df.orderBy("id").select(F.xxhash64(F.lit(7), "id")).collect()])

    def pseudo_f(g):
        between = sum((g == k).sum() * ((m[g == k].mean(axis=0) - m.mean(axis=0)) ** 2).sum() for k in range(3))
        return between / 2 / ((((m - m.mean(axis=0)) ** 2).sum() - between) / (n - 3))

    z = draws.mix(keys, np.arange(1, reps + 1)) >> np.uint64(1)
    dealt = [label[np.argsort(np.argsort(z[:, r]))] for r in range(reps)]
    f = pseudo_f(label)
    want = (f, (sum(pseudo_f(g) >= f for g in dealt) + 1) / (reps + 1))
    assert tuple(effects.permanova(df, reps).first()) == pytest.approx(want) and 0.01 < want[1] < 1
    p = q_evaluate.queries()["A14_permanova"](spark, sf).first().p_value
    assert p * 1001 == pytest.approx(round(p * 1001))


def test_threshold_stability_equals_brute_force(spark, sf, monkeypatch):
    rng = np.random.default_rng(14)
    rows = [(k, s, float(rng.gamma(2))) for k in ("a", "b") for s in range(40)] + [("c", 1, 2.0), ("d", 2, None)]
    df = spark.createDataFrame(rows, "k string, s long, x double")
    keys = dict(spark.range(40).select("id", F.xxhash64(F.lit(20260923), "id")).collect())
    drawn = {s: draws.mix(np.array([h]), np.arange(1, 201))[0] / 2.0**64 < 1 - np.exp(-1) for s, h in keys.items()}
    want = {}
    for k in "abc":
        cut = [np.percentile(x, 99) for r in range(200) if (x := [v for g, s, v in rows if g == k and drawn[s][r]])]
        q = np.percentile(cut, [25, 50, 75])
        want[k] = (pytest.approx(q[1]), pytest.approx((q[2] - q[0]) / q[1]))
    assert {r.k: (r["median"], r.wobble) for r in evaluate.threshold_stability(df, "k", "s", "x").collect()} == want
    # The query leaves the operator's count alone.
    given = {}
    monkeypatch.setattr(evaluate, "threshold_stability", lambda *a, **how: given.update(n=len(a), how=how))
    q_evaluate.queries()["Q21_threshold_stability"](spark, sf)
    assert given == {"n": 5, "how": {}}


def test_twenty_splits(spark, sf):
    name = "S20_repeated_splits_whole"
    assert_same(spark, sf, q_more.queries()[name], q_more.oracle_sql()[name])
    assert q_more.queries()[name](spark, sf).select("seed").distinct().count() == 20


def test_audit_of_unlinked_markers(spark, tmp_path):
    df = spark.createDataFrame([("D1", "Octanoyl-carnitine ↑; Glucose ↓; α-Thing*; Zed; Glucose", "(no HMDB entry found); Glucose (HMDB0000122); (no HMDB entry found); none; (no HMDB entry found)", None)], "Disease string, Biochemical_Markers string, `HMDB codes of named metabolites` string, `SMPDB code (SMP)` string")
    bare = readers.parse_diseases(df, coded=False).withColumn("hmdb_id", F.lit(None).cast("string"))
    markers = bare.select("disease", "marker", "direction", "hmdb_id").unionByName(spark.createDataFrame([("D2", "Glucose", "up", "HMDB0000122"), ("D2", "Lactate", "up", "HMDB0000999")], "disease string, marker string, direction string, hmdb_id string"))
    features = spark.createDataFrame([(x,) for x in ("octanoyl carnitine.HMDB0000215", "Octanoylcarnitine", "Alpha-thing.HMDB0000007", "alpha thing", "glucose", "Glucose", None)], "feature string")
    index = matching.name_index(spark.createDataFrame([("HMDB0000122", "Glucose", None), ("HMDB0000123", "X", ["glucose"])], "accession string, name string, synonyms array<string>"))
    out = matching.audit_unlinked(markers, spark.createDataFrame([("HMDB0000122",), (None,)], "hmdb_id string"), features, index)
    got = {(r.disease, r.marker, r.direction, r.matched_features, r.name_index_accessions) for r in out.collect()}
    assert got == {
        ("D1", "Octanoyl-carnitine", "up", "Octanoylcarnitine;octanoyl carnitine.HMDB0000215", ""),
        ("D1", "α-Thing", "", "Alpha-thing.HMDB0000007", ""),
        ("D1", "Zed", "", "", ""),
        ("D1", "Glucose", "", "Glucose;glucose", "HMDB0000122;HMDB0000123"),
        ("D2", "Lactate", "up", "", ""),
    }
    spark.createDataFrame([("A", "hmdb0000001 "), ("α-D-Glucose", None), ("4‑hydroxy-X", None)], "feature string, hmdb_id string").write.parquet(f"{tmp_path}/feature_to_hmdb.parquet")
    spark.createDataFrame(ENTRIES, "accession string, name string, synonyms array<string>").write.parquet(f"{tmp_path}/hmdb_metabolites.parquet")
    got = {r.hmdb_id: r.matched_features for r in q_matrix.queries()["J17_unlinked_audit"](spark, str(tmp_path)).collect()}
    assert got == {"HMDB0000002": "", "HMDB0000003": "4‑hydroxy-X", "HMDB0000004": "", "HMDB0000005": ""}


def test_shared_drift_equals_brute_force(spark):
    rng = np.random.default_rng(15)
    rows, want = [], {}
    for batch, size, step in ((1, 30, 4), (2, 36, 3), (3, 10, 10), (4, 66, 3)):
        qc = np.arange(size) % step == 0
        v = (np.arange(8)[:, None] + 3) * (1 + 0.02 * np.arange(size)) * rng.uniform(0.9, 1.1, (8, size))
        rows += [(f"f{j}", batch, i, bool(qc[i]), float(v[j, i])) for j in range(8) for i in range(size)]
        factor, x = np.ones((8, size)), np.flatnonzero(qc)
        if len(x) >= 2:
            means = v[:, qc].mean(axis=1)
            high = means >= np.quantile(means, 0.3)
            assert 4 < high.sum() < 8
            for j in np.flatnonzero(high):
                smooth = normalise.lowess(x.astype(float), v[j, qc], 1.0 if len(x) < 10 else 0.5 if len(x) < 20 else 0.3)
                at = means[j] / np.where(smooth > 0, smooth, means[j])
                factor[j] = [at[np.argmin(abs(x - i))] for i in range(size)]
            factor[~high] = np.median(factor, axis=0)
        want |= {(f"f{j}", batch, i): v[j, i] * factor[j, i] for j in range(8) for i in range(size)}
    df = spark.createDataFrame(rows, "feature string, batch int, position int, is_qc boolean, value double")
    got = {(r.feature, r.batch, r.position): r.value for r in normalise.drift_correct_shared(df, 0.3, 0.7).collect()}
    assert got == pytest.approx(want)


def test_trees_draw_from_all_rows(spark):
    df = spark.range(4000).select("id", F.array(F.col("id").cast("double")).alias("vector"))
    got = {}
    for r in scorers.tree_rows(df, 30, 8).collect():
        assert r.vector == [float(r.id)]
        got.setdefault(r.tree, set()).add(r.id)
    h = {t: sorted((x % 2**64 >> 11, i) for i, x in df.select("id", F.xxhash64(F.lit(42), F.lit(t), "id")).collect()) for t in (0, 29)}
    assert all({i for _, i in h[t][:8]} == got[t] for t in h) and all(len(v) == 8 for v in got.values())
    # One pool of 16 trees' rows could not give as many.
    assert len(set.union(*got.values())) > 16 * 8


def test_svm_tells_that_it_did_not_converge(spark):
    rng = np.random.default_rng(16)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(200)], "id int, vector array<double>")
    with pytest.warns(RuntimeWarning, match="not converged after 3 exchanges"):
        scorers.one_class_svm(df, "true", steps=3)
