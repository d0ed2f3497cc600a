import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from assaylake.llm import mapping as M
from assaylake.llm import mixing, packing, percentiles, spans, tokens, topn
from assaylake.llm import queries as Q
from oracle import assert_same


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    assert_same(spark, sf, Q.queries()[name], Q.oracle_sql()[name])


# Mapping

LISTED = [("HMDB0000001", "2-hydroxyoctanoyltaurine", ["2OH-C8-Tau"]), ("HMDB0000002", "Octanoyltaurine", None), ("HMDB0000003", "Rolmabmupic acid", ["rolmabmupinezuur", "ROL-668"]), ("HMDB0000004", "3-oxooctenoylglycine", []), ("HMDB0000005", "3-hydroxyoctenoylglycine", [])]
CASES = [
    ("2-hydroxyoctanoyltaurine", None, "HMDB0000001"), ("  2 – Hydroxy octanoyl-taurine @ 5.71 [M+H]+", None, "HMDB0000001"), ("taurine, 2-hydroxyoctanoyl_neg", "hmdb0000002", "HMDB0000001"), ("2-hydroxyoctanoyltaurinne (F12)", None, "HMDB0000001"),
    ("7-hydroxyoctanoyltaurine", None, "UNMATCHED"), ("7 - octanoyltaurine", None, "UNMATCHED"), ("2-hydroxyoctanoyltaurine-d3", None, "UNMATCHED"), ("octanoyltaurine IS d9", "hmdb0000002", "UNMATCHED"), ("octanoylsarcosine", "hmdb0000002", "UNMATCHED"),
    ("ROLMABMUPIC ACID; dup", None, "HMDB0000003"), ("rolmabmupic ac.", None, "HMDB0000003"), ("rol 668", None, "HMDB0000003"), ("rol 669", None, "UNMATCHED"), ("xyz.HMDB0000002", None, "HMDB0000002"), ("xyz.HMDB0009999", "HMDB0000002x", "UNMATCHED"),
    ("peak 12", "hmdb2", "HMDB0000002"), ("peak 12", "HMDB00000002", "HMDB0000002"), ("peak 12", "HMDB0000099", "UNMATCHED"), (None, " 0000003 ", "HMDB0000003"), ("", None, "UNMATCHED"), (None, None, "UNMATCHED"), ("3OHoctenoylglycine", None, "HMDB0000005"), ("?" * 5000 + " octanoyltaurine", None, "HMDB0000002"),
]


@pytest.mark.parametrize("shard_entries", [2, 50_000])
def test_mapping(spark, shard_entries):
    canonical = spark.createDataFrame([*LISTED, (None, "x", None)], "accession string, name string, synonyms array<string>")
    rows = [(i, t, c, "clash") for i, (t, c, _) in enumerate(CASES)] + [(900, "octanoyltaurine", "HMDB0000001", "clash")]
    values = spark.createDataFrame(rows, "entry_id int, feature string, hmdb_id string, name string")
    got = {r.entry_id: r.accession for r in M.map_to_canonical(values, "entry_id", "feature", "hmdb_id", canonical, "accession", "name", "synonyms", shard_entries).collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: w for i, (_, _, w) in enumerate(CASES)}
    assert 900 not in got
    assert {r.accession for r in M.map_to_canonical(values, "entry_id", "feature", "hmdb_id", canonical.limit(0), "accession", "name", "synonyms").collect()} == {"UNMATCHED"}
    assert M.map_to_canonical(values.limit(0), "entry_id", "feature", "hmdb_id", canonical, "accession", "name", "synonyms").count() == 0


@pytest.mark.parametrize("shard_entries", [1, 2, 50_000])
def test_mapping_keeps_rows_and_answers_whatever_the_shards(spark, shard_entries):
    listed = [("HMDB0000001", "gudbushotamide", None), ("HMDB0000002", "rolmabmupic acid", ["ROL-668"]), ("HMDB0000003", "gudbushotamide", ["twin"])]
    canonical = spark.createDataFrame([*listed, ("HMDB0000004", "kashotpinic acid", [])], "accession string, name string, synonyms array<string>")
    rows = [(7, "kashotpinic acid rolmabmupic acid", None), (7, "kashotpinic acid rolmabmupic acid", None), (None, "rolmabmupic acid", None), (None, "rolmabmupic acid", None), (3, "kashotpinic acid sarcosine rolmabmupic acid", None)]
    rows += [(4, "gudbushotamide", None), (5, "twin", None), (6, "rolmabmupicc acid", None), (8, "kashotpinic acid", "hmdb 2"), (9, "peak 1", "hmdb 2"), (10, "acid, kashotpinic, hmdb2", None), (11, "acid kashotpinic", None)]
    values = spark.createDataFrame(rows, "entry_id int, feature string, hmdb_id string")
    got = M.map_to_canonical(values, "entry_id", "feature", "hmdb_id", canonical, "accession", "name", "synonyms", shard_entries, hot_rows=1)
    tie = "UNMATCHED"
    want = [(7, tie), (7, tie), (None, "2"), (None, "2"), (3, tie), (4, tie), (5, "3"), (6, "2"), (8, "4"), (9, "2"), (10, "2"), (11, "4")]
    assert Counter((r.entry_id, r.accession) for r in got.collect()) == Counter((i, k if k == tie else f"HMDB000000{k}") for i, k in want)


PLACES = [("ams", "Amsterdam", ["Mokum"]), ("zrh", "Zürich", []), ("mow", "Москва", None), ("tyo", "東京", None), ("que", "Québec", None), ("acm", "Acme Incorporated", None), ("sam", "manager account senior", None), ("se2", "software engineer 2", None), ("se3", "software engineer 3", None), ("nyc", "New York City", None)]
TYPED = [
    ("Zurich", "zrh"), ("ZÜRICH ", "zrh"), ("Amsterdm", "ams"), ("City of Amsterdam", "ams"), ("Amsterdam (NL)", "ams"), ("Acme Inc", "acm"), ("quebec city", "que"), ("Москва", "mow"), ("г. москва", "mow"), ("東京", "tyo"), ("senior account manager", "sam"),
    ("Sr. Account Manager", "UNMATCHED"), ("senior acount manager", "sam"), ("engineer software 2", "se2"), ("software engineer 4", "UNMATCHED"), ("newyork city", "nyc"), ("Rotterdam", "UNMATCHED"), ("", "UNMATCHED"), (None, "UNMATCHED"), ("mokum", "ams"), ("x " * 4000 + "Amsterdam", "ams"),
]


@pytest.mark.parametrize("shard_entries", [3, 50_000])
def test_mapping_of_any_names(spark, shard_entries):
    canonical = spark.createDataFrame(PLACES, "id string, name string, aliases array<string>")
    values = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TYPED)], "row int, place string")
    got = {r.row: r.id for r in M.map_to_canonical(values, "row", "place", None, canonical, "id", "name", "aliases", shard_entries, vocabulary=M.Vocabulary()).collect()}
    assert {TYPED[i][0]: k for i, k in got.items()} == dict(TYPED)


COMPOUNDS_TYPED = [
    # Words in another order with an error each, beside a word that names nothing, number glued to a word: only token sets find them.
    ("acidd rolmabmupinicc sulfatte", "HMDB0000001"), ("peak mixture octanoylcarnitinne", "HMDB0000002"), ("hydroxyoctanoylglycinne ester 3methylbutanoyl", "HMDB0000003"), ("ester 3methylbutanoyl hydroxyoctanoylglycinne sample9", "UNMATCHED"),
    # Another number, a word missing or too much, blanks moved, two names that are equally near.
    ("ester 4methylbutanoyl hydroxyoctanoylglycinne", "UNMATCHED"), ("sulfatee rolmabmupinicc", "UNMATCHED"), ("acid rolmabmupinicc sulfate kashot", "UNMATCHED"), ("rolmab mupinicacid sulfatee", "HMDB0000001"), ("gudbushotamixe", "UNMATCHED"),
]


@pytest.mark.parametrize("shard_entries", [2, 50_000])
def test_compounds_go_to_token_sets(spark, shard_entries):
    listed = [("HMDB0000001", "rolmabmupinic acid sulfate", None), ("HMDB0000002", "Octanoylcarnitine", None), ("HMDB0000003", "3-methylbutanoyl hydroxyoctanoylglycine ester", None), ("HMDB0000004", "gudbushotamide", None), ("HMDB0000005", "gudbushotamine", None)]
    canonical = spark.createDataFrame(listed, "accession string, name string, synonyms array<string>")
    values = spark.createDataFrame([(i, t, None) for i, (t, _) in enumerate(COMPOUNDS_TYPED)], "entry_id int, feature string, hmdb_id string")
    got = {r.entry_id: r.accession for r in M.map_to_canonical(values, "entry_id", "feature", "hmdb_id", canonical, "accession", "name", "synonyms", shard_entries).collect()}
    assert {COMPOUNDS_TYPED[i][0]: k for i, k in got.items()} == dict(COMPOUNDS_TYPED)


def test_similarity_of_token_sets():
    names = M.Names(M.COMPOUNDS)
    sets = M.TokenSets(names, [(M.WORDS, "acid rolmabmupinic sulfate", "a"), (M.NAME, "octanoylcarnitine", "b")], {"acid": 0.25})
    # Intersection over union: one of the words is common by its likeness, 1 - (1 + SPELT or HEARD) / (letters + 1).
    [(d, k)] = sets.similar("rolmabmupinc sulfate acid")
    assert k == "a" and d == pytest.approx(1 - (0.25 + 1 + 1 - 1.1 / 13) / 2.25, abs=1e-6)
    [(d, k)] = sets.similar("octanoylcarnitin")
    assert k == "b" and d == pytest.approx(0.05 / 17, abs=1e-6)
    # Two ways to write a form, as typed and with the abbreviation written out, with one error each: a tie.
    tie = M.TokenSets(names, [(M.NAME, "2oxoheptanoylglycine", "c"), (M.NAME, "2hydroxyheptanoylglycine", "d")], {})
    assert [k for _, k in tie.similar("2 ohoheptanoylglycine")] == ["c", "d"]
    assert sets.similar("rolmabmupinc acid") == [] and sets.similar("") == []


def plain_edits(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_edits_equal_brute_force(a, b):
    assert M.edits(a, b, 3) == min(plain_edits(a, b), 4)


# Top N


def test_top_n_with_ties_bands_and_hot_group(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, float("nan"), float("inf"), *map(float, range(6))]), rng.choice(["x", "y", None])) for i in range(600)]
    rows += [(1000 + i, "hot", 3.0, "x") for i in range(400)] + [(2000, "one", -1.0, "x")] + [(2001, "two", 1.0, "x")] * 2
    df = spark.createDataFrame(rows, "id int, g string, s double, t string").withColumn("rank", F.lit(7))
    groups = defaultdict(list)
    for i, g, s, t in rows:
        if g is not None and s is not None and s == s:
            groups[g].append((-s, t is None, t or "", i))
    want = Counter((g, i) for g, v in groups.items() for *_, i in sorted(v)[:5])
    for how in ({}, {"band_shares": (0.02, 0.2, 0.6)}, {"bucket_bits": 6}, {"bucket_bits": 10, "band_shares": (0.3,)}):
        assert Counter((r.g, r.id) for r in topn.top_n_per_group(df, "g", "s", ["t", "id"], 5, **how).collect()) == want
    assert topn.top_n_per_group(df.limit(0), "g", "s", ["t", "id"], 5).count() == 0


def test_top_n_beyond_a_thousand_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"g{i % 50}", float(rng.randint(0, 900))) for i in range(9000)]
    df = spark.createDataFrame(rows, "id int, g string, s double").repartition(3)
    groups = defaultdict(list)
    for i, g, s in rows:
        groups[g].append((-s, i))
    before = spark.conf.get(topn.LIMIT)
    got = topn.top_n_per_group(df, "g", "s", ["id"], 1500)
    assert spark.conf.get(topn.LIMIT) == before
    assert {(r.g, r.id, r["rank"]) for r in got.collect()} == {(g, i, k + 1) for g, v in groups.items() for k, (_, i) in enumerate(sorted(v)[:1500])}
    with topn._limits_up_to(spark, 1500):
        ranked = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), "id"))).where("r <= 1500")
        assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()


# Percentiles


@pytest.mark.parametrize("broadcast_groups", [0, 1000])
def test_percentiles_equal_numpy(spark, broadcast_groups):
    rng = np.random.default_rng(2)
    data = {"n": rng.normal(size=700), "hot": np.full(500, 2.5), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "exp": 10.0 ** rng.integers(-200, 200, 90), "inf": np.array([-np.inf, 1, 2, np.inf])}
    rows = [(k, float(v)) for k, x in data.items() for v in x] + [("n", None), ("n", float("nan")), ("none", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("n", F.lit(0))
    got = {r.g: r for r in percentiles.group_percentiles(df, ["g"], "v", [0.0, 0.5, 0.95, 1.0], broadcast_groups=broadcast_groups).collect()}
    assert set(got) == {*data, None}
    for k, x in data.items():
        assert got[k].n == len(x)
        if k != "inf":
            assert np.allclose([got[k][f"p{i}"] for i in range(4)], np.quantile(x, [0, 0.5, 0.95, 1]), rtol=1e-9), k
    assert (got["inf"].p0, got["inf"].p1, got["inf"].p3) == (-np.inf, 1.5, np.inf)
    assert percentiles.group_percentiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
    hot = percentiles.group_percentiles(df, ["g"], "v", [0.5, 0.95], broadcast_groups=broadcast_groups, hot_rows=100)
    assert all(np.allclose([r.p0, r.p1], np.quantile(data[r.g], [0.5, 0.95]), rtol=1e-9) for r in hot.collect() if r.g in ("n", "hot", "two", "exp"))


def test_extreme_values_keep_ranks_of_states(spark):
    df = spark.createDataFrame([("a", 1, v) for v in (float("-inf"), 1.0, 2.0, 1e300, float("inf"))], "g string, day int, v double")
    r = percentiles.percentiles_from_counts(percentiles.period_counts(df, ["g"], "v", "day", 0.5), ["g"], [0.25, 0.5], 0.5).first()
    assert (r.n, r.p0, r.p1) == (5, 1.25, 2.25)


def test_states_of_days_combine(spark):
    rng = np.random.default_rng(3)
    rows = [("a", int(d), float(v)) for d, v in zip(rng.integers(0, 5, 900), rng.gamma(2, 2, 900), strict=True)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    state = percentiles.period_counts(df.where("day < 2"), ["g"], "v", "day", 0.01).unionAll(percentiles.period_counts(df.where("day >= 2"), ["g"], "v", "day", 0.01))
    r = percentiles.percentiles_from_counts(state, ["g"], [0.5, 0.95], 0.01).first()
    x = np.sort([v for *_, v in rows])
    assert r.n == 900 and abs(r.p0 - x[int(0.5 * 899)]) <= 0.005 + 1e-9 and abs(r.p1 - x[int(0.95 * 899)]) <= 0.005 + 1e-9


# Packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_fill_keeps_items_and_capacity(sizes):
    to, m = packing.fill(sizes, 50)
    load = np.bincount(to, weights=sizes, minlength=m) if sizes else np.zeros(0)
    assert len(to) == len(sizes) and (load <= 50).all() and load.sum() == sum(sizes) and (load > 0).all()


def test_differencing_balances():
    sizes = np.random.default_rng(1).integers(1, 400, 300)
    load = np.bincount(packing.difference(sizes, 20), weights=sizes, minlength=20)
    assert load.max() - load.min() <= 30
    assert sorted(np.bincount(packing.difference([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4])) == [14, 16]


def test_packing_round_trip(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["sample", "urine", "peak", "7.31"]) for _ in range(rng.randint(1, 60))) for _ in range(150)] + ["word " * 2000, None, "", "same text", "same text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("id", F.lit(1)).withColumn("part", F.lit("x"))
    out = packing.pack(df, "doc_id", "text", capacity=128, block_containers=8).toPandas()
    count = tokens.token_counter()
    n = {i: count(t) if t else 0 for i, t in enumerate(texts)}
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == n
    used = out[out.container_id.notna()]
    assert used.groupby("container_id").n_tokens.sum().max() <= 128 and set(out[out.container_id.isna()].doc_id) == {151, 152}
    assert all(g.sort_values("part").start_token.tolist() == [0, *g.sort_values("part").n_tokens.cumsum()[:-1]] for _, g in out.groupby("doc_id"))
    assert set(out[out.n_parts > 1].doc_id) == {i for i, k in n.items() if k > 128}
    assert n[150] > 1000 and packing.pack(df.limit(0), "doc_id", "text").count() == 0
    r = packing.fill_report(packing.pack(df.coalesce(1), "doc_id", "text", capacity=128), 128).first()
    assert r.fullest <= 128 and r.used_share > 0.9


def test_blocks_of_tiny_items_are_bounded(spark):
    df = spark.createDataFrame([(i, "a") for i in range(700)], "doc_id int, text string").coalesce(1)
    out = packing.pack(df, "doc_id", "text", capacity=128, block_items=256).toPandas()
    assert len(out) == 700 and out.groupby("container_id").n_tokens.sum().max() <= 128
    assert out.container_id.str.rsplit("-", n=1).str[0].value_counts().max() == 256


def test_packed_documents_of_the_table(spark, sf):
    count = tokens.token_counter()
    want = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and count(r.text) > 2048}
    assert {r.doc_id for r in Q.p6_found(spark, sf).collect()} == want


# Mixing


def test_mix_reaches_targets(spark):
    rng = random.Random(5)
    rows = [(i, s, rng.randint(5, 50)) for i, s in enumerate(rng.choices(["big", "mid", "small", "other", None], [60, 25, 8, 5, 2], k=6000))]
    weights = [("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("absent", 0.1, 9), ("zero", 0.0, 1), (None, 0.5, 1), ("small", 0.2, 3)]
    df = spark.createDataFrame(rows, "doc_id int, source string, n_tokens long")
    w = spark.createDataFrame(weights, "source string, target_share double, max_repeats int")
    mix, rates = mixing.mix_sources(df, w, "doc_id")
    m = mix.toPandas()
    caps = {"big": 1, "mid": 2, "small": 3}
    assert set(m.source) == set(caps) and all(g["copy"].max() <= caps[s] for s, g in m.groupby("source"))
    assert m.groupby(["doc_id", "copy"]).size().max() == 1
    report = {r.source: r for r in mixing.share_report(mix, rates).collect()}
    assert all(abs(r.actual_share - r.share) < 0.02 for r in report.values()) and abs(report["big"].share - 4 / 9) < 1e-9
    every = {r.source: r.status for r in mixing.share_report(mix, rates, "source", df, w).collect()}
    assert every == {**dict.fromkeys(caps, "drawn"), "absent": "no tokens", "zero": "no tokens", "other": "not listed", None: "no source"}
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, mixing.draw_mix(df.repartition(7), rates, "doc_id").collect()))
    assert mixing.mix_sources(df.limit(0), w, "doc_id")[0].count() == 0
    big = mixing.repetition_rates(df, w, total_tokens=10**9)
    assert {r.source: r.rate for r in big.collect()} == {"big": 1.0, "mid": 2.0, "small": 3.0}


# Spans


def brute(docs, least):
    where = defaultdict(list)
    for i, t in docs:
        for s in range(len(t or "") - least + 1):
            where[t[s : s + least]].append((i, s))
    pairs, cover = set(), defaultdict(set)
    for v in where.values():
        ids = sorted({i for i, _ in v})
        if len(ids) > 1:
            pairs |= {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]}
            for i, s in v:
                cover[i] |= set(range(s, s + least))
    return pairs, {i: len(cover[i]) for i, _ in docs}


def fixture(rng):
    word = lambda n: "".join(rng.choice("abcdefghij µ😀é\n") for _ in range(n))
    span, foot, edge = word(300), word(110), word(160)
    docs = [word(rng.randint(0, 500)) for _ in range(40)]
    docs += [word(50) + span[k : k + 200] + word(60) for k in (0, 30, 90)] + [word(90) + foot for _ in range(12)] + [edge, word(10) + edge, edge[:159] + "#" + word(200), edge[1:] + "#"]
    docs += ["z" * 700, "z" * 400, "ab" * 300, None, "", "x"] + [span + foot] * 3
    return list(enumerate(docs))


@pytest.mark.parametrize("how", [{}, {"part_chars": 400, "shard_phrases": 3}, {"bits": 5}], ids=["plain", "salted", "crowded"])
def test_spans_equal_brute_force(spark, how):
    docs = fixture(random.Random(7))
    df = spark.createDataFrame([*docs, (None, docs[-1][1])], "doc_id int, text string").withColumn("id", F.lit(3)).withColumn("n", F.lit("x"))
    pairs, cover = brute(docs, 160)
    assert {tuple(r) for r in spans.shared_pairs(df, "doc_id", "text", **how).collect()} == pairs and len(pairs) > 8
    assert {tuple(r) for r in spans.shared_pairs(df, "doc_id", "text", block_members=2, hot_rows=5, **how).collect()} == pairs
    members = spans.shared_members(df, "doc_id", "text", **how).cache()
    own = defaultdict(set)
    for r in members.collect():
        own[r.span, r.span2].add(r.doc_id)
    assert {(a, b) for v in own.values() for a in v for b in v if a < b} == pairs
    assert Counter(r.n_documents for r in spans.shared_classes(members, "doc_id").collect()) == Counter(map(len, own.values()))
    assert {r.doc_id: r.shared_chars for r in spans.shared_coverage(df, "doc_id", "text", **how).collect()} == cover


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id int, text string")
    assert spans.shared_pairs(df, "doc_id", "text").count() == 0
    assert spans.shared_pairs(df.limit(0), "doc_id", "text").count() == 0
    assert sorted(map(tuple, spans.shared_coverage(df, "doc_id", "text").collect())) == [(1, 3, 0, 0.0), (2, 0, 0, 0.0)]


def test_long_texts_are_hashed_in_pieces():
    rng = random.Random(9)
    text = "".join(rng.choice("abcd") for _ in range(spans.CHUNK + 5000))
    whole = spans.chosen_phrases(spans.code_points(text), np.full(len(text), len(text)), 160, 96)[0]
    parts = {int(p) for _, pos, _ in spans.phrases_of([text], 160, 96) for p in pos}
    assert parts == set(whole.tolist())
