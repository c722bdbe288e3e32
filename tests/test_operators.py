"""Operators against plain Python on small tables, some with one very large group."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from penprint.functions import lexicon as lx
from penprint.functions import quantiles
from penprint.functions.order import first_per_group, global_rank, grouped_quantiles, hash_rank, keys_at, order_key
from penprint.operators import curate, ensemble, evaluate, features, merge, model, select, split, stats
from penprint.operators.forest import Draws, GrownForest, fit_forest, vote_tables
from penprint.operators.reduction import SparseReduction, fit_sparse_svd


def corpus(spark, n=3000, authors=30, seed=1):
    """A third of the documents belong to one author; ids are unique."""
    rng = random.Random(seed)
    start = datetime(2020, 1, 1)
    rows = [(i, "hot" if rng.random() < 1 / 3 else f"a{rng.randrange(authors)}", start + timedelta(hours=rng.randrange(8784)), rng.random() < 0.3, rng.randrange(40))
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, author string, ts timestamp_ntz, rel boolean, words int")


# --- Orders ----------------------------------------------------------------------------
def test_ranks_match_sorting(spark):
    df = spark.range(5000).select("id", order_key(3, "id").alias("key"), (F.col("id") % 7).alias("g")).repartition(6)
    keys = sorted(r["key"] for r in df.collect())
    assert all(keys[r["rank"] - 1] == r["key"] for r in hash_rank(df, "key").collect())
    ranked = sorted((-r["g"], r["id"]) for r in df.collect())
    assert all(ranked[r["rank"] - 1] == (-r["g"], r["id"]) for r in global_rank(df, [F.desc("g"), F.col("id")]).collect())
    found = keys_at(df.select(F.lit(0).alias("series"), "key"), {0: [0, 1, 2499, 4999, 5000]})[0]
    assert found == [keys[0], keys[1], keys[2499], keys[4999], None]


@pytest.mark.parametrize("accuracy", [50, 10000])
def test_exact_quantiles(spark, accuracy):
    rng = random.Random(4)
    groups = {"ties": [float(rng.choice([1, 1, 1, 5])) for _ in range(4000)], "wide": [rng.gauss(0, 1) for _ in range(3001)], "one": [2.5], "two": [1.0, 4.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    probabilities = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r["g"], r["probability"]): r["quantile"] for r in grouped_quantiles(df, ["g"], "v", probabilities, accuracy=accuracy).collect()}
    for g, vs in groups.items():
        for p in probabilities:
            assert got[g, p] == pytest.approx(np.quantile(vs, p), abs=1e-9), (g, p)


@pytest.mark.parametrize("whole", [1 << 18, 50, 0])
def test_quantiles_by_radix(spark, monkeypatch, whole):
    """Every place of an array against numpy: ties, one value, signs, tiny and huge numbers, gaps, infinities; with and without whole counts."""
    monkeypatch.setattr(quantiles, "WHOLE", whole)
    rng = random.Random(whole)
    kinds = [lambda: rng.gauss(0, 1), lambda: float(rng.randrange(5)), lambda: 7.5, lambda: -(10 ** rng.uniform(-300, 300)), lambda: rng.choice([0.0, -0.0, 1e-320, float("inf"), -5.0]),
             lambda: rng.choice([None, 3.0, -3.0]), lambda: 1 + rng.random() * 1e-13]
    rows = [[k() for k in kinds] for _ in range(900)]
    df = spark.createDataFrame([(r,) for r in rows] + [(None,), ([None] * 7,), ([2.0],)], "f array<double>").repartition(5)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = quantiles.array_quantiles(df, F.col("f"), probabilities)
    rows.append([2.0] + [None] * 6)
    for place in range(7):
        own = sorted(r[place] for r in rows if r[place] is not None)
        for p, value in zip(probabilities, got[place].tolist()):
            at = p * (len(own) - 1)
            a, b = own[math.floor(at)], own[math.ceil(at)]
            want = a if a == b else a + (at - math.floor(at)) * (b - a)
            assert value == pytest.approx(want, rel=1e-12, abs=0) or value == want or (math.isnan(value) and math.isnan(want)), (place, p)
    assert quantiles.array_quantiles(df.limit(0), F.col("f"), [0.5]).shape == (0, 1)


def test_first_per_group_beyond_the_limit_of_spark(spark):
    rows, df = corpus(spark)
    got = first_per_group(df, ["author"], [F.col("ts"), F.col("id")], 1001, F.col("id")).groupBy("author").count().collect()
    want = Counter(r[1] for r in rows)
    assert {r["author"]: r["count"] for r in got} == {a: min(n, 1001) for a, n in want.items()}


# --- Curation ------------------------------------------------------------------------------
def test_balanced_month_sample_equals_taking_turns(spark):
    rows, df = corpus(spark)
    months = list(range(1, 12))
    got = curate.balanced_month_sample(df, "author", "ts", F.col("rel").cast("int"), F.col("words"), ["id"], maximum=25, months=months)
    want = set()
    by_author = defaultdict(lambda: defaultdict(list))
    for r in rows:
        by_author[r[1]][r[2].month].append(r)
    for piles in by_author.values():
        for pile in piles.values():
            pile.sort(key=lambda r: (not r[3], -r[4], r[0]))
        held, turn = [], 0
        while len(held) < 25 and any(len(piles[m]) > turn for m in months):
            held += [piles[m][turn][0] for m in months if len(piles[m]) > turn]
            turn += 1
        want |= set(held)
    assert {r["id"] for r in got.collect()} == want


def test_syndicated(spark):
    texts = ["algo vía @x_1", "vía @x en medio", "a través de @Ñu", "a | b", "#endirecto ya", "#Endirecto", "via x"]
    kept = curate.drop_syndicated(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    assert [r["t"] for r in kept] == ["vía @x en medio", "#Endirecto", "via x"]


def test_age_bins(spark):
    ages = {0: None, 1: "0-12", 13: "0-12", 14: "13-17", 18: "13-17", 65: "50-64", 66: "over-65", 999: "over-65", 1000: None, None: None}
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    assert [r[0] for r in df.select(curate.bin_range(F.col("age"))).collect()] == list(ages.values())
    assert df.where("age = 13").select(curate.bin_range(F.col("age"), right=False)).first()[0] == "13-17"


def test_masks_replace_whole_handles(spark):
    df = spark.createDataFrame([(1, "@Ana y @anabel, @ANA"), (2, "nada"), (3, "@otro"), (4, None)], "id long, text string")
    masks = spark.createDataFrame([("ana", "@user1"), ("a.b", "@user2")], "account string, mask string")
    out = {r["id"]: r["text"] for r in curate.mask_handles(df, "id", "text", masks, "account").collect()}
    assert out == {1: "@user1 y @anabel, @user1", 2: "nada", 3: "@otro", 4: None}


def test_accounts_that_differ_in_case_share_a_mask(spark):
    masks = spark.createDataFrame([("Ana", "@user9"), ("ana", "@user1"), ("ANA", "@user5")], "account string, mask string").repartition(3)
    df = spark.createDataFrame([(1, "@aNa")], "id long, text string")
    assert curate.mask_handles(df, "id", "text", masks, "account").first()["text"] == "@user1"


def test_min_documents_keeps_the_exact_count(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2, "author string")
    assert {r["author"] for r in curate.min_documents(df, "author", 3).collect()} == {"a"}


def test_membership_and_groups(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "v string")
    assert [r[0] for r in df.select(curate.map_membership(F.col("v"), ["x"])).collect()] == ["left", "right", "right"]
    assert [r[0] for r in df.select(curate.map_groups(F.col("v"), {"g": ["x"], "h": ["z"]})).collect()] == ["g", None, None]


def test_topics(spark):
    topics = spark.createDataFrame([("sanidad publica", None), (None, "covid")], "a string, b string")
    df = spark.createDataFrame([("SanidadPublica ya",), ("sanidad  publica",), ("COVID",), ("otra",)], "t string")
    assert {r["t"]: r["is_relevant"] for r in curate.flag_topic(df, "t", topics).collect()} == {
        "SanidadPublica ya": True, "sanidad  publica": False, "COVID": True, "otra": False}


def test_topics_of_all_kinds(spark):
    """Every text against every cell, one by one."""
    import re

    cells = ["covid", "a", "ñu", "two words", "three small words", "x+y?", "(ab|cd) ef", "end$", "İstanbul", "ΟΔΟΣ", "  ", "#tag", "twice", "twice"]
    texts = ["anticovid19", "COVID", "c o v i d", "ÑU", "Two\twords", "twowords", "two  words", "THREE smallWORDS", "xxy", "x+y", "cdEF", "ab ef", "the END", "end.", "istanbul",
             "οδος", "οδοσ", "#TAGged", "bbb", "", None, "bbb", "none of it but twi ce", "b" * 5000 + "two words"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").selectExpr("*", "'x' AS string", "1 AS topic")
    for some in (cells[1:], [c for c in cells if c not in ("a", "  ")], ["covid"], ["x+y?"], []):
        topics = spark.createDataFrame([(c, None) for c in some] + [(None, None)], "a string, `b.c` string")
        got = {r["id"]: r["is_relevant"] for r in curate.flag_topic(df, "t", topics).collect()}
        patterns = [re.compile(c.replace(" ", r"\s?"), re.I) for c in some if c != "İstanbul"]
        want = {i: None if t is None else any(p.search(t) for p in patterns) or ("İstanbul" in some and t == "istanbul") for i, t in enumerate(texts)}
        assert got == want, some


# --- Splits -----------------------------------------------------------------------------------
def test_random_split_sizes_and_stability(spark):
    df = spark.range(1003)
    one = {r["id"]: r["__split"] for r in split.random_split(df, "id").collect()}
    two = {r["id"]: r["__split"] for r in split.random_split(df.repartition(5), "id").collect()}
    assert one == two and Counter(one.values()) == {"train": 601, "val": 201, "test": 201}


def test_author_splits(spark):
    rows, df = corpus(spark)
    counts = Counter(r[1] for r in rows)
    smallest = min(counts.values())
    got = split.author_disjoint_split(df, "author", ["ts", "id"], k=10).select("author", "__split").collect()
    assert {n for n in Counter(r["author"] for r in got).values()} == {smallest}
    assert len({(r["author"], r["__split"]) for r in got}) == len(counts)
    assert len({r["author"] for r in got if r["__split"] == "train"}) == 10
    val, test = (len({r["author"] for r in got if r["__split"] == s}) for s in ("val", "test"))
    assert abs(val - test) <= 1
    out = split.author_attribution_split(df, "author", "id", ["ts", "id"], k=5, n=4).select("id", "author", "__split").collect()
    assert len({r["id"] for r in out}) == len(out)
    by = Counter((r["author"], r["__split"]) for r in out)
    assert all(n <= {"train": smallest, "val": 2, "test": 2}[s] for (_, s), n in by.items())
    assert sum(n for (_, s), n in by.items() if s == "train") == 5 * smallest


# --- Merging ------------------------------------------------------------------------------------
def test_merge_in_parts_is_whole(spark):
    rows = [(i, "hot" if i % 3 else f"a{i % 5}", None if i % 2 else "t", f"text {i}" if i % 11 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, author string, trait string, text string").repartition(7)
    whole = merge.merge_by_author(df, ["author", "trait"], ["text"], ["id"]).collect()
    assert {r["part"] for r in whole} == {0}
    parts = merge.merge_by_author(df, ["author", "trait"], ["text"], ["id"], part_characters=1500).collect()
    joined = defaultdict(list)
    for r in sorted(parts, key=lambda r: r["part"]):
        joined[r["author"], r["trait"]].append(r["text"])
        assert len(r["text"]) < 6000
    want = defaultdict(list)
    for _, author, trait, text in rows:
        want[author, trait].append(text or "")
    for table in ({(r["author"], r["trait"]): r["text"] for r in whole}, {k: lx.MERGE_SEPARATOR.join(v) for k, v in joined.items()}):
        assert table == {k: lx.MERGE_SEPARATOR.join(v) for k, v in want.items()}
    assert max(len(v) for v in joined.values()) > 1


def test_votes(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), ("a", None), ("a", None), ("b", None), ("c", "z")], "author string, v string")
    assert {r["author"]: r["v"] for r in merge.vote_by_author(df, "author", "v").collect()} == {"a": "x", "b": None, "c": "z"}


# --- Evaluation -----------------------------------------------------------------------------------
def test_report(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", "c")] + [("d", "a")]
    df = spark.createDataFrame(pairs, "actual string, predicted string")
    report = {r["label"]: r for r in evaluate.classification_report(df, "actual", "predicted").collect()}
    assert report["a"]["precision"] == pytest.approx(75) and report["a"]["recall"] == pytest.approx(75)
    assert report["c"]["support"] == 0 and report["c"]["f1_score"] == 0 and report["d"]["precision"] == 0
    assert report["weighted avg"]["recall"] == pytest.approx(report["accuracy"]["recall"]) == pytest.approx(100 * 5 / 8)
    assert report["macro avg"]["recall"] == pytest.approx((75 + 200 / 3) / 4)
    matrix = {r["actual"]: r for r in evaluate.confusion_matrix(df, "actual", "predicted", ["a", "b", "c", "d", "e"]).collect()}
    assert matrix["b"]["c"] == pytest.approx(1 / 3) and matrix["e"]["a"] == 0


def test_ensemble_ties_go_to_the_smallest(spark):
    votes = spark.createDataFrame([(1, "m1", "b"), (1, "m2", "a"), (2, "m1", "b"), (2, "m2", "b")], "id long, model string, predicted string")
    assert {r["id"]: r["predicted"] for r in ensemble.ensemble_mode(votes, "id").collect()} == {1: "a", 2: "b"}
    weights = spark.createDataFrame([("m1", 0.6), ("m2", 0.4)], "model string, weight double")
    assert {r["id"]: r["predicted"] for r in ensemble.ensemble_weighted(votes, weights, "id", "model").collect()} == {1: "b", 2: "b"}


def test_weights_and_balance(spark):
    df = spark.createDataFrame([("x; y",), ("x",), ("x",), ("y",)], "l string")
    got = [r["weight"] for r in stats.sample_weights(df, "l", ["x", "y"]).collect()]
    # x is held by 3 of 4 rows, y by 2 of 4: balanced weights 4/(2*3), 4/(2*1) and 1.
    assert got == pytest.approx([2 / 3, 2 / 3, 2 / 3, 2.0])
    assert stats.is_imbalanced(df, "l", balanced=True).first()["imbalanced"] is False
    assert stats.is_imbalanced(df, "l", task_type="regression").first()["imbalanced"] is False


def test_labels_fall_back_to_all_rows(spark):
    df = spark.createDataFrame([("b", "val"), ("a", None), (None, "train")], "l string, __split string")
    assert [r["l"] for r in stats.available_labels(df, "l").collect()] == ["a", "b"]
    multi = spark.createDataFrame([("b; a", "train"), ("c", "test")], "l string, __split string")
    assert [r["l"] for r in stats.available_labels(multi, "l", task_type="multi_label").collect()] == ["a", "b"]


# --- Features -----------------------------------------------------------------------------------------
def test_sequences_pad_and_cut_in_front(spark):
    train = spark.createDataFrame([(1, "A b, b c"), (2, "b d")], "id long, text string")
    vocabulary = features.fit_vocabulary(train, "text")
    assert {r["token"]: r["index"] for r in vocabulary.table.collect()} == {"b": 2, "a": 3, "c": 4, "d": 5}
    assert (vocabulary.documents, vocabulary.maxlen) == (2, 4)
    new = spark.createDataFrame([(1, "d zz"), (2, "a a b b c c"), (3, None)], "id long, text string")
    got = {r["id"]: r["tokens"] for r in features.to_sequences(new, "id", "text", vocabulary).collect()}
    assert got == {1: [0, 0, 5, 1], 2: [2, 2, 4, 4], 3: [0, 0, 0, 0]}


def test_svd_spans_the_same_space(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 9)) + 0.01 * rng.normal(size=(60, 9))
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["id", "v"]).repartition(4)
    v = np.array(features.fit_svd(df, "v", 4).components)
    want = np.linalg.svd(x)[2][:4].T
    assert np.allclose(v @ v.T, want @ want.T, atol=1e-8)


def test_language(spark):
    rows = [("the cat and the dog went there", "en"), ("this is what they think", "en"), ("el perro y el gato de la casa", "es"), ("que es lo que piensan ellos", "es")] * 5
    profiles = features.fit_language_profiles(spark.createDataFrame(rows, "t string, lang string"), "t", "lang")
    new = spark.createDataFrame([(1, "the dog and the cat think"), (2, "el gato es de ellos"), (3, "")], "id long, t string")
    assert {r["id"]: r["language"] for r in features.detect_language(new, "id", "t", profiles).collect()} == {1: "en", 2: "es", 3: None}


def test_missing_features_are_left_out_of_means(spark):
    nan = float("nan")
    rows = [("a", [1.0, None, nan]), ("a", [3.0, 4.0, None]), ("a", None), ("b", None), ("c", [nan, 1.0, 2.0])]
    out = merge.merge_features_by_author(spark.createDataFrame([(*r, "train") for r in rows], "author string, features array<double>, __split string"), "author")
    assert {r["author"]: r["features"] for r in out.collect()} == {"a": [2.0, 4.0, None], "b": None, "c": [None, 1.0, 2.0]}


def test_features_with_gaps(spark):
    sets = {"se": spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, None])], "id long, features array<double>"), "lf": spark.createDataFrame([(1, [5.0])], "id long, features array<double>")}
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    filled = {r["id"]: list(r["features"]) for r in model.union_features(sets, "id", rows, fill=0.0).collect()}
    assert filled == {1: [5.0, 1.0, 2.0], 2: [0.0, 3.0, 0.0], 3: [0.0, 0.0, 0.0]}
    with pytest.raises(Exception, match="no features in set lf for document 2"):
        model.union_features(sets, "id").where("id = 2").collect()


@pytest.mark.parametrize("width", [40, 100_000])
def test_sparse_decomposition(spark, width, tmp_path):
    """Singular values and projections of sparse rows, also with very many columns, against those of all products of rows."""
    rng = np.random.default_rng(width)
    rows, full = [], np.zeros((150, width))
    for i in range(150):
        columns = np.sort(rng.choice(width, 25, replace=False)) if i % 3 else np.arange(25)
        weights = rng.standard_normal(25) + (4 * (i % 5) if not i % 3 else 0)
        full[i, columns] = weights
        rows.append((i, columns.tolist(), weights.tolist()))
    rows.append((150, [], []))
    df = spark.createDataFrame(rows, "id long, columns array<int>, weights array<double>").repartition(4)
    fitted = fit_sparse_svd(df, width, k=3)
    want = np.sqrt(np.linalg.eigvalsh(full @ full.T)[::-1][:3])
    assert fitted.values == pytest.approx(want, rel=1e-6) and np.abs(fitted.directions.T @ fitted.directions - np.eye(3)).max() < 1e-9
    fitted.save(spark, str(tmp_path / "s"))
    loaded = SparseReduction.load(spark, str(tmp_path / "s"))
    found = {r["id"]: r["features"] for r in loaded.transform(df, "id").collect()}
    assert len(found) == 151 and found[150] == [0.0] * 3
    assert np.abs(np.array([found[i] for i in range(150)]) - full @ fitted.directions).max() < 1e-9


def test_language_profiles_in_blocks(spark, monkeypatch):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5 + [("", "en"), ("the dog", None), ("und der", None)])]
    df = spark.createDataFrame(rows, "id long, t string, lang string")
    profiles = features.fit_language_profiles(df, "t", "lang")
    found = []
    for size in (10**6, 30):
        monkeypatch.setattr(features, "PROFILE_ROWS", size)
        found.append({r["id"]: (r["language"], r["confidence"] and round(r["confidence"], 9)) for r in features.detect_language(df, "id", "t", profiles).collect()})
    assert found[0] == found[1] and found[0][11][0] == "en" and found[0][12][0] == "de"


def test_labels_unseen_in_train_count_as_errors(spark):
    rows = [(i, "ab"[i % 2], "train", [float(i % 2)]) for i in range(40)] + [(50, "a", "val", [0.0]), (51, "b", "val", [1.0]), (52, "c", "val", [1.0]), (53, "c", "val", [0.0])]
    df = spark.createDataFrame(rows, "id long, y string, __split string, features array<double>")
    grid = {"lr": {"fit_intercept": [True], "max_iter": [20]}}
    search = model.random_search(df, "y", grid, draws=3)
    assert [r["accuracy"] for r in search.trials.collect()] == [0.5]
    refitted = model.random_search(df, "y", grid, draws=1, refit_with_val=True)
    assert set(model.predict(refitted.model, df, ["id"]).toPandas()["predicted"]) <= {"a", "b", "c"}


def test_search_over_regressions_and_networks(spark):
    rng = random.Random(3)
    rows = [(i, 2.0 * (x := rng.random()) + 1, "lh"[x > 0.5], ("train", "val")[i % 4 == 0], [x, rng.random()]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, y double, side string, __split string, features array<double>")
    grid = {"linear": {"fit_intercept": [True]}, "rf": {"trees": [5], "depth": [2], "max_features": ["all"]}}
    search = model.random_search(df, "y", grid, draws=9, task_type="regression", refit_with_val=True)
    trials = search.trials.orderBy("rank").collect()
    assert [t["kind"] for t in trials] == ["linear", "rf"] and trials[0]["score"] < 1e-6 < trials[1]["score"]
    assert all(abs(r["predicted"] - r["y"]) < 1e-6 for r in model.predict(search.model, df, ["y"]).collect())
    network = model.random_search(df, "side", {"mlp": {"shape": ["brick", "funnel"], "layers": [1], "first": [4], "max_iter": [60]}}, draws=2)
    assert network.trials.first()["accuracy"] > 0.9


def _noisy(spark, labels=3):
    rng = random.Random(11)
    rows = []
    for i in range(240):
        x = [rng.gauss(0, 1) for _ in range(6)]
        rows.append((i, float(int(abs(3 * x[0] + 2 * x[1] * x[2] + rng.gauss(0, 1))) % labels), ("train", "val")[i % 3 == 0], x))
    return spark.createDataFrame(rows, "id long, label_index double, __split string, features array<double>").withColumn("features", array_to_vector("features"))


def _said(votes, model_, rows, depth, size):
    leaves = model_.copy({model_.leafCol: "leaf"}).transform(rows).select("id", vector_to_array("leaf").cast("array<int>").alias("leaf")).orderBy("id").collect()
    return votes.predictions(np.array([r["leaf"] for r in leaves]), depth, [size])[:, 0].tolist()


def test_parts_of_a_forest(spark):
    """All trees give the model's own predictions, the first ones theirs, and cut trees those of a forest fitted to that depth."""
    rows = _noisy(spark)
    full = model.random_forest(trees=12, depth=None, min_leaf=2, max_features="all", seed=4).fit(rows)
    votes = vote_tables(full, [None, 3, 1, 40], spark)
    whole = [r["prediction"] for r in full.transform(rows).orderBy("id").collect()]
    assert _said(votes, full, rows, None, 12) == whole == _said(votes, full, rows, 40, 12)
    shares = np.zeros((240, 3))
    for size, tree in enumerate(full.trees[:7], 1):
        shares += np.array([r["probability"].toArray() for r in tree.transform(rows).orderBy("id").collect()])
        assert _said(votes, full, rows, None, size) == shares.argmax(1).tolist()
    for depth in (1, 3):
        # With all features at every node, a tree of the same draw is the same down to its depth.
        fitted = model.random_forest(trees=12, depth=depth, min_leaf=2, max_features="all", seed=4).fit(rows)
        assert _said(votes, full, rows, depth, 12) == [r["prediction"] for r in fitted.transform(rows).orderBy("id").collect()]


def test_search_of_nested_forests(spark):
    """All settings are in the log, with scores of the parts of three forests, whatever runs at the same time."""
    rows = _noisy(spark).withColumn("side", F.concat(F.lit("s"), F.col("label_index").cast("int").cast("string")))
    grid = {"lr": {"fit_intercept": [True, False], "max_iter": [30]}, "rf": {"trees": [4, 9, 15], "depth": [2, None], "min_leaf": [1, 2, 4]}, "svm": {"c": [1.0], "max_iter": [10]}}
    logs = []
    for at_once in (1, 4):
        search = model.random_search(rows.drop("label_index"), "side", grid, at_once=at_once)
        logs.append(sorted((r["kind"], tuple(sorted(r["params"].items())), round(r["score"], 9), round(r["accuracy"], 9)) for r in search.trials.collect()))
    assert logs[0] == logs[1] and len(logs[0]) == 21
    train, val = (rows.where(F.col("__split") == name) for name in ("train", "val"))
    forest = model.random_forest(trees=15, depth=None, min_leaf=2).fit(train.coalesce(1))
    votes = vote_tables(forest, [2, None], spark)
    actual = [r["label_index"] for r in val.orderBy("id").collect()]
    for depth in (2, None):
        for size in (4, 9, 15):
            right = sum(a == b for a, b in zip(actual, _said(votes, forest, val, depth, size))) / len(actual)
            params = {"trees": str(size), "depth": str(depth), "min_leaf": "2"}
            assert [round(a, 6) for kind, p, _, a in logs[0] if dict(p) == params] == [round(right, 6)]
    assert set(model.predict(search.model, rows, ["id"]).toPandas()["predicted"]) <= {"s0", "s1", "s2"}
    # All trials on other rows, one of which has an unknown label.
    arrays = rows.withColumn("features", vector_to_array("features"))
    selection = select.fit_selection(arrays.where("__split = 'train'"), "side")
    search = model.random_search(selection.variants(arrays)["minmax"], "side", grid)
    other = arrays.where("id % 2 = 0").withColumn("side", F.when(F.col("id") == 0, "new").otherwise(F.col("side")))
    scores = model.cross_corpus_trials(search, selection, "minmax", other, "side").collect()
    assert len(scores) == 21 and {r["kind"] for r in scores} == {"lr", "rf", "svm"}
    fitted = next(m for m, _, family in search.fitted if search.settings[family.trials[0]] == {"kind": "lr", "fit_intercept": False, "max_iter": 30})
    said = fitted.transform(select.apply_to_other_corpus(selection, "minmax", other).withColumn("features", array_to_vector("features"))).collect()
    right = sum(search.labels[int(r["prediction"])] == r["side"] for r in said) / len(said)
    assert [r["accuracy"] for r in scores if r["params"] == {"fit_intercept": "False", "max_iter": "30"}] == [pytest.approx(right)]


def test_forests_keep_the_node_of_each_row(spark):
    """No job is sent the trees grown so far: node numbers are kept with the rows, nothing of them is left, and the trees are those of a fit without, in several groups of nodes."""
    rows = _noisy(spark).repartition(2, "id").persist()
    rows.count()
    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    for build in (model.random_forest, model.forest_regression):
        forest = build(trees=30, depth=None, seed=4).setMaxMemoryInMB(1)
        assert forest.getCacheNodeIds()
        kept, plain = (f.fit(rows).toDebugString.split("\n", 1)[1] for f in (forest, forest.copy().setCacheNodeIds(False)))
        assert kept == plain and kept.count("Tree ") == 30
        assert len(spark.sparkContext._jsc.getPersistentRDDs()) == held
    rows.unpersist()


def test_forests_grown_in_one_task_are_those_of_spark(spark, tmp_path):
    """The same votes to the last bit for every setting, in several groups of nodes, with copies of rows and a constant feature; a saved forest says the same."""
    rows = _noisy(spark)
    rows = rows.unionAll(rows.where("id < 60")).withColumn("features", array_to_vector(F.concat(vector_to_array("features"), F.array(F.lit(1.0))))).coalesce(1).persist()
    draws = Draws(spark)
    for trees, depth, least, features, memory in ((70, None, 1, "sqrt", 1), (3, 4, 2, "all", 1), (40, 3, 4, "sqrt", 256), (5, None, 1, "log2", 256)):
        forest = model.random_forest(trees=trees, depth=depth, min_leaf=least, max_features=features, seed=7).setMaxMemoryInMB(memory)
        grown, plain = fit_forest(forest, rows, draws, True), forest.fit(rows)
        assert isinstance(grown, GrownForest) and not isinstance(fit_forest(forest, rows, draws, False), GrownForest)
        columns = ["id", "rawPrediction", "probability", "prediction"]
        right = plain.transform(rows).select(columns).orderBy("id").collect()
        assert grown.transform(rows).select(columns).orderBy("id").collect() == right
    model.save_stage(grown, str(tmp_path / "forest"))
    assert GrownForest.load(str(tmp_path / "forest")).transform(rows).select(columns).orderBy("id").collect() == right
    # Splits of more rows than Spark looks at for them come from its own sample.
    many = spark.range(12_000).select(F.expr("cast(id % 2 as double)").alias("label_index"), array_to_vector(F.array(F.expr("hash(id) % 5000 + 0.0D"), F.expr("cast(id % 7 as double)"))).alias("features")).coalesce(1)
    forest = model.random_forest(trees=2, depth=5, seed=3)
    assert [m.transform(many).groupBy("rawPrediction").count().orderBy(F.col("rawPrediction").cast("string")).collect() for m in (fit_forest(forest, many, draws, True),)] == [
        forest.fit(many).transform(many).groupBy("rawPrediction").count().orderBy(F.col("rawPrediction").cast("string")).collect()]
    search = model.random_search(rows.withColumn("side", F.concat(F.lit("s"), F.col("label_index").cast("int").cast("string"))).drop("label_index"), "side", {"rf": {"trees": [4, 9], "depth": [2, None]}}, refit_with_val=True)
    assert isinstance(search.fitted[0][0], GrownForest) and isinstance(search.model.stages[0], GrownForest)
    model.save_stage(search.model, str(tmp_path / "search"))
    said = [model.predict(m, rows, ["id"]).orderBy("id").collect() for m in (search.model, model.load_stage(str(tmp_path / "search")))]
    assert said[0] == said[1]
    rows.unpersist()


def test_trees_deeper_than_spark_goes_are_an_error():
    with pytest.raises(ValueError):
        model.random_forest(depth=35)


# --- Selection and models -----------------------------------------------------------------------------
def test_scalers_and_saving(spark, tmp_path):
    df = spark.createDataFrame([([1.0, 5.0, 0.0], "a"), ([3.0, 5.0, 9.0], "b"), ([2.0, 5.0, 1.0], "a"), ([4.0, 5.0, 7.0], "b")], "features array<double>, label string")
    minmax, robust = select.fit_minmax(df), select.fit_robust(df)
    assert minmax.transform(df).first()["features"] == pytest.approx([0.0, 0.0, 0.0])
    assert robust.unit == pytest.approx([1.5, 1.0, 6.75]) and robust.shift == pytest.approx([2.5, 5.0, 4.0])
    fitted = select.fit_selection(df, "label")
    assert all(1 not in places for places in fitted.chosen.values())
    assert set(fitted.variants(df)) == {"ig", "anova", "minmax_ig", "minmax_anova", "robust_ig", "robust_anova", "minmax", "robust"}
    fitted.save(spark, str(tmp_path / "s"))
    assert select.Selection.load(spark, str(tmp_path / "s")) == fitted


def test_layer_sizes():
    assert model.layer_sizes("funnel", 4, 64) == [64, 32, 21, 16]
    assert model.layer_sizes("3angle", 3, 60) == [20, 30, 60]
    assert model.layer_sizes("brick", 3, 8) == [8, 8, 8]
    assert model.layer_sizes("rhombus", 5, 64) == [16, 32, 64, 32, 16]
    assert model.layer_sizes("rhombus", 4, 64) == [32, 64, 32, 32]
    assert model.layer_sizes("diamond", 5, 64) == [32, 32, 64, 32, 16]
    assert model.layer_sizes("lfunnel", 4, 64) == [64, 32, 16, 8]


def test_sampled_trials_are_distinct_and_repeatable():
    grid = {"lr": {"fit_intercept": [True, False]}, "rf": {"trees": [1, 2], "depth": [3, 4]}}
    trials = model.sampled_trials(grid, 100)
    assert len(trials) == 6 and trials == model.sampled_trials(grid, 100)


def test_decisions(spark):
    df = spark.createDataFrame([([0.5],), ([0.4],), ([0.2, 0.4, 0.4],)], "p array<double>")
    assert [r[0] for r in model.predict_labels(df.limit(2), "p", ["no", "yes"]).select("predicted").collect()] == ["yes", "no"]
    assert model.predict_labels(df.where(F.size("p") == 3), "p", ["a", "b", "c"]).first()["predicted"] == "b"
    many = spark.createDataFrame([([0.5, 0.1, 0.9],)], "p array<double>")
    assert model.predict_labels(many, "p", ["a", "b", "c"], "multi_label").first()["predicted"] == "a; c"


def test_mad_is_rounded(spark):
    df = spark.createDataFrame([("a",)] * 2 + [("b",)] * 9 + [("c",)] * 30, "author string")
    assert stats.author_mad(df, "author").first()["mad"] == round(7 / (2 / math.sqrt(3)))


def test_merged_experiment_and_saving(spark, tmp_path):
    from penprint.plans.experiment import run_experiment
    from penprint.spec import Columns, TaskSpec

    rng = random.Random(2)
    rows = []
    for i in range(240):
        author = i % 24
        side = "left" if author % 2 else "right"
        shift = 1.0 if side == "left" else -1.0
        rows.append((i, f"a{author}", side, ("train", "train", "val", "test")[author // 2 % 4], [rng.gauss(shift, 0.3), rng.gauss(0, 1), rng.gauss(shift, 0.5), 5.0]))
    df = spark.createDataFrame(rows, "doc_id long, author string, side string, s string, features array<double>")
    sets = {"lf": df.select("doc_id", "features"), "se": df.select("doc_id", F.slice("features", 1, 1).alias("features"))}
    spec = TaskSpec("side", "side", "s", merge=True, columns=Columns())
    out = run_experiment(df.drop("features"), sets, spec, {"lr": {"fit_intercept": [True], "max_iter": [20]}}, draws=1)
    assert out.predictions.count() == len({r[1] for r in rows if r[3] == "test"})
    report = {r["label"]: r["f1_score"] for r in out.report.collect()}
    assert report["accuracy"] == 100.0
    model.save_stage(out.search.model, str(tmp_path / "m"))
    again = model.predict(model.load_stage(str(tmp_path / "m")), out.selection.variants(
        df.select("doc_id", F.concat("features", F.slice("features", 1, 1)).alias("features")))["minmax_anova"], ["doc_id"])
    assert again.count() == 240


def test_search_queries_try_the_whole_grid(spark, monkeypatch):
    from inspect import signature

    from penprint.catalog import QUERIES, selection

    class Taken(Exception):
        pass

    def taken(function):
        def stub(*args, **kwargs):
            bound = signature(function).bind(*args, **kwargs)
            bound.apply_defaults()
            raise Taken(bound.arguments)
        return stub

    def asked(name):
        with pytest.raises(Taken) as told:
            QUERIES[name](spark, "/root/testdata/sf0.001")
        return told.value.args[0]

    monkeypatch.setattr(selection, "SAVED", {})
    monkeypatch.setattr(selection, "SEARCHED", {})
    monkeypatch.setattr(model, "random_search", taken(model.random_search))
    monkeypatch.setattr(model, "dense_network", taken(model.dense_network))
    for name, settings in {"random_search": 33, "predict_labels": 32, "predictions_are_likeliest": 32, "cross_corpus_scores": 33, "experiment_report": 33}.items():
        given = asked(name)
        trials = model.sampled_trials(given["grid"], given["draws"])
        assert len(trials) == settings and max(t.get("trees", 0) for t in trials) == 2000, name
        assert all("max_iter" not in t for t in trials), name
    assert asked("dense_network")["max_iter"] == 100


def test_the_svd_query_gives_all_directions(spark):
    from penprint.catalog import QUERIES

    out = QUERIES["reduce_svd"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", *[f"ng_{i}" for i in range(100)]] and out.count() == 200
    assert out.where("ng_99 is null").count() == 0
