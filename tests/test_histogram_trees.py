"""Trees grown on shared histograms against MLlib's and against plain recursive ones; nested tuning against a plain loop."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from taufold.functions.numeric import hash32, poisson_one, poisson_steps, uniform
from taufold.operators import histogram_trees as H
from taufold.operators import uplift as U
from taufold.operators.bagging import bagged_tree_errors, running_majority
from taufold.operators.cate import ForestParams
from taufold.operators.classify import forest_scores_by_arm
from taufold.operators.effect_trees import NuisanceTrees, bag_spread, fit_effect_bags, tune_nested
from taufold.operators.split import with_draws
from taufold.sources.stage import stage

N = 600


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(11)
    x = np.column_stack([draw.integers(0, 9, N), draw.integers(0, 4, N), draw.integers(0, 2, N)]).astype(float)
    t = (draw.random(N) < 0.3 + 0.05 * x[:, 1]).astype(float)
    y = 0.3 * x[:, 0] + x[:, 2] + t * (0.5 + (x[:, 0] > 4)) + draw.normal(0, 0.5, N)
    return x, t, y


@pytest.fixture(scope="module")
def units(spark, data):
    x, t, y = data
    label = ((x[:, 0] + 2 * x[:, 1] + np.random.default_rng(2).integers(0, 3, N)) % 3).astype(int)
    rows = [(k, x[k].tolist(), float(t[k]), float(y[k]), int(label[k])) for k in range(N)]
    df = spark.createDataFrame(rows, "unit_id long, x array<double>, t double, y double, label int")
    return stage(df.repartition(4).withColumn("features", array_to_vector("x")), "units")


def table_of(df, cuts, den, num, draws=(1,), folds=()):
    numbers = lambda values, kind: F.array(*[F.lit(v) if isinstance(v, int) else v for v in values]).cast(f"array<{kind}>")
    held = df.withColumns({"draws": numbers(draws, "tinyint"), "folds": numbers(folds, "int"), "den": numbers(den, "double"), "num": numbers(num, "double")})
    return stage(H.binned(held, "x", cuts, ["draws", "folds", "den", "num", "unit_id"]), "bins")


def predict(trees, x, tree=0):
    return trees.value[trees.leaves(trees.binned(x), np.array([tree]))[:, 0]]


def test_regression_trees_equal_mllib(spark, units, data, monkeypatch):
    x, _, _ = data
    monkeypatch.setattr(H, "PAIRS", 300)
    monkeypatch.setattr(H, "HISTOGRAM_CELLS", 60)  # several passes per level
    cuts = H.feature_cuts(units, "x")
    assert [len(c) for c in cuts] == [8, 3, 1]
    specs = [H.TreeSpec(max_depth=d, min_leaf=m) for d in (0, 2, 4) for m in (1, 20)]
    trees = H.grow(table_of(units, cuts, [1], [F.col("y")]), specs, cuts)
    for k, s in enumerate(specs):
        model = DecisionTreeRegressor(featuresCol="features", labelCol="y", maxDepth=s.max_depth, minInstancesPerNode=s.min_leaf).fit(units)
        wanted = {r["unit_id"]: r["prediction"] for r in model.transform(units).collect()}
        np.testing.assert_allclose(predict(trees, x, k)[:, 0], [wanted[i] for i in range(N)], rtol=1e-9)


def test_classification_trees_equal_mllib(units, data):
    x, _, _ = data
    cuts = H.feature_cuts(units, "x")
    classes = [(F.col("label") == c).cast("double") for c in range(3)]
    trees = H.grow(table_of(units, cuts, [1], classes), [H.TreeSpec(max_depth=4)], cuts, numerators=3)
    model = DecisionTreeClassifier(featuresCol="features", labelCol="label", maxDepth=4).fit(units)
    wanted = {r["unit_id"]: r["probability"].toArray() for r in model.transform(units).collect()}
    np.testing.assert_allclose(predict(trees, x), [wanted[i] for i in range(N)], atol=1e-12)


def plain_tree(x, num, den, weight, depth, min_leaf):
    """A function of one row: greedy splits on num^2 / den."""
    num_, den_ = (num * weight).sum(), (den * weight).sum()
    best = (1e-12 * num_**2 / den_ if den_ else 0, None)
    if depth:
        for k in range(x.shape[1]):
            for v in np.unique(x[weight > 0, k])[:-1]:
                low = x[:, k] <= v
                sides = [((num * weight)[s].sum(), (den * weight)[s].sum(), weight[s].sum()) for s in (low, ~low)]
                if min(s[2] for s in sides) < min_leaf or min(s[1] for s in sides) <= 0:
                    continue
                gain = sum(a * a / b for a, b, _ in sides) - num_**2 / den_
                if gain > best[0] + 1e-9:
                    best = (gain, (k, v))
    if best[1] is None:
        return lambda row: num_ / den_ if den_ else math.nan
    k, v = best[1]
    low, high = (plain_tree(x, num, den, weight * side, depth - 1, min_leaf) for side in (x[:, k] <= v, x[:, k] > v))
    return lambda row: low(row) if row[k] <= v else high(row)


def test_effect_trees_equal_plain_ones(units, data):
    x, t, y = data
    cuts = H.feature_cuts(units, "x")
    rest, gap = F.col("y") - 2.0, F.col("t") - 0.4
    draws = [1, (F.col("unit_id") % 3).cast("int")]
    fold = (F.col("unit_id") % 5).cast("int")
    table = table_of(units, cuts, [gap * gap], [rest * gap], draws, [fold])
    specs = [H.TreeSpec(draw=d, max_depth=3, min_leaf=m, skip=(f,)) for d in (0, 1) for m in (3, 9) for f in (-1, 2)]
    trees = H.grow(table, specs, cuts)
    for k, s in enumerate(specs):
        weight = (np.ones(N) if s.draw == 0 else np.arange(N) % 3) * (np.arange(N) % 5 != s.skip[0])
        tree = plain_tree(x, (y - 2.0) * (t - 0.4), (t - 0.4) ** 2, weight, 3, s.min_leaf)
        np.testing.assert_allclose(predict(trees, x, k)[:, 0], [tree(row) for row in x], rtol=1e-9)
    assert np.unique(predict(trees, x)).size > 5


def test_trees_share_moments_until_their_splits_differ(units, data, monkeypatch):
    x, t, y = data
    cuts = H.feature_cuts(units, "x")
    table = table_of(units, cuts, [1], [F.col("y")])
    asked, level = [], H._level
    monkeypatch.setattr(H, "_level", lambda *a: asked.append(len(a[2])) or level(*a))
    specs = [H.TreeSpec(max_depth=d, min_leaf=m) for d in (1, 2, 4) for m in (1, 150)]
    trees = H.grow(table, specs, cuts)
    assert asked[0] == 1 and all(n <= 2 ** (k + 1) for k, n in enumerate(asked))
    for k, s in enumerate(specs):
        tree = plain_tree(x, y, np.ones(N), np.ones(N), s.max_depth, s.min_leaf)
        np.testing.assert_allclose(predict(trees, x, k)[:, 0], [tree(row) for row in x], rtol=1e-9)
    twins = H.grow(table, [*specs[2:], specs[2]], cuts).alike()
    assert twins[-1] == 0 and len(set(twins.tolist())) > 2


def test_cuts_of_many_values_missing_values_and_empty_tables(spark):
    rows = [(k, [float(k), float(k % 2), float("nan") if k % 5 == 0 else 1.0]) for k in range(1000)]
    df = spark.createDataFrame(rows, "unit_id long, x array<double>")
    cuts = H.feature_cuts(df, "x", max_bins=8)
    assert [len(c) for c in cuts] == [7, 1, 0] and cuts[0][3] == pytest.approx(499.5, abs=1)
    table = table_of(df, cuts, [1], [(F.col("unit_id") >= 500).cast("double")])
    trees = H.grow(table, [H.TreeSpec(max_depth=2), H.TreeSpec(max_depth=2, skip=(0,))], cuts)
    assert predict(trees, np.array([[10.0, 0.0, 1.0], [990.0, 1.0, float("nan")]]))[:, 0] == pytest.approx([0.0, 1.0], abs=0.01)
    none = H.grow(table.filter("unit_id < 0"), [H.TreeSpec()], cuts)
    assert np.isnan(predict(none, np.zeros((1, 3)))).all()
    assert H.feature_cuts(df.filter("unit_id < 0"), "x") == ()


def test_draws_are_those_of_the_expressions(spark):
    df = spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "unit_id long")
    steps = np.array(poisson_steps())
    got = with_draws(df, "unit_id", 7, [1, "b"], lambda u: np.searchsorted(steps, u, "right"))
    both = got.withColumns({"_u": uniform(7, F.lit(1), F.col("unit_id")), "_v": uniform(7, F.lit("b"), F.col("unit_id"))})
    same = both.select((F.col("draws")[0] == poisson_one("_u")) & (F.col("draws")[1] == poisson_one("_v"))).collect()
    assert len(same) == 51 and all(r[0] for r in same)


def test_running_majority():
    votes = np.array([[1, 0, 0, 2, 2, 2], [0, 1, 1, 0, 2, 2]])
    known = np.array([[1, 1, 1, 0, 1, 1], [0, 1, 0, 1, 1, 1]], bool)
    assert running_majority(votes, known, 3).tolist() == [[1, 0, 0, 0, 0, 0], [0, 1, 1, 0, 0, 2]]


def test_bagging_counts_labels_that_were_never_trained_as_wrong(spark, units):
    train, test = units.filter("label < 2"), units.filter("label = 2")
    got = bagged_tree_errors(train, test, "unit_id", "label", rounds=3, max_depth=3).collect()
    assert [r["test_error"] for r in got] == [1.0] * 3 and all(0 < r["oob_error"] < 0.6 for r in got)
    with pytest.raises(ValueError, match="no class label"):
        many = spark.range(1500).select(F.col("id").alias("unit_id"), F.array(F.lit(1.0)).alias("features"), F.col("id").alias("label"))
        bagged_tree_errors(many, many, "unit_id", "label", rounds=1)


def test_nested_tuning_equals_a_plain_loop(spark, units, data):
    x, t, y = data
    tags = units.select("unit_id", (hash32(43, F.col("unit_id")) % 3).alias("cv"), (hash32(44, F.col("unit_id")) % 2).alias("nf"))
    tags = tags.withColumns({f"u{j}": uniform(42, F.lit(f"e{j}"), F.col("unit_id")) for j in range(2)}).orderBy("unit_id").toPandas()
    cv, nf = tags["cv"].to_numpy(), tags["nf"].to_numpy()
    points = [ForestParams(num_trees=2, min_leaf=m, max_depth=d, sample_share=s) for m in (3, 9) for d in (1, 3) for s in (0.4, 0.8)]
    scores = [[] for _ in points]
    for f in range(3):
        m, e = np.zeros(N), np.zeros(N)
        for g in range(2):
            seen = ((cv != f) & (nf != g)).astype(float)
            for target, out in ((y, m), (t, e)):
                tree = plain_tree(x, target, np.ones(N), seen, 2, 4)
                out[nf == g] = [tree(row) for row in x[nf == g]]
        for k, p in enumerate(points):
            forest = []
            for j in range(2):
                weight = ((cv != f) & (tags[f"u{j}"].to_numpy() < p.sample_share)).astype(float)
                tree = plain_tree(x, (y - m) * (t - e), (t - e) ** 2, weight, p.max_depth, p.min_leaf)
                forest.append([tree(row) for row in x[cv == f]])
            scores[k].append(((y[cv == f] - np.mean(forest, axis=0) * t[cv == f]) ** 2).mean())
    found = tune_nested(units, "unit_id", "t", "y", points, nuisance=NuisanceTrees(1, 2, 4), folds=3, nuisance_folds=2).collect()
    assert [r["score"] for r in found] == sorted(r["score"] for r in found)
    by_point = {r["point"]: r["score"] for r in found}
    assert [by_point[k] for k in range(len(points))] == pytest.approx([np.mean(s) for s in scores], rel=1e-9)


def test_nested_tuning_prefers_the_planted_depth(spark):
    draw = np.random.default_rng(5)
    x = draw.integers(0, 2, (4000, 3)).astype(float)
    t = (draw.random(4000) < 0.5).astype(float)
    y = t * np.where(x[:, 0] == x[:, 1], 1.5, -1.5) + draw.normal(0, 0.3, 4000)
    y += 0.2 * t * x[:, 0]  # the first split of an exclusive-or has a gain
    rows = [(k, x[k].tolist(), float(t[k]), float(y[k])) for k in range(4000)]
    df = spark.createDataFrame(rows, "unit_id long, features array<double>, t double, y double").repartition(3)
    points = [ForestParams(num_trees=4, min_leaf=5, max_depth=d, sample_share=0.5) for d in (1, 2)]
    found = tune_nested(df, "unit_id", "t", "y", points, nuisance=NuisanceTrees(3, 3, 5), folds=3).collect()
    assert found[0]["max_depth"] == 2 and found[0]["score"] < 0.5 * found[1]["score"]


def test_uplift_errors_do_not_depend_on_the_mean(spark):
    draw = np.random.default_rng(3)
    cate = draw.random(2000)
    score = cate - 0.5 + draw.normal(0, 0.4, 2000)
    frame = lambda shift: spark.createDataFrame(
        [(1, float(c), float(s + shift)) for c, s in zip(cate, score)], "arm int, cate double, dr double"
    )
    cuts = U.thresholds(frame(0.0))
    for metric in U.METRICS:
        found = []
        for shift in (0.0, 1e8):
            moments = U.bucket_moments(frame(shift), cuts)
            row = U.uplift_coefficient(moments, metric=metric).first()
            errors = [r["err"] for r in U.uplift_curve(moments, metric=metric).orderBy("pct_treated").collect()]
            found.append([row["est"], row["se"], *errors])
        assert found[1] == pytest.approx(found[0], rel=1e-6)


def test_little_bags_cover_planted_effects(spark):
    """200 simulated outcomes are 200 targets of one table; all their forests grow in one pass."""
    sims, n, groups, size = 200, 400, 30, 2
    draw = np.random.default_rng(17)
    x = draw.integers(0, 2, n).astype(float)
    gap = draw.choice([-0.5, 0.5], n)
    effect = 1.0 + x
    rest = effect * gap + draw.normal(0, 1, (sims, n))
    half = draw.random((groups, n)) < 0.5
    trees = (draw.random((groups, size, n)) < 0.8) & half[:, None]
    rows = [
        ([float(x[k])], trees[:, :, k].reshape(-1).astype(int).tolist(), [], [float(gap[k] ** 2)] * sims, (rest[:, k] * gap[k]).tolist()) for k in range(n)
    ]
    df = spark.createDataFrame(rows, "x array<double>, draws array<tinyint>, folds array<int>, den array<double>, num array<double>").repartition(4)
    table = stage(H.binned(df, "x", ((0.0,),), ["draws", "folds", "den", "num"]), "simulated")
    specs = [H.TreeSpec(draw=j, target=s, max_depth=1) for s in range(sims) for j in range(groups * size)]
    grown = H.grow(table, specs, ((0.0,),))
    values = grown.value[grown.leaves(np.array([[0], [1]])), 0].reshape(2 * sims, groups, size)
    mean, spread = bag_spread(values)
    truth = np.repeat([1.0, 2.0], sims)
    covered = (np.abs(mean - truth) <= 1.96 * np.sqrt(spread)).mean()
    assert 0.90 <= covered <= 0.98
    assert mean.reshape(2, sims).mean(axis=1) == pytest.approx([1.0, 2.0], abs=0.05)


def test_bag_spread_is_not_negative():
    values = np.array([[[0.0, 2.0], [2.0, 0.0]], [[0.0, 0.0], [4.0, 4.0]]])
    mean, spread = bag_spread(values)
    assert mean.tolist() == [1.0, 2.0] and spread.tolist() == [0.0, 8.0]


def test_effect_bags_of_a_table(spark):
    draw = np.random.default_rng(8)
    n = 3000
    x = draw.integers(0, 3, (n, 2)).astype(float)
    t = (draw.random(n) < 0.3 + 0.2 * (x[:, 1] > 1)).astype(float)
    y = x[:, 1] + t * x[:, 0] + draw.normal(0, 0.5, n)
    rows = [(k, x[k].tolist(), float(t[k]), float(y[k]), "kept") for k in range(n)] + [(None, [0.0, 0.0], None, 1.0, "kept")]
    df = spark.createDataFrame(rows, "unit_id long, features array<double>, t double, y double, extra string")
    bags = fit_effect_bags(df, "unit_id", "t", "y", ForestParams(num_trees=40, min_leaf=5, max_depth=3, sample_share=0.5), nuisance=NuisanceTrees(3, 4, 5))
    found = bags.effect_interval(df.withColumn("x0", F.col("features")[0])).toPandas()
    assert len(found) == n + 1 and "features" not in found and set(found["extra"]) == {"kept"}
    means = found.groupby("x0")[["cate", "cate_lower", "cate_upper"]].mean()
    assert means["cate"].to_list() == pytest.approx([0.0, 1.0, 2.0], abs=0.15)
    assert (means["cate_lower"] < means["cate"]).all() and (means["cate_upper"] - means["cate_lower"] < 0.5).all()
    with pytest.raises(ValueError, match="little bags"):
        fit_effect_bags(df, "unit_id", "t", "y", ForestParams(num_trees=4, sample_share=0.5))


def test_arm_forests_see_their_own_arm(spark, units):
    ours = units.withColumn("arm", (F.col("t") > 0).cast("int")).withColumn("hit", F.when(F.col("arm") == 1, F.col("x")[2]).otherwise(1 - F.col("x")[2]))
    found = forest_scores_by_arm(ours, ours, "unit_id", "arm", "hit", trees=6, depth=2, features="x").toPandas()
    assert (found["score"] == found["hit"]).all() and (found["predicted"] == found["hit"]).all()
    assert (found["mu1"] + found["mu0"]).to_numpy() == pytest.approx(1.0)
    one = forest_scores_by_arm(ours.filter("arm = 1"), ours, "unit_id", "arm", "hit", trees=2, depth=2, features="x")
    assert one.filter("mu0 IS NOT NULL").count() == 0 and one.filter("mu1 IS NULL").count() == 0
