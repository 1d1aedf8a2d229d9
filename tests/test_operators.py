"""Operators on hand-made rows, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taufold.functions.values import AGE_EDGES, AGE_LABELS
from taufold.operators import balance as B
from taufold.operators import encode as E
from taufold.operators import impute as I
from taufold.operators import quantiles as Q
from taufold.operators import rate as R
from taufold.operators import summary as G
from taufold.operators.bagging import out_of_bag, vote_errors
from taufold.operators.metrics import classification_report, roc_auc
from taufold.operators.quantiles import exact_quantiles
from taufold.operators.rank import distributed_rank, running_total
from taufold.operators.split import train_test_split, with_stratified_folds
from taufold.operators.subgroup import subgroup_table
from taufold.plans.prepare import merge_keep_right
from taufold.sources import tables as S
from taufold.sources.stage import new_stage_path, stage


def numbers(spark, values, name="x", kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


# --- percentiles ---------------------------------------------------------------------------


def test_interpolated_percentiles(spark):
    got = exact_quantiles(numbers(spark, [1.0, 2.0, 3.0, 10.0, None]), "x", [0.25, 0.99])
    assert got[()] == pytest.approx([1.75, 9.79])


@pytest.mark.parametrize("hot", [0.0, 0.34, 0.95])
def test_percentiles_match_numpy(spark, hot):
    rng = np.random.default_rng(5)
    values = np.where(rng.random(20000) < hot, 3.25, np.exp(4 * rng.normal(size=20000)))
    shares = [0, 0.001, 0.05, 0.33, 0.5, 0.66, 0.9, 0.999, 1]
    got = exact_quantiles(numbers(spark, values.tolist()), "x", shares)
    assert got[()] == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)


@pytest.mark.parametrize("hot", [0.0, 0.34])
def test_percentiles_from_narrowed_brackets(spark, monkeypatch, hot):
    rng = np.random.default_rng(6)
    values = np.where(rng.random(60000) < hot, 3.25, np.exp(4 * rng.normal(size=60000)))
    shares = [0, 0.66, 0.33, 0.999]
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)], "g int, x double")
    monkeypatch.setattr(Q, "PICK_ROWS", 1)
    monkeypatch.setattr(Q, "SKETCH", 200)
    got = exact_quantiles(df, "x", shares, by=["g"])
    for g in (0, 1):
        assert got[(g,)] == pytest.approx(np.quantile(values[g::2], shares).tolist(), rel=1e-12)
    assert exact_quantiles(df, "x", shares)[()] == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)


def test_percentiles_missed_by_their_brackets_are_found(spark, monkeypatch):
    values = np.random.default_rng(7).normal(size=30000)
    monkeypatch.setattr(Q, "SKETCH", 8)
    monkeypatch.setattr(Q, "REACH", 1e-6)  # far below the error of such a sketch
    got = exact_quantiles(numbers(spark, values.tolist()), "x", [0.1, 0.5, 0.9])[()]
    assert got == pytest.approx(np.quantile(values, [0.1, 0.5, 0.9]).tolist(), rel=1e-12)


@pytest.mark.parametrize("size", [9, 260_001])
def test_percentiles_have_one_answer_for_odd_values_at_any_size(spark, size):
    own = spark.range(size).selectExpr("cast(id AS double) AS x")
    odd = numbers(spark, [float("nan"), float("inf"), float("-inf"), None])
    values = np.sort(np.concatenate([np.arange(size, dtype=float), [np.inf, -np.inf]]))
    got = exact_quantiles(own.unionByName(odd), "x", [0, 0.25, 0.5, 0.75, 1])[()]
    ranks = [s * (len(values) - 1) for s in (0.25, 0.5, 0.75)]
    assert (got[0], got[-1]) == (float("-inf"), float("inf"))
    assert got[1:-1] == pytest.approx([values[int(r)] + (r - int(r)) for r in ranks])


def test_percentiles_of_many_groups(spark):
    df = spark.range(10_001 * 27).selectExpr("id % 10001 AS g", "cast(id AS double) AS x")
    found = Q.quantile_table(df, "x", [0.5], by=["g"])
    assert found.filter("value = g + 13 * 10001").count() == found.count() == 10_001
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_percentiles_by_group_and_extreme_range(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for g in "ab" for _ in range(3000)]
    rows += [(None, 1.0), (None, 2.0), ("c", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = exact_quantiles(df, "x", [0.1, 0.5, 0.9], by=["g"])
    for g in ("a", "b", "c", None):
        # Interpolated the plain way: numpy's difference of two huge numbers overflows.
        own = sorted(x for h, x in rows if h == g)
        for s, q in zip((0.1, 0.5, 0.9), got[(g,)]):
            position = s * (len(own) - 1)
            low, high = own[int(position)], own[min(int(position) + 1, len(own) - 1)]
            assert q == pytest.approx(low + (high - low) * (position - int(position)), rel=1e-9)


def test_percentiles_of_nothing(spark):
    assert exact_quantiles(numbers(spark, [None]), "x", [0.5]) == {}


# --- bins and flags ------------------------------------------------------------------------


def test_right_open_bins(spark):
    df = numbers(spark, [19.0, 20.0, 99.0, 100.0, None]).select(E.fixed_bins(F.col("x"), [20, 30, 100], ["a", "b"]).alias("o"))
    assert [r["o"] for r in df.collect()] == [None, "a", "b", None, None]


def test_open_top_bin(spark):
    df = numbers(spark, [-1.0, 0.0, 49.9, 50.0, 1e9]).select(E.fixed_bins(F.col("x"), [0, 50, float("inf")], ["l", "h"]).alias("o"))
    assert [r["o"] for r in df.collect()] == [None, "l", "l", "h", "h"]


def test_quantile_bins_with_ties(spark):
    df = E.quantile_bins(numbers(spark, [1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]), "x", 5)
    assert sorted((r["x"], r["bin"]) for r in df.collect()) == [
        (1.0, 0), (1.0, 0), (1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1), (5.0, 2), (6.0, 2), (7.0, 3), (8.0, 3),
    ]


def test_closed_groups_share_inner_cuts(spark):
    df = numbers(spark, [-1.0, 0.0, 5.0, 10.0, 11.0]).select("x", E.closed_groups("x", [0.0, 5.0, 10.0]).alias("g"))
    assert {r["x"]: r["g"] for r in df.collect()} == {-1.0: None, 0.0: [0], 5.0: [0, 1], 10.0: [1], 11.0: None}


def test_one_hot_declared_levels_and_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "i int, v string")
    got = E.one_hot(df, ["v"], known={"v": ["a", "b", "c"]}).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, 0), (2, 0, 0, 0), (3, 1, 0, 0)]
    assert E.one_hot(df, ["v"], drop_first=True).columns == ["i", "v_b"]


def test_too_many_levels_is_refused(spark, monkeypatch):
    monkeypatch.setattr(E, "MAX_LEVELS", 5)
    with pytest.raises(ValueError, match="too many levels"):
        E.levels(spark.range(100), ["id"])


def test_preprocessor_unseen_level_and_constant(spark):
    train = spark.createDataFrame([(1.0, 5.0, "a"), (3.0, 5.0, "b"), (None, 5.0, "b")], "x double, c double, v string")
    test = spark.createDataFrame([(2.0, 6.0, "z"), (None, 5.0, None)], "x double, c double, v string")
    fitted = E.Preprocessor.fit(train, ["x", "c"], ["v"])
    got = [tuple(r) for r in fitted.transform(test).collect()]
    assert fitted.features == ["num__x", "num__c", "cat__v_a", "cat__v_b"]
    assert list(fitted.bases.values()) == ["x", "c", "v", "v"]
    assert got[0] == pytest.approx((0.0, 1.0, 0.0, 0.0))
    assert got[1] == pytest.approx((0.0, 0.0, 0.0, 1.0))


def test_feature_base():
    assert E.base_of("cat__age_group_0-29", ["size", "age_group"]) == "age_group"
    assert E.base_of("x", ["size"]) == "Other"


# --- imputation ----------------------------------------------------------------------------


def test_mode_takes_the_smallest_tie(spark):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (3, "b"), (1, "a"), (None, None), (10, "c")], "n int, t string")
    assert I.modes(df, ["n", "t"]) == {"n": 1.0, "t": "a"}


def test_fill_keeps_types(spark):
    df = spark.createDataFrame([(3, 2.0), (None, None), (3, 3.0)], "n int, x double")
    filled = I.fill_rounded_mean(I.fill_mode(df, ["n"]), ["x"])
    assert filled.schema["n"].dataType.simpleString() == "int"
    assert sorted(tuple(r) for r in filled.collect()) == [(3, 2.0), (3, 2.0), (3, 3.0)]


def test_all_null_column_stays(spark):
    df = spark.createDataFrame([(None, 1), (None, 1)], "n int, m int")
    assert [tuple(r) for r in I.fill_mode(df, ["n", "m"]).collect()] == [(None, 1), (None, 1)]


# --- descriptions --------------------------------------------------------------------------


def test_empty_bins_are_kept(spark):
    df = spark.createDataFrame([("30-39", 31), ("30-39", 33)], "g string, age int")
    got = {r["g"]: r["mean"] for r in G.mean_by_bin(df, "g", "age", AGE_LABELS).collect()}
    assert len(got) == len(AGE_LABELS) == len(AGE_EDGES) - 1
    assert got["30-39"] == 32 and got["0-29"] is None


def test_duplicates_with_one_very_common_row(spark, monkeypatch):
    monkeypatch.setattr(G, "COPIES_PER_CHUNK", 100)
    df = spark.range(1000).select(F.when(F.col("id") < 350, 7).otherwise(F.col("id")).alias("k"), F.lit(None).cast("int").alias("n"))
    df = df.unionByName(df.filter("k = 400"))
    got = [r["k"] for r in G.duplicate_rows(df).collect()]
    assert sorted(got) == [7] * 350 + [400] * 2


def test_crosstab_fills_empty_cells(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, None)], "a int, b int")
    assert sorted(tuple(r) for r in G.crosstab(df, "a", "b", [0, 1]).collect()) == [(0, 2, 0), (1, 0, 1)]


def test_box_whiskers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("0-9", v) for v in values], "g string, v double")
    row = G.box_stats(df, "g", "v").first()
    assert (row["whisker_low"], row["whisker_high"], row["outliers"], row["order_key"]) == (1.0, 5.0, 1, 0)
    assert [r["v"] for r in G.box_outliers(df, "g", "v").collect()] == [100.0]


# --- rank and running totals ---------------------------------------------------------------


def test_rank_with_a_hot_score(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.rand(4)).alias("s"))
    df = stage(df, "hot")
    ranked = R.rank_by_score(df.repartition(13), "id", "s")
    got = {r["id"]: r["rank"] for r in ranked.collect()}
    expect = sorted(((-r["s"], r["id"]) for r in df.collect()))
    assert got == {key: i for i, (_, key) in enumerate(expect, 1)}


def test_rank_by_group(spark):
    df = stage(spark.range(2000).select("id", (F.col("id") % 7 % 3).alias("g"), F.rand(1).alias("s")), "g")
    got = {r["id"]: r["rank"] for r in distributed_rank(df, [F.col("s"), F.col("id")], by=["g"]).collect()}
    rows = df.collect()
    for g in range(3):
        own = sorted((r["s"], r["id"]) for r in rows if r["g"] == g)
        assert [got[key] for _, key in own] == list(range(1, len(own) + 1))


def test_running_total(spark):
    df = spark.range(1, 501).select("id", (F.col("id") * 2).alias("v"))
    got = {r["id"]: r["v_before"] for r in running_total(df.repartition(9), [F.col("id")], ["v"]).collect()}
    assert got == {i: i * (i - 1) for i in range(1, 501)}


def test_rank_plan_has_no_single_task_window(spark):
    ranked = R.rank_by_score(spark.range(100).select("id", F.rand(1).alias("s")), "id", "s")
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    # The only window left runs over the partition totals.
    assert plan.count("Window ") == 1
    assert plan.index("Window ") < plan.index("Aggregate")


# --- splits --------------------------------------------------------------------------------


def test_split_ignores_layout(spark):
    df = spark.range(2000).withColumnRenamed("id", "unit_id")
    one = {r[0] for r in train_test_split(df, "unit_id")[1].collect()}
    two = {r[0] for r in train_test_split(df.repartition(7), "unit_id")[1].collect()}
    assert one == two and 340 < len(one) < 460


def test_stratified_folds_are_even(spark):
    df = spark.range(1003).select(F.col("id").alias("unit_id"), F.when(F.col("id") < 700, 0).otherwise(1).alias("arm"))
    counts = with_stratified_folds(df, "unit_id", "arm", 5).groupBy("arm", "fold").count().collect()
    for arm in (0, 1):
        sizes = [r["count"] for r in counts if r["arm"] == arm]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


# --- balance -------------------------------------------------------------------------------


def test_smd_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0, 1), (1, 5.0, 0), (0, 5.0, 1), (0, 5.0, 1)], "t int, c double, f int")
    got = {r["covariate"]: r["smd"] for r in B.smd_table(df, "t", ["c"], ["f"]).collect()}
    assert got == {"c": 0.0, "f": 0.5}


def test_wide_smd_takes_several_passes(spark):
    names = [f"c{i}" for i in range(230)]
    df = spark.range(200).select((F.col("id") % 2).alias("t"), *[(F.col("id") % (i + 2)).cast("double").alias(n) for i, n in enumerate(names)])
    got = {r["covariate"]: r["smd"] for r in B.smd_table(df, "t", names).collect()}
    pdf = df.toPandas()
    a, b = pdf[pdf.t == 1], pdf[pdf.t == 0]
    for n in ("c0", "c57", "c229"):
        pooled = np.sqrt((a[n].var() + b[n].var()) / 2)
        assert got[n] == pytest.approx(abs(a[n].mean() - b[n].mean()) / pooled if pooled > 0 else 0)


def test_weights_and_effective_size(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.5), (0, 1.0), (0, 0.75)], "t int, e double")
    out = df.withColumn("w", B.iptw_weight(F.col("t"), F.col("e")))
    assert [r["w"] for r in out.collect()] == [None, 2.0, None, 4.0]
    row = B.weight_summary(out, "w").first()
    assert row["ess"] == pytest.approx(36 / 20)
    assert 1 <= row["ess"] <= row["n"]


def test_trim_drops_and_cap_keeps(spark):
    df = numbers(spark, [float(i) for i in range(1, 101)], "w")
    assert B.trim_weights(df, "w").count() == 99
    capped = B.trim_weights(df, "w", cap=True)
    assert capped.count() == 100 and capped.agg(F.max("w")).first()[0] == pytest.approx(99.01)


def test_propensity_matches_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 2))
    t = (rng.random(2000) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.5])))).astype(int)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, (b, c) in zip(t, x)], "t int, a double, b double")
    model, values = B.fit_propensity(df, "t", ["a", "b"])
    design, w = np.column_stack([np.ones(2000), x]), np.zeros(3)
    penalty = np.diag([0.0, 1.0, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (p - t) + penalty @ w)
    assert [model.intercept, *model.coefficients] == pytest.approx(w.tolist(), abs=1e-5)


# --- subgroups, metrics, votes -------------------------------------------------------------


def test_subgroup_rules(spark):
    rows = [("a", 1.0 + 0.1 * (i % 2)) for i in range(12)] + [("b", 1.0)] * 9 + [(None, 2.0)] * 10
    df = spark.createDataFrame(rows, "g string, cate double")
    got = {r["subgroup_value"]: r for r in subgroup_table(df, ["g"]).collect()}
    assert set(got) == {"a", "nan"}
    assert got["a"]["z_sd"] == pytest.approx(1.05 / np.std([1.0, 1.1] * 6, ddof=1))
    assert got["nan"]["z_sd"] == float("inf") and got["nan"]["p_value"] == 1e-16 and got["nan"]["significant"]


def test_auc_with_ties(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2), rng.randrange(8) / 8) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    expect = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert roc_auc(df, "y", "s").first()[0] == pytest.approx(expect)


def test_metrics_without_predictions(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2)], "y int, s double")
    row = classification_report(df, "y", "s").first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"], row["roc_auc"]) == (0.5, 0, 0, 0, 0)


def test_votes_against_brute_force(spark):
    rng = random.Random(2)
    label = {u: rng.randrange(3) for u in range(60)}
    rows = [(u, b, rng.randrange(3), label[u]) for u in label for b in range(1, 9) if rng.random() < 0.4]
    votes = spark.createDataFrame(rows, "unit_id int, round int, prediction int, label int")
    got = {r["round"]: r["error"] for r in vote_errors(votes, [0, 1, 2]).collect()}
    for b in range(1, 9):
        wrong = []
        for u, r, _, y in rows:
            if r == b:
                cast = [p for v, q, p, _ in rows if v == u and q <= b]
                wrong.append(min(set(cast), key=lambda c: (-cast.count(c), c)) != y)
        assert got[b] == pytest.approx(sum(wrong) / len(wrong))


def test_out_of_bag(spark):
    df = spark.range(10).withColumnRenamed("id", "unit_id")
    left = out_of_bag(df, df.filter("unit_id < 7").unionByName(df.filter("unit_id < 2")), "unit_id")
    assert sorted(r[0] for r in left.collect()) == [7, 8, 9]


def test_targeting_curve_small(spark):
    df = spark.createDataFrame([(i, float(20 - i), float(i)) for i in range(20)], "unit_id int, cate double, y double")
    got = [tuple(r) for r in R.targeting_curve(R.rank_by_score(df, "unit_id", "cate"), "y").orderBy("top_percentile").collect()]
    assert got == [(10 * k, pytest.approx(np.mean(range(2 * k)))) for k in range(1, 11)]


def test_targeting_curve_with_fewer_units_than_points(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.0)], "unit_id int, cate double")
    got = [r[1] for r in R.targeting_curve(R.rank_by_score(df, "unit_id", "cate"), "cate").orderBy("top_percentile").collect()]
    assert got == [None, None, None, 3.0, 3.0, 3.0, 2.5, 2.5, 2.5, 2.0]


# --- sources -------------------------------------------------------------------------------


def test_merge_refuses_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "unit_id int, v string")
    with pytest.raises(ValueError, match="repeats"):
        merge_keep_right(df, df, "unit_id")


def test_nan_becomes_null(spark):
    df = S.nan_to_null(numbers(spark, [1.0, float("nan"), None]))
    assert df.filter("x is null").count() == 2


def test_names_keep_their_order(spark):
    path = new_stage_path(spark, "names")
    S.write_names(spark, ["z", "a", "m"], path)
    assert S.read_names(spark, path) == ["z", "a", "m"]


def test_csv_schema_is_inferred_on_request(spark):
    path = new_stage_path(spark, "csv")
    S.write_table(spark.createDataFrame([(1, 2.5, "x")], "a int, b double, c string"), path, "csv")
    assert [f.dataType.simpleString() for f in S.read_csv(spark, path).schema] == ["int", "double", "string"]


def test_text_lines(spark):
    df = spark.createDataFrame([(1, " a \n\n b\r\nc"), (2, None), (3, " ")], "page int, body string")
    got = [(r["page"], r["line_no"], r["line"]) for r in S.text_lines(df, "page", "body").orderBy("page", "line_no").collect()]
    assert got == [(1, 0, "a"), (1, 2, "b"), (1, 3, "c")]


# --- nothing is cut without a word ---------------------------------------------------------


def test_modes_keep_types_and_long_keys(spark):
    from taufold.operators.impute import modes

    big = 9007199254740993
    df = spark.createDataFrame([(big, "b", None), (big, "a", None), (big - 1, "b", None), (None, "a", None)], "k long, t string, n double")
    assert modes(df, ["k", "t", "n"]) == {"k": big, "t": "a", "n": None}
    assert modes(df, ["k"]) == {"k": big} and modes(df, []) == {}


def test_infinite_text_is_missing(spark):
    from taufold.functions.labels import number_or_null

    df = spark.createDataFrame([("Infinity",), ("-inf",), ("NaN",), ("x",), ("1.5",)], "t string")
    assert [r[0] for r in df.select(number_or_null(F.col("t"))).collect()] == [None, None, None, None, 1.5]


@pytest.mark.parametrize("stray", [7, None])
def test_stray_folds_are_refused(spark, stray):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression

    from taufold.operators.nuisance import cross_fit

    df = spark.createDataFrame([(k, k % 2, float(k), k % 3 if k else stray) for k in range(30)], "unit_id long, arm int, y double, f int")
    with pytest.raises(ValueError, match="outside"):
        cross_fit(df, "f", 3, "arm", "y", [0, 1], LinearRegression(), LogisticRegression())


def test_uplift_refuses_units_without_an_effect(spark):
    from taufold.operators.uplift import bucket_moments

    df = spark.createDataFrame([(1, 0.5, 1.0), (1, None, 2.0), (2, 0.1, 1.0)], "arm int, cate double, dr double")
    for bad in (df.filter("arm = 1"), df.filter("cate IS NOT NULL")):
        with pytest.raises(ValueError, match="arm"):
            bucket_moments(bad, {1: [0.2]})


def test_cleaning_keeps_all_columns_unless_told(spark):
    from taufold.plans.prepare import clean_records

    df = spark.createDataFrame([("1. Lung", 1, "z")], "`Diag Name` string, unit_id int, `odd col` string")
    assert clean_records(df, {"Diag Name": "diagnosis"}).columns == ["diagnosis", "unit_id", "odd col"]
    assert clean_records(df, {"Diag Name": "diagnosis"}, keep=["diagnosis"]).columns == ["diagnosis"]


def test_least_squares_matches_numpy_for_large_means(spark):
    from taufold.operators.linear import fit_ols

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = 1e8 + x @ [2.0, -1.0] + rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    fit = fit_ols(df, "y", ["a", "b"])
    design = np.column_stack([np.ones(400), x])
    beta, squared = np.linalg.lstsq(design, y - 1e8, rcond=None)[:2]
    assert fit.estimate == pytest.approx(beta + [1e8, 0, 0], rel=1e-6)
    assert fit.r_squared == pytest.approx(1 - squared[0] / ((y - y.mean()) ** 2).sum(), rel=1e-6)


def test_merged_sketches_equal_one_sketch_of_all(spark):
    from taufold.operators.summary import distinct_sketches, merged_distinct

    rows = [(k % 3, k % 700 if k % 11 else None) for k in range(5000)]
    df = spark.createDataFrame(rows, "part int, v int")
    merged = merged_distinct(distinct_sketches(df, "v", ["part"]), []).first()[0]
    assert abs(merged - 700) <= 4 * 1.04 / 64 * 700
    assert merged == merged_distinct(distinct_sketches(df, "v", []), []).first()[0]
    assert merged_distinct(distinct_sketches(df.filter("v IS NULL"), "v", []), []).first()[0] == 0


def test_balance_is_one_aggregation_however_many_covariates(spark):
    names = [f"c{k}" for k in range(120)]
    df = spark.range(40).select((F.col("id") % 3).cast("int").alias("t"), *[(F.col("id") * (k + 1) % 7).cast("double").alias(c) for k, c in enumerate(names)])
    smd = B.smd_table(df.withColumn("c5", F.lit(None).cast("double")), "t", names[:60], names[60:])
    assert smd._jdf.queryExecution().optimizedPlan().toString().count("avg(") == 1
    got = {r["covariate"]: r["smd"] for r in smd.collect()}
    x = np.array([[k * (j + 1) % 7 for j in range(120)] for k in range(40)], float)
    treated, control = x[np.arange(40) % 3 == 1], x[np.arange(40) % 3 == 0]
    gap = np.abs(treated.mean(axis=0) - control.mean(axis=0))
    pooled = np.sqrt((treated.var(axis=0, ddof=1) + control.var(axis=0, ddof=1)) / 2)
    want = np.where(pooled > 0, gap / np.where(pooled > 0, pooled, 1), 0.0)
    want[60:], want[5] = gap[60:], 0.0
    assert len(got) == 120 and [got[c] for c in names] == pytest.approx(want.tolist())
    none = {r["covariate"]: r["smd"] for r in B.smd_table(df.filter("t = 1"), "t", ["c1"], ["c2"]).collect()}
    assert none == {"c1": 0.0, "c2": None}
