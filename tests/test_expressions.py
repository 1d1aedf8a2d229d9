"""Scalar expressions on hand-made rows."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from taufold.functions import labels as L
from taufold.functions import numeric as N
from taufold.functions import text as X


def column(spark, values, kind, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_outline_number(spark):
    got = column(spark, ["1.2.3. Name", "1 Name", "10. A.1. B", "Name 1.", None], "string", X.strip_outline_number)
    assert got == ["Name", "1 Name", "A.1. B", "Name 1.", None]


def test_code_in_parentheses(spark):
    got = column(spark, ["Dead (DOD) (x)", "none", "()", None], "string", X.code_in_parentheses)
    assert got == ["DOD", None, None, None]


def test_leading_integer(spark):
    got = column(spark, [" [0] none", "12", "[3", "x 1", "", None], "string", X.leading_integer)
    assert got == [0, 12, 3, None, None, None]


def test_event_flag_reads_numbers_in_text(spark):
    got = column(spark, ["-", None, "0", "2", "0.0", "many"], "string", L.event_flag)
    assert got == [0, 0, 0, 1, 0, 1]


def test_presence_flag(spark):
    assert column(spark, ["-", None, "0", "yes"], "string", L.presence_flag) == [0, 0, 1, 1]


def test_at_least_one_and_nonzero(spark):
    assert column(spark, [0.0, 1.0, 2.5, None], "double", L.at_least_one) == [0, 1, 1, 0]
    assert column(spark, [0, 1, -1], "int", L.nonzero_flag) == [0, 1, 1]


def test_region_label(spark):
    got = column(spark, [1.0, 3.0, 6.0, 7.0, None], "double", L.code_label)
    assert got == ["Head and Neck", "Lower Extremity", "Vizeral and Intraperitoneal", "Others", "Others"]


def test_strict_dates(spark):
    got = column(spark, ["2020-01-31", "2020-13-01", "-", "2020-1-2", "2020-02-30"], "string", L.iso_date)
    assert [str(d) if d else None for d in got] == ["2020-01-31", None, None, None, None]


def test_open_duration(spark):
    df = spark.createDataFrame(
        [("2020-01-01", "2020-01-11"), ("2020-01-01", None), (None, "2020-01-11")], "a string, b string"
    )
    days = L.open_duration(L.iso_date(F.col("a")), L.iso_date(F.col("b")), "2020-02-01")
    assert [r[0] for r in df.select(days).collect()] == [10, 31, None]


def test_number_or_null(spark):
    assert column(spark, ["1.5", "-", "", "x", "NaN", None], "string", L.number_or_null) == [1.5, None, None, None, None, None]


def test_half_even_rounding(spark):
    assert column(spark, [2.5, 3.5, -2.5], "double", lambda c: L.round_even(c, 0)) == [2.0, 4.0, -2.0]


def test_stars_and_p_text(spark):
    assert column(spark, [0.0005, 0.001, 0.02, 0.07, 0.1], "double", L.stars) == ["***", "**", "*", ".", ""]
    assert column(spark, [0.0, 0.012345], "double", L.p_text) == ["1.00e-16", "1.23e-02"]


def test_finite(spark):
    values = [1.0, float("inf"), float("nan"), None]
    assert column(spark, values, "double", L.is_finite) == [True, False, False, False]


def test_term_lines(spark):
    lines = ["Foreword by X", "12", "3 Heading", "3. Heading", "12th floor", "Soft tissue", "My References", "٣"]
    got = column(spark, lines, "string", X.is_term_line)
    assert got == [False, False, False, True, False, True, False, False]


def test_page_number(spark):
    lines = ["Name 12", "Name 12 34", "Name12", "12", "  "]
    assert column(spark, lines, "string", X.strip_page_number) == ["Name", "Name 12", "Name12", "12", None]


def test_terms(spark):
    texts = [" A 2020| b,, c ", "-", "x12345, é2020, 2020-2021", None]
    got = column(spark, texts, "string", X.split_terms)
    assert got == [["a", "b", "c"], [], ["x12345", "é2020", "-"], None]


def test_strip_is_unicode_aware(spark):
    texts = ["  a b  ", "\t\x1cx\x85", "　"]
    assert column(spark, texts, "string", X.strip) == [t.strip() for t in texts]


def test_lines_like_splitlines(spark):
    text = "a\r\nb\x0bc\x0cd\x85e f\rg"
    assert column(spark, [text], "string", X.split_lines)[0] == text.splitlines()


def test_bin_order(spark):
    assert column(spark, ["80+", "20-29", "x", None], "string", X.bin_order_key) == [80, 20, None, None]


def test_normal_tail(spark):
    zs = [0.0, 0.5, -1.96, 3.0, 6.0, 8.0]
    got = column(spark, zs, "double", N.normal_tail)
    for z, p in zip(zs, got):
        assert p == pytest.approx(0.5 * math.erfc(abs(z) / math.sqrt(2)), rel=2e-9)


def test_infinite_z(spark):
    assert column(spark, [float("inf"), float("-inf")], "double", N.two_sided_p) == [0.0, 0.0]


def test_student_tail():
    # Reference points of the t table.
    assert N.student_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert N.student_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-5)
    assert N.student_two_sided(1.96, 1e6) == pytest.approx(math.erfc(1.96 / math.sqrt(2)), abs=1e-6)
    assert N.student_two_sided(0.0, 7) == 1.0


def test_cut_search_matches_a_scan(spark):
    cuts = [-1.0, 0.0, 0.0, 2.5, 7.0]
    values = [-2.0, -1.0, -0.5, 0.0, 1.0, 2.5, 7.0, 8.0, None]
    at_or_below = column(spark, values, "double", lambda c: N.cuts_at_or_below("v", cuts))
    below = column(spark, values, "double", lambda c: N.cuts_below("v", cuts))
    assert at_or_below == [None if v is None else sum(q <= v for q in cuts) for v in values]
    assert below == [None if v is None else sum(q < v for q in cuts) for v in values]


def test_draws_do_not_depend_on_layout(spark):
    df = spark.range(5000).withColumn("z", N.standard_normal(3, F.col("id")))
    one = {r["id"]: r["z"] for r in df.coalesce(1).collect()}
    many = {r["id"]: r["z"] for r in df.repartition(7).collect()}
    assert one == many
    assert abs(statistics.fmean(one.values())) < 0.05
    assert abs(statistics.pstdev(one.values()) - 1) < 0.03


def test_poisson_draws(spark):
    df = spark.range(20000).withColumn("u", N.uniform(1, F.col("id"))).select(N.poisson_one("u").alias("k"))
    row = df.agg(F.avg("k").alias("m"), F.var_pop("k").alias("v"), F.avg((F.col("k") == 0).cast("int")).alias("z")).first()
    assert row["m"] == pytest.approx(1, abs=0.03)
    assert row["v"] == pytest.approx(1, abs=0.06)
    assert row["z"] == pytest.approx(math.exp(-1), abs=0.02)
