"""Counts, shares, crosstabs, boxes, duplicates, ranks and curves on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from taufold.operators import rate as R
from taufold.operators import summary as G
from taufold.operators.quantiles import quantile_table
from taufold.plans.prepare import group_records, label_records
from taufold.functions.values import AGE_LABELS
from taufold.queries.fixtures import AS_OF, COHORT, GROUPS, SCORED, cohort, records, scored, table
from taufold.queries.registry import query
from taufold.sources.stage import stage

AGE_LABEL_SQL = ", ".join(f"'{v}'" for v in AGE_LABELS)


@query(
    "G1 E1",
    "age_group:s, mean:d",
    f"""WITH {GROUPS}, l AS (SELECT unnest([{AGE_LABEL_SQL}]) AS age_group)
    SELECT l.age_group, avg(age) AS mean FROM l LEFT JOIN binned b ON l.age_group = b.age_group GROUP BY l.age_group""",
)
def mean_age_by_bin(spark, sf):
    groups = group_records(label_records(records(spark, sf), AS_OF))
    return G.mean_by_bin(groups, "age_group", "age", AGE_LABELS)


@query(
    "G3 H6",
    "segment:s, count:i",
    f"WITH {COHORT} SELECT segment, count(*) AS count FROM cohort GROUP BY segment",
)
def segment_counts(spark, sf):
    return G.value_counts(cohort(spark, sf), "segment")


@query(
    "G3 B4 B9",
    "size:i, count:i",
    "SELECT p_size AS size, count(*) AS count FROM part WHERE p_size IS NOT NULL GROUP BY p_size",
)
def counts_by_value(spark, sf):
    sizes = table(spark, sf, "part").select(F.col("p_size").cast("int").alias("size")).dropna()
    return G.value_counts(sizes, "size", by_value=True)


@query(
    "G4 C20",
    "outcome:s, untreated:i, treated:i",
    f"""WITH {COHORT} SELECT CASE outcome WHEN 0 THEN 'Not Survived' ELSE 'Survived' END AS outcome,
      count(*) FILTER (treatment = 0) AS untreated, count(*) FILTER (treatment = 1) AS treated FROM cohort GROUP BY outcome""",
)
def outcome_by_treatment(spark, sf):
    from taufold.functions.labels import display_label

    counts = G.crosstab(cohort(spark, sf), "outcome", "treatment", [0, 1])
    label = display_label(F.col("outcome"), {0: "Not Survived", 1: "Survived"})
    return counts.select(label.alias("outcome"), F.col("0").alias("untreated"), F.col("1").alias("treated"))


@query(
    "G5",
    "n_keys:i",
    "SELECT count(DISTINCT l_orderkey) AS n_keys FROM lineitem",
)
def distinct_units(spark, sf):
    return G.distinct_keys(table(spark, sf, "lineitem"), "l_orderkey")


@query(
    "G6",
    "l_returnflag:s, l_linestatus:s, l_quantity:d",
    """SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem
    QUALIFY count(*) OVER (PARTITION BY l_returnflag, l_linestatus, l_quantity) > 1""",
)
def repeated_rows(spark, sf):
    return G.duplicate_rows(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@query(
    "G11",
    "arm:i, share:d, value:d",
    f"""WITH {SCORED} SELECT arm, unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS share,
      unnest(quantile_cont(cate, [0.05, 0.25, 0.5, 0.75, 0.95])) AS value FROM scored GROUP BY arm""",
)
def effect_percentiles(spark, sf):
    return quantile_table(scored(spark, sf), "cate", [0.05, 0.25, 0.5, 0.75, 0.95], by=["arm"])


@query(
    "G11",
    "share:d, value:d",
    """SELECT unnest([0.01, 0.5, 0.99]) AS share, unnest(quantile_cont(l_extendedprice, [0.01, 0.5, 0.99])) AS value FROM lineitem""",
)
def price_percentiles_by_counting(spark, sf):
    return quantile_table(table(spark, sf, "lineitem"), "l_extendedprice", [0.01, 0.5, 0.99])


@query(
    "G13",
    "statistic:s, value:d",
    """SELECT unnest(['count', 'mean', 'std', 'min', '10%', '25%', '50%', '75%', '90%', 'max']) AS statistic,
      unnest(list_concat([CAST(count(value) AS DOUBLE), avg(value), stddev_samp(value), min(value)],
        list_concat(quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9]), [max(value)]))) AS value FROM events""",
)
def describe_values(spark, sf):
    return G.describe(table(spark, sf, "events"), "value")


@query(
    "G15 B3",
    "variable:s, zeros:i, ones:i",
    f"""WITH {COHORT} SELECT unnest(['Treated', 'Returned', 'Event']) AS variable,
      unnest([count(*) FILTER (treatment = 0), count(*) FILTER (returned = 0), count(*) FILTER (outcome = 0)]) AS zeros,
      unnest([count(*) FILTER (treatment = 1), count(*) FILTER (returned = 1), count(*) FILTER (outcome = 1)]) AS ones FROM cohort""",
)
def flag_counts(spark, sf):
    labels = {"treatment": "Treated", "returned": "Returned", "outcome": "Event"}
    return G.zero_one_counts(cohort(spark, sf), labels)


@query(
    "G16",
    "event_type:s, n:i, pct:d",
    """SELECT event_type, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM events GROUP BY event_type""",
)
def event_shares(spark, sf):
    return G.share_table(table(spark, sf, "events"), "event_type")


BOX = """q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
      FROM events GROUP BY event_type),
    f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


@query(
    "G17",
    "event_type:s, q1:d, median:d, q3:d, whisker_low:d, whisker_high:d, mean:d, n:i, outliers:i",
    f"""WITH {BOX} SELECT event_type, q1, median, q3, min(value) FILTER (value BETWEEN lo AND hi) AS whisker_low,
      max(value) FILTER (value BETWEEN lo AND hi) AS whisker_high, avg(value) AS mean, count(value) AS n,
      count(*) FILTER (NOT value BETWEEN lo AND hi) AS outliers
    FROM events JOIN f USING (event_type) GROUP BY event_type, q1, median, q3""",
)
def value_boxes(spark, sf):
    return G.box_stats(table(spark, sf, "events"), "event_type", "value")


@query(
    "G17",
    "event_id:i, event_type:s, value:d",
    f"WITH {BOX} SELECT event_id, event_type, value FROM events JOIN f USING (event_type) WHERE value < lo OR value > hi",
)
def value_outliers(spark, sf):
    return G.box_outliers(table(spark, sf, "events"), "event_type", "value", keep=["event_id"])


@query(
    "H1",
    "unit_id:i, rank:i",
    f"WITH {SCORED} SELECT unit_id, row_number() OVER (ORDER BY cate DESC, unit_id) AS rank FROM scored",
)
def effect_rank(spark, sf):
    return R.rank_by_score(scored(spark, sf).select("unit_id", "cate"), "unit_id", "cate")


@query(
    "H1",
    "l_orderkey:i, l_linenumber:i, rank:i",
    """SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem""",
)
def tied_line_rank(spark, sf):
    from taufold.operators.rank import distributed_rank

    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    order = [F.desc("l_quantity"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return distributed_rank(lines, order)


CURVE = f"""{SCORED},
    ranked AS (SELECT *, row_number() OVER (ORDER BY cate DESC, unit_id) AS rank, count(*) OVER () AS n FROM scored),
    curve AS (SELECT 10 * i AS top_percentile, (SELECT avg(dr) FROM ranked WHERE rank <= i * n // 10) AS dr_effect,
        (SELECT avg(cate) FROM ranked WHERE rank <= i * n // 10) AS mean_effect FROM range(1, 11) t(i))"""


def ranked_scores(spark, sf):
    from taufold.operators.dr import dr_score

    df = scored(spark, sf)
    mu, e = [F.col("mu0"), F.col("mu1")], [F.col("e0"), F.col("e")]
    dr = dr_score(F.col("outcome").cast("double"), F.col("treatment"), [0, 1], 1, mu, e)
    return R.rank_by_score(df.select("unit_id", "cate", "segment", "region", "returned", dr.alias("dr")), "unit_id", "cate")


@query(
    "H2 K25",
    "top_percentile:i, mean_effect:d, dr_effect:d",
    f"WITH {CURVE} SELECT * FROM curve",
)
def targeting_points(spark, sf):
    ranked = ranked_scores(spark, sf)
    by_model = R.targeting_curve(ranked, "cate")
    by_score = R.targeting_curve(ranked, "dr").withColumnRenamed("mean_effect", "dr_effect")
    return by_model.join(by_score, "top_percentile")


@query(
    "K25 H3 K30",
    "autoc:d, se:d, lower:d, upper:d",
    f"""WITH {CURVE}, steps AS (SELECT mean_effect, (top_percentile - lag(top_percentile) OVER w) / 100.0
        * (mean_effect + lag(mean_effect) OVER w) / 2 AS step FROM curve WINDOW w AS (ORDER BY top_percentile)),
    s AS (SELECT sum(step) AS autoc, stddev_pop(mean_effect) / sqrt(10) AS se FROM steps)
    SELECT autoc, se, autoc - 1.96 * se AS lower, autoc + 1.96 * se AS upper FROM s""",
)
def targeting_area(spark, sf):
    return R.rate_summary(R.targeting_curve(ranked_scores(spark, sf), "cate"))


@query(
    "K30",
    "top_percentile:i, lower:d, upper:d",
    f"""WITH {CURVE}, s AS (SELECT stddev_pop(mean_effect) / sqrt(10) AS se FROM curve)
    SELECT top_percentile, mean_effect - 1.96 * se AS lower, mean_effect + 1.96 * se AS upper FROM curve, s""",
)
def targeting_band(spark, sf):
    curve = R.targeting_curve(ranked_scores(spark, sf), "cate")
    return R.with_curve_band(curve, R.rate_summary(curve))


@query(
    "H5",
    "subgroup_var:s, subgroup_value:s, mean:d, n:i",
    f"""WITH {CURVE}, top AS (SELECT * FROM ranked WHERE rank <= CAST(floor(0.1 * n) AS BIGINT)),
    u AS (SELECT 'segment' AS subgroup_var, segment AS subgroup_value, cate FROM top
      UNION ALL SELECT 'region', region, cate FROM top
      UNION ALL SELECT 'returned', CAST(returned AS VARCHAR), cate FROM top)
    SELECT subgroup_var, subgroup_value, avg(cate) AS mean, count(cate) AS n FROM u WHERE subgroup_value IS NOT NULL GROUP BY ALL""",
)
def top_tenth_subgroups(spark, sf):
    return R.top_share_subgroups(ranked_scores(spark, sf), ["segment", "region", "returned"], "cate")


@query(
    "H7 H6",
    "unit_id:i, price:d",
    f"WITH {COHORT} SELECT unit_id, price FROM cohort ORDER BY price DESC, unit_id LIMIT 20",
)
def highest_prices(spark, sf):
    return cohort(spark, sf).select("unit_id", "price").orderBy(F.desc("price"), "unit_id").limit(20)


# Sketches of (status, priority) are stored, then merged by status; four standard errors around the exact count.
@query(
    "G5",
    "status:s, n_distinct:i, within:b",
    "SELECT o_orderstatus AS status, count(DISTINCT o_custkey) AS n_distinct, true AS within FROM orders GROUP BY 1",
)
def merged_distinct_counts(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status")
    stored = stage(G.distinct_sketches(orders, "o_custkey", ["status", "o_orderpriority"]), "sketches")
    exact = orders.groupBy("status").agg(F.count_distinct("o_custkey").alias("n_distinct"))
    found = exact.join(G.merged_distinct(stored, ["status"]), "status")
    gap = F.abs(F.col("estimate") - F.col("n_distinct"))
    return found.select("status", "n_distinct", (gap <= 4 * 1.04 / 64 * F.col("n_distinct")).alias("within"))
