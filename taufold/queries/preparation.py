"""Sources, projections, scalar expressions, imputation, bins and encoding on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from taufold.functions import labels as L
from taufold.functions import text as X
from taufold.operators import encode as E
from taufold.operators import impute as I
from taufold.operators import merge as M
from taufold.operators.split import fold_of, train_flag, with_stratified_folds
from taufold.plans import prepare as P
from taufold.queries.fixtures import (
    AS_OF,
    COHORT,
    GROUPS,
    LABELLED,
    RECORDS,
    SCORED,
    cohort,
    hash32_sql,
    raw_records,
    records,
    scored,
    table,
    uniform_sql,
)
from taufold.queries.registry import query
from taufold.sources import tables as S
from taufold.sources.stage import new_stage_path, stage


@query(
    "A1 A2 B1 B9",
    "unit_id:i, price:d, status:s, ordered:s",
    """SELECT o_orderkey AS unit_id, o_totalprice AS price, o_orderstatus AS status,
      CAST(o_orderdate AS DATE) AS ordered FROM orders""",
)
def csv_round_trip(spark, sf):
    path = new_stage_path(spark, "csv")
    out = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("unit_id"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("date").alias("ordered"),
    )
    S.write_table(out, path, "csv")
    return S.read_csv(spark, path, "unit_id bigint, price double, status string, ordered date")


@query(
    "A3 G8 B6",
    "position:i, covariate:s",
    f"""WITH {COHORT}, smd AS (
      SELECT 'price' AS covariate, abs(avg(price) FILTER (treatment = 1) - avg(price) FILTER (treatment = 0))
        / sqrt((var_samp(price) FILTER (treatment = 1) + var_samp(price) FILTER (treatment = 0)) / 2) AS smd FROM cohort
      UNION ALL SELECT 'bal', abs(avg(bal) FILTER (treatment = 1) - avg(bal) FILTER (treatment = 0))
        / sqrt((var_samp(bal) FILTER (treatment = 1) + var_samp(bal) FILTER (treatment = 0)) / 2) FROM cohort
      UNION ALL SELECT 'qty', abs(avg(qty) FILTER (treatment = 1) - avg(qty) FILTER (treatment = 0))
        / sqrt((var_samp(qty) FILTER (treatment = 1) + var_samp(qty) FILTER (treatment = 0)) / 2) FROM cohort)
    SELECT row_number() OVER (ORDER BY smd DESC, covariate) - 1 AS position, covariate FROM smd WHERE smd > 0.001""",
)
def variable_list_store(spark, sf):
    from taufold.operators.balance import imbalanced_names, smd_table

    names = imbalanced_names(smd_table(cohort(spark, sf), "treatment", ["price", "bal", "qty"]), 0.001)
    path = new_stage_path(spark, "names")
    S.write_names(spark, names, path)
    kept = S.read_names(spark, path)
    return spark.createDataFrame(list(enumerate(kept)), "position int, covariate string")


@query(
    "A5 C16 C17 I1",
    "kind:s, page:i, line_no:i, term:s",
    r"""WITH pages_of AS (
      SELECT 'document' AS kind, doc_id AS page, text FROM documents
      UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations),
    split AS (SELECT kind, page, regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS parts FROM pages_of),
    lines AS (
      SELECT kind, page, unnest(range(len(parts))) AS line_no,
        regexp_replace(unnest(parts), '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g') AS line FROM split),
    kept AS (
      SELECT * FROM lines WHERE line <> ''
        AND NOT (lower(line) LIKE '%list of abbreviations%' OR lower(line) LIKE '%foreword%' OR lower(line) LIKE '%paypal%'
          OR lower(line) LIKE '%contributors%' OR lower(line) LIKE '%declaration%' OR lower(line) LIKE '%sources%'
          OR lower(line) LIKE '%references%' OR lower(line) LIKE '%subject index%' OR lower(line) LIKE '%previous volumes%')
        AND NOT regexp_matches(line, '^\p{Nd}+$')
        AND NOT regexp_matches(regexp_replace(substr(line, 1, 2), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^\p{Nd}+$')),
    terms AS (SELECT kind, page, line_no, regexp_replace(regexp_extract(line, '^(.*?)(?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]+\p{Nd}+)?$', 1),
        '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g') AS term FROM kept)
    SELECT * FROM terms WHERE term <> ''""",
)
def page_terms(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("page"), "text")
    turns = table(spark, sf, "conversations").select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("page"), "text"
    )
    pages = docs.unionByName(turns).select(F.struct("kind", "page").alias("key"), "text")
    lines = S.text_lines(pages, "key", "text").filter(X.is_term_line(F.col("line")))
    terms = lines.select("key.*", "line_no", X.strip_page_number(F.col("line")).alias("term"))
    return terms.filter("term is not null")


@query(
    "B1 B2 B3",
    "key:i, name:s, balance:d",
    "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer",
)
def project_drop_rename(spark, sf):
    df = table(spark, sf, "customer").drop("c_nationkey", "c_mktsegment")
    return df.withColumnsRenamed({"c_custkey": "key", "c_name": "name", "c_acctbal": "balance"})


@query(
    "B4 B5",
    "unit_id:i, qty:d, per_return:d",
    f"""WITH {COHORT} SELECT unit_id, qty, n_lines / returned AS per_return FROM cohort
    WHERE qty IS NOT NULL AND returned IS NOT NULL AND returned <> 0""",
)
def complete_finite_units(spark, sf):
    from taufold.operators.linear import finite_rows

    df = cohort(spark, sf).dropna(subset=["qty", "returned"])
    ratio = F.when(F.col("returned") == 0, float("inf")).otherwise(F.col("n_lines") / F.col("returned"))
    return finite_rows(df.select("unit_id", "qty", ratio.alias("per_return")), ["qty", "per_return"])


@query(
    "B7 G7",
    "treatment:i, units:i, events:i, low_price:d, high_price:d",
    f"""WITH {COHORT} SELECT treatment, count(*) AS units, sum(outcome) AS events, min(price) AS low_price,
      max(price) AS high_price FROM cohort GROUP BY treatment""",
)
def arm_summary(spark, sf):
    return cohort(spark, sf).groupBy("treatment").agg(
        F.count(F.lit(1)).alias("units"),
        F.sum("outcome").alias("events"),
        F.min("price").alias("low_price"),
        F.max("price").alias("high_price"),
    )


@query(
    "C1 C2 C3 C4 C5 C6 C7 C8 C9 C10 C11 C12 C13 C14 C15 D1 D2",
    "unit_id:i, diagnosis:s, age:i, reoperation_label:i, region_label:s, metastasis_label:i, metastasis_days:i, chemo_status:i,"
    "chemo_duration:i, survival_status_label:s, survival_status:i, radiation_status:i, overall_survival_days:i, size_mm:d, cci:d",
    f"WITH {LABELLED} SELECT * FROM labelled",
)
def labelled_records(spark, sf):
    return P.label_records(records(spark, sf), AS_OF)


@query(
    "C10 C12 C15 C20",
    "key:i, code:s, lead:i, size:d, label:s",
    r"""SELECT p_partkey AS key, p_brand AS code, p_size AS lead, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS size,
      CASE WHEN p_size % 2 = 0 THEN 'No' ELSE 'Yes' END AS label FROM part""",
)
def text_codes(spark, sf):
    p = table(spark, sf, "part")
    status = F.concat(F.lit("Dead ("), "p_brand", F.lit(") at "), "p_size")
    size = F.when(F.col("p_size") % 7 == 0, "-").otherwise(F.col("p_size").cast("string"))
    return p.select(
        F.col("p_partkey").alias("key"),
        X.code_in_parentheses(status).alias("code"),
        X.leading_integer(F.concat(F.lit(" ["), "p_size", F.lit("] x"))).alias("lead"),
        L.number_or_null(size).alias("size"),
        L.display_label(F.col("p_size") % 2, {0: "No", 1: "Yes"}).alias("label"),
    )


@query(
    "C18 G14 H7",
    "term:s, frequency:i",
    r"""WITH lowered AS (SELECT lower(regexp_replace(text, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g')) AS t
        FROM documents),
    once AS (SELECT regexp_replace(t, '(^|[^\p{L}\p{N}_])\p{Nd}{4}($|[^\p{L}\p{N}_])', '\1\2', 'g') AS t FROM lowered WHERE t <> '-'),
    twice AS (SELECT regexp_replace(t, '(^|[^\p{L}\p{N}_])\p{Nd}{4}($|[^\p{L}\p{N}_])', '\1\2', 'g') AS t FROM once),
    terms AS (SELECT regexp_replace(unnest(regexp_split_to_array(t, '[|,]')),
        '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g') AS term FROM twice)
    SELECT term, count(*) AS frequency FROM terms WHERE term <> '' GROUP BY term ORDER BY frequency DESC, term LIMIT 50""",
)
def frequent_terms(spark, sf):
    from taufold.operators.summary import term_counts

    return term_counts(table(spark, sf, "documents").select("text"), "text", top=50)


@query(
    "C18 G14",
    "term:s, frequency:i",
    f"""WITH {LABELLED}, terms AS (
      SELECT trim(unnest(regexp_split_to_array(regexp_replace(lower(diagnosis), '\\b\\d{{4}}\\b', '', 'g'), '[|,]'))) AS term FROM labelled)
    SELECT term, count(*) AS frequency FROM terms WHERE term <> '' GROUP BY term""",
)
def diagnosis_terms(spark, sf):
    from taufold.operators.summary import term_counts

    return term_counts(records(spark, sf), "diagnosis")


@query(
    "C19 H6",
    "age_group:s, order_key:i, n:i, position:i",
    f"""WITH {GROUPS}, counts AS (SELECT age_group, count(*) AS n FROM binned WHERE age_group IS NOT NULL GROUP BY age_group)
    SELECT age_group, CAST(regexp_extract(age_group, '^(\\d+)', 1) AS BIGINT) AS order_key, n,
      row_number() OVER (ORDER BY CAST(regexp_extract(age_group, '^(\\d+)', 1) AS BIGINT)) AS position FROM counts""",
)
def ordered_bin_labels(spark, sf):
    from pyspark.sql import Window

    groups = P.group_records(P.label_records(records(spark, sf), AS_OF))
    counts = groups.filter("age_group is not null").groupBy("age_group").agg(F.count(F.lit(1)).alias("n"))
    keyed = counts.withColumn("order_key", X.bin_order_key(F.col("age_group")))
    # One row per label.
    return keyed.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("order_key")))


@query(
    "C21 C22 C23",
    "event_id:i, p:d, mark:s, p_label:s, even3:d",
    """SELECT event_id, p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p < 0.1 THEN '.' ELSE '' END AS mark,
      printf('%.2e', greatest(p, 1e-16)) AS p_label, round_even(value / 8, 2) AS even3
    FROM (SELECT *, exp(-value / 4) AS p FROM events) e""",
)
def marks_and_rounding(spark, sf):
    p = F.exp(-F.col("value") / 4)
    return table(spark, sf, "events").select(
        "event_id",
        p.alias("p"),
        L.stars(p).alias("mark"),
        L.p_text(p).alias("p_label"),
        L.round_even(F.col("value") / 8, 2).alias("even3"),
    )


@query(
    "C24",
    "unit_id:i, own:d, flag:i",
    f"""WITH {SCORED} SELECT unit_id, CASE WHEN treatment = 1 THEN mu0 + cate ELSE mu0 END AS own,
      CASE WHEN (CASE WHEN treatment = 1 THEN mu0 + cate ELSE mu0 END) >= 0.3 THEN 1 ELSE 0 END AS flag FROM scored""",
)
def own_arm_score(spark, sf):
    own = L.by_arm(F.col("treatment"), F.col("mu1"), F.col("mu0"))
    return scored(spark, sf).select("unit_id", own.alias("own"), L.binarize(own, 0.3).alias("flag"))


@query(
    "D1 D3",
    "unit_id:i, n_lines:i, returned:i, cci:d, tissue:s",
    f"""WITH {COHORT}, {RECORDS}, m AS (SELECT
        (SELECT n_lines FROM cohort WHERE n_lines IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS a,
        (SELECT returned FROM cohort WHERE returned IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS b,
        (SELECT cci FROM records WHERE cci IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS c,
        (SELECT tissue FROM records WHERE tissue IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS d)
    SELECT k.unit_id, coalesce(k.n_lines, a) AS n_lines, coalesce(k.returned, b) AS returned, coalesce(r.cci, c) AS cci,
      coalesce(r.tissue, d) AS tissue FROM cohort k JOIN records r ON k.unit_id = r.unit_id, m""",
)
def fill_with_mode(spark, sf):
    units = cohort(spark, sf).select("unit_id", "n_lines", "returned")
    both = units.join(raw_records(spark, sf).select("unit_id", "cci", "tissue"), "unit_id")
    return I.fill_mode(stage(both, "units"), ["n_lines", "returned", "cci", "tissue"])


@query(
    "D2 D3",
    "unit_id:i, qty:d, qty_mean:d",
    f"""WITH {COHORT} SELECT unit_id, coalesce(qty, (SELECT round_even(avg(qty), 0) FROM cohort)) AS qty,
      coalesce(qty, (SELECT avg(qty) FROM cohort)) AS qty_mean FROM cohort""",
)
def fill_with_mean(spark, sf):
    df = cohort(spark, sf).select("unit_id", "qty", F.col("qty").alias("qty_mean"))
    return I.fill(I.fill_rounded_mean(df, ["qty"]), I.means(df, ["qty_mean"]))


@query(
    "D4",
    "variable:s, nulls:i",
    f"""WITH {COHORT} SELECT unnest(['qty', 'returned', 'price']) AS variable,
      unnest([count(*) FILTER (qty IS NULL), count(*) FILTER (returned IS NULL), count(*) FILTER (price IS NULL)]) AS nulls FROM cohort""",
)
def null_counts(spark, sf):
    return I.null_audit(cohort(spark, sf), ["qty", "returned", "price"])


@query(
    "E1",
    "unit_id:i, age_group:s, size_group:s, cci_group:s",
    f"WITH {GROUPS} SELECT * FROM binned",
)
def fixed_bin_groups(spark, sf):
    return P.group_records(P.label_records(records(spark, sf), AS_OF))


@query(
    "E1",
    "key:i, bin:s",
    """SELECT c_custkey AS key, CASE WHEN c_acctbal >= 0 AND c_acctbal < 2000 THEN 'low' WHEN c_acctbal >= 2000 AND c_acctbal < 5000 THEN 'mid'
      WHEN c_acctbal >= 5000 AND c_acctbal < 9000 THEN 'high' END AS bin FROM customer""",
)
def right_open_bins(spark, sf):
    bins = E.fixed_bins(F.col("c_acctbal"), [0, 2000, 5000, 9000], ["low", "mid", "high"])
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), bins.alias("bin"))


@query(
    "E2 G11",
    "l_orderkey:i, l_linenumber:i, l_quantity:d, bin:i",
    """WITH q AS (SELECT quantile_cont(l_quantity, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS c FROM lineitem),
    d AS (SELECT list_sort(list_distinct(c)) AS c FROM q)
    SELECT l_orderkey, l_linenumber, l_quantity, greatest(len(list_filter(c, lambda x : x < l_quantity)) - 1, 0) AS bin FROM lineitem, d""",
)
def quantile_bin_lines(spark, sf):
    return E.quantile_bins(table(spark, sf, "lineitem"), "l_quantity", 5)


@query(
    "E3",
    "unit_id:i, grp:i",
    f"""WITH {SCORED}, q AS (SELECT quantile_cont(round(cate, 2), [0.0, 0.25, 0.5, 0.75, 1.0]) AS c FROM scored WHERE fold <> 0),
    cuts AS (SELECT unnest([0, 1, 2, 3]) AS grp, c FROM q)
    SELECT unit_id, grp FROM scored, cuts WHERE fold = 0 AND round(cate, 2) BETWEEN c[grp + 1] AND c[grp + 2]""",
)
def closed_effect_groups(spark, sf):
    from taufold.operators.quantiles import exact_quantiles

    df = scored(spark, sf).select("unit_id", "fold", F.round("cate", 2).alias("cate"))
    cuts = exact_quantiles(df.filter("fold <> 0"), "cate", [0, 0.25, 0.5, 0.75, 1])[()]
    val = df.filter("fold = 0")
    return val.select("unit_id", F.explode(E.closed_groups("cate", cuts)).alias("grp"))


@query(
    "E4",
    "unit_id:i, segment_AUTOMOBILE:i, segment_BUILDING:i, segment_FURNITURE:i, segment_HOUSEHOLD:i, segment_MACHINERY:i, returned_0:i, returned_1:i",
    f"""WITH {COHORT} SELECT unit_id, CASE WHEN segment = 'AUTOMOBILE' THEN 1 ELSE 0 END AS "segment_AUTOMOBILE",
      CASE WHEN segment = 'BUILDING' THEN 1 ELSE 0 END AS "segment_BUILDING", CASE WHEN segment = 'FURNITURE' THEN 1 ELSE 0 END AS "segment_FURNITURE",
      CASE WHEN segment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS "segment_HOUSEHOLD", CASE WHEN segment = 'MACHINERY' THEN 1 ELSE 0 END AS "segment_MACHINERY",
      CASE WHEN returned = 0 THEN 1 ELSE 0 END AS returned_0, CASE WHEN returned = 1 THEN 1 ELSE 0 END AS returned_1 FROM cohort""",
)
def one_hot_all_levels(spark, sf):
    return E.one_hot(cohort(spark, sf).select("unit_id", "segment", "returned"), ["segment", "returned"])


@query(
    "E4 F1",
    "unit_id:i, age:i, age_group:s, gender_f:i, gender_m:i, cci_group_6:i, tissue_bone:i, tissue_soft:i",
    f"""WITH {GROUPS} SELECT unit_id, age, age_group, CASE WHEN gender = 'f' THEN 1 ELSE 0 END AS gender_f,
      CASE WHEN gender = 'm' THEN 1 ELSE 0 END AS gender_m, CASE WHEN cci_group = '6' THEN 1 ELSE 0 END AS cci_group_6,
      CASE WHEN tissue = 'bone' THEN 1 ELSE 0 END AS tissue_bone, CASE WHEN tissue = 'soft' THEN 1 ELSE 0 END AS tissue_soft FROM binned""",
)
def groups_with_flags(spark, sf):
    return P.encode_groups(P.group_records(P.label_records(records(spark, sf), AS_OF)))


@query(
    "F1",
    "unit_id:i, price:d, weights:d, arm:i",
    f"WITH {SCORED} SELECT unit_id, price, weights, arm FROM scored",
)
def merge_on_key(spark, sf):
    df = scored(spark, sf)
    left = df.select("unit_id", "price", F.lit(0.0).alias("weights"))
    return P.merge_keep_right(left, df.select("unit_id", "weights", "arm"), "unit_id")


@query(
    "F1",
    "unit_id:i, n_rows:i, quantity:i, weighted:i",
    """SELECT o.o_orderkey AS unit_id, count(*) AS n_rows, sum(l.l_quantity) AS quantity, sum(l.l_quantity * r.l_linenumber) AS weighted
    FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey LEFT JOIN lineitem r ON r.l_orderkey = l.l_orderkey GROUP BY 1""",
)
def merge_on_repeated_key(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "unit_id")
    units = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"))
    left = M.merge_fan_out(units, lines.select("unit_id", "l_quantity", F.lit(0).alias("l_linenumber")), "unit_id")
    merged = M.merge_fan_out(left, lines.select("unit_id", "l_linenumber"), "unit_id")
    weighted = F.sum(F.col("l_quantity") * F.col("l_linenumber"))
    return merged.groupBy("unit_id").agg(F.count("*").alias("n_rows"), F.sum("l_quantity").alias("quantity"), weighted.alias("weighted"))


@query(
    "E5",
    "key:i, l_returnflag_N:i, l_returnflag_R:i",
    """SELECT l_orderkey * 10 + l_linenumber AS key, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS "l_returnflag_N",
      CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS "l_returnflag_R" FROM lineitem""",
)
def one_hot_drop_first(spark, sf):
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key")
    return E.one_hot(table(spark, sf, "lineitem").select(key, "l_returnflag"), ["l_returnflag"], drop_first=True)


@query(
    "E6 E7 E8 D3 K3",
    "unit_id:i, num__price:d, num__qty:d, cat__region_AFRICA:d, cat__region_ASIA:d, cat__region_EUROPE:d",
    f"""WITH {COHORT}, flagged AS (SELECT *, {uniform_sql(42, "unit_id")} >= 0.2 AS in_train FROM cohort),
    split AS (SELECT * REPLACE (CASE WHEN NOT in_train AND bal < 0 THEN 'ELSEWHERE' ELSE region END AS region) FROM flagged),
    f AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(qty) AS mq FROM split WHERE in_train),
    g AS (SELECT stddev_pop(coalesce(qty, mq)) AS sq FROM split, f WHERE in_train)
    SELECT unit_id, (price - mp) / sp AS num__price, (coalesce(qty, mq) - mq) / sq AS num__qty,
      CASE WHEN region = 'AFRICA' THEN 1 ELSE 0 END AS "cat__region_AFRICA", CASE WHEN region = 'ASIA' THEN 1 ELSE 0 END AS "cat__region_ASIA",
      CASE WHEN region = 'EUROPE' THEN 1 ELSE 0 END AS "cat__region_EUROPE" FROM split, f, g WHERE NOT in_train""",
)
def fitted_preprocessor(spark, sf):
    in_train = train_flag(F.col("unit_id"))
    # A level that only test units have.
    region = F.when(~in_train & (F.col("bal") < 0), "ELSEWHERE").otherwise(F.col("region")).alias("region")
    df = cohort(spark, sf).select("unit_id", "price", "qty", region)
    train, test = df.filter(in_train), df.filter(~in_train)
    path = new_stage_path(spark, "preprocessor")
    E.Preprocessor.fit(train, ["price", "qty"], ["region"]).save(spark, path)
    return E.Preprocessor.load(spark, path).transform(test, keep=["unit_id"])


@query(
    "E7",
    "key:i, p_size:d, p_retailprice:d",
    """SELECT p_partkey AS key, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS p_size,
      (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS p_retailprice FROM part""",
)
def standard_scores(spark, sf):
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_size", "p_retailprice")
    return E.standardize(df, ["p_size", "p_retailprice"])


@query(
    "K3 K4",
    "unit_id:i, in_train:b, fold:i",
    f"""SELECT o_orderkey AS unit_id, {uniform_sql(42, "o_orderkey")} >= 0.2 AS in_train,
      {hash32_sql(123, "o_orderkey")} % 5 AS fold FROM orders""",
)
def hash_split(spark, sf):
    unit = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        unit.alias("unit_id"), train_flag(unit).alias("in_train"), fold_of(unit, 5).alias("fold")
    )


@query(
    "K4",
    "unit_id:i, arm:i, fold:i",
    f"""WITH {COHORT} SELECT unit_id, arm,
      (row_number() OVER (PARTITION BY arm ORDER BY {hash32_sql(123, "unit_id")}, unit_id) - 1) % 5 AS fold FROM cohort""",
)
def stratified_folds(spark, sf):
    return with_stratified_folds(cohort(spark, sf).select("unit_id", "arm"), "unit_id", "arm", 5)


@query(
    "F2 A3 B4 K2",
    "unit_id:i, treatment:i, outcome:i, weights:d",
    f"""WITH {SCORED} SELECT unit_id, treatment, outcome, weights FROM scored
    WHERE weights <= (SELECT quantile_cont(weights, 0.99) FROM scored)""",
)
def units_with_weights(spark, sf):
    from taufold.operators.balance import trim_weights
    from taufold.plans.estimate import attach_weights
    from taufold.roles import Roles

    df = scored(spark, sf)
    weights = stage(trim_weights(df.select("unit_id", "weights"), "weights"), "weights")
    return attach_weights(df.drop("weights"), weights, Roles())


@query(
    "F4",
    "unit_id:i",
    f"""WITH {COHORT}, sampled AS (SELECT unit_id FROM cohort WHERE {uniform_sql(7, "unit_id")} >= 0.37)
    SELECT unit_id FROM cohort WHERE unit_id NOT IN (SELECT unit_id FROM sampled)""",
)
def out_of_bag_units(spark, sf):
    from taufold.functions.numeric import uniform
    from taufold.operators.bagging import out_of_bag

    df = cohort(spark, sf).select("unit_id")
    return out_of_bag(df, df.filter(uniform(7, F.col("unit_id")) >= 0.37), "unit_id")
