"""Test inputs derived from the given tables, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taufold.functions import values as V
from taufold.operators.balance import iptw_weight
from taufold.operators.dr import dr_long
from taufold.operators.split import fold_of
from taufold.plans.prepare import clean_records
from taufold.sources.tables import read_parquet

FOLDS = 5
FOLD_SEED = 123
AS_OF = "2005-01-01"


# Declared, so that building a query reads no file.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", TABLE_SCHEMAS[name])


def hash32_sql(seed: int, key: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"


def uniform_sql(seed: int, key: str) -> str:
    return f"((CAST({hash32_sql(seed, key)} AS DOUBLE) + 0.5) / 4294967296.0)"


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit per order; orders without line items give missing covariates."""
    o, c, n, r, li = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region", "lineitem"))
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.avg("l_quantity").alias("qty"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"),
        F.max("l_shipdate").alias("last_ship"),
    )
    urgent = F.col("o_orderpriority")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .join(lines, "o_orderkey", "left")
        .select(
            F.col("o_orderkey").alias("unit_id"),
            urgent.isin("1-URGENT", "2-HIGH").cast("int").alias("treatment"),
            F.when(urgent == "1-URGENT", 2).when(urgent == "2-HIGH", 1).otherwise(0).alias("arm"),
            (F.col("o_orderstatus") == "F").cast("int").alias("outcome"),
            F.col("o_totalprice").alias("price"),
            F.col("c_acctbal").alias("bal"),
            "n_lines",
            "qty",
            "returned",
            F.col("last_ship").cast("date").alias("last_ship"),
            F.col("o_orderdate").cast("date").alias("start_date"),
            F.col("c_mktsegment").alias("segment"),
            F.col("r_name").alias("region"),
            fold_of(F.col("o_orderkey"), FOLDS, FOLD_SEED).alias("fold"),
        )
    )


COHORT = f"""cohort AS (
  SELECT o.o_orderkey AS unit_id,
    CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS treatment,
    CASE o.o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 0 END AS arm,
    CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS outcome,
    o.o_totalprice AS price, c.c_acctbal AS bal,
    l.n_lines, l.qty, l.returned, CAST(l.last_ship AS DATE) AS last_ship,
    CAST(o.o_orderdate AS DATE) AS start_date, c.c_mktsegment AS segment, r.r_name AS region,
    {hash32_sql(FOLD_SEED, "o.o_orderkey")} % {FOLDS} AS fold
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (
    SELECT l_orderkey, count(*) AS n_lines, avg(l_quantity) AS qty,
      max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned, max(l_shipdate) AS last_ship
    FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort with closed-form nuisances and predicted effect, so that no model fit is needed."""
    with_models = cohort(spark, sf_dir).withColumns(
        {
            "e": 1.0 / (1.0 + F.exp(0.4 - 0.05 * F.col("bal") / 1000)),
            "mu0": 0.2 + 0.2 * F.col("price") / 500000,
            "cate": 0.3 * F.col("bal") / 10000 - 0.2 * F.col("price") / 500000,
        }
    )
    return with_models.withColumns(
        {
            "e0": 1.0 - F.col("e"),
            "mu1": F.col("mu0") + F.col("cate"),
            "weights": iptw_weight(F.col("treatment"), F.col("e")),
        }
    )


SCORED = f"""{COHORT},
scored AS (
  SELECT *, CASE WHEN treatment = 1 THEN 1.0 / e ELSE 1.0 / (1.0 - e) END AS weights,
    (mu0 + cate + (CASE WHEN treatment = 1 THEN 1 ELSE 0 END) / greatest(e, 0.01) * (outcome - mu0 - cate))
    - (mu0 + (CASE WHEN treatment = 0 THEN 1 ELSE 0 END) / greatest(1.0 - e, 0.01) * (outcome - mu0)) AS dr
  FROM (SELECT *, 1.0 / (1.0 + exp(0.4 - 0.05 * bal / 1000)) AS e,
          0.2 + 0.2 * price / 500000 AS mu0,
          0.3 * bal / 10000 - 0.2 * price / 500000 AS cate FROM cohort) z)"""


def one_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit_id, fold, arm, dr, cate) of the binary treatment."""
    return dr_long(
        scored(spark, sf_dir), "outcome", "treatment", [0, 1], ["mu0", "mu1"], ["e0", "e"], ["cate"], ["unit_id", "fold"]
    )


ONE_ARM = f"""{SCORED},
long AS (SELECT unit_id, fold, 1 AS arm, dr, cate FROM scored)"""


def two_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with arms 1 and 2 against control 0."""
    df = scored(spark, sf_dir).withColumns(
        {
            "p1": 0.2 + 0.02 * F.col("bal") / 10000,
            "p2": 0.15 + 0.05 * F.col("price") / 500000,
            "cate2": 0.05 + 0.5 * F.col("cate"),
        }
    )
    df = df.withColumns({"p0": 1.0 - F.col("p1") - F.col("p2"), "mu2": F.col("mu0") + F.col("cate2")})
    return dr_long(
        df, "outcome", "arm", [0, 1, 2], ["mu0", "mu1", "mu2"], ["p0", "p1", "p2"], ["cate", "cate2"], ["unit_id", "fold"]
    )


TWO_ARMS = f"""{SCORED},
nuisance AS (SELECT *, mu0 + cate AS mu1, mu0 + 0.05 + 0.5 * cate AS mu2, 0.05 + 0.5 * cate AS cate2,
    0.2 + 0.02 * bal / 10000 AS p1, 0.15 + 0.05 * price / 500000 AS p2 FROM scored),
base AS (SELECT *, mu0 + (CASE WHEN arm = 0 THEN 1 ELSE 0 END) / greatest(1.0 - p1 - p2, 0.01) * (outcome - mu0) AS y0 FROM nuisance),
long AS (
  SELECT unit_id, fold, 1 AS arm, cate,
    mu1 + (CASE WHEN arm = 1 THEN 1 ELSE 0 END) / greatest(p1, 0.01) * (outcome - mu1) - y0 AS dr FROM base
  UNION ALL
  SELECT unit_id, fold, 2 AS arm, cate2 AS cate,
    mu2 + (CASE WHEN arm = 2 THEN 1 ELSE 0 END) / greatest(p2, 0.01) * (outcome - mu2) - y0 AS dr FROM base)"""


def train_val(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold 0 validates what the other folds train."""
    return long.filter("fold <> 0"), long.filter("fold = 0")


# Raw records of the preparation stage, in SQL that both engines read.
RECORDS_BODY = """
SELECT o.o_orderkey AS unit_id,
  CAST(1925 + o.o_custkey % 80 AS INT) AS birth_year,
  CASE WHEN c.c_nationkey % 2 = 0 THEN 'f' ELSE 'm' END AS gender,
  CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS first_contact,
  concat(CAST(1 + o.o_custkey % 9 AS STRING), '.', CAST(o.o_orderkey % 4 AS STRING), '. ', c.c_mktsegment, ' | ',
    r.r_name, ' ', CAST(EXTRACT(YEAR FROM o.o_orderdate) AS STRING), ', ', o.o_orderpriority) AS diagnosis,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'G1' WHEN '2-HIGH' THEN 'G2' ELSE 'G3' END AS grade,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(c.c_custkey % 8 AS DOUBLE) END AS cci,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE CAST(1 + c.c_nationkey % 7 AS DOUBLE) END AS region_code,
  CASE c.c_nationkey % 3 WHEN 0 THEN 'bone' WHEN 1 THEN 'soft' ELSE NULL END AS tissue,
  CASE WHEN o.o_orderkey % 17 = 0 THEN '-' ELSE CAST(CAST(floor(l.qty * 6) AS INT) AS STRING) END AS size_mm,
  CAST(l.n_lines % 3 AS DOUBLE) AS n_operations,
  CASE o.o_custkey % 5 WHEN 0 THEN '[0] none' WHEN 1 THEN '1' WHEN 2 THEN ' [2] late' WHEN 3 THEN 'unknown' ELSE NULL END
    AS radio_indication,
  CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'yes' WHEN o.o_orderkey % 2 = 0 THEN '-' ELSE NULL END
    AS chemo_first_indication,
  CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CAST(CAST(o.o_orderdate AS DATE) AS STRING)
    WHEN o.o_orderkey % 7 = 0 THEN '2020-13-01' ELSE NULL END AS line_start,
  CASE WHEN o.o_orderkey % 5 <> 0 THEN CAST(CAST(l.last_ship AS DATE) AS STRING) ELSE NULL END AS line_end,
  CASE WHEN l.returned = 1 THEN CAST(l.n_lines AS STRING) WHEN o.o_orderkey % 3 = 0 THEN '-'
    WHEN o.o_orderkey % 3 = 1 THEN '0' ELSE NULL END AS n_metastasis,
  CASE WHEN l.returned = 1 THEN CAST(CAST(o.o_orderdate AS DATE) AS STRING) ELSE NULL END AS metastasis_date,
  CAST(CAST(l.last_ship AS DATE) AS STRING) AS last_follow_up,
  CASE WHEN o.o_orderstatus = 'F' THEN CAST(CAST(l.last_ship AS DATE) AS STRING) ELSE NULL END AS death_date,
  CASE WHEN o.o_orderstatus = 'F' THEN 'Dead (DOD)' WHEN o.o_orderstatus = 'O' THEN 'Alive (AWD)'
    WHEN o.o_orderkey % 2 = 0 THEN 'No evidence (NED)' ELSE NULL END AS status
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (
  SELECT l_orderkey, count(*) AS n_lines, avg(l_quantity) AS qty,
    max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned, max(l_shipdate) AS last_ship
  FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
"""
RECORD_TABLES = ("orders", "customer", "nation", "region", "lineitem")
RECORDS = f"records AS ({RECORDS_BODY.format(**{t: t for t in RECORD_TABLES})})"


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RECORDS_BODY, **{t: table(spark, sf_dir, t) for t in RECORD_TABLES})


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_records(raw_records(spark, sf_dir))


LABELLED = f"""{RECORDS},
derived AS (
  SELECT *,
    TRY_CAST(CASE WHEN regexp_matches(line_start, '^\\d{{4}}-\\d\\d-\\d\\d$') THEN line_start END AS DATE) AS start_d,
    TRY_CAST(line_end AS DATE) AS end_d, TRY_CAST(metastasis_date AS DATE) AS met_d,
    TRY_CAST(last_follow_up AS DATE) AS follow_d, TRY_CAST(death_date AS DATE) AS death_d,
    TRY_CAST(first_contact AS DATE) AS contact_d,
    2005 - birth_year AS age,
    CASE WHEN n_operations >= 1 THEN 1 ELSE 0 END AS reoperation_label,
    CASE WHEN n_metastasis IS NULL OR n_metastasis = '-' OR TRY_CAST(n_metastasis AS DOUBLE) = 0 THEN 0 ELSE 1 END AS metastasis_label,
    CASE WHEN chemo_first_indication IS NULL OR chemo_first_indication = '-' THEN 0 ELSE 1 END AS chemo_status,
    nullif(regexp_extract(status, '\\(([^)]+)\\)', 1), '') AS code_raw,
    TRY_CAST(nullif(regexp_extract(trim(radio_indication), '^\\[?(\\d+)\\]?', 1), '') AS BIGINT) AS radio_raw,
    TRY_CAST(size_mm AS DOUBLE) AS size_raw
  FROM records),
fills AS (
  SELECT
    (SELECT region_code FROM derived WHERE region_code IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS region_fill,
    (SELECT code_raw FROM derived WHERE code_raw IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS code_fill,
    (SELECT radio_raw FROM derived WHERE radio_raw IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS radio_fill,
    (SELECT cci FROM derived WHERE cci IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS cci_fill,
    (SELECT round_even(avg(size_raw), 0) FROM derived) AS size_fill),
labelled AS (
  SELECT unit_id, age, gender, grade, tissue, coalesce(cci, cci_fill) AS cci, coalesce(size_raw, size_fill) AS size_mm,
    reoperation_label, metastasis_label, chemo_status,
    CASE coalesce(region_code, region_fill) WHEN 1 THEN 'Head and Neck' WHEN 2 THEN 'Upper Extremity'
      WHEN 3 THEN 'Lower Extremity' WHEN 4 THEN 'Trunk' WHEN 5 THEN 'Retroperitoneal'
      WHEN 6 THEN 'Vizeral and Intraperitoneal' ELSE 'Others' END AS region_label,
    coalesce(code_raw, code_fill) AS survival_status_label,
    CASE WHEN coalesce(code_raw, code_fill) IN ('AWD', 'NED') THEN 1 ELSE 0 END AS survival_status,
    CASE WHEN coalesce(radio_raw, radio_fill) = 0 THEN 0 ELSE 1 END AS radiation_status,
    CASE WHEN metastasis_label = 1 THEN date_diff('day', met_d, follow_d) END AS metastasis_days,
    date_diff('day', start_d, coalesce(end_d, DATE '{AS_OF}')) AS chemo_duration,
    CASE WHEN coalesce(code_raw, code_fill) NOT IN ('AWD', 'NED') THEN date_diff('day', contact_d, death_d) END AS overall_survival_days,
    regexp_replace(diagnosis, '^\\d+(\\.\\d+)*\\.\\s*', '') AS diagnosis
  FROM derived, fills)"""

GROUPS = f"""{LABELLED},
binned AS (
  SELECT *,
    CASE WHEN age >= 20 AND age < 30 THEN '0-29' WHEN age >= 30 AND age < 40 THEN '30-39' WHEN age >= 40 AND age < 50 THEN '40-49'
      WHEN age >= 50 AND age < 60 THEN '50-59' WHEN age >= 60 AND age < 70 THEN '60-69' WHEN age >= 70 AND age < 80 THEN '70-79'
      WHEN age >= 80 AND age < 90 THEN '80-89' WHEN age >= 90 AND age < 100 THEN '90-100' END AS age_group,
    CASE WHEN size_mm < 0 THEN NULL WHEN size_mm < 50 THEN '0-49' WHEN size_mm < 100 THEN '50-99' WHEN size_mm < 150 THEN '100-149'
      WHEN size_mm < 200 THEN '150-199' WHEN size_mm < 250 THEN '200-249' WHEN size_mm >= 250 THEN '250-350' END AS size_group,
    CASE WHEN cci < 0 THEN NULL WHEN cci >= 6 THEN '6' WHEN cci IS NOT NULL THEN CAST(CAST(floor(cci) AS INT) AS VARCHAR) END AS cci_group
  FROM labelled)"""


def tail_sql(z: str) -> str:
    """Upper normal tail of |z| with the constants of functions.values."""
    def poly(coefficients):
        out = f"CAST({coefficients[0]!r} AS DOUBLE)"
        for c in coefficients[1:]:
            out = f"({out} * az + CAST({c!r} AS DOUBLE))"
        return out

    near = f"exp(-az * az / 2.0) * {poly(V.TAIL_NUMERATOR)} / {poly(V.TAIL_DENOMINATOR)}"
    far = f"exp(-az * az / 2.0) / (az + 1 / (az + 2 / (az + 3 / (az + 4 / (az + {V.TAIL_FAR_END}))))) / {V.SQRT_TWO_PI}"
    body = f"CASE WHEN az < {V.TAIL_SPLIT} THEN {near} ELSE {far} END"
    return "(" + body.replace("az", f"abs({z})") + ")"
