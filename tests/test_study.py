"""A whole study from a CSV file, with source column names of its own."""

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import types as T

from taufold.operators.cate import ForestParams
from taufold.operators.encode import Preprocessor
from taufold.plans import study
from taufold.plans.prepare import RECORD_COLUMNS, RECORD_SCHEMA
from taufold.queries.fixtures import AS_OF, raw_records
from taufold.sources import tables as S
from taufold.sources.stage import drop_stages, new_stage_path, stage, stage_root


def test_study_from_csv(spark):
    path = new_stage_path(spark, "records")
    source = raw_records(spark, "/root/testdata/sf0.001").select(*RECORD_COLUMNS).withColumnsRenamed({"unit_id": "Record No", "gender": "Sex"})
    S.write_table(source, path, "csv")
    back = {"unit_id": "Record No", "gender": "Sex"}
    declared = T.StructType([T.StructField(back.get(f.name, f.name), f.dataType) for f in RECORD_SCHEMA.fields])
    records = S.read_csv(spark, path, declared)
    table, roles = study.prepare(records, AS_OF, {"Record No": "unit_id", "Sex": "gender"})
    assert table.count() == source.count()
    small = RandomForestRegressor(featuresCol="features", numTrees=5, maxDepth=3, seed=42)
    found = study.estimate(
        table, roles, ForestParams(num_trees=6, max_depth=2), smd_limit=0.01, interval_groups=2, outcome_model=small
    )
    reports = study.report(found, roles, small)
    n = reports.average.first()["n"]
    assert 0.1 * table.count() < n < 0.3 * table.count()
    assert [r["top_percentile"] for r in reports.targeting.collect()] == list(range(10, 101, 10))
    assert reports.targeting_area.count() == 1
    assert {r["subgroup_var"] for r in reports.subgroups.collect()} <= set(roles.subgroups)
    assert reports.subgroup_bars.count() == reports.subgroups.count()
    assert reports.top_tenth.count() > 0
    assert reports.calibration.count() == 3
    assert reports.projection.count() == len(found.preprocessor.features) + 1
    assert reports.projection_by_covariate.count() == len(roles.covariates)
    assert 0 <= reports.classification.first()["accuracy"] <= 1

    saved = new_stage_path(spark, "preprocessor")
    found.preprocessor.save(spark, saved)
    assert Preprocessor.load(spark, saved).features == found.preprocessor.features


def test_stage_tables_can_be_dropped(spark):
    session = spark.newSession()
    kept = stage(session.range(3), "x")
    assert kept.count() == 3
    assert stage_root(session) == stage_root(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(path)
    drop_stages(spark)
    assert not files.exists(path)
