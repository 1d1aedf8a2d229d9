"""A whole study from a record table to its reports, stage by stage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import DataFrame

from taufold.operators.calibration import calibration_bins, calibration_regression
from taufold.operators.cate import ForestParams
from taufold.operators.classify import outcome_forest, score_by_arm
from taufold.operators.dr import average_effect
from taufold.operators.linear import fit_ols, projection_by_covariate, significant_only
from taufold.operators.metrics import classification_report
from taufold.operators.rate import rank_by_score, rate_summary, targeting_curve, top_share_subgroups, with_curve_band
from taufold.operators.subgroup import subgroup_error_bars, subgroup_table
from taufold.plans.estimate import Estimate, attach_weights, estimate_effects, weigh_units
from taufold.plans.prepare import CATEGORIES, clean_records, encode_groups, encoded_names, group_records, label_records
from taufold.roles import Roles
from taufold.sources.stage import stage

NUMERIC = ("reoperation_label", "metastasis_label", "radiation_status")
SUBGROUPS = (
    "age_group",
    "size_group",
    "cci_group",
    "region_label",
    "gender",
    "grade",
    "tissue",
    "radiation_status",
    "metastasis_label",
    "reoperation_label",
)


def prepare(records: DataFrame, as_of: str, names: dict[str, str] | None = None) -> tuple[DataFrame, Roles]:
    """Clean, label, group and encode; returns the analysis table and its column roles."""
    groups = stage(group_records(label_records(clean_records(records, names), as_of)), "groups")
    merged = stage(encode_groups(groups), "merged")
    roles = Roles(
        treatment="chemo_status",
        outcome="survival_status",
        numeric=NUMERIC,
        categorical=CATEGORIES,
        subgroups=SUBGROUPS,
        flags=tuple(encoded_names(groups, merged)),
    )
    return merged, roles.check(merged)


def estimate(
    table: DataFrame,
    roles: Roles,
    params: ForestParams = ForestParams(),
    grid: Sequence[ForestParams] = (),
    smd_limit: float = 0.1,
    interval_groups: int = 4,
    outcome_model: Estimator | None = None,
) -> Estimate:
    """Balance, weights, effect forest; the scored test units keep all their columns."""
    weighted = attach_weights(table, weigh_units(table, roles, smd_limit), roles)
    return estimate_effects(weighted, roles, params, grid, interval_groups, outcome_model)


@dataclass(frozen=True)
class Reports:
    average: DataFrame
    subgroups: DataFrame
    subgroup_bars: DataFrame
    targeting: DataFrame
    targeting_area: DataFrame
    top_tenth: DataFrame
    calibration: DataFrame
    projection: DataFrame
    projection_by_covariate: DataFrame
    projection_significant: DataFrame
    classification: DataFrame


def report(found: Estimate, roles: Roles, forest: Estimator | None = None) -> Reports:
    """Every report on the scored test units."""
    scored = stage(found.scored_test, "scored")
    subgroups = subgroup_table(scored, roles.subgroups)
    ranked = rank_by_score(scored, roles.unit_id, "cate")
    curve = targeting_curve(ranked, "cate")
    area = rate_summary(curve)
    treatment, outcome = roles.treatment, roles.outcome
    wide = stage(found.preprocessor.transform(scored, keep=["cate", treatment, outcome]), "wide")
    features = found.preprocessor.features
    fit = fit_ols(wide, "cate", features)
    by_covariate = projection_by_covariate(fit.table(wide, digits=5), found.preprocessor.bases)
    vectors = found.preprocessor.assemble(wide, keep=["cate", treatment, outcome])
    classified = score_by_arm(vectors, vectors, treatment, outcome, forest or outcome_forest())
    scores = stage(classified.select(outcome, "score"), "classified")
    return Reports(
        average=average_effect(scored, "cate", by=()),
        subgroups=subgroups,
        subgroup_bars=subgroup_error_bars(subgroups),
        targeting=with_curve_band(curve, area),
        targeting_area=area,
        top_tenth=top_share_subgroups(ranked, roles.subgroups, "cate"),
        calibration=calibration_regression(calibration_bins(wide, "cate", treatment, outcome)),
        projection=fit.table(wide, digits=5),
        projection_by_covariate=by_covariate,
        projection_significant=significant_only(by_covariate),
        classification=classification_report(scores, outcome, "score"),
    )
