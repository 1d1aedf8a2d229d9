"""Classification metrics without collecting scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taufold.functions.labels import binarize
from taufold.operators.rank import running_total


def threshold_metrics(df: DataFrame, label: str, score: str, cut: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1 from one pass of conditional counts.

    Precision and recall are 0 where nothing is predicted or present, as usual.
    """
    y, p = F.col(label), binarize(F.col(score), cut)
    counts = df.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve; tied scores count half.

    Labels are counted per distinct score first, so a score shared by very many
    units is one row.  The distinct scores are ranked over all tasks, and the
    running counts come from partition totals plus a window inside each
    partition's own rows.
    """
    per_score = df.groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    summed = running_total(per_score, [F.col("s")], ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return summed.agg(F.try_divide(wins, pairs).alias("roc_auc"))


def classification_report(df: DataFrame, label: str, score: str, cut: float = 0.5) -> DataFrame:
    """All five metrics as one row."""
    auc = roc_auc(df, label, score).first()["roc_auc"]
    return threshold_metrics(df, label, score, cut).withColumn("roc_auc", F.lit(auc).cast("double"))
