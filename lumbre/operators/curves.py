"""Threshold analysis of a binary classifier's scores: ROC curve, area under it, F-measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.operators.ordered import in_segments, running_totals
from lumbre.sources.frames import small_frame


def _confusion(scored: DataFrame) -> tuple[DataFrame, int, int]:
    """``score, p, n, tp, fp`` by descending score, and the totals of positives and negatives.

    Rows are first counted per distinct score.  If scores are continuous that is as many rows as the input, so the
    running counts are computed in segments.
    """
    positive = F.count(F.when(F.col("label") > 0.5, 1))
    per_score = scored.groupBy("score").agg(positive.alias("p"), (F.count(F.lit(1)) - positive).alias("n"))
    order = [F.desc("score")]
    placed = in_segments(per_score, order)
    totals = placed.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    counted = running_totals(placed, order, {"tp": ("sum", F.col("p")), "fp": ("sum", F.col("n"))})
    return counted, totals.p, totals.n


def _f_measure(positives: int) -> Column:
    """Harmonic mean of precision and recall, as one division."""
    return 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.lit(positives))


def area_under_roc(scored: DataFrame) -> DataFrame:
    """One row ``positives, negatives, auc`` from ``label, score``; null without both classes."""
    return summary(scored).select("positives", "negatives", "auc")


def roc_curve(scored: DataFrame) -> DataFrame:
    """``threshold, fpr, tpr`` per distinct score, between the fixed ends (0, 0) and (1, 1).

    The ends have no threshold.
    """
    counted, positives, negatives = _confusion(scored)

    def share(count: str, total: int):
        return F.col(count) / F.lit(float(total)) if total else F.lit(0.0)

    points = counted.select(
        F.col("score").cast("double").alias("threshold"),
        share("fp", negatives).alias("fpr"),
        share("tp", positives).alias("tpr"),
    )
    ends = small_frame(
        scored.sparkSession, "threshold double, fpr double, tpr double", [(None, 0.0, 0.0), (None, 1.0, 1.0)]
    )
    return points.unionByName(ends)


def f_measures(scored: DataFrame) -> DataFrame:
    """``threshold, f_measure`` when every score at or above the threshold is predicted positive."""
    counted, positives, _ = _confusion(scored)
    return counted.select(F.col("score").cast("double").alias("threshold"), _f_measure(positives).alias("f_measure"))


def best_threshold(scored: DataFrame) -> DataFrame:
    """The threshold with the highest F-measure; of equal ones the highest threshold."""
    return summary(scored).select("threshold", "f_measure")


def summary(scored: DataFrame) -> DataFrame:
    """One row ``positives, negatives, auc, threshold, f_measure``, all from one pass over the running counts."""
    counted, positives, negatives = _confusion(scored)
    # trapezoids: a group of equal scores moves right by n and up by p
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    pairs = float(positives) * float(negatives)
    best = F.max(F.struct(_f_measure(positives).alias("f_measure"), F.col("score").cast("double").alias("threshold")))
    return counted.agg(
        F.lit(positives).cast("long").alias("positives"),
        F.lit(negatives).cast("long").alias("negatives"),
        (area / pairs if pairs else F.lit(None).cast("double")).alias("auc"),
        best.alias("best"),
    ).select("positives", "negatives", "auc", "best.threshold", "best.f_measure")
