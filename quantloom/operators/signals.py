"""Signals and scores from the two models' outputs: prob_up and expected_return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORES = ("S1", "S2", "S6")


def signals(df: DataFrame, p: float = 0.55, mu: float = 0.001) -> DataFrame:
    """Each model's long and short signals (strict), their agreement, and the ensemble score (0 where they disagree)."""
    prob, ret = F.col("prob_up"), F.col("expected_return")
    df = df.withColumns(
        {
            "prob_down": 1 - prob,
            "logistic_score": 2 * prob - 1,
            "logistic_signal_long": prob > p,
            "logistic_signal_short": prob < F.lit(1) - p,
            "linear_signal_long": ret > mu,
            "linear_signal_short": ret < -mu,
        }
    )
    df = df.withColumns({"agreed_long": F.col("logistic_signal_long") & F.col("linear_signal_long"), "agreed_short": F.col("logistic_signal_short") & F.col("linear_signal_short")})
    df = df.withColumn("agreed_any", F.col("agreed_long") | F.col("agreed_short")).withColumn("disagreed", ~F.col("agreed_any"))
    return df.withColumn("ensemble_score", F.when(F.col("disagreed"), 0.0).otherwise(F.col("logistic_score")))


def scores(df: DataFrame) -> DataFrame:
    prob, ret = F.col("prob_up"), F.col("expected_return")
    return df.withColumns({"score_S1": prob * ret, "score_S2": (prob - 0.5) * ret, "score_S6": (2 * prob - 1) * F.abs(ret)})


def long_scores(df: DataFrame) -> DataFrame:
    """One row a scoring: columns scoring and score in place of the three scores."""
    stacked = ", ".join(f"'{s}', score_{s}" for s in SCORES)
    rest = [c for c in df.columns if not c.startswith("score_")]
    return df.select(*rest, F.expr(f"stack({len(SCORES)}, {stacked}) AS (scoring, score)"))
