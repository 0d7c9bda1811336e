"""From a model matrix to trades: both models tuned over rolling folds, refitted, evaluated, backtested, and the best pair's trades."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import backtest as B
from . import models as M
from .features import volatility
from .panel import cross_section_filled
from .signals import signals

#: The published grids.
LOGISTIC = {"C": (0.1, 0.5, 1.0), "l1_ratio": (0.8, 0.9)}
LINEAR = {"alpha": (5e-6, 5e-5, 5e-4, 1e-6, 1e-5, 1e-4), "l1_ratio": (0.4, 0.5, 0.6)}


@dataclass
class Tuned:
    """The error of each setting over the folds, the best setting, and the model refitted with it on all rows it was tuned on."""

    found: list[dict]
    best: dict
    model: M.Fitted

    def per_ratio(self) -> list[dict]:
        """Of each l1_ratio the setting of least error, ties to the earlier one."""
        return [M.best_setting([x for x in self.found if x["l1_ratio"] == r]) for r in sorted({x["l1_ratio"] for x in self.found})]


def tuned(rows: DataFrame, features: Sequence[str], target: str, grid: Mapping[str, Sequence[float]], logistic: bool, folds: int = 10) -> Tuned:
    """Grid search over rolling folds of the rows' dates, then a fit of the best setting on all rows."""
    geometry = M.fold_geometry(M.calendar(rows).count(), folds)
    found = M.grid_search(rows, M.fold_dates(rows, geometry), features, target, dict(grid), logistic)
    best = M.best_setting(found)
    fit = M.fit_logistic if logistic else M.fit_linear
    return Tuned(found, best, fit(rows, features, target, **{k: best[k] for k in grid}))


@dataclass
class Outcome:
    """What a run comes to: both models, their scores, evaluations out of sample, metrics by pair and side, the pair chosen in sample, and its trades."""

    up: Tuned
    mean: Tuned
    scored: DataFrame
    classification: DataFrame
    regression: DataFrame
    metrics: DataFrame
    scoring: str
    allocation: str
    trades: DataFrame


def fit_to_trades(matrix: DataFrame, features: Sequence[str], ret: str, target: str, logistic: Mapping[str, Sequence[float]] = LOGISTIC, linear: Mapping[str, Sequence[float]] = LINEAR, share: float = 0.65, folds: int = 10, most: float = 0.05) -> Outcome:
    """The whole run over a model matrix (permno, date, features, ret, and target, the next day's return).

    The first `share` of the dates tunes and fits; the rest evaluates. Every scoring and allocation is backtested; the pair of the
    greatest Sharpe ratio in sample is chosen, ties to the earlier one, and gives the trades of the date after the last. Rows with
    a missing feature have no scores; a matrix whose models agree on no name has no trades. The matrix and its scores are stored
    once each; what reaches the driver is models and a row a pair.
    """
    rows = stored(M.split(matrix, share))
    inside = rows.filter("in_sample")
    up, mean = tuned(inside, features, target, logistic, True, folds), tuned(inside, features, target, linear, False, folds)
    out = rows.withColumn("volatility", volatility(ret, 20, 5, None))
    out = signals(mean.model.scored(up.model.scored(out, "prob_up"), "expected_return"))
    known = cross_section_filled(out.filter(F.col("prob_up").isNotNull() & F.col("expected_return").isNotNull()), "volatility")
    scored = stored(known.withColumn("target", F.col(target)))
    outside = scored.filter(~F.col("in_sample") & F.col("target").isNotNull())
    called = outside.select((F.col("target") > 0).cast("int").alias("label"), (F.col("prob_up") > 0.5).cast("int").alias("called"))
    level = inside.agg(F.avg(target)).first()[0]
    metrics = stored(B.metrics(B.sides(B.portfolio_returns(B.grid_weights(scored)), share), (*B.COMBO, "in_sample")))
    best = B.chosen(metrics.filter("in_sample").drop("in_sample")).first()
    trades = B.next_day(rows, up.model, mean.model, best["scoring"], best["allocation"], ret, most)
    return Outcome(
        up, mean, scored,
        M.classification_report(called, "label", "called"), M.regression_report(outside.withColumn("_level", F.lit(level)), "target", "expected_return", "_level"),
        metrics, best["scoring"], best["allocation"], trades,
    )
