"""Daily portfolio weights from scores and the agreed pools.

Every allocation is a set of windows over one date's names: one exchange on the date serves them all. Weights of a side add up
to its target; then each is capped, and both sides are scaled to half again, so that a weight may pass the cap once more.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, ratio

LONG, SHORT = "agreed_long", "agreed_short"


def _day(by: Sequence[str]):
    return Window.partitionBy(*by)


def normalised(w: Column, by: Sequence[str] = ("date",), long_target: float = 0.5, short_target: float = 0.5) -> Column:
    """Positive weights over their sum times the long target, negative ones likewise; an empty side stays zero."""
    up, down = F.sum(F.when(w > 0, w)).over(_day(by)), F.sum(F.when(w < 0, -w)).over(_day(by))
    return F.when(w > 0, ratio(w, up) * long_target).when(w < 0, ratio(w, down) * short_target).otherwise(w)


def capped(df: DataFrame, w: str, most: float = 0.10, by: Sequence[str] = ("date",), targets: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Column w cut to +-most and normalised."""
    df = df.withColumn(w, clip(F.col(w), -most, most))
    return df.withColumn(w, normalised(F.col(w), by, *targets))


def _sides(up: Column, down: Column, by: Sequence[str], long_target: float, short_target: float) -> Column:
    """Two non-negative columns, known in their pools only, as shares of their sums."""
    ups, downs = F.sum(up).over(_day(by)), F.sum(down).over(_day(by))
    return F.when(F.col(LONG) & (ups > 0), ratio(up, ups) * long_target).when(F.col(SHORT) & (downs > 0), -ratio(down, downs) * short_target).otherwise(0.0)


def _proportional(x: Column, by, long_target, short_target) -> Column:
    return F.coalesce(_sides(F.when(F.col(LONG), x), F.when(F.col(SHORT), x), by, long_target, short_target), F.lit(0.0))


def equal(by=("date",), long_target=0.5, short_target=0.5) -> Column:
    return _proportional(F.lit(1.0), by, long_target, short_target)


def by_score(by=("date",), long_target=0.5, short_target=0.5) -> Column:
    return _proportional(F.abs("score"), by, long_target, short_target)


def by_quantile(by=("date",), long_target=0.5, short_target=0.5, long_share=0.20, short_share=0.20) -> Column:
    """The best share of the long pool and the worst of the short pool, each alike; thresholds are interpolated."""
    best = F.percentile(F.when(F.col(LONG), F.col("score")), 1 - long_share).over(_day(by))
    worst = F.percentile(F.when(F.col(SHORT), F.col("score")), short_share).over(_day(by))
    up, down = F.col(LONG) & (F.col("score") >= best), F.col(SHORT) & (F.col("score") <= worst)
    return F.when(up, ratio(F.lit(long_target), F.sum(F.when(up, 1.0)).over(_day(by)))).when(down, -ratio(F.lit(short_target), F.sum(F.when(down, 1.0)).over(_day(by)))).otherwise(0.0)


def by_threshold(by=("date",), long_target=1.0, short_target=0.0, share=0.60) -> Column:
    """Names of either pool that score at or over a percentile of all of the date's scores, alike and long."""
    over = (F.col(LONG) | F.col(SHORT)) & (F.col("score") >= F.percentile("score", share).over(_day(by)))
    return F.when(over, ratio(F.lit(long_target), F.sum(F.when(over, 1.0)).over(_day(by)))).otherwise(0.0)


def by_scaled_score(by=("date",), long_target=0.5, short_target=0.5) -> Column:
    return _proportional(F.abs(ratio(F.col("score"), F.col("volatility") + 1e-8)), by, long_target, short_target)


def by_inverse_volatility(by=("date",), long_target=0.5, short_target=0.5) -> Column:
    return _proportional(ratio(F.lit(1.0), F.col("volatility") + 1e-8), by, long_target, short_target)


def by_softmax(by=("date",), long_target=0.5, short_target=0.5, heat=2.0) -> Column:
    return _proportional(F.exp(heat * F.col("score")), by, long_target, short_target)


def by_kelly(by=("date",), long_target=0.5, short_target=0.5, fraction=0.25, most=0.10) -> Column:
    share = clip(fraction * ratio(F.col("expected_return"), F.col("volatility") * F.col("volatility") + 1e-8), -most, most)
    return normalised(F.coalesce(F.when(F.col(LONG) | F.col(SHORT), share), F.lit(0.0)), by, long_target, short_target)


STRATEGIES: dict[str, Callable[..., Column]] = {"A1": equal, "A2": by_score, "A3": by_quantile, "A4": by_threshold, "A5": by_scaled_score, "A7": by_inverse_volatility, "A8": by_softmax, "A9": by_kelly}
#: A9's own normalisation takes the targets; what comes before windows of windows is a column of its own.
DEFAULT = ("A1", "A2", "A3", "A4", "A5")


def allocate(df: DataFrame, names: Sequence[str] = DEFAULT, by: Sequence[str] = ("date",), most: float = 0.10, **params) -> DataFrame:
    """`df` with a weight column a strategy, named as it is. Unknown names raise; parameters that a strategy doesn't take are left out.

    by: what makes a cross-section, e.g. (scoring, date).
    """
    import inspect

    if unknown := [n for n in names if n not in STRATEGIES]:
        raise ValueError(f"unknown strategies {unknown}; there are {sorted(STRATEGIES)}")
    takes = {n: inspect.signature(STRATEGIES[n]).parameters for n in names}
    # All strategies' windows at a time: each step is one pass over a cross-section.
    df = df.withColumns({n: STRATEGIES[n](by=by, **{k: v for k, v in (params | {"most": most}).items() if k in takes[n]}) for n in names})
    df = df.withColumns({n: clip(F.col(n), -most, most) for n in names})
    return df.withColumns({n: normalised(F.col(n), by) for n in names})


def long_weights(df: DataFrame, names: Sequence[str] = DEFAULT) -> DataFrame:
    """One row an allocation: columns allocation and w."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.expr(f"stack({len(names)}, {', '.join(f'{n!r}, {n}' for n in names)}) AS (allocation, w)"))


# Maximum Sharpe


def _with_history(returns: DataFrame, asked: DataFrame, lookback: int, ridge: float, made: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """`made` of each date's rows of `asked` (date, permno, ...) and the covariances of its names, ascending, over the `lookback`
    calendar dates before it: NaN for names that no date has both of, or where the calendar lacks the date.

    A return goes to its block of `lookback` dates and to the next one, where the histories of all dates of a block are slices of one
    matrix of 2 lookback x names; neither a date's history nor its pairs of names ever are rows.
    """
    days = returns.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date")))  # thousands of dates
    block = lambda t: F.floor(F.col(t) / lookback).cast("long")
    # All columns get names of their own: both tables may come of one.
    x = returns.join(F.broadcast(days), "date").select(F.col("permno").alias("of"), F.col("t").alias("t"), F.coalesce("ret", F.lit(0.0)).alias("r"), F.explode(F.array(block("t"), block("t") + 1)).alias("block"))
    rows = asked.join(F.broadcast(days.withColumnRenamed("t", "at")), "date", "left").withColumn("block", F.coalesce(block("at"), F.lit(-1)))
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])

    def run(past: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return made(rows, np.empty((0, 0)))
        who = np.unique(rows["permno"].to_numpy())
        past = past[past["of"].isin(who)]
        first = (int(rows["block"].iloc[0]) - 1) * lookback
        i, j = np.searchsorted(who, past["of"].to_numpy()), past["t"].to_numpy() - first
        r, known = np.zeros((2 * lookback, len(who))), np.zeros((2 * lookback, len(who)))
        r[j, i], known[j, i] = past["r"].to_numpy(), 1.0
        out = []
        for _, g in rows.groupby("date"):
            own = np.searchsorted(who, np.unique(g["permno"].to_numpy()))
            at = g["at"].iloc[0] - first
            when = slice(0, 0) if np.isnan(at) else slice(int(at) - lookback, int(at))
            a, k = r[when, own], known[when, own]
            n, sums = k.T @ k, a.T @ k  # dates that both have, and the sum of the first over them
            with np.errstate(all="ignore"):
                cov = np.where(n > 1, (a.T @ a - sums * sums.T / n) / (n - 1), 0.0) + ridge * np.eye(len(own))
            out.append(made(g, np.where(n > 0, cov, np.nan)))
        return pd.concat(out)

    return x.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(run, schema)


def covariances(returns: DataFrame, names: DataFrame, lookback: int = 252, ridge: float = 1e-4) -> DataFrame:
    """(date, a, b, cov): per date the covariances of its agreed names over the `lookback` calendar dates before it, unknown returns as 0.

    returns: permno, date, ret. names: date, permno. Of two names the dates that both have count. For A6 itself see
    `max_sharpe_from_returns`, which makes no rows of pairs.
    """

    def pairs(g: pd.DataFrame, cov: np.ndarray) -> pd.DataFrame:
        who = np.unique(g["permno"].to_numpy())
        a, b = np.nonzero(~np.isnan(cov))
        return pd.DataFrame({"date": g["date"].iloc[:1].repeat(len(a)).to_numpy(), "a": who[a], "b": who[b], "cov": cov[a, b]})

    return _with_history(returns, names.select("date", "permno"), lookback, ridge, pairs, "date date, a long, b long, cov double")


def _sharpe_weights(mu: np.ndarray, side: np.ndarray, s: np.ndarray) -> np.ndarray:
    """In proportion to inv(s) (mu - lambda), lambda such that they sum to zero; without a solution equal weights of either side."""
    w = None
    if len(mu) >= 2 and np.isfinite(s).all() and np.isfinite(mu).all() and np.linalg.cond(s) < 1e12:
        inverse = np.linalg.inv(s)
        one = np.ones(len(mu))
        w = inverse @ (mu - (one @ inverse @ mu) / (one @ inverse @ one))
    return side / np.array([(side == x).sum() for x in side]) if w is None or not np.abs(w).sum() > 1e-12 else w


def _agreed(df: DataFrame) -> DataFrame:
    return df.filter(F.col(LONG) | F.col(SHORT)).select("date", "permno", F.col("expected_return").alias("mu"), F.when(F.col(LONG), 0.5).otherwise(-0.5).alias("side"))


def max_sharpe_from_returns(df: DataFrame, returns: DataFrame, most: float = 0.10, lookback: int = 252, ridge: float = 1e-4) -> DataFrame:
    """(permno, date, A6) as `max_sharpe` gives them by `covariances(returns, ...)`, solved where a date's covariances are made."""

    def solve(g: pd.DataFrame, cov: np.ndarray) -> pd.DataFrame:
        g = g.drop_duplicates("permno").sort_values("permno")
        w = _sharpe_weights(g["mu"].to_numpy(), g["side"].to_numpy(), cov)
        return pd.DataFrame({"permno": g["permno"].to_numpy(), "date": g["date"].to_numpy(), "A6": w})

    solved = _with_history(returns, _agreed(df), lookback, ridge, solve, "permno long, date date, A6 double")
    return capped(solved.withColumn("A6", normalised(F.col("A6"))), "A6", most)


def max_sharpe(df: DataFrame, cov: DataFrame, most: float = 0.10) -> DataFrame:
    """(permno, date, A6): sum-zero weights in proportion to inv(cov) (mu - lambda), lambda such that they sum to zero; capped.

    One small matrix a date in a grouped map. With fewer than two names, or a singular matrix, equal weights of either side.
    """
    rows = _agreed(df).withColumnRenamed("permno", "a").join(cov, ["date", "a"], "left")

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        names = g.drop_duplicates("a").sort_values("a")
        s = g.pivot_table(index="a", columns="b", values="cov").reindex(index=names["a"], columns=names["a"]).to_numpy()
        w = _sharpe_weights(names["mu"].to_numpy(), names["side"].to_numpy(), s)
        return pd.DataFrame({"permno": names["a"].to_numpy(), "date": names["date"].to_numpy(), "A6": w})

    solved = rows.groupBy("date").applyInPandas(solve, "permno long, date date, A6 double")
    return capped(solved.withColumn("A6", normalised(F.col("A6"))), "A6", most)
