"""Portfolio returns, performance metrics, choices and reports, for all (scoring, allocation) pairs in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.numeric import ratio
from ..sources.tables import stored
from . import allocate as A
from .features import volatility
from .panel import latest
from .signals import SCORES, long_scores, scores, signals

COMBO = ("scoring", "allocation")


def grid_weights(df: DataFrame, names: Sequence[str] = A.DEFAULT, **params) -> DataFrame:
    """Weights of every scoring and allocation: scoring, allocation, date, permno, w and the columns of `df`."""
    return A.long_weights(A.allocate(long_scores(scores(df)), names, by=("scoring", "date"), **params), names)


def portfolio_returns(weights: DataFrame, ret: str = "target", by: Sequence[str] = COMBO) -> DataFrame:
    """Per date the sum of weight times next-day return; unknown products count as nothing."""
    return weights.groupBy(*by, "date").agg(F.coalesce(F.sum(F.col("w") * F.col(ret)), F.lit(0.0)).alias("port_ret"))


def user_weights(df: DataFrame, weigh: Callable[[pd.DataFrame], Sequence[float]], by: Sequence[str] = ("scoring", "date")) -> DataFrame:
    """`df` with w and error: weights of a user's function, which gets a cross-section (the rows of equal keys, by permno) and returns a number a row.

    Where it raises, or returns something else, or a number that isn't finite, all weights of the cross-section are 0 and error says
    why; other cross-sections go on. A cross-section is a date's entities: it fits a task.
    """
    schema = StructType([*df.schema.fields, StructField("w", DoubleType()), StructField("error", StringType())])

    def weighed(rows: pd.DataFrame) -> tuple[np.ndarray, str | None]:
        try:
            w = np.array([float(x) for x in weigh(rows.reset_index(drop=True))])
            if w.shape != (len(rows),) or not np.isfinite(w).all():
                raise ValueError(f"{len(rows)} finite weights are wanted, not {w.tolist()[:5]}")
            return w, None
        except Exception as e:  # whatever a user's function raises is a result
            return np.zeros(len(rows)), f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cross-sections stream by in order; the last one of a batch may go on in the next."""
        held: list[pd.DataFrame] = []

        def done(rows: pd.DataFrame, ends: np.ndarray) -> pd.DataFrame:
            found = [weighed(rows.iloc[a:b]) for a, b in zip([0, *ends], ends)]
            errors = np.repeat(np.array([e for _, e in found], object), np.diff(ends, prepend=0))
            return rows.assign(w=np.concatenate([w for w, _ in found]), error=errors)

        for batch in batches:
            if not len(batch):
                continue
            rows = pd.concat([*held, batch], ignore_index=True)
            new = np.zeros(len(rows), bool)
            for k in by:
                a, b = rows[k].to_numpy()[1:], rows[k].to_numpy()[:-1]
                new[1:] |= (a != b) & ~(pd.isna(a) & pd.isna(b))
            cuts = np.flatnonzero(new)
            last = int(cuts[-1]) if len(cuts) else 0
            held = [rows.iloc[last:]]
            if last:
                yield done(rows.iloc[:last], cuts)
        if held:
            yield done(held[0].reset_index(drop=True), np.array([len(held[0])]))

    return df.repartition(*by).sortWithinPartitions(*by, "permno").mapInPandas(run, schema)


def user_backtest(df: DataFrame, weigh: Callable[[pd.DataFrame], Sequence[float]], name: str, by: Sequence[str] = ("scoring", "date")) -> tuple[DataFrame, DataFrame]:
    """(weights, errors) of a user's allocation over all scorings: weights as grid_weights has them, and a row a failed cross-section with its error.

    The function runs once a cross-section; its weights are stored for both.
    """
    rows = stored(user_weights(long_scores(scores(df)), weigh, by).withColumn("allocation", F.lit(name)))
    errors = rows.filter(F.col("error").isNotNull()).groupBy(*by, "allocation").agg(F.max("error").alias("error"), F.count("*").alias("n"))
    return rows.drop("error"), errors


def positions(weights: DataFrame, by: Sequence[str] = COMBO) -> DataFrame:
    """n_trades (weights other than 0) and avg_n_positions per date."""
    per_day = weights.groupBy(*by, "date").agg(F.count_if(F.col("w") != 0).alias("n"))
    return per_day.groupBy(*by).agg(F.sum("n").alias("n_trades"), F.avg("n").alias("avg_n_positions"))


def equity(returns: DataFrame, by: Sequence[str] = COMBO, capital: float = 1.0) -> DataFrame:
    """equity_log: capital times exp of the running sum; equity_simple: running product of 1 + return; drawdown of the former from its running maximum."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumns({"equity_log": capital * F.exp(F.sum("port_ret").over(w)), "equity_simple": F.product(1 + F.col("port_ret")).over(w)})
    top = F.max("equity_log").over(w)
    return out.withColumn("drawdown", ratio(F.col("equity_log") - top, top))


def metrics(returns: DataFrame, by: Sequence[str] = COMBO, rf: float = 0.0, year: int = 252) -> DataFrame:
    """Performance per pair, shares in percent; ratios are 0 where their divisor isn't positive."""
    r, root = F.col("port_ret"), float(year) ** 0.5
    g = equity(returns, by).groupBy(*by).agg(
        F.count("*").alias("n_periods"),
        F.avg(r).alias("_mean"),
        F.stddev_samp(r).alias("_sd"),
        F.sum(r).alias("_sum"),
        F.min("drawdown").alias("_dd"),
        F.avg((r > 0).cast("double")).alias("_win"),
        F.stddev_samp(F.when(r < 0, r)).alias("_down"),
    )
    ann = F.col("_mean") * year
    over = lambda x: F.coalesce(F.when(x > 0, (ann - rf) / F.nullif(x, F.lit(0.0))), F.lit(0.0))
    return g.select(
        *by,
        "n_periods",
        (100 * (F.exp("_sum") - 1)).alias("total_return"),
        (100 * ann).alias("ann_return"),
        (100 * F.col("_sd") * root).alias("ann_vol"),
        over(F.col("_sd") * root).alias("sharpe"),
        over(F.col("_down") * root).alias("sortino"),
        F.coalesce(F.when(F.col("_dd") < 0, ratio(ann, F.abs("_dd"))), F.lit(0.0)).alias("calmar"),
        (100 * F.col("_dd")).alias("max_drawdown"),
        (100 * F.col("_win")).alias("win_rate"),
        (100 * F.col("_mean")).alias("avg_daily_ret"),
        (100 * F.col("_sd")).alias("daily_vol"),
    )


def results(weights: DataFrame, ret: str = "target") -> DataFrame:
    """Metrics with counts of trades and positions: the table of a grid."""
    return metrics(portfolio_returns(weights, ret)).join(positions(weights), list(COMBO))


def ordered(df: DataFrame, names: Sequence[str] = A.DEFAULT) -> DataFrame:
    """combo_order: scoring outer, allocation inner, as ties are broken."""
    rank = lambda c, values: F.array_position(F.array(*map(F.lit, values)), F.col(c))
    return df.withColumn("combo_order", ((rank("scoring", SCORES) - 1) * len(names) + rank("allocation", names) - 1).cast("long"))


def chosen(table: DataFrame, how: str = "best", k: int = 5, names: Sequence[str] = A.DEFAULT) -> DataFrame:
    """The pairs of greatest in-sample Sharpe ratio: best, top (k) or all."""
    if how == "all":
        return table.select(*COMBO)
    # Scores that differ in scale alone make equal weights: what differs beyond the ninth place is noise.
    return ordered(table, names).orderBy(F.round("sharpe", 9).desc(), "combo_order").limit(1 if how == "best" else k).select(*COMBO)


def sides(returns: DataFrame, share: float = 0.65, by: Sequence[str] = COMBO) -> DataFrame:
    """in_sample per row: the first int(dates x share) dates of each pair. Pairs of one grid have the same dates, those of its calendar."""
    w = Window.partitionBy(*by)
    return returns.withColumn("in_sample", F.row_number().over(w.orderBy("date")) <= F.floor(F.count("*").over(w) * share))


def out_of_sample(table: DataFrame, how: str = "best", k: int = 5, names: Sequence[str] = A.DEFAULT) -> DataFrame:
    """Of the metrics of both sides (a row a pair and in_sample), those out of sample of the pairs chosen in sample."""
    inside = F.max(F.when(F.col("in_sample"), F.round("sharpe", 9))).over(Window.partitionBy(*COMBO))
    rows = ordered(table.withColumn("_is", inside), names).filter("NOT in_sample AND _is IS NOT NULL")
    if how != "all":
        order = Window.orderBy(F.col("_is").desc(), "combo_order")  # a row a pair
        rows = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= (1 if how == "best" else k)).drop("_n")
    return rows.drop("_is", "combo_order", "in_sample")


def degradation(table: DataFrame) -> DataFrame:
    """In-sample against out-of-sample metrics (a row a pair and in_sample): percent lost of Sharpe, return and volatility, and what to think of it."""
    cols = ("sharpe", "ann_return", "ann_vol")
    one = lambda c, inside: F.max(F.when(F.col("in_sample") == inside, F.col(c)))
    out = table.groupBy(*COMBO).agg(*[one(c, inside).alias(f"{p}_{c}") for c in cols for p, inside in (("is", True), ("oos", False))])
    out = out.filter("is_sharpe IS NOT NULL AND oos_sharpe IS NOT NULL")
    loss = lambda c: 100 * ratio(F.col(f"is_{c}") - F.col(f"oos_{c}"), F.abs(F.col(f"is_{c}")))
    out = out.withColumns({f"{c}_degradation": loss(c) for c in cols})
    d = F.col("sharpe_degradation")
    return out.withColumn("assessment", F.when(d < 15, "excellent").when(d < 30, "good").when(d < 50, "moderate").otherwise("severe"))


def monthly(returns: DataFrame, r: str, by: Sequence[str] = COMBO) -> DataFrame:
    """Compounded simple returns per calendar month, dated at its end; months without rows have none."""
    return returns.groupBy(*by, F.last_day("date").alias("date")).agg((F.product(1 + F.col(r)) - 1).alias(r))


def report(returns: DataFrame, factors: DataFrame, freq: str = "daily", by: Sequence[str] = COMBO, days: DataFrame | None = None) -> DataFrame:
    """Simple returns of the equity curve beside the riskless rate and the benchmark (mktrf + rf) of their dates, and the excess.

    factors: date, mktrf, rf; gaps are filled forward, then backward, over the dates from the second on: once for all strategies,
    on a table of a row a date. days: the dates of `returns`, where they can be had for less than `returns` itself.
    """
    w, once = Window.partitionBy(*by).orderBy("date"), Window.orderBy("date")  # thousands of dates
    simple = equity(returns, by).withColumn("strategy", ratio(F.col("equity_simple"), F.lag("equity_simple").over(w)) - 1)
    simple = simple.withColumn("_first", F.row_number().over(w)).filter("_first > 1").select(*by, "date", "strategy")
    known = (returns if days is None else days).select("date").distinct().withColumn("_n", F.row_number().over(once)).filter("_n > 1").drop("_n")
    known = known.join(factors.groupBy("date").agg(F.avg("mktrf").alias("mktrf"), F.avg("rf").alias("rf")), "date", "left")
    past, ahead = once.rowsBetween(Window.unboundedPreceding, 0), once.rowsBetween(0, Window.unboundedFollowing)
    known = known.withColumns({c: F.coalesce(F.last(c, True).over(past), F.first(c, True).over(ahead)) for c in ("mktrf", "rf")})
    joined = simple.join(F.broadcast(known), "date", "left")
    out = joined.withColumn("benchmark", F.col("mktrf") + F.col("rf")).select(*by, "date", "strategy", "rf", "benchmark")
    if freq == "monthly":
        out = out.groupBy(*by, F.last_day("date").alias("date")).agg(*[(F.product(1 + F.col(c)) - 1).alias(c) for c in ("strategy", "rf", "benchmark")])
    return out.withColumn("excess", F.col("strategy") - F.col("rf")).withColumn("freq", F.lit(freq))


def scenarios(trades: DataFrame, sd: float = 0.015) -> DataFrame:
    """Expected portfolio return, its volatility and 95 percent band; zeros without trades."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    out = trades.agg(z(F.sum(F.col("weight") * F.col("expected_return"))).alias("expected"), (z(F.sqrt(F.sum(F.col("weight") * F.col("weight")))) * sd).alias("volatility"))
    return out.withColumns({"pessimistic": F.col("expected") - 1.96 * F.col("volatility"), "optimistic": F.col("expected") + 1.96 * F.col("volatility")})


def trade_list(weighted: DataFrame) -> DataFrame:
    """Non-zero weights of the latest date with action and conviction (columns permno, date, prob_up, expected_return, score, w)."""
    last = weighted.join(F.broadcast(weighted.agg(F.max("date").alias("date"))), "date", "left_semi").filter("w <> 0")  # one row
    return last.select("permno", "prob_up", "expected_return", F.col("w").alias("weight"), F.abs("score").alias("conviction"), F.when(F.col("w") > 0, "BUY").otherwise("SELL-SHORT").alias("action"))


def next_day(matrix: DataFrame, up, mean, scoring: str, allocation: str, ret: str = "adj_prc_logret", most: float = 0.05, **params) -> DataFrame:
    """Trades for the date after a model matrix's last: both fitted models over the latest slice, signals, the chosen strategy's weights.

    matrix: permno, date, the models' features and `ret`, whose deviation over an entity's last 20 rows is its volatility. A row a
    trade: permno, prob_up, expected_return, weight, conviction, action; none if the models agree on no name.
    """
    recent = matrix.withColumn("volatility", volatility(ret, 20, 20, None))
    rows = signals(mean.scored(up.scored(latest(recent), "prob_up"), "expected_return"))
    return trade_list(grid_weights(rows, (allocation,), most=most, **params).filter(F.col("scoring") == scoring))
