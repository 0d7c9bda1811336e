"""Features: lags, returns, rolling measures and windowed technical indicators, as windows of one specification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import log_ratio, ratio
from .panel import history


def lagged(df: DataFrame, lags: Mapping[str, int | Sequence[int]], entity: str = "permno", date: str = "date") -> DataFrame:
    """{c}_lag{k} for listed columns that `df` has."""
    w = history(entity, date)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c, ks in lags.items() if c in df.columns for k in ([ks] if isinstance(ks, int) else ks)})


def lead_target(df: DataFrame, c: str, entity: str = "permno", date: str = "date") -> DataFrame:
    """{c}_lead1. The last row's is NULL and stays so."""
    return df.withColumn(f"{c}_lead1", F.lead(c, 1).over(history(entity, date)))


def log_returns(df: DataFrame, columns: Sequence[str], entity: str = "permno", date: str = "date") -> DataFrame:
    w = history(entity, date)
    return df.withColumns({f"{c}_logret": log_ratio(F.col(c), F.lag(c, 1).over(w)) for c in columns})


def rolling(c: Column | str, how, rows: int, least: int | None = None, entity: str = "permno", date: str = "date") -> Column:
    """how over the last `rows` rows, NULL with fewer than `least` known values."""
    c = F.col(c) if isinstance(c, str) else c
    w = history(entity, date).rowsBetween(1 - rows, 0)
    return F.when(F.count(c).over(w) >= (rows if least is None else least), how(c).over(w))


def volatility(c: str, rows: int = 20, least: int = 10, year: int | None = 252, entity: str = "permno", date: str = "date") -> Column:
    out = rolling(c, F.stddev_samp, rows, least, entity, date)
    return out * float(year) ** 0.5 if year else out


def series_volatility(c: str, rows: int = 30, date: str = "date", year: int = 252) -> Column:
    """Realised volatility of a series with one row a date."""
    w = Window.orderBy(date).rowsBetween(1 - rows, 0)  # a date table: thousands of rows
    return F.when(F.count(c).over(w) >= rows, F.stddev_samp(c).over(w)) * float(year) ** 0.5


def beta_proxy(stock: Column, index: Column) -> Column:
    return ratio(stock, index + 1e-8)


def skew(c: str, rows: int = 63, entity: str = "permno", date: str = "date") -> Column:
    """Bias-corrected rolling skewness."""
    n = float(rows)
    return rolling(c, F.skewness, rows, rows, entity, date) * ((n * (n - 1)) ** 0.5 / (n - 2))


def kurtosis(c: str, rows: int = 63, entity: str = "permno", date: str = "date") -> Column:
    """Bias-corrected rolling excess kurtosis."""
    n = float(rows)
    return ((n + 1) * rolling(c, F.kurtosis, rows, rows, entity, date) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def windowed_indicators(df: DataFrame, open_: str = "openprc", high: str = "askhi", low: str = "bidlo", close: str = "adj_prc", vol: str = "vol", prefix: str = "ti_", entity: str = "permno", date: str = "date") -> DataFrame:
    """Indicators whose value needs no more than a fixed number of rows, by their published definitions; NULL until there are enough."""
    w = history(entity, date)
    o, h, l, c, v = map(F.col, (open_, high, low, close, vol))
    over = lambda rows: w.rowsBetween(1 - rows, 0)
    n = F.row_number().over(w)
    out = df.withColumns({"_n": n, "_tp": (h + l + c) / 3, "_mid": (h + l) / 2})
    out = out.withColumns({"_dtp": F.col("_tp") - F.lag("_tp").over(w), "_dmid": F.col("_mid") - F.lag("_mid").over(w)})
    raw = F.col("_tp") * v
    out = out.withColumns(
        {
            "_pos": F.when(F.col("_dtp") > 0, raw).otherwise(F.when(F.col("_dtp").isNotNull(), F.lit(0.0))),
            "_neg": F.when(F.col("_dtp") < 0, raw).otherwise(F.when(F.col("_dtp").isNotNull(), F.lit(0.0))),
            "_cmf": ratio(v * (c - o), h - l),
            "_eom": ratio(F.col("_dmid"), ratio(v / 1e8, h - l)),
            "_k": 100 * ratio(c - F.min(l).over(over(14)), F.max(h).over(over(14)) - F.min(l).over(over(14))),
        }
    )
    mean, sd = F.avg(c).over(over(20)), F.stddev_pop(c).over(over(20))
    pos, neg = F.sum("_pos").over(over(14)), F.sum("_neg").over(over(14))
    since = lambda best: F.col("_n") - best
    top = F.max(F.struct(h.alias("x"), F.col("_n").alias("n"))).over(over(26))["n"]
    bottom = F.min(F.struct(l.alias("x"), (-F.col("_n")).alias("n"))).over(over(26))["n"]
    enough = lambda rows, x: F.when(F.col("_n") >= rows, x)
    out = out.withColumns(
        {
            f"{prefix}bbp_20": enough(20, ratio(c - (mean - 2 * sd), 4 * sd)),
            f"{prefix}mfi_14": enough(15, 100 * ratio(pos, pos + neg)),
            f"{prefix}cmf_20": enough(20, ratio(F.sum("_cmf").over(over(20)), F.sum(v).over(over(20)))),
            f"{prefix}eom_14": enough(15, F.avg("_eom").over(over(14))),
            f"{prefix}var_21": enough(21, F.var_samp(c).over(over(21))),
            f"{prefix}stoch_14_3": enough(16, F.avg("_k").over(over(3))),
            f"{prefix}aroon_25": enough(26, 4 * (since(-bottom) - since(top)).cast("double")),
            f"{prefix}tr": F.greatest(h - l, F.abs(h - F.lag(c).over(w)), F.abs(l - F.lag(c).over(w))),
        }
    )
    return out.drop("_n", "_tp", "_mid", "_dtp", "_dmid", "_pos", "_neg", "_cmf", "_eom", "_k")
