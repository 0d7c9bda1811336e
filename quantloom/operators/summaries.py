"""Aggregates that describe a table, and data-quality findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import FOREVER, require
from .quantiles import median


def null_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row a column: n_null, pct_null (2 places), has_nulls; one pass, then a row per column."""
    columns = list(columns or df.columns)
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    stacked = one.select("_n", F.expr(f"stack({len(columns)}, {', '.join(f'{c!r}, `{c}`' for c in columns)}) AS (column, n_null)"))
    return stacked.select("column", "n_null", F.round(100 * F.try_divide(F.col("n_null"), F.col("_n")), 2).alias("pct_null"), (F.col("n_null") > 0).alias("has_nulls"))


def distribution(df: DataFrame, c: str, edge: float = 1.0) -> DataFrame:
    """Extremes, moments and counts beyond an edge; the median by selection, in jobs of its own."""
    x, middle = F.col(c), median(df, [c])[c]
    return df.agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.lit(middle).cast("double").alias("median"), F.stddev_samp(x).alias("std"), F.count_if(x < -edge).alias("n_below"), F.count_if(x > edge).alias("n_above"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Counts and percents of up and down among known targets."""
    g = df.filter(F.col(target).isNotNull()).groupBy((F.col(target) > 0).cast("int").alias("label")).agg(F.count("*").alias("n"))
    return g.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # two rows


def agreement(df: DataFrame) -> DataFrame:
    flags = ("agreed_long", "agreed_short", "agreed_any", "disagreed")
    return df.agg(*[f(F.col(c).cast("int")).alias(f"{c}_{n}") for c in flags for n, f in (("count", F.sum), ("rate", F.avg))])


def by_side(df: DataFrame) -> DataFrame:
    side = F.when(F.col("agreed_long"), "long").when(F.col("agreed_short"), "short").otherwise("none")
    return df.groupBy(side.alias("side")).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in ("prob_up", "expected_return", "ensemble_score")])


def value_counts(df: DataFrame, c: str, k: int = 5) -> DataFrame:
    return df.groupBy(F.lower(c).alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(k)


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])


def latest_start(df: DataFrame, entity: str = "permno", date: str = "date") -> DataFrame:
    return df.groupBy(entity).agg(F.min(date).alias("first")).agg(F.max("first").alias("latest_first"))


def histogram(df: DataFrame, c: str, bins: int = 30) -> DataFrame:
    """Counts of equal-width bins, the last closed."""
    edges = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    x = df.filter(F.col(c).isNotNull()).crossJoin(F.broadcast(edges))  # one row
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col(c) - F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins), F.lit(0.0))), F.lit(bins - 1))
    return x.groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def run_summary(df: DataFrame, entity: str = "permno", date: str = "date") -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(entity).alias("n_entities"), F.count_distinct(date).alias("n_dates"), F.min(date).alias("first_date"), F.max(date).alias("last_date")).withColumn("n_columns", F.lit(len(df.columns)))


def sharpe_matrix(results: DataFrame, scorings: Sequence[str]) -> DataFrame:
    return results.groupBy("allocation").pivot("scoring", list(scorings)).agg(F.first("sharpe"))


def best_per(df: DataFrame, by: str, error: str) -> DataFrame:
    return df.groupBy(by).agg(F.min(error).alias("best"))


# Findings: rule, severity, n


def findings(df: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """One pass: a row a rule with the number of offending rows."""
    one = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(rule) for rule, (_, bad) in rules.items()])
    stack = ", ".join(f"'{rule}', '{severity}', `{rule}`" for rule, (severity, _) in rules.items())
    return one.select(F.expr(f"stack({len(rules)}, {stack}) AS (rule, severity, n)"))


def raise_errors(found: DataFrame) -> DataFrame:
    """`found`, unless a rule of severity error has offenders."""
    if bad := found.filter("severity = 'error' AND n > 0").take(1):
        raise ValueError(f"{bad[0].rule}: {bad[0].n} rows")
    return found


def repeated_keys(df: DataFrame, keys: Sequence[str], rule: str = "repeated_key", severity: str = "error") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("_c")).agg(F.count_if(F.col("_c") > 1).alias("n")).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n")


def price_findings(df: DataFrame, keys: Sequence[str], factors: Sequence[str], price: str) -> DataFrame:
    rules = {f"negative_{c}": ("error", F.col(c) < 0) for c in factors} | {f"zero_{c}": ("warn", F.col(c) == 0) for c in factors} | {"negative_price": ("warn", F.col(price) < 0)}
    return findings(df, rules).unionByName(repeated_keys(df, keys))


def overlaps(df: DataFrame, key: str, start: str, end: str, *ties: str) -> DataFrame:
    """`df` with overlap: whether the key's next interval starts before this one has ended."""
    w = Window.partitionBy(key).orderBy(start, *ties)
    return df.withColumn("overlap", F.coalesce(F.lead(start).over(w) <= F.coalesce(end, F.lit(FOREVER).cast("date")), F.lit(False)))


def interval_findings(df: DataFrame, key: str, start: str, end: str, *ties: str) -> DataFrame:
    return findings(overlaps(df, key, start, end, *ties), {"start_after_end": ("error", F.col(start) > F.col(end)), "overlap": ("warn", F.col("overlap"))})


def factor_findings(df: DataFrame, columns: Sequence[str], rf: str | None = None, most: float = 0.5, most_rf: float = 0.05) -> DataFrame:
    """Checks of daily factors, one row a date: columns that must be there, unknown, infinite and overly large values, repeated dates."""
    every = [*columns, *([rf] if rf else [])]
    require(df, ["date", *every], "factors")
    infinite = lambda c: F.abs(c) == F.lit(float("inf"))
    rules = {f"missing_{c}": ("warn", F.col(c).isNull() | F.isnan(c)) for c in columns} | {f"infinite_{c}": ("warn", infinite(c)) for c in every} | {f"large_{c}": ("warn", F.abs(c) > most) for c in columns}
    if rf:
        rules["large_rf"] = ("warn", F.abs(rf) > most_rf)
    return findings(df, rules).unionByName(repeated_keys(df, ["date"]))


#: Columns that estimates and actuals must have (fixed values).
CONSENSUS = ("official_ticker", "stat_date", "periodicity", "fpi", "n_analysts", "cons_mean")
ACTUALS = ("oftic", "anndats", "pdicity", "act_measure", "act_value", "usfirm")


def consensus_findings(df: DataFrame) -> DataFrame:
    """Checks of consensus snapshots: columns that must be there, and keys of several rows, to be thinned out before a join."""
    return repeated_keys(require(df, CONSENSUS, "consensus"), ["official_ticker", "stat_date"], "multi_row_key", "info")


def actuals_findings(df: DataFrame) -> DataFrame:
    """The same of reported actuals."""
    return repeated_keys(require(df, ACTUALS, "actuals"), ["oftic", "anndats"], "multi_row_key", "info")


def coverage(df: DataFrame, entity: str = "permno", date: str = "date") -> DataFrame:
    """Whether all entities have the same number of rows, first and last date."""
    per = df.groupBy(entity).agg(F.count("*").alias("n"), F.min(date).alias("lo"), F.max(date).alias("hi"))
    return per.agg(F.count("*").alias("n_entities"), F.count_distinct("n", "lo", "hi").alias("n_shapes")).withColumn("equal", F.col("n_shapes") <= 1)
