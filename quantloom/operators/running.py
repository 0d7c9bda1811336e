"""Running aggregates from the start of a history, in two levels, so that no entity's rows are one task.

A window from the start of an entity puts the entity into one task. Here its days are cut into blocks: a row a block says what
the block comes to, a window over these rows what came before each block, and a window inside the block the rest. Blocks are
tasks' groups; an entity with all rows of a table is spread over as many groups as it has blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio

#: Of each kind: the aggregate, and how what came before and what a block has so far are put together.
KINDS = {
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "sum": (F.sum, lambda before, own: F.coalesce(before + own, own, before)),
    "product": (F.product, lambda before, own: F.coalesce(before * own, own, before)),
}


def running(df: DataFrame, columns: Mapping[str, tuple[str, Column]], by: Sequence[str] = ("permno",), date: str = "date", block_days: int = 366) -> DataFrame:
    """`df` with {name: (kind, value)}: a kind of KINDS of the value over all rows of the keys up to each row's, missing values left out.

    The keys and the date must tell rows apart. `df` is read twice: store what is costly to make.
    """
    if unknown := {k for k, _ in columns.values()} - set(KINDS):
        raise ValueError(f"unknown kinds {sorted(unknown)}; there are {sorted(KINDS)}")
    rows = df.withColumn("_block", F.floor(F.unix_date(F.to_date(date)) / block_days)).withColumns({f"_v{i}": v for i, (_, v) in enumerate(columns.values())})
    inside = Window.partitionBy(*by, "_block").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    kinds = [k for k, _ in columns.values()]
    whole = [F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.col(date))) if k == "last" else KINDS[k][0](f"_v{i}") for i, k in enumerate(kinds)]
    blocks = rows.groupBy(*by, "_block").agg(*[x.alias(f"_b{i}") for i, x in enumerate(whole)])  # a row a block
    blocks = blocks.select(*by, "_block", *[KINDS[k][0](f"_b{i}").over(earlier).alias(f"_p{i}") for i, k in enumerate(kinds)])
    side = blocks.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_block").alias("_of"), *[f"_p{i}" for i in range(len(kinds))])
    same = F.col("_block") == F.col("_of")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = rows.withColumns({f"_o{i}": KINDS[k][0](f"_v{i}").over(inside) for i, k in enumerate(kinds)}).join(side, same)
    return out.select(*df.columns, *[KINDS[k][1](F.col(f"_p{i}"), F.col(f"_o{i}")).alias(n) for i, (n, (k, _)) in enumerate(columns.items())])


def filled_forward_in_blocks(df: DataFrame, columns: Sequence[str], entity: str = "permno", date: str = "date", block_days: int = 366) -> DataFrame:
    """`df` with gaps of columns filled from before."""
    out = running(df, {f"_f{i}": ("last", F.col(c)) for i, c in enumerate(columns)}, (entity,), date, block_days)
    return out.withColumns({c: F.col(f"_f{i}") for i, c in enumerate(columns)}).select(df.columns)


def from_first_complete_in_blocks(df: DataFrame, columns: Sequence[str], entity: str = "permno", date: str = "date", block_days: int = 366) -> DataFrame:
    """Each entity from its first row without any NULL on."""
    complete = F.lit(1)
    for c in columns:
        complete = F.when(F.col(c).isNull(), 0).otherwise(complete)
    return running(df, {"_on": ("max", complete)}, (entity,), date, block_days).filter("_on = 1").drop("_on")


def equity_in_blocks(returns: DataFrame, by: Sequence[str] = ("scoring", "allocation"), capital: float = 1.0, block_days: int = 366) -> DataFrame:
    """equity_log, equity_simple and drawdown of returns, as backtest.equity has them."""
    r = F.col("port_ret")
    out = running(returns, {"_sum": ("sum", r), "equity_simple": ("product", 1 + r)}, by, "date", block_days)
    out = running(out, {"_top": ("max", F.col("_sum"))}, by, "date", block_days)
    level, top = capital * F.exp("_sum"), capital * F.exp("_top")
    return out.select(*returns.columns, level.alias("equity_log"), "equity_simple", ratio(level - top, top).alias("drawdown"))
