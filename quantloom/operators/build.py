"""The joined panel in one call: entities filtered, prices cleaned, guarded joins of the side tables, gaps filled, published if it passes its checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import publish
from . import panel as P


@dataclass
class Side:
    """A table that is joined to the panel: on which of its columns ({the panel's: its own}), and which of its columns are filled forward.

    Its keys must be unique: `checked` says so in the panel's own pass, no job looks before.
    """

    table: DataFrame
    on: Mapping[str, str]
    columns: Sequence[str]


def joined(prices: DataFrame, sides: Sequence[Side], names: Sequence | DataFrame | None = None, entity: str = "permno", date: str = "date", name: str = "ticker", price: str = "prc", factors: Sequence[str] = ("cfacpr", "cfacshr")) -> DataFrame:
    """Prices of the wanted names, cleaned, with the columns of every side: left joins on unique keys, side rows of other names left out first.

    `_copies` is 1 in each row; it is more where a side repeats a key, of which one row is taken then.
    """
    out = P.among(prices, name, names) if names is not None else prices
    out = P.clean_prices(out, factors, price, entity)
    kept = out.select(name).distinct() if names is not None else None
    copies = F.lit(1)
    for i, side in enumerate(sides):
        table = side.table.select(*[F.col(c).alias(a) for a, c in side.on.items()], *side.columns)
        if name in side.on and kept is not None:
            table = P.among(table, name, kept)
        often = table.groupBy(*side.on).agg(F.count("*").alias(f"_c{i}"), *[F.first(c).alias(c) for c in side.columns])
        out = out.join(often, list(side.on), "left")
        copies = F.greatest(copies, F.coalesce(f"_c{i}", F.lit(1)))
    return out.withColumn("_copies", copies).drop(*[f"_c{i}" for i in range(len(sides))])


def build(prices: DataFrame, sides: Sequence[Side], path: str, names: Sequence | DataFrame | None = None, rules: Mapping[str, tuple[str, Column]] | None = None, entity: str = "permno", date: str = "date", name: str = "ticker", price: str = "prc", factors: Sequence[str] = ("cfacpr", "cfacshr"), sentinel: bool = True) -> list[tuple[str, str, int]]:
    """Build a joined panel and publish it at `path`; its findings.

    Columns of the sides are filled forward within an entity; those that an entity lacks altogether get a sentinel; each entity
    starts at its first row without gaps. A side that repeats a key is an error and leaves the panel unpublished, as are negative
    prices left and rows that break a rule of severity error among `rules`.
    """
    out = joined(prices, sides, names, entity, date, name, price, factors)
    out = P.forward_filled(out, [c for s in sides for c in s.columns], entity=entity, date=date, sentinel=sentinel)
    checks = {"repeated_side_key": ("error", F.col("_copies") > 1), "negative_price": ("error", F.col(price) < 0), "no_price": ("warn", F.col(price).isNull()), **(rules or {})}
    return publish(out, path, checks, drop=["_copies"])
