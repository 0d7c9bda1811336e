"""Exact quantiles of whole columns, without a sort of them and without an aggregate that holds them.

Selection by shrinking brackets: a bounded sketch names two values around the wanted ranks, a count of what lies below, on and
between them tells what they hold, and the next sketch looks between them alone, until few values are left there. The sketch
only says where to look; ranks are counted, so results are exact. Brackets of all columns and quantiles shrink in the same jobs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class _Bracket:
    """Values a <= b with the number of values below a, on a and between them, around the value of a rank."""

    x: Column
    rank: int
    a: float
    b: float
    below: int
    on_a: int
    between: int

    @property
    def open(self) -> bool:
        return 0 <= self.rank - self.below - self.on_a < self.between

    def inside(self) -> Column:
        return F.when((self.x > self.a) & (self.x < self.b), self.x)

    def holds(self) -> bool:
        """Whether the rank's value is a, b or between them."""
        k = self.rank - self.below
        return 0 <= k < self.on_a if self.a == self.b else 0 <= k <= self.on_a + self.between

    def value(self, between: Sequence[float]) -> float:
        k = self.rank - self.below
        return self.a if k < self.on_a else between[k - self.on_a] if k < self.on_a + self.between else self.b


def quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], most: int = 20_000, accuracy: int = 10_000, rounds: int = 100) -> dict[str, list[float | None]]:
    """Of each column the quantiles asked for, interpolated between neighbours; None of a column without values. NaN counts as missing.

    `most` values of a bracket at most are gathered at last; it should be no less than `accuracy`, or brackets shrink slowly. A round is two jobs of an aggregate row; a thousand million values
    take two rounds at the default accuracy.
    """
    xs = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in wanted}
    if not xs:
        return {}
    first = df.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(xs.values()) for n, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
    places = [(i, c, p) for i, c in enumerate(wanted) for p in wanted[c]]
    if bad := [p for _, _, p in places if not 0 <= p <= 1]:
        raise ValueError(f"quantiles lie between 0 and 1, not {bad}")
    at = {(c, p): p * (first[f"n{i}"] - 1) for i, c, p in places if first[f"n{i}"]}
    brackets = {(c, k): _Bracket(xs[c], k, first[f"a{i}"], first[f"b{i}"], 0, 0, 0) for i, c, p in places if (c, p) in at for k in (floor(at[c, p]), ceil(at[c, p]))}

    def count(of: dict) -> dict:
        row = df.agg(*[F.count_if(test(b)).alias(f"{n}{i}") for i, b in enumerate(of.values()) for n, test in (("l", lambda b: b.x < b.a), ("e", lambda b: b.x == b.a), ("m", lambda b: (b.x > b.a) & (b.x < b.b)))]).first()
        return {k: _Bracket(b.x, b.rank, b.a, b.b, row[f"l{i}"], row[f"e{i}"], row[f"m{i}"]) for i, (k, b) in enumerate(of.items())}

    brackets = count(brackets) if brackets else {}
    slack = dict.fromkeys(brackets, 4 / accuracy)  # how far a sketch of merged parts may be off
    for _ in range(rounds):
        wide = {k: b for k, b in brackets.items() if b.open and b.between > most}
        if not wide:
            break
        share = lambda key, b, d: min(max((b.rank - b.below - b.on_a + d) / b.between + d * slack[key], 0.0), 1.0)
        sketch = df.agg(*[F.percentile_approx(b.inside(), [share(k, b, -1), share(k, b, 1)], accuracy).alias(f"s{i}") for i, (k, b) in enumerate(wide.items())]).first()
        narrow = count({k: _Bracket(b.x, b.rank, *sketch[f"s{i}"], 0, 0, 0) for i, (k, b) in enumerate(wide.items())})
        for k, b in narrow.items():
            if b.holds():
                brackets[k], slack[k] = b, max(slack[k] / 2, 4 / accuracy)
            else:
                slack[k] *= 4
    else:
        raise RuntimeError(f"quantiles didn't narrow down in {rounds} rounds")
    last = {k: b for k, b in brackets.items() if b.open}
    rows = df.agg(*[F.array_sort(F.collect_list(b.inside())).alias(f"v{i}") for i, b in enumerate(last.values())]).first() if last else ()
    between = dict(zip(last, rows))
    out: dict[str, list[float | None]] = {c: [] for c in wanted}
    for _, c, p in places:
        if (c, p) not in at:
            out[c].append(None)
            continue
        low, high = (brackets[c, k].value(between.get((c, k), ())) for k in (floor(at[c, p]), ceil(at[c, p])))
        out[c].append(low + (high - low) * (at[c, p] - floor(at[c, p])))
    return out


def median(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in quantiles(df, {c: [0.5] for c in columns}).items()}
