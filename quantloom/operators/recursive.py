"""Indicators that carry state from row to row: RSI, ATR, MACD, ADX and the parabolic SAR's acceleration.

A window frame can't carry state. `recursive_indicators` has each entity's rows stream by in order, in batches: the state of an
entity goes on from batch to batch, so a task holds a batch, however long a history is, and all columns come out beside the
indicators, without a join. `scanned_indicators` cuts histories into blocks of days instead, which are tasks of their own: a
smoothing over a block is an affine map of the state that it starts from, and such maps compose. Seed of every smoothing: the first
value; results are NULL for the first length - 1 rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..sources.tables import stored


def smoothed(x: np.ndarray, alpha: float, state: float = np.nan) -> np.ndarray:
    """y[i] = y[i-1] + alpha (x[i] - y[i-1]) from a state on; from none, the first known value is the state. An unknown value leaves it."""
    out = np.full(len(x), np.nan)
    for i, v in enumerate(x):
        if not np.isnan(v):
            state = v if np.isnan(state) else state + alpha * (v - state)
        out[i] = state
    return out


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(b == 0, np.nan, a / b)


def true_range(h: np.ndarray, l: np.ndarray, c: np.ndarray, before: float = np.nan) -> np.ndarray:
    last = np.concatenate(([before], c[:-1]))[: len(c)]
    return np.fmax(h - l, np.fmax(np.abs(h - last), np.abs(l - last)))


#: The smoothed series by name, and what a step of each gives to the new value.
ALPHAS = {"gain": 1 / 14, "loss": 1 / 14, "atr_14": 1 / 14, "atr_7": 1 / 7, "fast": 2 / 13, "slow": 2 / 27, "plus": 1 / 14, "minus": 1 / 14}
NAMES = ("rsi_14", "atr_14", "atr_7", "macd_12_26", "adx_14", "psar_af")


def inputs(h: np.ndarray, l: np.ndarray, c: np.ndarray, last: tuple[float, float, float]) -> dict[str, np.ndarray]:
    """What each smoothing takes, of rows that follow a row of high, low and close `last` (NaN if none)."""
    d, up, down = np.diff(c, prepend=last[2]), np.diff(h, prepend=last[0]), -np.diff(l, prepend=last[1])
    tr = true_range(h, l, c, last[2])
    return {
        "gain": np.where(np.isnan(d), np.nan, np.maximum(d, 0)), "loss": np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), "atr_14": tr, "atr_7": tr, "fast": c, "slow": c,
        "plus": np.where((up > down) & (up > 0), up, 0.0), "minus": np.where((down > up) & (down > 0), down, 0.0),
    }


def results(y: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    """Indicators of smoothed series, NULL (NaN) where a row's number `at`, from 0, is below length - 1. `dx` is what ADX smooths."""
    after = lambda x, rows: np.where(at < rows - 1, np.nan, x)
    p, m = _share(y["plus"], y["atr_14"]), _share(y["minus"], y["atr_14"])
    return {
        "rsi_14": after(100 * _share(y["gain"], y["gain"] + y["loss"]), 14), "atr_14": after(y["atr_14"], 14), "atr_7": after(y["atr_7"], 7),
        "macd_12_26": after(y["fast"] - y["slow"], 26), "dx": 100 * _share(np.abs(p - m), p + m),
    }


class Reversal:
    """The acceleration factor of the stop-and-reverse machine, which starts long at the first low."""

    def __init__(self, step: float = 0.02, most: float = 0.2):
        self.rising, self.sar, self.extreme, self.factor, self.step, self.most = True, np.nan, np.nan, step, step, most

    def __call__(self, h: np.ndarray, l: np.ndarray) -> np.ndarray:
        out = np.full(len(h), np.nan)
        for i in range(len(h)):
            if np.isnan(h[i]) or np.isnan(l[i]):
                continue
            if np.isnan(self.sar):
                self.sar, self.extreme = l[i], h[i]
            else:
                self.sar += self.factor * (self.extreme - self.sar)
                if l[i] < self.sar if self.rising else h[i] > self.sar:
                    self.rising, self.sar, self.extreme, self.factor = not self.rising, self.extreme, l[i] if self.rising else h[i], self.step
                elif h[i] > self.extreme if self.rising else l[i] < self.extreme:
                    self.extreme, self.factor = h[i] if self.rising else l[i], min(self.factor + self.step, self.most)
            out[i] = self.factor
        return out


class History:
    """The state of an entity's rows so far; takes the rows that follow."""

    def __init__(self):
        self.n, self.last, self.at, self.reversal = 0, (np.nan,) * 3, {}, Reversal()

    def smooth(self, name: str, x: np.ndarray, alpha: float) -> np.ndarray:
        out = smoothed(x, alpha, self.at.get(name, np.nan))
        self.at[name] = out[-1]
        return out

    def __call__(self, h: np.ndarray, l: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
        at = self.n + np.arange(len(h))
        out = results({n: self.smooth(n, x, ALPHAS[n]) for n, x in inputs(h, l, c, self.last).items()}, at)
        out["adx_14"] = np.where(at < 13, np.nan, self.smooth("adx", out.pop("dx"), 1 / 14))
        out["psar_af"] = self.reversal(h, l)
        self.n, self.last = self.n + len(h), (h[-1], l[-1], c[-1])
        return out

    def packed(self) -> list[float]:
        """The state as numbers, NaN where there is none yet."""
        r = self.reversal
        return [float(x) for x in (self.n, *self.last, *[self.at.get(n, np.nan) for n in (*ALPHAS, "adx")], r.rising, r.sar, r.extreme, r.factor)]

    @classmethod
    def of(cls, packed: list[float] | None) -> History:
        """The state that `packed` gave; of None, that of no rows."""
        self = cls()
        if packed is not None:
            self.n, self.last = int(packed[0]), tuple(packed[1:4])
            self.at = dict(zip((*ALPHAS, "adx"), packed[4:-4]))
            r = self.reversal
            r.rising, r.sar, r.extreme, r.factor = bool(packed[-4]), *packed[-3:]
        return self


def rsi(c: np.ndarray) -> np.ndarray:
    return History()(c, c, c)["rsi_14"]


def atr(h: np.ndarray, l: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    return History()(h, l, c)[f"atr_{n}"]


def macd(c: np.ndarray) -> np.ndarray:
    return History()(c, c, c)["macd_12_26"]


def adx(h: np.ndarray, l: np.ndarray, c: np.ndarray) -> np.ndarray:
    return History()(h, l, c)["adx_14"]


def psar_acceleration(h: np.ndarray, l: np.ndarray) -> np.ndarray:
    return Reversal()(h, l)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def recursive_indicators(df: DataFrame, high: str = "askhi", low: str = "bidlo", close: str = "adj_prc", prefix: str = "ti_", entity: str = "permno", date: str = "date") -> DataFrame:
    """`df` with {prefix}{name} for NAMES: one exchange, no join. Rows of equal entity and date follow each other in no stated order."""
    at = {c: df.columns.index(c) for c in (entity, high, low, close)}
    schema = StructType([*df.schema.fields, *[StructField(f"{prefix}{n}", DoubleType()) for n in NAMES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(at[entity]).dictionary_encode()
            code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), batch.num_rows]
            h, l, c = (_numbers(batch.column(at[x])) for x in (high, low, close))
            parts = []
            for a, b in zip(cuts, cuts[1:]):
                one = (batch.column(at[entity])[a].as_py(),)
                if one != who:
                    who, state = one, History()
                parts.append(state(h[a:b], l[a:b], c[a:b]))
            found = [pa.array(np.concatenate([p[n] for p in parts]), from_pandas=True) for n in NAMES]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=schema.names)

    return df.repartition(entity).sortWithinPartitions(entity, date).mapInArrow(run, schema)


def entity_states(df: DataFrame, high: str = "askhi", low: str = "bidlo", close: str = "adj_prc", entity: str = "permno", date: str = "date") -> DataFrame:
    """(entity, history): the state of each entity behind all its rows, which stream by as in `recursive_indicators`."""
    rows = df.select(entity, date, high, low, close)
    schema = StructType([df.schema[entity], StructField("history", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, state, kind = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field(0).type
            code = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), batch.num_rows]
            h, l, c = (_numbers(batch.column(i)) for i in (2, 3, 4))
            ended = []
            for a, b in zip(cuts, cuts[1:]):
                one = (batch.column(0)[a].as_py(),)
                if one != who:
                    ended += [] if who is None else [(who[0], state.packed())]
                    who, state = one, History()
                state(h[a:b], l[a:b], c[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in ended], kind), pa.array([x for _, x in ended], pa.list_(pa.float64()))], names=schema.names)
        if who is not None:
            yield pa.RecordBatch.from_arrays([pa.array([who[0]], kind), pa.array([state.packed()], pa.list_(pa.float64()))], names=schema.names)

    return rows.repartition(entity).sortWithinPartitions(entity, date).mapInArrow(run, schema)


def affine(x: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, u) of each row: the smoothed value is a s + b from a state s before the first row, and u from none."""
    a, b = np.empty(len(x)), np.empty(len(x))
    one, zero = 1.0, 0.0
    for i, v in enumerate(x):
        if not np.isnan(v):
            one, zero = one * (1 - alpha), zero + alpha * (v - zero)
        a[i], b[i] = one, zero
    return a, b, smoothed(x, alpha)


def composed(maps: list[tuple[float, float, float]]) -> list[float]:
    """The state before each block of the blocks in order, whose maps (a, b, u) are those of their last rows."""
    out, state = [], np.nan
    for a, b, u in maps:
        out.append(state)
        state = u if np.isnan(state) else a * state + b
    return out


def scanned_indicators(df: DataFrame, high: str = "askhi", low: str = "bidlo", close: str = "adj_prc", prefix: str = "ti_", entity: str = "permno", date: str = "date", block_days: int = 366) -> DataFrame:
    """(entity, date, {prefix}{name}) for all NAMES but psar_af, whose state doesn't compose, by an associative scan over blocks of days.

    A block of an entity's days is a task's group; no group is a whole history. Blocks' last rows and maps (a row a block) are put
    in order per entity, and each block goes on from the state before it. ADX smooths what comes of smoothed series, so that its
    blocks are scanned in a second turn. Entity and date must tell rows apart.
    """
    names, shown = list(ALPHAS), ("rsi_14", "atr_14", "atr_7", "macd_12_26")
    keys = [df.schema[entity], StructField("_block", DoubleType()), df.schema[date]]
    prices = ("_h", "_l", "_c")
    rows = df.select(entity, date, *[F.col(c).cast("double").alias(n) for c, n in zip((high, low, close), prices)])
    rows = rows.withColumn("_block", F.floor(F.unix_date(F.to_date(date)) / block_days).cast("double"))
    order = Window.partitionBy(entity).orderBy("_block")
    ends = rows.groupBy(entity, "_block").agg(F.count("*").alias("_n"), F.max_by(F.struct(*prices), date).alias("_end"))  # a row a block
    before = F.lag("_end").over(order)
    ends = stored(ends.select(entity, "_block", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_at"), *[before[p].alias(f"_before{p}") for p in prices]))

    def series(own: pd.DataFrame, start: pd.DataFrame) -> dict[str, np.ndarray]:
        return inputs(*(own[p].to_numpy("f8") for p in prices), tuple(start[[f"_before{p}" for p in prices]].to_numpy("f8")[0]))

    def mapped(own: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(date)
        last = [v for n, x in series(own, start).items() for v in (y[-1] for y in affine(x, ALPHAS[n]))]
        return pd.DataFrame({entity: own[entity].iloc[:1], "_block": own["_block"].iloc[:1], "_maps": [last]})

    def states(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("_block")
        maps = np.array(blocks["_maps"].tolist(), "f8").reshape(len(blocks), -1, 3)
        found = np.array([composed([tuple(x) for x in maps[:, k]]) for k in range(maps.shape[1])]).T
        return pd.DataFrame({entity: blocks[entity].to_numpy(), "_block": blocks["_block"].to_numpy(), "_states": found.tolist()})

    def applied(own: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(date)
        state = dict(zip(names, start["_states"].iloc[0]))
        y = {n: smoothed(x, ALPHAS[n], np.nan if state[n] is None else state[n]) for n, x in series(own, start).items()}
        at = int(start["_at"].iloc[0]) + np.arange(len(own))
        found = results(y, at)
        a, b, u = affine(found["dx"], 1 / 14)
        out = {entity: own[entity], "_block": own["_block"], date: own[date], **{n: found[n] for n in shown}, "_row": at.astype("f8"), "_a": a, "_b": b, "_u": u}
        return pd.DataFrame(out)

    doubles = lambda *n: [StructField(x, DoubleType()) for x in n]
    grouped = lambda x: x.groupBy(entity, "_block")
    put = lambda maps: maps.groupBy(entity).applyInPandas(states, StructType([*keys[:2], StructField("_states", ArrayType(DoubleType()))]))
    maps = grouped(rows).cogroup(grouped(ends)).applyInPandas(mapped, StructType([*keys[:2], StructField("_maps", ArrayType(DoubleType()))]))
    starts = ends.join(put(maps), [entity, "_block"])
    first = stored(grouped(rows).cogroup(grouped(starts)).applyInPandas(applied, StructType([*keys, *doubles(*shown, "_row", "_a", "_b", "_u")])))
    second = put(grouped(first).agg(F.max_by(F.array("_a", "_b", "_u"), date).alias("_maps")))
    state = F.nanvl(F.col("_states")[0], F.lit(None))
    adx = F.when(F.col("_row") >= 13, F.coalesce(F.col("_a") * state + F.col("_b"), F.col("_u")))
    out = first.join(second, [entity, "_block"]).withColumn("adx_14", adx)
    return out.select(entity, date, *[F.nanvl(n, F.lit(None)).alias(f"{prefix}{n}") for n in NAMES[:-1]])
