"""Daily runs from kept state: a day's features from the last rows and the recursive states of each entity, not from whole histories.

A state is a table of a row an entity below {folder}/state={date of its last rows}: its last rows, and what the smoothings carry.
A run reads the state before its days and those days' rows, and publishes the state after them; both meet in one join. Run again,
the same days start from the same state and give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import exists, publish
from .recursive import NAMES, History, entity_states

#: Rows that are kept of an entity: as many as the longest window of the features.
ROWS = 63


def states(spark: SparkSession, folder: str) -> list[str]:
    """The dates of the published states, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not exists(spark, folder):
        return []
    names = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    return sorted(n.removeprefix("state=") for n in names if n.startswith("state=") and ".staged-" not in n)


def begin(history: DataFrame, folder: str, rows: int = ROWS, high: str = "askhi", low: str = "bidlo", close: str = "adj_prc", prefix: str = "ti_", entity: str = "permno", date: str = "date") -> str | None:
    """Publish the state after a whole history; its date, or None for a history without rows. Entity and date must tell rows apart."""
    last = history.agg(F.max(date).cast("string")).first()[0]
    if last is None:
        return None
    columns = [c for c in history.columns if c not in (entity, date)]
    order = Window.partitionBy(entity).orderBy(F.col(date).desc())
    kept = history.withColumn("_back", F.row_number().over(order)).filter(F.col("_back") <= rows)
    row = F.struct(F.col(date), *[F.col(c) for c in columns], *[F.lit(None).cast("double").alias(f"{prefix}{n}") for n in NAMES])
    tails = kept.groupBy(entity).agg(F.sort_array(F.collect_list(row)).alias("tail"))  # so many rows at most
    out = tails.join(entity_states(history, high, low, close, entity, date), entity).withColumn("fresh", F.lit(0))
    publish(out, f"{folder}/state={last}", {})
    return last


def run_days(new: DataFrame, folder: str, features: Callable[[DataFrame], DataFrame] | None = None, rows: int = ROWS, high: str = "askhi", low: str = "bidlo", close: str = "adj_prc", prefix: str = "ti_", entity: str = "permno", date: str = "date") -> DataFrame:
    """The rows of `new` with recursive indicators and what `features` adds, from the last state before their first date.

    new: rows of the days since that state, with the columns of the history. features: columns from windows of at most `rows` rows
    of an entity. Entities without new rows keep their state, new entities start without one. The state after the rows is published.
    Raises where there is no state before the rows, or a row isn't later than its entity's last.
    """
    spark = new.sparkSession
    first, last = new.agg(F.min(date).cast("string"), F.max(date).cast("string")).first()
    if first is None:
        raise ValueError("no rows to run")
    before = [s for s in states(spark, folder) if s < first]
    if not before:
        raise ValueError(f"{folder} holds no state before {first}")
    state = spark.read.parquet(f"{folder}/state={before[-1]}")
    columns = [f.name for f in state.schema["tail"].dataType.elementType.fields[1 : -len(NAMES)]]
    row = F.struct(F.col(date), *[F.col(c) for c in columns])
    days = new.groupBy(entity).agg(F.sort_array(F.collect_list(row)).alias("_new"))  # an entity's rows of these days
    both = state.drop("fresh").join(days, entity, "full").select(entity, "tail", "history", "_new")

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in (*NAMES, "after")]
            for old, kept, tail in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(1).to_pylist()):
                if kept and tail and kept[0][date] <= tail[-1][date]:
                    raise ValueError(f"a row of {kept[0][date]} isn't later than what its entity's state holds, {tail[-1][date]}")
                h = History.of(old)
                found = h(*(np.array([np.nan if r[c] is None else float(r[c]) for r in kept]) for c in (high, low, close))) if kept else {}
                for values, n in zip(out, NAMES):
                    values.append([None if np.isnan(x) else float(x) for x in found[n]] if kept else [])
                out[-1].append(h.packed())
            kinds = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, kinds) for x in out]], names=[*batch.schema.names, *NAMES, "after"])

    lists = ", ".join(f"{n} array<double>" for n in (*NAMES, "after"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema) + f", {lists}"
    done = both.mapInArrow(carried, schema)
    item = state.schema["tail"].dataType.elementType
    fresh = F.transform("_new", lambda x, i: F.struct(x[date].alias(date), *[x[c].alias(c) for c in columns], *[F.col(n)[i].alias(f"{prefix}{n}") for n in NAMES]))
    none = F.array().cast(f"array<{item.simpleString()}>")
    added, old = F.coalesce(fresh.cast(f"array<{item.simpleString()}>"), none), F.coalesce("tail", none)
    size = F.when(F.col("_new").isNull(), 0).otherwise(F.size("_new"))
    both_rows = F.concat(old, added)
    keep = F.lit(rows - 1) + F.greatest(size, F.lit(1))
    tail = F.slice(both_rows, F.greatest(F.size(both_rows) - keep, F.lit(0)) + 1, keep)
    publish(done.select(entity, tail.alias("tail"), F.col("after").alias("history"), size.alias("fresh")), f"{folder}/state={last}", {})
    now = spark.read.parquet(f"{folder}/state={last}").filter("fresh > 0")
    out = now.select(entity, "fresh", F.size("tail").alias("_n"), F.posexplode("tail").alias("_i", "_row")).select(entity, "_row.*", (F.col("_i") >= F.col("_n") - F.col("fresh")).alias("_fresh"))
    return (features(out) if features else out).filter("_fresh").drop("_fresh")
