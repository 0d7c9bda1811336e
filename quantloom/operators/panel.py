"""Operators on (entity, date) panels: filters, joins, de-duplication, filling and calendars.

All are lazy DataFrame to DataFrame functions. Windows of an entity's history share one specification, so a chain of them
costs one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .quantiles import median

KEYS = ("permno", "date")
FOREVER = "9999-12-31"


def history(entity: str = "permno", date: str = "date") -> WindowSpec:
    return Window.partitionBy(entity).orderBy(date)


def until_now(entity: str = "permno", date: str = "date") -> WindowSpec:
    return history(entity, date).rowsBetween(Window.unboundedPreceding, 0)


def require(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    if gone := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} lacks {gone}")
    return df


# Filters


def among(df: DataFrame, column: str, values: Sequence | DataFrame) -> DataFrame:
    """Rows whose column is one of a short list, or of the first column of a DataFrame (left semi join)."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(column)).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(*values))


def among_any(df: DataFrame, keep: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Rows any of whose keys is in the keep-set's column of the same role ({own column: keep-set's}); unchanged if none applies."""
    shared = {a: b for a, b in keys.items() if a in df.columns and b in keep.columns}
    if not shared:
        return df
    found = F.lit(False)
    for i, (a, b) in enumerate(shared.items()):
        side = keep.filter(F.col(b).isNotNull()).select(F.col(b).alias(f"_k{i}")).distinct().withColumn(f"_f{i}", F.lit(True))
        df = df.join(side, F.col(a) == F.col(f"_k{i}"), "left")
        found = found | F.coalesce(f"_f{i}", F.lit(False))
    return df.filter(found).drop(*[c for i in range(len(shared)) for c in (f"_k{i}", f"_f{i}")])


def without_any(df: DataFrame, entity: str, bad: Column) -> DataFrame:
    """Rows of entities none of whose rows is bad (NULL counts as good)."""
    worst = df.groupBy(entity).agg(F.bool_or(F.coalesce(bad, F.lit(False))).alias("_bad")).filter("_bad")
    return df.join(worst.select(entity), entity, "left_anti")


def drop_zero_factors(df: DataFrame, columns: Sequence[str], entity: str = "permno") -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.col(c) == 0, F.lit(False))
    return without_any(df, entity, bad)


def drop_negative_prices(df: DataFrame, price: str, entity: str = "permno", share: float = 0.01) -> DataFrame:
    """Entities with more than `share` of negative prices go; other prices lose their sign."""
    counted = df.groupBy(entity).agg(F.count_if(F.col(price) < 0).alias("_neg"), F.count("*").alias("_all")).filter(F.col("_neg") > share * F.col("_all"))
    return df.join(counted.select(entity), entity, "left_anti").withColumn(price, F.abs(price))


def clean_prices(df: DataFrame, factors: Sequence[str], price: str, entity: str = "permno", share: float = 0.01) -> DataFrame:
    return drop_negative_prices(drop_zero_factors(df, factors, entity), price, entity, share)


def drop_empty_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without those of `columns` that are NULL in every row: one job that brings back a row of counts."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if not counts[c]])


def prefer_latest(df: DataFrame, own: str = "cusip", named: str = "ncusip") -> DataFrame:
    """Without the identifier of the price table where the names' own came along: that is the one of the date."""
    return df.drop(own) if own in df.columns and named in df.columns else df


def latest(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows of the greatest date."""
    return df.join(F.broadcast(df.agg(F.max(date).alias(date))), date, "left_semi")  # one row


def to_date(c: str) -> Column:
    """Raises on what isn't a date."""
    return F.col(c).cast("date")


def to_number(c: str) -> Column:
    """NULL for what isn't a number."""
    return F.expr(f"try_cast({c} AS double)")


def model_columns(columns: Sequence[str], lists: Sequence[str] = (), index: str = "^GSPC", target: str = "adj_prc_logret", label: str = "ticker") -> list[str]:
    """Names that make a model matrix: returns, lags, listed ratios, indicators but the index's ease of movement; then label and targets."""
    features = [c for c in columns if (c.endswith("_logret") or "_lag" in c or c in lists or "ti_" in c) and not c.startswith(f"comm_ti_{index}_eom") and not c.startswith(f"{target}_lead")]
    targets = [c for c in columns if c.startswith(target) and "lead" in c]
    return list(dict.fromkeys([*features, *[c for c in columns if c == label], *targets]))


# Joins


#: A key with at least this share of a table's rows is cut into buckets.
HOT_SHARE = 0.001


def _often(keys: Sequence[str]) -> tuple[Column, Column]:
    """Aggregates: counts of the hashes of keys that a sketch of bounded size finds most, and of all rows."""
    return F.expr(f"approx_top_k(xxhash64({', '.join(f'`{k}`' for k in keys)}), {int(2 / HOT_SHARE)}, {int(10 / HOT_SHARE)})").alias("often"), F.count("*").alias("n")


def _hot(found) -> set[int]:
    return {x["item"] for x in found["often"] or () if x["item"] is not None and x["count"] >= HOT_SHARE * found["n"]}


def _bucketed(df: DataFrame, spans: DataFrame, on: Mapping[str, str], at: str, start: str, end: str, days: int) -> tuple[DataFrame, DataFrame, bool]:
    """`df` with the bucket of days of each row, `_in`; `spans` once for each bucket that an interval touches, `_bucket`, within those of `df`.

    Only keys with many rows or intervals have buckets, all others one, so that an interval is one row but for these keys. Says if there
    are such. A key that the sketches miss costs balance, never rows: both sides go by one list of at most 2 / HOT_SHARE hashes.
    """
    number = lambda c: F.floor(F.unix_date(F.to_date(c)) / days).cast("int")
    found = df.agg(F.min(number(F.col(at))).alias("first"), F.max(number(F.col(at))).alias("last"), *_often(list(on))).first()
    first, last = (0, -1) if found["first"] is None else (found["first"], found["last"])  # no dates, no buckets
    hot = sorted(_hot(found) | _hot(spans.agg(*_often(list(on.values()))).first()))
    cut = lambda keys: F.xxhash64(*[F.col(k) for k in keys]).isin(hot) if hot else F.lit(False)
    low = F.greatest(number(F.col(start)), F.lit(first).cast("int"))
    high = F.least(number(F.coalesce(F.col(end), F.lit(FOREVER).cast("date"))), F.lit(last).cast("int"))
    near = spans.withColumns({"_low": low, "_high": high}).filter(F.col(start).isNotNull() & (F.col("_high") >= F.col("_low")))
    if hot:
        near = near.withColumn("_bucket", F.explode(F.when(cut(on.values()), F.sequence("_low", "_high")).otherwise(F.array(F.lit(0)))))
    else:
        near = near.withColumn("_bucket", F.lit(0))
    return df.withColumn("_in", F.when(cut(on), number(F.col(at))).otherwise(0)), near.drop("_low", "_high"), bool(hot)


def _matched(df: DataFrame, spans: DataFrame, on: Mapping[str, str], at: str, start: str, end: str, how: str) -> DataFrame:
    left, right = df.alias("_left"), spans.alias("_right")
    of = lambda side, c: F.col(f"{side}.`{c}`")
    cond = (of("_left", at) >= of("_right", start)) & (of("_left", at) <= F.coalesce(of("_right", end), F.lit(FOREVER).cast("date")))
    for a, b in on.items():
        cond = cond & (of("_left", a) == of("_right", b))
    return left.join(right, cond, how)


def interval_join(df: DataFrame, spans: DataFrame, on: Mapping[str, str], at: str, start: str, end: str, how: str = "inner", bucket_days: int | None = None) -> DataFrame:
    """Rows with the intervals of equal key that hold their date: [start, end], a NULL end open. The key is hashed, the range a residual.

    bucket_days: intervals of keys with many rows or intervals are cut at the borders of buckets of so many days, and key and bucket are
    hashed: such a row meets the intervals of its bucket alone, and a key with most of all rows is as many groups as there are buckets.
    Two jobs find the range of dates and these keys.
    """
    if not bucket_days:
        return _matched(df, spans, on, at, start, end, how)
    df, spans, hot = _bucketed(df, spans, on, at, start, end, bucket_days)
    return _matched(df, spans, {**on, "_in": "_bucket"} if hot else on, at, start, end, how).drop("_in", "_bucket")


def as_of_interval(df: DataFrame, spans: DataFrame, on: Mapping[str, str], row: Sequence[str], at: str, start: str, end: str, ties: Sequence[str] = (), drop_uncovered: bool = False, bucket_days: int | None = None, one_key: bool = False) -> DataFrame:
    """Every row of `df` once, with the interval that holds its date and starts last; rows without one keep NULLs, or go if drop_uncovered.

    row: columns that tell rows of `df` apart. ties: further columns of `spans`, ascending, between equal starts. bucket_days: as in
    interval_join. one_key: rows that are equal in `row` are known to have one key; they are told apart where the join has put them,
    without another exchange, unless keys are cut into buckets.
    """
    how, hot = "inner" if drop_uncovered else "left", False
    if bucket_days:
        df, spans, hot = _bucketed(df, spans, on, at, start, end, bucket_days)
    both = _matched(df, spans, {**on, "_in": "_bucket"} if hot else on, at, start, end, how)
    own = [F.col(f"_left.`{c}`") for c in on] if one_key and not hot else []
    order = Window.partitionBy(*own, *row).orderBy(F.col(start).desc_nulls_last(), *ties)
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", *(["_in", "_bucket"] if bucket_days else []))


def by_key(df: DataFrame, side: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Left join to a table of unique keys, whose key columns go unless they are the left's own. Spark broadcasts the side if it is small enough."""
    renamed = side.select(*[F.col(c).alias(next((a for a, b in on.items() if b == c), c)) for c in side.columns])
    return df.join(renamed, list(on), "left")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def determined(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> bool:
    """Whether rows of equal keys are equal in `columns`: one job over these columns alone."""
    one = F.struct(*columns)
    return not df.groupBy(*keys).agg(F.min(one).alias("_least"), F.max(one).alias("_most")).filter("NOT _least <=> _most").take(1)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df`, if its keys are unique: then a left join to it adds no rows. One job that stops at the first offender."""
    if found := duplicate_keys(df, keys).take(1):
        raise ValueError(f"keys {list(keys)} repeat, as {found[0].asDict()}")
    return df


# De-duplication and order


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row a key, the first by `order`; end it with what tells rows apart."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def ranked(c: str, order: Sequence[str]) -> Column:
    """0, 1, ... for listed values, then one more for all others and NULL."""
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(F.col(c) == v, i).otherwise(out)
    return out


def consensus_per_day(df: DataFrame, keys: Sequence[str], periodicity: str, horizon: str, analysts: str, ties: Sequence[Column]) -> DataFrame:
    """Consensus snapshots, one a key: periodicity Q, S, A, then others; least horizon as a number; most analysts."""
    return first_by(df, keys, ranked(periodicity, ("Q", "S", "A")).asc(), to_number(horizon).asc_nulls_last(), F.col(analysts).desc_nulls_last(), *ties)


def actuals_per_day(df: DataFrame, keys: Sequence[str], periodicity: str, activated: str, ties: Sequence[Column], newest: bool = False) -> DataFrame:
    """Reported actuals, one a key: periodicity Q, A, then others; the earliest activation, or the latest if `newest`."""
    at = F.col(activated).desc_nulls_last() if newest else F.col(activated).asc_nulls_last()
    return first_by(df, keys, ranked(periodicity, ("Q", "A")).asc(), at, *ties)


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


# Filling and calendars


def filled_forward(c: str, entity: str = "permno", date: str = "date") -> Column:
    return F.last(c, ignorenulls=True).over(until_now(entity, date))


def filled_backward(c: str, entity: str = "permno", date: str = "date") -> Column:
    return F.first(c, ignorenulls=True).over(history(entity, date).rowsBetween(0, Window.unboundedFollowing))


def filled(df: DataFrame, columns: Sequence[str], how: str = "ffill", final: str = "none", entity: str = "permno", date: str = "date") -> DataFrame:
    """how: none, ffill, bfill or both (forward, then backward). final: none, zero, mean or median of the column, for what is left."""
    out = df
    if how in ("ffill", "both"):
        out = out.withColumns({c: filled_forward(c, entity, date) for c in columns})
    if how in ("bfill", "both"):
        out = out.withColumns({c: filled_backward(c, entity, date) for c in columns})
    if final == "zero":
        out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})
    elif final == "median":  # selected in jobs of its own
        out = out.withColumns({c: F.coalesce(c, F.lit(v).cast("double")) for c, v in median(df, columns).items()})
    elif final == "mean":
        one = df.agg(*[F.avg(c).alias(f"_{c}") for c in columns])
        out = out.crossJoin(F.broadcast(one)).withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])  # one row
    return out


def with_sentinels(df: DataFrame, columns: Sequence[str], number: float | None = -9999.0, text: str | None = "missing", entity: str = "permno") -> DataFrame:
    """Columns that are NULL in all of an entity's rows get a sentinel there."""
    kinds, all_of = dict(df.dtypes), Window.partitionBy(entity)
    mark = lambda c: F.lit(text if kinds[c] == "string" else number).cast(kinds[c])
    return df.withColumns({c: F.when(F.count(c).over(all_of) == 0, mark(c)).otherwise(F.col(c)) for c in columns})


def source_dates(df: DataFrame, columns: Sequence[str], date: str = "date") -> DataFrame:
    """{c}_ffill_source_date: the date where c is known, to be carried forward with it."""
    return df.withColumns({f"{c}_ffill_source_date": F.when(F.col(c).isNotNull(), F.col(date)) for c in columns})


def from_first_complete(df: DataFrame, columns: Sequence[str], entity: str = "permno", date: str = "date") -> DataFrame:
    """Each entity from its first row without any NULL on."""
    complete = F.lit(1)
    for c in columns:
        complete = F.when(F.col(c).isNull(), 0).otherwise(complete)
    return df.withColumn("_on", F.max(complete).over(until_now(entity, date))).filter("_on = 1").drop("_on")


def forward_filled(df: DataFrame, columns: Sequence[str], drop: Sequence[str] = (), entity: str = "permno", date: str = "date", sentinel: bool = True, sources: bool = False) -> DataFrame:
    """Columns dropped, sentinels set, gaps filled forward, incomplete heads cut: one exchange on the entity."""
    out = df.drop(*drop)
    out = source_dates(out, columns, date) if sources else out
    out = with_sentinels(out, columns, entity=entity) if sentinel else out
    more = [f"{c}_ffill_source_date" for c in columns] if sources else []
    return from_first_complete(filled(out, [*columns, *more], entity=entity, date=date), columns, entity, date)


def _calendar(df: DataFrame, calendar: DataFrame | None, entity: str, date: str) -> tuple[list, object]:
    """The dates of `calendar` (or of `df`) in order, and the latest of the entities' first dates in `df`: one job over two columns, a row a date to the driver."""
    both = df.select(entity, date).groupingSets([[F.col(date)], [F.col(entity)]], F.col(date), F.col(entity)).agg(F.min(date).alias("_first"), F.grouping(entity).alias("_by_date"))
    days = F.collect_list(F.when(F.col("_by_date") == 1, F.col("_first")))
    one = both.agg(F.array_sort(days).alias("days"), F.max(F.when(F.col("_by_date") == 0, F.col("_first"))).alias("start")).first()
    if calendar is None:
        return one.days, one.start
    return [r[0] for r in calendar.select(date).dropna().distinct().orderBy(date).collect()], one.start


def _expanded(df: DataFrame, columns: Sequence[str], days: Sequence, start, carry: bool, entity: str, date: str) -> DataFrame:
    """A row for every entity and each of `days` from `start` on, by expansion of gaps.

    Days are numbered; a row is repeated for the days up to the entity's next row (an entity's first row also for those before
    it), with its values on its own day alone, or, to carry them, on all days from its own on. One window over the entity's
    history and two lookups of a table of a row a day; no product, no join back. Rows on other days count for nothing.
    """
    kind = df.schema[date].dataType.simpleString()
    table = F.broadcast(df.sparkSession.createDataFrame([(d, i) for i, d in enumerate(days)], f"_day {kind}, _at int"))  # a row a day
    least, n = next((i for i, d in enumerate(days) if start is None or d >= start), len(days)), len(days)
    w, all_of = history(entity, date), Window.partitionBy(entity)
    rows = df.select(entity, F.col(date).alias(date), *columns).join(table, F.col(date) == F.col("_day"), "left").drop("_day")
    # Of an entity without any row on these days one row stays, for its days without values.
    rows = rows.withColumns({"_any": F.max("_at").over(all_of), "_n": F.row_number().over(w)}).filter(F.col("_at").isNotNull() | F.col("_any").isNull() & (F.col("_n") == 1))
    at = F.col("_at")
    low = F.when(F.lag(F.lit(1)).over(w).isNull(), F.lit(least)).otherwise(F.greatest(at, F.lit(least)))
    high = F.greatest(F.coalesce(F.lead(at).over(w), F.lit(n)) - 1, at)
    rows = rows.withColumns({"_low": low, "_high": high}).filter("_high >= _low").withColumn("_to", F.explode(F.sequence("_low", "_high")))
    own = F.col("_to") >= at if carry else F.col("_to") == at
    named = table.withColumnRenamed("_at", "_to")
    return rows.withColumns({c: F.when(own, F.col(c)) for c in columns}).drop(date).join(named, "_to").select(entity, F.col("_day").alias(date), *columns)


def densified(df: DataFrame, columns: Sequence[str], calendar: DataFrame | None = None, from_latest_start: bool = True, entity: str = "permno", date: str = "date") -> DataFrame:
    """A row for every entity and calendar date (the union of dates, from the latest first date on), NULL where there was none."""
    days, start = _calendar(df, calendar, entity, date)
    return _expanded(df, columns, days, start if from_latest_start else None, False, entity, date)


def aligned(df: DataFrame, columns: Sequence[str], entity: str = "permno", date: str = "date") -> DataFrame:
    """All entities on one calendar from the latest first date on, gaps filled from before, also from before the calendar's start."""
    days, start = _calendar(df, None, entity, date)
    return _expanded(filled(df.select(entity, date, *columns), columns, entity=entity, date=date), columns, days, start, True, entity, date)


def even_length(df: DataFrame, multiple: int = 252, entity: str = "permno", date: str = "date") -> DataFrame:
    """Each entity's head cut so that its length is a multiple."""
    n = F.count("*").over(Window.partitionBy(entity)) % multiple
    return df.withColumn("_cut", F.row_number().over(history(entity, date)) > n).filter("_cut").drop("_cut")


def cross_section_filled(df: DataFrame, c: str, date: str = "date") -> DataFrame:
    """NULLs of a column get the median of their date."""
    return df.withColumn(c, F.coalesce(c, F.median(c).over(Window.partitionBy(date))))
