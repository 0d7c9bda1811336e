"""The chain from a joined panel to a model matrix: indicators, returns, ratios, volatility, lags, target, selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import log1p, log_ratio, ratio
from ..sources.tables import stored
from . import features as X
from . import panel as P
from .recursive import recursive_indicators

#: Series that get indicators of their own, columns that get log returns, sectors, lags, ratios, and the names of
#: estimates, factors and a series' fields (INDEXED to FIELDS).
INDEXED = ("^VIX", "^GSPC")
RETURNS = ("adj_mktcap", "vol", "comm_^GSPC_close", "comm_^IXIC_close", "comm_^RUT_close", "comm_XLK_close", "comm_XLF_close", "comm_XLE_close", "comm_XLV_close", "comm_XLI_close", "comm_^VIX_close", "comm_^VXN_close", "comm_^OVX_close", "comm_^GVZ_close")
SECTORS = ("XLK", "XLF", "XLE", "XLV", "XLI")
LAGS: dict[str, tuple[int, ...]] = {
    "adj_prc_logret": (1, 2, 3, 4, 5),
    "comm_^GSPC_close_logret": (1, 5),
    "comm_^IXIC_close_logret": (1, 5),
    "comm_^RUT_close_logret": (1, 5),
    **{f"comm_{s}_close_logret": (1,) for s in SECTORS},
    "ratio_^VIX_^GSPC": (1,),
    **{f"ratio_{s}_^GSPC": (1,) for s in SECTORS},
    "ratio_volatility_premium": (1,),
}
RATIOS = ("ratio_^VIX_^GSPC", *(f"ratio_{s}_^GSPC" for s in SECTORS), "ratio_volatility_premium", "ratio_beta_proxy")
ESTIMATES = ("n_analysts", "n_up", "n_down", "cons_mean", "cons_median", "cons_stdev", "cons_high", "cons_low", "cons_cv", "cons_range_pct")
FACTORS = ("mktrf", "smb", "hml", "rf", "umd")
FIELDS = ("open", "high", "low", "close", "volume")


def indicators(df: DataFrame, open_: str = "openprc", high: str = "askhi", low: str = "bidlo", close: str = "adj_prc", vol: str = "vol", prefix: str = "ti_", entity: str = "permno", date: str = "date", recursive: bool = True) -> DataFrame:
    """All indicators of an entity's history; those that carry state from row to row only if `recursive`."""
    df = recursive_indicators(df, high, low, close, prefix, entity, date) if recursive else df
    out = X.windowed_indicators(df, open_, high, low, close, vol, prefix, entity, date).drop(f"{prefix}tr")
    return out.withColumns({f"{prefix}skew_63": X.skew(close, entity=entity, date=date), f"{prefix}kurt_63": X.kurtosis(close, entity=entity, date=date)})


def index_indicators(macro: DataFrame, series: Sequence[str] = INDEXED, date: str = "date", recursive: bool = True) -> DataFrame:
    """(date, comm_ti_{series}_{indicator}): the same of macro series, each once on the macro calendar.

    macro: a row a date with columns comm_{series}_{field}. A series without all five fields is left out, as are columns without
    any value. Series are the partitions of one pass over a long table, and come back as columns.
    """
    known = [s for s in series if all(f"comm_{s}_{f}" in macro.columns for f in FIELDS)]
    if not known:
        return macro.select(date)
    rows = ", ".join(f"'{s}', " + ", ".join(f"`comm_{s}_{f}`" for f in FIELDS) for s in known)
    long = macro.select(date, F.expr(f"stack({len(known)}, {rows}) AS (series, {', '.join(FIELDS)})")).dropna(subset=["close"])
    found = indicators(long, *FIELDS, prefix="", entity="series", date=date, recursive=recursive)
    names = [c for c in found.columns if c not in (date, "series", *FIELDS)]
    wide = found.groupBy(date).agg(*[F.max(F.when(F.col("series") == s, F.col(c))).alias(f"comm_ti_{s}_{c}") for s in known for c in names])
    return P.drop_empty_columns(wide, [c for c in wide.columns if c != date])


def macro_features(macro: DataFrame, date: str = "date") -> DataFrame:
    """Ratios of macro series to the index, and implied less realised volatility, a row a date."""
    has, index = set(macro.columns), "comm_^GSPC_close"
    if index not in has:
        return macro.select(date)
    made = {f"ratio_{s}_^GSPC": ratio(f"comm_{s}_close", index) for s in ("^VIX", *SECTORS) if f"comm_{s}_close" in has}
    out = macro.withColumn("_r", log_ratio(F.col(index), F.lag(index).over(Window.orderBy(date))))  # thousands of dates
    if "comm_^VIX_close" in has:
        made["ratio_volatility_premium"] = F.col("comm_^VIX_close") - X.series_volatility("_r", date=date)
    return out.select(date, *[c.alias(n) for n, c in made.items()])


def augmented(df: DataFrame, macro: DataFrame, columns: Mapping[str, str] | None = None, recursive: bool = True) -> DataFrame:
    """The panel with every feature and the target adj_prc_logret_lead1.

    df: permno, date, ret, prices and volume (columns: what open_, high, low, close and vol are called). macro: a row a date with
    comm_{series}_{field}, joined by date. Columns that are not there make no features. Returns are logs of 1 + ret, which holds
    dividends. Windows of an entity share one specification; the two tables of a row a date are joined.
    """
    names = dict(columns or {})
    if recursive:  # first, while rows are narrow
        df = recursive_indicators(df, *(names.get(k, v) for k, v in (("high", "askhi"), ("low", "bidlo"), ("close", "adj_prc"))))
    out = P.by_key(df, macro, {"date": "date"})
    out = P.by_key(out, macro_features(macro), {"date": "date"})
    out = P.by_key(out, index_indicators(macro, recursive=recursive), {"date": "date"})
    out = out.withColumn("adj_prc_logret", log1p("ret"))
    out = X.log_returns(out, [c for c in RETURNS if c in out.columns])
    if "comm_^GSPC_close_logret" in out.columns:
        out = out.withColumn("ratio_beta_proxy", X.beta_proxy(F.col("adj_prc_logret"), F.col("comm_^GSPC_close_logret")))
    out = out.withColumn("anualized_volatility_20d", X.volatility("adj_prc_logret"))
    out = X.lead_target(X.lagged(out, LAGS), "adj_prc_logret")
    return indicators(out, **names, recursive=False)


def model_matrix(df: DataFrame, macro: DataFrame, columns: Mapping[str, str] | None = None, recursive: bool = True) -> DataFrame:
    """From a joined panel to the matrix: augmented, incomplete heads cut, columns selected, all entities on one calendar.

    The target is unknown in an entity's last row, which stays. The features are made once and stored: the calendar and the start,
    and then the rows, are read from there.
    """
    full = augmented(df, macro, columns, recursive)
    chosen = P.model_columns(full.columns, [*RATIOS, *ESTIMATES, *FACTORS])
    features = [c for c in chosen if c != "ticker" and not c.startswith("adj_prc_logret_lead")]
    return P.aligned(stored(P.from_first_complete(full.select("permno", "date", *chosen), features)), chosen)
