"""The registered queries over derived panels, each with the SQL that expresses it, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import log1p, ratio
from ..operators import allocate as A
from ..operators import augment as G
from ..operators import backtest as B
from ..operators import build as N
from ..operators import daily as E
from ..operators import features as X
from ..operators import models as M
from ..operators import panel as P
from ..operators import quantiles as Q
from ..operators import running as U
from ..operators import strategy as Y
from ..operators import summaries as S
from ..operators.recursive import recursive_indicators, scanned_indicators
from ..sources import snapshots as H
from ..sources import tables as T
from .fixtures import NAMES, SERIES, Fixtures, shown, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_W = "OVER (PARTITION BY permno ORDER BY date)"


def query(name: str, out: str, body: str | None = None):
    """Registers a query; its columns, and the body of its SQL."""

    def put(f: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, folder: shown(f(Fixtures(spark, folder)), out)
        if body is not None:
            ORACLE_SQL[name] = sql(body, out)
        return f

    return put


def frame(rows: int, name: str = "v") -> str:
    return f"{name} AS (PARTITION BY permno ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


# Sources and projections


@query("src1_scan", "region_name #n", "SELECT r_name AS region_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def _(t):
    both = T.load(t.spark, t.folder, ["region", "nation"])
    return both["nation"].join(both["region"], F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region_name")).agg(F.count("*").alias("n"))


@query("src2_src3_src5_snapshot", "#o_orderkey #o_custkey ~o_totalprice date #part", "SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS date, CAST(o_orderdate >= TIMESTAMP '1996-01-01' AS INT) AS part FROM orders")
def _(t):
    # A first run while the table ends with 1995, one over all of it that takes what is new, and one that takes what is there.
    rows = t.spark.read.parquet(f"{t.folder}/orders.parquet").withColumn("date", F.to_date("o_orderdate"))
    folder, whole = T.scratch(t.spark), H.table("orders", rows)
    H.snapshot(t.spark, H.table("orders", rows.filter("date < DATE '1996-01-01'")), folder, "orders", "date")
    parts = H.snapshot(t.spark, whole, folder, "orders", "date", "extend")
    assert H.snapshot(t.spark, whole, folder, "orders", "date") == parts
    return H.read(t.spark, parts, "part")


@query("src5_reuse_or_extract", "segment #customers #orders ~total", "SELECT c_mktsegment AS segment, count(DISTINCT c_custkey) AS customers, count(*) AS orders, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    folder, tables = T.scratch(t.spark), T.load(t.spark, t.folder, ["orders", "customer"])
    sources = {n: (H.table(n, tables[n]), k) for n, k in (("orders", "o_orderkey"), ("customer", "c_custkey"))}
    H.reuse_or_extract(t.spark, sources, folder)
    found = H.reuse_or_extract(t.spark, sources, folder)  # a second run, which extracts nothing
    rows = found["orders"].join(found["customer"], F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count_distinct("c_custkey").alias("customers"), F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))


_DSF = "SELECT cust AS permno, date, label AS ticker, price AS prc, -price / 3 AS bidlo, quantity AS cfacpr0, CASE WHEN quantity = 7 THEN 0 ELSE quantity / 10 END AS cfacpr, 2.0 AS cfacshr, quantity AS vol, 1000.0 AS shrout FROM shipped JOIN intervals ON custkey = cust AND date >= namedt AND date <= coalesce(nameenddt, DATE '9999-12-31') WHERE date >= DATE '1999-01-01' AND date < DATE '2000-01-01' AND label IN ('1-URGENT', '5-LOW')"


@query("src6_daily_stock_file", "permno date ticker ~prc ~adj_prc ~adj_bidlo ~adj_vol ~adj_shrout ~adj_mktcap", f"SELECT *, abs(prc) / nullif(cfacpr, 0) AS adj_prc, abs(bidlo) / nullif(cfacpr, 0) AS adj_bidlo, vol * cfacshr AS adj_vol, shrout * cfacshr AS adj_shrout, abs(prc) / nullif(cfacpr, 0) * shrout * cfacshr AS adj_mktcap FROM ({_DSF})")
def _(t):
    joined = P.interval_join(T.half_open(t.shipped, "1999-01-01", "2000-01-01"), P.among(t.intervals, "label", ["1-URGENT", "5-LOW"]), {"cust": "custkey"}, "date", "namedt", "nameenddt")
    raw = joined.select(F.col("cust").alias("permno"), "date", F.col("label").alias("ticker"), F.col("price").alias("prc"), (-F.col("price") / 3).alias("bidlo"), F.col("price").alias("askhi"), F.col("price").alias("openprc"), F.when(F.col("quantity") == 7, 0.0).otherwise(F.col("quantity") / 10).alias("cfacpr"), F.lit(2.0).alias("cfacshr"), F.col("quantity").alias("vol"), F.lit(1000.0).alias("shrout"))
    return T.adjusted(raw)


@query("src7_factor_range", "date ~f1 ~f5", "SELECT * FROM factors WHERE date >= DATE '1996-01-01' AND date < DATE '1998-01-01'")
def _(t):
    return T.half_open(t.factors, "1996-01-01", "1998-01-01")


@query("src8_consensus", "key date #id ~cons_mean ~cons_cv ~cons_range_pct", "SELECT key, date, id, n AS cons_mean, CASE WHEN m <> 0 THEN 100.0 / abs(m) END AS cons_cv, CASE WHEN m <> 0 THEN (n - 50000) / abs(m) END AS cons_range_pct FROM (SELECT *, CASE WHEN id % 11 = 0 THEN 0 ELSE n END AS m FROM snapshots WHERE periodicity = 'Q' AND fpi <> 'n/a')")
def _(t):
    rows = t.snapshots.filter("periodicity = 'Q' AND fpi <> 'n/a'").withColumns({"m": F.when(F.col("id") % 11 == 0, 0.0).otherwise(F.col("n")), "sd": F.lit(100.0), "low": F.lit(50000.0)})
    return rows.withColumns(T.dispersion("m", "sd", "n", "low")).withColumn("cons_mean", F.col("n"))


@query("src9_actuals_upper_bound", "key date #id", "SELECT * FROM snapshots WHERE date < DATE '1997-06-01' AND periodicity = 'A'")
def _(t):
    return T.half_open(t.snapshots, None, "1997-06-01").filter("periodicity = 'A'")


@query("src10_macro_pivot", "date " + " ".join(f"~{s}_{v}" for s in SERIES for v in ("avg", "min", "max")), "SELECT * FROM macro")
def _(t):
    return t.macro


@query("src11_macro_sink", "date " + " ".join(f"~{s}_{v}" for s in SERIES for v in ("avg", "min", "max")), "SELECT * FROM macro")
def _(t):
    """Written as a named artifact, found and read back."""
    T.write_macro(t.macro, folder := T.scratch(t.spark))
    return T.load(t.spark, folder, ["common_features"])["common_features"]


@query("p15_latest_name", "#l_orderkey #line label", "SELECT l_orderkey, line, i.label AS label FROM shipped JOIN intervals i ON custkey = cust AND date >= namedt AND date <= coalesce(nameenddt, DATE '9999-12-31')")
def _(t):
    own = t.shipped.withColumn("cusip", F.lit("of the price table"))
    joined = P.interval_join(own, t.intervals.withColumnRenamed("label", "ncusip"), {"cust": "custkey"}, "date", "namedt", "nameenddt")
    out = P.prefer_latest(joined)
    assert "cusip" not in out.columns and "cusip" in P.prefer_latest(own).columns
    return out.withColumnRenamed("ncusip", "label")


@query("p1_adjusted_price", "#l_orderkey #l_linenumber #l_partkey ~adj_prc", "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_extendedprice) / nullif(l_tax, 0) AS adj_prc FROM lineitem")
def _(t):
    return t.lineitem.withColumn("adj_prc", ratio(F.abs("l_extendedprice"), F.nullif(F.col("l_tax"), F.lit(0.0))))


@query("p6_ticker_filter", "#o_orderkey o_orderpriority", "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(t):
    return P.among(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("p7_company_filter", "#c_custkey c_name", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(t):
    keep = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("cust"), F.lit(None).cast("int").alias("nat")).unionByName(t.nation.filter("n_regionkey = 1").select(F.lit(None).cast("long").alias("cust"), F.col("n_nationkey").alias("nat")))
    return P.among_any(t.customer, keep, {"c_custkey": "cust", "c_nationkey": "nat", "absent": "cust"})


@query("p8_name_map", "#custkey label", "SELECT DISTINCT custkey, label FROM intervals WHERE label IN ('1-URGENT') AND custkey IS NOT NULL")
def _(t):
    return P.among(t.intervals.dropna(subset=["custkey", "label"]), "label", ["1-URGENT"]).select("custkey", "label").distinct()


@query("p9_zero_factor_entities", "#l_orderkey #n ~tax", "SELECT l_orderkey, count(*) AS n, sum(l_tax) AS tax FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_tax = 0 OR l_discount = 0) GROUP BY 1")
def _(t):
    return P.drop_zero_factors(t.lineitem, ["l_tax", "l_discount"], "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_tax").alias("tax"))


_NEG = "c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) FILTER (WHERE c_acctbal < 0) <= 0.08 * count(*))"


@query("p10_negative_price_entities", "#c_custkey #c_nationkey ~c_acctbal", f"SELECT c_custkey, c_nationkey, abs(c_acctbal) AS c_acctbal FROM customer WHERE {_NEG}")
def _(t):
    return P.drop_negative_prices(t.customer, "c_acctbal", "c_nationkey", 0.08)


@query("p11_clean_prices", "#c_custkey ~c_acctbal", f"SELECT c_custkey, abs(c_acctbal) AS c_acctbal FROM customer WHERE {_NEG} AND c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 700 = 0)")
def _(t):
    rows = t.customer.withColumn("factor", F.col("c_custkey") % 700)
    return P.clean_prices(rows, ["factor"], "c_acctbal", "c_nationkey", 0.08)


@query("p13_drop_empty_columns", "permno date ~close", "SELECT permno, date, close FROM bars")
def _(t):
    out = P.drop_empty_columns(t.bars.withColumn("void", F.lit(None).cast("double")), ["close", "void"])
    assert "void" not in out.columns
    return out


@query("p14_model_columns", "permno date ~close_logret ~vol_lag1 ~adj_prc_logret_lead1", f"SELECT permno, date, ln(close / lag(close) {_W}) AS close_logret, lag(vol, 1) {_W} AS vol_lag1, lead(close, 1) {_W} AS adj_prc_logret_lead1 FROM bars")
def _(t):
    rows = X.lagged(X.log_returns(t.bars, ["close"]), {"vol": 1, "absent": 2}).withColumn("adj_prc_logret_lead1", F.lead("close").over(P.history()))
    return rows.select("permno", "date", *P.model_columns(rows.columns))


@query("p16_extreme_targets", "permno date ~ret", "SELECT permno, date, ret FROM returns WHERE ret < -1.0 ORDER BY ret, permno, date LIMIT 10")
def _(t):
    return P.top(t.returns.filter("ret < -1.0"), 10, F.col("ret").asc(), F.col("permno"), F.col("date"))


@query("p19_latest_slice", "permno date ~close", "SELECT * FROM bars WHERE date = (SELECT max(date) FROM bars)")
def _(t):
    return P.latest(t.bars)


@query("p20_coercion", "#id fpi ~number day", "SELECT id, fpi, TRY_CAST(fpi AS DOUBLE) AS number, CAST(CAST(date AS VARCHAR) AS DATE) AS day FROM snapshots")
def _(t):
    return t.snapshots.withColumn("text", F.col("date").cast("string")).withColumns({"number": P.to_number("fpi"), "day": P.to_date("text")})


# Joins


@query("j1_interval_join", "#l_orderkey #line #partkey label namedt date", "SELECT * FROM shipped JOIN intervals ON custkey = cust AND date >= namedt AND date <= coalesce(nameenddt, DATE '9999-12-31')")
def _(t):
    return P.interval_join(t.shipped, t.intervals, {"cust": "custkey"}, "date", "namedt", "nameenddt")


@query("j1_interval_join_buckets", "#l_orderkey #line #partkey label namedt date", "SELECT * FROM shipped JOIN intervals ON custkey = cust AND date >= namedt AND date <= coalesce(nameenddt, DATE '9999-12-31')")
def _(t):
    return P.interval_join(t.shipped, t.intervals, {"cust": "custkey"}, "date", "namedt", "nameenddt", bucket_days=31)


_ROW = ("l_orderkey", "line", "partkey", "suppkey", "price", "quantity")
for _name, _drop, _days in (("j2_as_of_interval", False, None), ("q1_as_of_interval_inner", True, None), ("j2_as_of_interval_buckets", False, 31)):

    @query(_name, "#l_orderkey #line #partkey label namedt", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(_ROW)} ORDER BY namedt DESC NULLS LAST, orderkey) AS rn FROM shipped {'' if _drop else 'LEFT '}JOIN intervals ON custkey = cust AND date >= namedt AND date <= coalesce(nameenddt, DATE '9999-12-31')) WHERE rn = 1")
    def _(t, drop=_drop, days=_days):
        one_key = P.determined(t.orders, ["o_orderkey"], ["o_custkey"])  # so a line's order tells its customer
        return P.as_of_interval(t.shipped, t.intervals, {"cust": "custkey"}, _ROW, "date", "namedt", "nameenddt", ["orderkey"], drop, days, one_key)


@query("j3_factors_by_date", "permno date ~close ~f1 ~f2", "SELECT permno, date, close, f1, f2 FROM bars LEFT JOIN factors USING (date)")
def _(t):
    return P.by_key(t.bars, P.assert_unique(t.factors, ["date"]), {"date": "date"})


_D1 = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, date ORDER BY CASE periodicity WHEN 'Q' THEN 0 WHEN 'S' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, TRY_CAST(fpi AS DOUBLE) NULLS LAST, n DESC NULLS LAST, id) AS rn FROM snapshots) WHERE rn = 1"
_D2 = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, date ORDER BY CASE periodicity WHEN 'Q' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, n {0} NULLS LAST, id) AS rn FROM snapshots) WHERE rn = 1"


def _consensus(t):
    return P.consensus_per_day(t.snapshots, ["key", "date"], "periodicity", "fpi", "n", [F.col("id")])


@query("j4_consensus_by_ticker_date", "permno date ~close #id ~n", f"SELECT permno, b.date AS date, close, coalesce(id, -1) AS id, n FROM bars b LEFT JOIN ({_D1}) s ON s.key = b.permno AND s.date = b.date")
def _(t):
    return P.by_key(t.bars, _consensus(t), {"permno": "key", "date": "date"}).withColumn("id", F.coalesce("id", F.lit(-1)))


@query("j5_actuals_by_ticker_date", "permno date ~close #id", f"SELECT permno, b.date AS date, close, coalesce(id, -1) AS id FROM bars b LEFT JOIN ({_D2.format('ASC')}) s ON s.key = b.permno AND s.date = b.date")
def _(t):
    return P.by_key(t.bars, P.actuals_per_day(t.snapshots, ["key", "date"], "periodicity", "n", [F.col("id")]), {"permno": "key", "date": "date"}).withColumn("id", F.coalesce("id", F.lit(-1)))


@query("j6_macro_by_date", "permno date ~p1_avg ~p5_max", "SELECT permno, date, p1_avg, p5_max FROM bars LEFT JOIN macro USING (date)")
def _(t):
    return P.by_key(t.bars, t.macro, {"date": "date"})


@query("j7_densify", "permno date ~close", "SELECT e.permno, c.date, close FROM (SELECT DISTINCT permno FROM bars) e CROSS JOIN (SELECT DISTINCT date FROM bars) c LEFT JOIN bars b ON b.permno = e.permno AND b.date = c.date")
def _(t):
    return P.densified(t.bars, ["close"], from_latest_start=False)


@query("j8_semi_anti", "#o_orderkey kind", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'in' ELSE 'out' END AS kind FROM orders")
def _(t):
    poor = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(poor, "o_custkey", "left_semi").withColumn("kind", F.lit("in")).unionByName(t.orders.join(poor, "o_custkey", "left_anti").withColumn("kind", F.lit("out")))


@query("j9_repeated_keys", "key date #n", "SELECT key, date, count(*) AS n FROM snapshots GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return P.duplicate_keys(t.snapshots, ["key", "date"])


@query("j10_common_dates", "date ~a ~b", "SELECT f.date AS date, f1 AS a, port_ret AS b FROM factors f JOIN (SELECT * FROM daily WHERE scoring = 'S1' AND allocation = 'A1') d ON d.date = f.date")
def _(t):
    one = B.portfolio_returns(B.grid_weights(t.signals)).filter("scoring = 'S1' AND allocation = 'A1'")
    return t.factors.select("date", F.col("f1").alias("a")).join(one.select("date", F.col("port_ret").alias("b")), "date")


# De-duplication and order


@query("d1_consensus_per_day", "key date #id periodicity fpi ~n", _D1)
def _(t):
    return _consensus(t)


for _name, _newest in (("d2_actuals_per_day", False), ("q2_latest_actuals", True)):

    @query(_name, "key date #id", _D2.format("DESC" if _newest else "ASC"))
    def _(t, newest=_newest):
        return P.actuals_per_day(t.snapshots, ["key", "date"], "periodicity", "n", [F.col("id")], newest)


@query("d3_keep_last", "#o_custkey #o_orderkey", "SELECT o_custkey, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def _(t):
    return P.first_by(t.orders, ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc())


@query("d5_top_k", "#o_orderkey ~o_totalprice", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def _(t):
    return P.top(t.orders, 5, F.col("o_totalprice").desc(), F.col("o_orderkey"))


@query("d7_calendar", "date", "SELECT DISTINCT date FROM bars")
def _(t):
    return t.bars.select("date").distinct()


# Aggregates


@query("ag1_null_report", "name #n_null ~pct_null has_nulls", "SELECT name, n_null, round(100.0 * n_null / n, 2) AS pct_null, n_null > 0 AS has_nulls FROM (SELECT unnest(['namedt', 'nameenddt', 'label']) AS name, unnest([count(*) FILTER (WHERE namedt IS NULL), count(*) FILTER (WHERE nameenddt IS NULL), count(*) FILTER (WHERE label IS NULL)]) AS n_null, count(*) AS n FROM intervals) c")
def _(t):
    return S.null_report(t.intervals, ["namedt", "nameenddt", "label"]).withColumnRenamed("column", "name")


@query("ag2_distribution", "~min ~max ~mean ~median ~std #n_below #n_above", "SELECT min(ret) AS min, max(ret) AS max, avg(ret) AS mean, median(ret) AS median, stddev_samp(ret) AS std, count(*) FILTER (WHERE ret < -1) AS n_below, count(*) FILTER (WHERE ret > 1) AS n_above FROM returns")
def _(t):
    return S.distribution(t.returns, "ret")


@query("ag17_quantiles", "name ~q05 ~q50 ~q95", "SELECT 'close' AS name, quantile_cont(close, 0.05) AS q05, quantile_cont(close, 0.5) AS q50, quantile_cont(close, 0.95) AS q95 FROM bars UNION ALL SELECT 'vol', quantile_cont(vol, 0.05), quantile_cont(vol, 0.5), quantile_cont(vol, 0.95) FROM bars")
def _(t):
    found = Q.quantiles(t.bars, {"close": [0.05, 0.5, 0.95], "vol": [0.05, 0.5, 0.95]})
    return t.spark.createDataFrame([(c, *x) for c, x in found.items()], "name string, q05 double, q50 double, q95 double")


@query("ag3_class_balance", "#label #n ~pct", "SELECT label, n, 100.0 * n / sum(n) OVER () AS pct FROM (SELECT CAST(target > 0 AS INT) AS label, count(*) AS n FROM signals WHERE target IS NOT NULL GROUP BY 1)")
def _(t):
    return S.class_balance(t.signals, "target")


_FLAGS = ("agreed_long", "agreed_short", "agreed_any", "disagreed")


@query("ag4_agreement", " ".join(f"#{c}_count ~{c}_rate" for c in _FLAGS), "SELECT " + ", ".join(f"sum(CAST({c} AS INT)) AS {c}_count, avg(CAST({c} AS INT)) AS {c}_rate" for c in _FLAGS) + " FROM signals")
def _(t):
    return S.agreement(t.signals)


@query("ag5_by_side", "side #n ~mean_prob_up ~mean_expected_return ~mean_ensemble_score", "SELECT CASE WHEN agreed_long THEN 'long' WHEN agreed_short THEN 'short' ELSE 'none' END AS side, count(*) AS n, avg(prob_up) AS mean_prob_up, avg(expected_return) AS mean_expected_return, avg(ensemble_score) AS mean_ensemble_score FROM signals GROUP BY 1")
def _(t):
    return S.by_side(t.signals)


@query("ag6_portfolio_returns", "scoring allocation date ~port_ret", "SELECT * FROM daily")
def _(t):
    return B.portfolio_returns(B.grid_weights(t.signals))


@query("ag8_positions", "scoring allocation #n_trades ~avg_n_positions", "SELECT scoring, allocation, sum(n) AS n_trades, avg(n) AS avg_n_positions FROM (SELECT scoring, allocation, date, count(*) FILTER (WHERE w <> 0) AS n FROM grid GROUP BY ALL) GROUP BY ALL")
def _(t):
    return B.positions(B.grid_weights(t.signals))


@query("ag9_mean_factors", "date ~rf ~mktrf", "SELECT date, avg(f1) AS rf, avg(f2) AS mktrf FROM bars JOIN factors USING (date) WHERE f1 IS NOT NULL AND f2 IS NOT NULL GROUP BY 1")
def _(t):
    return P.by_key(t.bars, t.factors, {"date": "date"}).dropna(subset=["f1", "f2"]).groupBy("date").agg(F.avg("f1").alias("rf"), F.avg("f2").alias("mktrf"))


@query("ag10_monthly", "scoring allocation date ~port_ret", "SELECT scoring, allocation, last_day(date) AS date, product(1 + port_ret) - 1 AS port_ret FROM daily GROUP BY 1, 2, 3")
def _(t):
    return B.monthly(B.portfolio_returns(B.grid_weights(t.signals)), "port_ret")


@query("ag11_sharpe_matrix", "allocation ~S1 ~S2 ~S6", "SELECT allocation, max(sharpe) FILTER (WHERE scoring = 'S1') AS S1, max(sharpe) FILTER (WHERE scoring = 'S2') AS S2, max(sharpe) FILTER (WHERE scoring = 'S6') AS S6 FROM metrics GROUP BY 1")
def _(t):
    return S.sharpe_matrix(B.metrics(B.portfolio_returns(B.grid_weights(t.signals))), ["S1", "S2", "S6"])


@query("ag12_top_duplicates", "key date #n", "SELECT key, date, count(*) AS n FROM snapshots GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, key, date LIMIT 10")
def _(t):
    return P.top(P.duplicate_keys(t.snapshots, ["key", "date"]), 10, F.col("n").desc(), F.col("key"), F.col("date"))


@query("ag13_multi_row_keys", "rule severity #n", "SELECT 'multi_row_key' AS rule, 'warn' AS severity, count(*) AS n FROM (SELECT key, date FROM snapshots GROUP BY 1, 2 HAVING count(*) > 1)")
def _(t):
    return S.repeated_keys(t.snapshots, ["key", "date"], "multi_row_key", "warn")


@query("ag14_missing_rates", "~id ~n", f"SELECT avg(CAST(id IS NULL AS INT)) AS id, avg(CAST(n IS NULL AS INT)) AS n FROM bars b LEFT JOIN ({_D1}) s ON s.key = b.permno AND s.date = b.date")
def _(t):
    return S.missing_rates(P.by_key(t.bars, _consensus(t), {"permno": "key", "date": "date"}), ["id", "n"])


@query("ag15_value_counts", "value #n", "SELECT lower(p_type) AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def _(t):
    return S.value_counts(t.part, "p_type")


@query("ag16_latest_start", "latest_first", "SELECT max(first) AS latest_first FROM (SELECT min(date) AS first FROM bars GROUP BY permno)")
def _(t):
    return S.latest_start(t.bars)


@query("ag18_best_per_l1", "#l1 ~best", "SELECT l_linenumber AS l1, min(l_extendedprice) AS best FROM lineitem GROUP BY 1")
def _(t):
    return S.best_per(t.lineitem.withColumn("l1", F.col("l_linenumber")), "l1", "l_extendedprice")


@query("ag19_histogram", "#bin #n", "SELECT least(floor((expected_return - lo) / ((hi - lo) / 30)), 29) AS bin, count(*) AS n FROM signals, (SELECT min(expected_return) AS lo, max(expected_return) AS hi FROM signals) WHERE expected_return IS NOT NULL GROUP BY 1")
def _(t):
    return S.histogram(t.signals, "expected_return")


@query("ag21_run_summary", "#n_rows #n_entities #n_dates first_date last_date", "SELECT count(*) AS n_rows, count(DISTINCT permno) AS n_entities, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date FROM bars")
def _(t):
    return S.run_summary(t.bars)


# Windows

_GAPS = "(SELECT e.permno, c.date, close, vol FROM (SELECT DISTINCT permno FROM bars) e CROSS JOIN (SELECT DISTINCT date FROM bars) c LEFT JOIN bars b ON b.permno = e.permno AND b.date = c.date)"


def _gaps(t):
    return P.densified(t.bars, ["close", "vol"], from_latest_start=False)


@query("w1_lags", "permno date ~close_lag1 ~close_lag5 ~vol_lag2", f"SELECT permno, date, lag(close, 1) {_W} AS close_lag1, lag(close, 5) {_W} AS close_lag5, lag(vol, 2) {_W} AS vol_lag2 FROM bars")
def _(t):
    return X.lagged(t.bars, {"close": [1, 5], "vol": 2, "absent": 3})


@query("w3_lead_target", "permno date ~ret_lead1", f"SELECT permno, date, lead(ret) {_W} AS ret_lead1 FROM returns")
def _(t):
    return X.lead_target(t.returns, "ret")


@query("w4_log_returns", "permno date ~close_logret ~vol_logret", f"SELECT permno, date, ln(close / lag(close) {_W}) AS close_logret, ln(vol / lag(vol) {_W}) AS vol_logret FROM bars")
def _(t):
    return X.log_returns(t.bars, ["close", "vol"])


@query("w5_log1p", "#l_orderkey #l_linenumber #l_partkey ~logret", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount * 20 - 1.5 > -1 THEN ln(1 + l_discount * 20 - 1.5) END AS logret FROM lineitem")
def _(t):
    return t.lineitem.withColumn("logret", log1p(F.col("l_discount") * 20 - 1.5))


_FF = "last_value({0} IGNORE NULLS) OVER (PARTITION BY permno ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BF = "first_value({0} IGNORE NULLS) OVER (PARTITION BY permno ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("w6_forward_fill", "permno date ~close ~vol", f"SELECT permno, date, {_FF.format('close')} AS close, {_FF.format('vol')} AS vol FROM {_GAPS}")
def _(t):
    return P.filled(_gaps(t), ["close", "vol"])


for _days in (7, 366):

    @query(f"w6_forward_fill_blocks_{_days}", "permno date ~close ~vol", f"SELECT permno, date, {_FF.format('close')} AS close, {_FF.format('vol')} AS vol FROM {_GAPS}")
    def _(t, days=_days):
        return U.filled_forward_in_blocks(_gaps(t), ["close", "vol"], block_days=days)


@query("w7_fill_both", "permno date ~close", f"SELECT permno, date, coalesce({_FF.format('close')}, {_BF.format('close')}) AS close FROM {_GAPS}")
def _(t):
    return P.filled(_gaps(t), ["close"], "both")


_HOLES = "(SELECT permno, date, CASE WHEN permno % 5 = 0 OR day(date) < 9 THEN NULL ELSE close END AS close, vol FROM bars)"


def _holes(t):
    return t.bars.select("permno", "date", F.when((F.col("permno") % 5 == 0) | (F.dayofmonth("date") < 9), None).otherwise(F.col("close")).alias("close"), "vol")


@query("w8_sentinels", "permno date ~close", f"SELECT permno, date, CASE WHEN count(close) OVER (PARTITION BY permno) = 0 THEN -9999 ELSE close END AS close FROM {_HOLES}")
def _(t):
    return P.with_sentinels(_holes(t), ["close"])


@query("w9_source_dates", "permno date source", f"SELECT permno, date, {_FF.format('CASE WHEN close IS NOT NULL THEN date END')} AS source FROM {_HOLES}")
def _(t):
    return P.filled(P.source_dates(_holes(t), ["close"]), ["close_ffill_source_date"]).withColumn("source", F.col("close_ffill_source_date"))


@query("w10_from_first_complete", "permno date ~close", f"SELECT * FROM (SELECT *, max(CAST(close IS NOT NULL AND vol IS NOT NULL AS INT)) OVER (PARTITION BY permno ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM {_HOLES}) WHERE o = 1")
def _(t):
    return P.from_first_complete(_holes(t), ["close", "vol"])


@query("w10_from_first_complete_blocks", "permno date ~close", f"SELECT * FROM (SELECT *, max(CAST(close IS NOT NULL AND vol IS NOT NULL AS INT)) OVER (PARTITION BY permno ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM {_HOLES}) WHERE o = 1")
def _(t):
    return U.from_first_complete_in_blocks(_holes(t), ["close", "vol"], block_days=30)


@query("w11_forward_fill_and_trim", "permno date ~close", f"SELECT * FROM (SELECT permno, date, CASE WHEN count(close) OVER (PARTITION BY permno) = 0 THEN -9999 ELSE {_FF.format('close')} END AS close FROM {_HOLES}) WHERE close IS NOT NULL")
def _(t):
    return P.forward_filled(_holes(t), ["close"], drop=["vol", "absent"])


@query("w12_volatility", "permno date ~vol20", f"SELECT permno, date, CASE WHEN count(ret) OVER v >= 10 THEN stddev_samp(ret) OVER v END * sqrt(252) AS vol20 FROM returns WINDOW {frame(20)}")
def _(t):
    return t.returns.withColumn("vol20", X.volatility("ret"))


@query("w13_w18_volatility_filled", "permno date ~volatility", "SELECT permno, date, volatility FROM signals")
def _(t):
    return P.cross_section_filled(t.outputs, "volatility")


@query("w14_series_volatility", "date ~rv", "SELECT date, CASE WHEN count(f1) OVER v >= 30 THEN stddev_samp(f1) OVER v END * sqrt(252) AS rv FROM factors WINDOW v AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def _(t):
    return t.factors.withColumn("rv", X.series_volatility("f1"))


_START = "(SELECT max(f) FROM (SELECT min(date) AS f FROM bars GROUP BY permno))"


@query("w15_align", "permno date ~close", f"SELECT * FROM (SELECT permno, date, {_FF.format('close')} AS close FROM {_GAPS}) WHERE date >= {_START}")
def _(t):
    return P.aligned(t.bars, ["close"])


for _final, _value in (("zero", "0"), ("mean", "(SELECT avg(close) FROM bars)"), ("median", "(SELECT median(close) FROM bars)")):

    @query(f"w16_reindex_{_final}", "permno date ~close", f"SELECT permno, date, coalesce(close, {_value}) AS close FROM {_GAPS}")
    def _(t, final=_final):
        return P.filled(_gaps(t), ["close"], "none", final)


#: Every third day of the order dates: with days that no bar has, and without most that one has.
_THIRD = "(SELECT DISTINCT date FROM macro WHERE day(date) % 3 = 0)"
_ON_THIRD = f"(SELECT e.permno, c.date, b.close FROM (SELECT DISTINCT permno FROM bars) e CROSS JOIN {_THIRD} c LEFT JOIN bars b ON b.permno = e.permno AND b.date = c.date)"

for _how, _value in (("bfill", _BF.format("close")), ("both", f"coalesce({_FF.format('close')}, {_BF.format('close')})")):

    @query(f"w16_reindex_{_how}", "permno date ~close", f"SELECT permno, date, {_value} AS close FROM {_ON_THIRD}")
    def _(t, how=_how):
        days = t.macro.select("date").filter(F.dayofmonth("date") % 3 == 0)
        return P.filled(P.densified(t.bars, ["close"], days, from_latest_start=False), ["close"], how)


@query("w17_even_length", "permno date", f"SELECT * FROM (SELECT permno, date, row_number() {_W} AS r, count(*) OVER (PARTITION BY permno) % 252 AS c FROM bars) WHERE r > c")
def _(t):
    return P.even_length(t.bars)


@query("w19_w20_w21_equity", "scoring allocation date ~equity_log ~equity_simple ~drawdown", "SELECT * FROM curve")
def _(t):
    return B.equity(B.portfolio_returns(B.grid_weights(t.signals)))


@query("w19_w20_w21_equity_blocks", "scoring allocation date ~equity_log ~equity_simple ~drawdown", "SELECT * FROM curve")
def _(t):
    return U.equity_in_blocks(T.stored(B.portfolio_returns(B.grid_weights(t.signals))), block_days=91)


@query("w23_overlap", "#custkey #orderkey overlap", "SELECT custkey, orderkey, coalesce(lead(namedt) OVER (PARTITION BY custkey ORDER BY namedt, orderkey) <= coalesce(e, DATE '9999-12-31'), false) AS overlap FROM (SELECT *, CASE WHEN orderkey % 3 = 0 THEN CAST(nameenddt + INTERVAL 2 DAY AS DATE) ELSE nameenddt END AS e FROM intervals)")
def _(t):
    rows = t.intervals.withColumn("e", F.when(F.col("orderkey") % 3 == 0, F.date_add("nameenddt", 2)).otherwise(F.col("nameenddt")))
    return S.overlaps(rows, "custkey", "namedt", "e", "orderkey")


# Ratios


@query("x1_x2_macro_ratios", "date ~vix_ratio ~sector_ratio", "SELECT date, p1_avg / p2_avg AS vix_ratio, p3_max / p2_avg AS sector_ratio FROM macro")
def _(t):
    return t.macro.withColumns({"vix_ratio": ratio("p1_avg", "p2_avg"), "sector_ratio": ratio("p3_max", "p2_avg")})


@query("x3_volatility_premium", "date ~premium", "SELECT m.date AS date, p1_avg - rv AS premium FROM macro m JOIN (SELECT date, CASE WHEN count(f1) OVER v >= 30 THEN stddev_samp(f1) OVER v END * sqrt(252) AS rv FROM factors WINDOW v AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) r ON r.date = m.date")
def _(t):
    return t.macro.join(t.factors.withColumn("rv", X.series_volatility("f1")), "date").withColumn("premium", F.col("p1_avg") - F.col("rv"))


@query("x4_beta_proxy", "permno date ~beta", "SELECT permno, date, ret / nullif(f1 + 1e-8, 0) AS beta FROM returns LEFT JOIN factors USING (date)")
def _(t):
    return P.by_key(t.returns, t.factors, {"date": "date"}).withColumn("beta", X.beta_proxy(F.col("ret"), F.col("f1")))


@query("x5_feature_panel", "permno date ~close_logret ~close_logret_lag1 ~vol20 ~beta ~close_logret_lead1", f"SELECT permno, date, ret AS close_logret, lag(ret) {_W} AS close_logret_lag1, CASE WHEN count(ret) OVER v >= 10 THEN stddev_samp(ret) OVER v END * sqrt(252) AS vol20, ret / nullif(f1 + 1e-8, 0) AS beta, lead(ret) {_W} AS close_logret_lead1 FROM (SELECT * FROM returns LEFT JOIN factors USING (date)) WINDOW {frame(20)}")
def _(t):
    df = X.log_returns(P.by_key(t.bars, t.factors, {"date": "date"}), ["close"])
    df = df.withColumns({"vol20": X.volatility("close_logret"), "beta": X.beta_proxy(F.col("close_logret"), F.col("f1"))})
    return X.lead_target(X.lagged(df, {"close_logret": 1}), "close_logret")


# Indicators

_COLS = dict(open_="open", high="high", low="low", close="close", vol="vol")


def _indicators(t):
    return X.windowed_indicators(t.bars, **_COLS)


_N = f"row_number() {_W} AS n"
_IND = {
    "t4_bollinger": ("bbp_20", f"SELECT permno, date, CASE WHEN n >= 20 THEN (close - (avg(close) OVER v - 2 * stddev_pop(close) OVER v)) / nullif(4 * stddev_pop(close) OVER v, 0) END AS ti_bbp_20 FROM (SELECT *, {_N} FROM bars) WINDOW {frame(20)}"),
    "t5_money_flow": ("mfi_14", f"SELECT permno, date, CASE WHEN n >= 15 THEN 100 * sum(CASE WHEN d > 0 THEN tp * vol WHEN d IS NOT NULL THEN 0 END) OVER v / nullif(sum(CASE WHEN d > 0 THEN tp * vol WHEN d IS NOT NULL THEN 0 END) OVER v + sum(CASE WHEN d < 0 THEN tp * vol WHEN d IS NOT NULL THEN 0 END) OVER v, 0) END AS ti_mfi_14 FROM (SELECT *, tp - lag(tp) {_W} AS d FROM (SELECT *, (high + low + close) / 3 AS tp, {_N} FROM bars)) WINDOW {frame(14)}"),
    "t8_chaikin": ("cmf_20", f"SELECT permno, date, CASE WHEN n >= 20 THEN sum(vol * (close - open) / nullif(high - low, 0)) OVER v / nullif(sum(vol) OVER v, 0) END AS ti_cmf_20 FROM (SELECT *, {_N} FROM bars) WINDOW {frame(20)}"),
    "t9_ease_of_movement": ("eom_14", f"SELECT permno, date, CASE WHEN n >= 15 THEN avg(e) OVER v END AS ti_eom_14 FROM (SELECT *, ((high + low) / 2 - lag((high + low) / 2) {_W}) / nullif(vol / 1e8 / nullif(high - low, 0), 0) AS e, {_N} FROM bars) WINDOW {frame(14)}"),
    "t10_variance": ("var_21", f"SELECT permno, date, CASE WHEN n >= 21 THEN var_samp(close) OVER v END AS ti_var_21 FROM (SELECT *, {_N} FROM bars) WINDOW {frame(21)}"),
    "t11_stochastic": ("stoch_14_3", f"SELECT permno, date, CASE WHEN n >= 16 THEN avg(k) OVER v END AS ti_stoch_14_3 FROM (SELECT *, 100 * (close - min(low) OVER w) / nullif(max(high) OVER w - min(low) OVER w, 0) AS k, {_N} FROM bars WINDOW {frame(14, 'w')}) WINDOW {frame(3)}"),
    "t14_aroon": ("aroon_25", f"SELECT permno, date, CASE WHEN n >= 26 THEN 4.0 * ((n + (min(row(low, -n)) OVER v)[2]) - (n - (max(row(high, n)) OVER v)[2])) END AS ti_aroon_25 FROM (SELECT *, {_N} FROM bars) WINDOW {frame(26)}"),
    "t2_true_range": ("tr", f"SELECT permno, date, greatest(high - low, abs(high - lag(close) {_W}), abs(low - lag(close) {_W})) AS ti_tr FROM bars"),
}
for _name, (_col, _body) in _IND.items():

    @query(_name, f"permno date {'%' if _col in ('eom_14', 'var_21') else '~'}ti_{_col}", _body)
    def _(t):
        return _indicators(t)


@query("t12_skew", "permno date ~skew_63", f"SELECT permno, date, CASE WHEN count(close) OVER v >= 63 THEN skewness(close) OVER v END AS skew_63 FROM bars WINDOW {frame(63)}")
def _(t):
    return t.bars.withColumn("skew_63", X.skew("close"))


@query("t13_kurtosis", "permno date ~kurt_63", f"SELECT permno, date, CASE WHEN count(close) OVER v >= 63 THEN kurtosis(close) OVER v END AS kurt_63 FROM bars WINDOW {frame(63)}")
def _(t):
    return t.bars.withColumn("kurt_63", X.kurtosis("close"))


_STEP = "CASE WHEN {1} IS NULL THEN s.{0} WHEN s.{0} IS NULL THEN {1} ELSE s.{0} + ({1} - s.{0}) / {2}.0 END"
_UP, _DOWN = "CASE WHEN r.up > r.down AND r.up > 0 THEN r.up ELSE 0 END", "CASE WHEN r.down > r.up AND r.down > 0 THEN r.down ELSE 0 END"
#: States carried from row to row: seeds of an entity's first row, then one step a round.
_RECURSIVE = f"""
WITH RECURSIVE r AS MATERIALIZED (SELECT permno, date, high AS h, low AS l, close AS c, row_number() {_W} AS n, close - lag(close) {_W} AS d, high - lag(high) {_W} AS up, lag(low) {_W} - low AS down, greatest(high - low, abs(high - lag(close) {_W}), abs(low - lag(close) {_W})) AS tr FROM bars),
s AS (
SELECT permno, date, n, CAST(NULL AS DOUBLE) AS gain, CAST(NULL AS DOUBLE) AS loss, tr AS atr14, tr AS atr7, c AS fast, c AS slow, CAST(0 AS DOUBLE) AS plus, CAST(0 AS DOUBLE) AS minus, CAST(NULL AS DOUBLE) AS adx, true AS rising, l AS sar, h AS extreme, CAST(0.02 AS DOUBLE) AS factor FROM r WHERE n = 1
UNION ALL
SELECT permno, date, n, gain, loss, atr14, atr7, fast, slow, plus, minus, CASE WHEN dx IS NULL THEN adx0 WHEN adx0 IS NULL THEN dx ELSE adx0 + (dx - adx0) / 14.0 END,
  rising <> turned, CASE WHEN turned THEN extreme ELSE sar END, CASE WHEN turned THEN (CASE WHEN rising THEN l ELSE h END) WHEN further THEN (CASE WHEN rising THEN h ELSE l END) ELSE extreme END,
  CASE WHEN turned THEN CAST(0.02 AS DOUBLE) WHEN further THEN least(factor + 0.02, 0.2) ELSE factor END
FROM (SELECT *, 100 * abs(plus / nullif(atr14, 0) - minus / nullif(atr14, 0)) / nullif(plus / nullif(atr14, 0) + minus / nullif(atr14, 0), 0) AS dx, CASE WHEN rising THEN l < sar ELSE h > sar END AS turned, CASE WHEN rising THEN h > extreme ELSE l < extreme END AS further FROM (
  SELECT r.permno, r.date, r.n, r.h, r.l, {_STEP.format('gain', 'greatest(r.d, 0)', 14)} AS gain, {_STEP.format('loss', 'greatest(-r.d, 0)', 14)} AS loss, {_STEP.format('atr14', 'r.tr', 14)} AS atr14, {_STEP.format('atr7', 'r.tr', 7)} AS atr7,
    s.fast + 2.0 / 13 * (r.c - s.fast) AS fast, s.slow + 2.0 / 27 * (r.c - s.slow) AS slow, {_STEP.format('plus', _UP, 14)} AS plus, {_STEP.format('minus', _DOWN, 14)} AS minus, s.adx AS adx0, s.rising, s.sar + s.factor * (s.extreme - s.sar) AS sar, s.extreme, s.factor
  FROM s JOIN r ON r.permno = s.permno AND r.n = s.n + 1)))
SELECT permno, date, CASE WHEN n >= 14 THEN 100 * gain / nullif(gain + loss, 0) END AS ti_rsi_14, CASE WHEN n >= 14 THEN atr14 END AS ti_atr_14, CASE WHEN n >= 7 THEN atr7 END AS ti_atr_7, CASE WHEN n >= 26 THEN fast - slow END AS ti_macd_12_26, CASE WHEN n >= 14 THEN adx END AS ti_adx_14, factor AS ti_psar_af FROM s"""


@query("t1_t2_t3_t6_t7_recursive", "permno date " + " ".join(f"~ti_{n}" for n in ("rsi_14", "atr_14", "atr_7", "macd_12_26", "adx_14", "psar_af")), _RECURSIVE)
def _(t):
    return recursive_indicators(t.bars, "high", "low", "close")


@query("r11_daily_state", "permno date " + " ".join(f"~ti_{n}" for n in ("rsi_14", "atr_14", "atr_7", "macd_12_26", "adx_14", "psar_af")) + " ~ti_bbp_20", f"SELECT i.*, b.ti_bbp_20 FROM ({_RECURSIVE}) i JOIN (SELECT permno, date, CASE WHEN n >= 20 THEN (close - (avg(close) OVER v - 2 * stddev_pop(close) OVER v)) / nullif(4 * stddev_pop(close) OVER v, 0) END AS ti_bbp_20 FROM (SELECT *, {_N} FROM bars) WINDOW {frame(20)}) b USING (permno, date) WHERE date >= DATE '1997-01-01'")
def _(t):
    # Whole histories up to 1996 once; each year since then from the state that the one before left.
    bars, folder = T.stored(t.bars), T.scratch(t.spark)
    E.begin(bars.filter("date < DATE '1997-01-01'"), folder, high="high", low="low", close="close")
    features = lambda df: X.windowed_indicators(df, "open", "high", "low", "close", "vol")
    years = [T.half_open(bars, a, b) for a, b in (("1997-01-01", "1998-01-01"), ("1998-01-01", None))]
    runs = [E.run_days(y, folder, features, high="high", low="low", close="close") for y in years if not y.isEmpty()]
    return runs[0].unionByName(runs[1]) if len(runs) > 1 else runs[0]


for _days in (7, 366):

    @query(f"t1_t2_t3_t6_scan_{_days}", "permno date " + " ".join(f"~ti_{n}" for n in ("rsi_14", "atr_14", "atr_7", "macd_12_26", "adx_14")), _RECURSIVE)
    def _(t, days=_days):
        return scanned_indicators(t.bars, "high", "low", "close", block_days=days)


#: Stand-ins for macro series: prices of an order priority each; the first without volume, the last with closes alone.
_MACRO = {"^VIX": ("p1", 0.0), "^GSPC": ("p2", 1e6), "^IXIC": ("p3", None), "^RUT": ("p4", None), "XLK": ("p5", None)}


def _comm(t):
    made = {}
    for s, (p, volume) in _MACRO.items():
        made[f"comm_{s}_close"] = F.col(f"{p}_avg")
        if volume is not None:
            made |= {f"comm_{s}_open": (F.col(f"{p}_min") + F.col(f"{p}_max")) / 2, f"comm_{s}_high": F.col(f"{p}_max"), f"comm_{s}_low": F.col(f"{p}_min"), f"comm_{s}_volume": F.lit(volume)}
    return t.macro.select("date", *[c.alias(n) for n, c in made.items()])


def _plain(df):
    """Names that SQL takes unquoted."""
    return df.toDF(*[c.replace("^", "") for c in df.columns])


_INDEX = {"bbp_20": "t4_bollinger", "stoch_14_3": "t11_stochastic", "aroon_25": "t14_aroon"}
_INDEX_BARS = "WITH bars AS (" + " UNION ALL ".join(f"SELECT {i} AS permno, date, ({p}_min + {p}_max) / 2 AS open, {p}_max AS high, {p}_min AS low, {p}_avg AS close, CAST({v} AS DOUBLE) AS vol FROM macro WHERE {p}_avg IS NOT NULL" for i, (p, v) in enumerate((("p1", 0), ("p2", 1000000)))) + ")"
_INDEX_OF = {f"comm_ti_{s}_{n}": (f"ti_{n}", _IND[q][1], i) for i, s in enumerate(("VIX", "GSPC")) for n, q in _INDEX.items()} | {f"comm_ti_GSPC_{n}": (f"ti_{n}", _IND[q][1], 1) for n, q in (("mfi_14", "t5_money_flow"), ("cmf_20", "t8_chaikin"))}


@query("t15_index_indicators", "permno date " + " ".join(f"~{n}" for n in _INDEX_OF), f"{_INDEX_BARS} SELECT x.permno, x.date, " + ", ".join(f"i{k}.{c} AS {n}" for k, (n, (c, _, _)) in enumerate(_INDEX_OF.items())) + " FROM returns x " + " ".join(f"LEFT JOIN (SELECT date, {c} FROM ({body}) WHERE permno = {i}) i{k} ON i{k}.date = x.date" for k, (c, body, i) in enumerate(_INDEX_OF.values())))
def _(t):
    found = G.index_indicators(_comm(t), recursive=False)
    assert not {"comm_ti_^VIX_cmf_20", "comm_ti_^VIX_eom_14"} & set(found.columns)  # without any value
    return _plain(P.by_key(t.bars, found, {"date": "date"}))


@query("t15_index_recursive", "date " + " ".join(f"~comm_ti_{s}_{n}" for s in ("VIX", "GSPC") for n in ("rsi_14", "atr_14", "macd_12_26", "adx_14", "psar_af")), f"{_INDEX_BARS} SELECT coalesce(v.date, g.date) AS date, " + ", ".join(f"{a}.ti_{n} AS comm_ti_{s}_{n}" for a, s in (("v", "VIX"), ("g", "GSPC")) for n in ("rsi_14", "atr_14", "macd_12_26", "adx_14", "psar_af")) + f" FROM (SELECT * FROM ({_RECURSIVE}) WHERE permno = 0) v FULL JOIN (SELECT * FROM ({_RECURSIVE}) WHERE permno = 1) g ON g.date = v.date")
def _(t):
    return _plain(G.index_indicators(_comm(t)))


_RET = f"(close / lag(close) {_W} - 1)"
_AUGMENTED = {
    "adj_prc_logret": "y", "vol_logret": f"ln(vol / lag(vol) {_W})", "adj_mktcap_logret": f"ln(close / lag(close) {_W})", "comm_GSPC_close_logret": "g", "comm_XLK_close_logret": f"ln(xlk / lag(xlk) {_W})",
    "ratio_VIX_GSPC": "vix / gspc", "ratio_XLK_GSPC": "xlk / gspc", "ratio_volatility_premium": "premium", "ratio_beta_proxy": "y / nullif(g + 1e-8, 0)",
    "anualized_volatility_20d": "CASE WHEN count(y) OVER v >= 10 THEN stddev_samp(y) OVER v END * sqrt(252)",
    **{f"adj_prc_logret_lag{k}": f"lag(y, {k}) {_W}" for k in range(1, 6)}, "comm_GSPC_close_logret_lag5": f"lag(g, 5) {_W}", "ratio_VIX_GSPC_lag1": f"lag(vix / gspc) {_W}", "ratio_volatility_premium_lag1": f"lag(premium) {_W}", "adj_prc_logret_lead1": f"lead(y) {_W}",
}


def _priced(t):
    """Bars with what a price table has beside them."""
    back = F.lag("close").over(P.history())
    return t.bars.withColumns({"ret": ratio(F.col("close"), back) - 1, "adj_mktcap": 1000 * F.col("close")})


@query("x5_augmented", "permno date ~ti_bbp_20 ~ti_aroon_25 " + " ".join(f"~{n}" for n in _AUGMENTED), "SELECT z.*, ti_bbp_20, ti_aroon_25 FROM (SELECT permno, date, " + ", ".join(f"{e} AS {n}" for n, e in _AUGMENTED.items()) + f" FROM (SELECT *, ln(1 + {_RET}) AS y, ln(gspc / lag(gspc) {_W}) AS g FROM (SELECT b.*, p1_avg AS vix, p2_avg AS gspc, p5_avg AS xlk, premium FROM bars b LEFT JOIN macro m ON m.date = b.date LEFT JOIN (SELECT date, p1_avg - CASE WHEN count(r) OVER w >= 30 THEN stddev_samp(r) OVER w END * sqrt(252) AS premium FROM (SELECT *, ln(p2_avg / lag(p2_avg) OVER (ORDER BY date)) AS r FROM macro) WINDOW w AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) q ON q.date = b.date)) WINDOW {frame(20)}) z JOIN ({_IND['t4_bollinger'][1]}) i ON i.permno = z.permno AND i.date = z.date JOIN ({_IND['t14_aroon'][1]}) j ON j.permno = z.permno AND j.date = z.date")
def _(t):
    return _plain(G.augmented(_priced(t), _comm(t), _COLS, recursive=False))


@query("x5_model_matrix", "permno date ~adj_prc_logret ~ti_rsi_14 ~ti_kurt_63 ~comm_ti_GSPC_adx_14 ~ratio_beta_proxy ~adj_prc_logret_lead1")
def _(t):
    """The whole chain, recursive indicators too: macro gaps filled, selected, heads cut, on one calendar."""
    macro, past = _comm(t), Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a row a date
    macro = macro.select("date", *[F.last(c, True).over(past).alias(c) for c in macro.columns if c != "date"])
    return _plain(G.model_matrix(_priced(t), macro, _COLS))


_D1_FILLED = {c: f"CASE WHEN count({c}) OVER (PARTITION BY permno) = 0 THEN -9999 ELSE {_FF.format(c)} END" for c in ("f1", "n", "p1_avg")}


@query("x0_joined_panel", "permno date ticker ~prc ~f1 ~n ~p1_avg", f"SELECT * FROM (SELECT *, max(CAST(f1 IS NOT NULL AND n IS NOT NULL AND p1_avg IS NOT NULL AS INT)) OVER (PARTITION BY permno ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM (SELECT permno, date, ticker, prc, " + ", ".join(f"{x} AS {c}" for c, x in _D1_FILLED.items()) + f" FROM (SELECT b.permno, b.date, 'T' || b.permno AS ticker, close AS prc, f1, d.n, p1_avg FROM bars b LEFT JOIN factors f ON f.date = b.date LEFT JOIN (SELECT key, date, CASE WHEN key % 4 = 0 THEN NULL ELSE CAST(n AS DOUBLE) END AS n FROM ({_D1})) d ON d.key = b.permno AND d.date = b.date LEFT JOIN macro m ON m.date = b.date WHERE b.permno % 6 <> 1))) WHERE o = 1")
def _(t):
    """Built, checked and published in one pass, then read back."""
    name = lambda c: F.concat(F.lit("T"), F.col(c).cast("string"))
    prices = t.bars.select("permno", "date", name("permno").alias("ticker"), F.col("close").alias("prc"), F.lit(1.0).alias("cfacpr"), F.lit(1.0).alias("cfacshr"))
    consensus = _consensus(t).select(name("key").alias("name"), "date", F.when(F.col("key") % 4 != 0, F.col("n").cast("double")).alias("n"))
    sides = [N.Side(t.factors, {"date": "date"}, ["f1"]), N.Side(consensus, {"ticker": "name", "date": "date"}, ["n"]), N.Side(t.macro, {"date": "date"}, ["p1_avg"])]
    N.build(prices, sides, path := T.scratch(t.spark), [f"T{i}" for i in range(25) if i % 6 != 1])
    return t.spark.read.parquet(path)


# Splits and models


@query("m1_split", "permno date in_sample", "SELECT permno, date, date < (SELECT date FROM calendar WHERE t = floor(n * 0.65)) AS in_sample FROM bars")
def _(t):
    return M.split(t.bars)


@query("m2_m3_folds", "#fold role date", "SELECT fold, CASE WHEN t < fold * step + a THEN 'train' ELSE 'val' END AS role, date FROM calendar, (SELECT a, b, step, unnest(range((n - a - b) // step + 1)) AS fold FROM (SELECT n, a, b, greatest(1, (n - a - b) // 9) AS step FROM (SELECT count(*) AS n, CAST(floor(count(*) * 0.6) AS BIGINT) AS a, CAST(floor(count(*) * 0.2) AS BIGINT) AS b FROM (SELECT DISTINCT date FROM bars)))) WHERE t >= fold * step AND t < fold * step + a + b")
def _(t):
    return M.fold_dates(t.bars, M.fold_geometry(M.calendar(t.bars).count()))


@query("m4_target", "permno date #up", "SELECT permno, date, CAST(target > 0 AS INT) AS up FROM signals WHERE target IS NOT NULL")
def _(t):
    return t.signals.filter("target IS NOT NULL").withColumn("up", (F.col("target") > 0).cast("int"))


@query("m5_scaling", "permno date ~prob_up ~volatility", "SELECT permno, date, (prob_up - avg(prob_up) OVER ()) / stddev_pop(prob_up) OVER () AS prob_up, (volatility - avg(volatility) OVER ()) / stddev_pop(volatility) OVER () AS volatility FROM signals")
def _(t):
    return M.scaled(t.signals, M.scale_of(t.signals, ["prob_up", "volatility"]))


def _features(t):
    rows = X.lagged(t.returns, {"ret": [1, 2, 3]}).withColumn("vol20", X.volatility("ret", 20, 10, None))
    return M.split(X.lead_target(rows, "ret")), ["ret", "ret_lag1", "ret_lag2", "ret_lag3", "vol20"]


@query("m6_m7_m10_models_scored", "permno date ~prob_up ~prob_down ~logistic_score ~expected_return")
def _(t):
    rows, names = _features(t)
    inside = rows.filter("in_sample").persist()
    up, mean = M.fit_logistic(inside, names, "ret_lead1"), M.fit_linear(inside, names, "ret_lead1")
    inside.unpersist()
    out = mean.scored(up.scored(rows.dropna(subset=names), "prob_up"), "expected_return")
    return out.withColumns({"prob_down": 1 - F.col("prob_up"), "logistic_score": 2 * F.col("prob_up") - 1})


@query("m8_m9_grid_search", "model ~l1_ratio ~setting ~error #combo_order")
def _(t):
    rows, names = _features(t)
    folds = M.fold_dates(rows.filter("in_sample"), M.fold_geometry(M.calendar(rows.filter("in_sample")).count()))
    a = M.grid_search(rows, folds, names, "ret_lead1", {"C": (0.1, 0.5, 1.0), "l1_ratio": (0.8, 0.9)}, True)
    b = M.grid_search(rows, folds, names, "ret_lead1", {"alpha": (5e-6, 5e-5, 5e-4, 1e-6, 1e-5, 1e-4), "l1_ratio": (0.4, 0.5, 0.6)}, False)
    found = [("logistic", x["l1_ratio"], x["C"], x["error"], x["combo_order"]) for x in a] + [("linear", x["l1_ratio"], x["alpha"], x["error"], x["combo_order"]) for x in b]
    return t.spark.createDataFrame(found, "model string, l1_ratio double, setting double, error double, combo_order int")


@query("m8_m9_ag18_refit", "model ~l1_ratio ~setting ~error chosen ~refit_error")
def _(t):
    """The least error of each l1_ratio over the whole grids, the setting chosen of all, and the refitted model's error out of sample."""
    rows, names = _features(t)
    rows = T.stored(rows)
    out = []
    for model, grid, logistic in (("logistic", Y.LOGISTIC, True), ("linear", Y.LINEAR, False)):
        found = Y.tuned(rows.filter("in_sample"), names, "ret_lead1", grid, logistic)
        tried = found.model.scored(rows.filter("NOT in_sample AND ret_lead1 IS NOT NULL"), "called").dropna(subset=["called"])
        wrong = F.avg(((F.col("called") > 0.5) != (F.col("ret_lead1") > 0)).cast("double")) if logistic else F.sqrt(F.avg((F.col("called") - F.col("ret_lead1")) ** 2))
        error = tried.agg(wrong).first()[0]
        out += [(model, x["l1_ratio"], x["C" if logistic else "alpha"], x["error"], x == found.best, error if x == found.best else None) for x in found.per_ratio()]
    return t.spark.createDataFrame(out, "model string, l1_ratio double, setting double, error double, chosen boolean, refit_error double")


@query("r11_fit_to_trades", "permno ~prob_up ~expected_return ~weight ~conviction action scoring allocation")
def _(t):
    """From features to trades in one run: both grids, refit, scores, the whole backtest, the best pair, the next day."""
    rows, names = _features(t)
    run = Y.fit_to_trades(rows.drop("in_sample"), names, "ret", "ret_lead1")
    return run.trades.withColumns({"scoring": F.lit(run.scoring), "allocation": F.lit(run.allocation)})


@query("m13_top_predictors", "feature ~coefficient")
def _(t):
    rows, names = _features(t)
    return M.top_predictors(M.fit_linear(rows.filter("in_sample"), names, "ret_lead1"), t.spark)


_PRED = "(SELECT CAST(target > 0 AS INT) AS up, CAST(prob_up > 0.5 AS INT) AS called FROM signals WHERE target IS NOT NULL)"


def _called(t):
    return t.signals.filter("target IS NOT NULL").select((F.col("target") > 0).cast("int").alias("up"), (F.col("prob_up") > 0.5).cast("int").alias("called"))


@query("m11_classification_report", "#label ~precision ~recall ~f1 #support ~accuracy ~error", "SELECT k AS label, count(*) FILTER (WHERE up = k AND called = k) / nullif(count(*) FILTER (WHERE called = k), 0) AS precision, count(*) FILTER (WHERE up = k AND called = k) / nullif(count(*) FILTER (WHERE up = k), 0) AS recall, 2.0 * count(*) FILTER (WHERE up = k AND called = k) / nullif(count(*) FILTER (WHERE called = k) + count(*) FILTER (WHERE up = k), 0) AS f1, count(*) FILTER (WHERE up = k) AS support, avg(CAST(up = called AS INT)) AS accuracy, 1 - avg(CAST(up = called AS INT)) AS error FROM " + _PRED + ", (SELECT unnest([0, 1]) AS k) GROUP BY k")
def _(t):
    return M.classification_report(_called(t), "up", "called")


@query("m11_confusion", "#label #predicted #n", "SELECT up AS label, called AS predicted, count(*) AS n FROM " + _PRED + " GROUP BY 1, 2")
def _(t):
    return M.confusion(_called(t), "up", "called")


@query("m12_regression_report", "~rmse ~r2 ~mae ~baseline_rmse ~improvement_pct", "SELECT *, 100 * (baseline_rmse - rmse) / baseline_rmse AS improvement_pct FROM (SELECT sqrt(avg((a - p) * (a - p))) AS rmse, 1 - sum((a - p) * (a - p)) / (sum(a * a) - sum(a) * avg(a)) AS r2, avg(abs(a - p)) AS mae, sqrt(avg((a - b) * (a - b))) AS baseline_rmse FROM (SELECT 100 * target AS a, 100 * expected_return AS p, 0.5 AS b FROM signals WHERE target IS NOT NULL AND expected_return IS NOT NULL))")
def _(t):
    rows = t.signals.select((100 * F.col("target")).alias("a"), (100 * F.col("expected_return")).alias("p"), F.lit(0.5).alias("b"))
    return M.regression_report(rows, "a", "p", "b")


# Signals and allocation


@query("g1_g2_g3_signals", "permno date logistic_signal_long logistic_signal_short linear_signal_long linear_signal_short agreed_long agreed_short agreed_any disagreed ~ensemble_score", "SELECT * FROM signals")
def _(t):
    return t.signals


@query("g4_g5_g6_scores", "permno date ~score_S1 ~score_S2 ~score_S6", "SELECT * FROM signals")
def _(t):
    return t.signals


@query("k1_k2_normalise_and_cap", "permno date ~w", "SELECT permno, date, CASE WHEN c > 0 THEN c / sum(CASE WHEN c > 0 THEN c END) OVER d * 0.5 WHEN c < 0 THEN c / sum(CASE WHEN c < 0 THEN -c END) OVER d * 0.5 ELSE c END AS w FROM (SELECT *, greatest(least(expected_return, 0.01), -0.01) AS c FROM signals) WINDOW d AS (PARTITION BY date)")
def _(t):
    return A.capped(t.signals.withColumn("w", F.col("expected_return")), "w", 0.01)


_NO = {"A1": "k3_a1_equal", "A2": "k4_a2_score", "A3": "k5_a3_quantile", "A4": "k6_a4_threshold", "A5": "k7_a5_scaled", "A7": "k10_a7_inverse_volatility", "A8": "k11_a8_softmax", "A9": "k12_a9_kelly"}
for _a in NAMES:

    @query(_NO[_a], "scoring permno date ~w", f"SELECT scoring, permno, date, w FROM weights WHERE allocation = '{_a}'")
    def _(t, a=_a):
        return B.grid_weights(t.signals, (a,))


@query("k8_covariances", "date #a #b ~cov", "SELECT l.date AS date, l.permno AS a, r.permno AS b, coalesce(covar_samp(l.r, r.r), 0) + CASE WHEN l.permno = r.permno THEN 1e-4 ELSE 0 END AS cov FROM (SELECT n.date, n.permno, x.t, x.r FROM (SELECT date, permno, c.t AS at FROM signals JOIN calendar c USING (date) WHERE agreed_any) n JOIN (SELECT permno, c.t AS t, coalesce(ret, 0) AS r FROM returns JOIN calendar c USING (date)) x ON x.permno = n.permno AND x.t < n.at AND x.t >= n.at - 252) l JOIN (SELECT n.date, n.permno, x.t, x.r FROM (SELECT date, permno, c.t AS at FROM signals JOIN calendar c USING (date) WHERE agreed_any) n JOIN (SELECT permno, c.t AS t, coalesce(ret, 0) AS r FROM returns JOIN calendar c USING (date)) x ON x.permno = n.permno AND x.t < n.at AND x.t >= n.at - 252) r ON l.date = r.date AND l.t = r.t GROUP BY 1, 2, 3")
def _(t):
    return A.covariances(t.returns, t.signals.filter("agreed_any").select("date", "permno"))


@query("k9_a6_max_sharpe", "permno date ~A6")
def _(t):
    return A.max_sharpe_from_returns(t.signals, t.returns)


# Backtest and reports

_METRICS = "n_periods total_return ann_return ann_vol sharpe sortino calmar max_drawdown win_rate avg_daily_ret daily_vol".split()
_SHOWN = "scoring allocation #n_periods " + " ".join(f"~{m}" for m in _METRICS[1:])


def _sides(t):
    """Daily returns of the grid, each in sample or out of it: one scan for both."""
    return B.sides(B.portfolio_returns(B.grid_weights(t.signals)))


def _both(t):
    """Metrics of the grid by pair and side."""
    return B.metrics(_sides(t), (*B.COMBO, "in_sample"))


@query("r1_r3_grid", _SHOWN, "SELECT * FROM metrics")
def _(t):
    return B.metrics(B.portfolio_returns(B.grid_weights(t.signals)))


@query("r2_single_backtest", _SHOWN, "SELECT * FROM metrics WHERE scoring = 'S2' AND allocation = 'A3'")
def _(t):
    return B.metrics(B.portfolio_returns(B.grid_weights(t.signals, ("A3",)).filter("scoring = 'S2'")))


def _own_weights(rows):
    """A user's allocation: the net long half over the positive scores, in equal parts; it has no answer for the 13th."""
    if rows["date"].iloc[0].day == 13:
        raise ValueError("no weights today")
    up = rows["score"] > 0
    return up * (0.5 / max(int(up.sum()), 1))


_OWN = "CASE WHEN day(date) = 13 OR score IS NULL OR score <= 0 THEN 0 ELSE 0.5 / count(*) FILTER (WHERE score > 0) OVER (PARTITION BY scoring, date) END"


@query("r2_user_allocation", "scoring allocation date ~port_ret", f"SELECT scoring, 'own' AS allocation, date, coalesce(sum(w * target), 0) AS port_ret FROM (SELECT *, {_OWN} AS w FROM scored) GROUP BY scoring, date")
def _(t):
    return B.portfolio_returns(B.user_backtest(t.signals, _own_weights, "own")[0])


@query("r2_user_errors", "scoring date allocation error #n", "SELECT scoring, date, 'own' AS allocation, 'ValueError: no weights today' AS error, count(*) AS n FROM scored WHERE day(date) = 13 GROUP BY scoring, date")
def _(t):
    return B.user_backtest(t.signals, _own_weights, "own")[1]


@query("r4_equity_curve", "scoring allocation date ~equity_log", "SELECT scoring, allocation, date, 1000 * equity_log AS equity_log FROM curve WHERE scoring = 'S1'")
def _(t):
    return B.equity(B.portfolio_returns(B.grid_weights(t.signals).filter("scoring = 'S1'")), capital=1000.0)


_ORDER = "ORDER BY round(sharpe, 9) DESC, (list_position(['S1', 'S2', 'S6'], scoring) - 1) * 5 + list_position(['A1', 'A2', 'A3', 'A4', 'A5'], allocation)"
for _how, _k in (("best", 1), ("top", 5), ("all", 15)):

    @query(f"r5_choose_{_how}", "scoring allocation", f"SELECT scoring, allocation FROM metrics_is {_ORDER} LIMIT {_k}")
    def _(t, how=_how):
        return B.chosen(B.metrics(_sides(t).filter("in_sample")), how)


@query("r6_out_of_sample", _SHOWN, f"SELECT * FROM metrics_oos WHERE (scoring, allocation) IN (SELECT (scoring, allocation) FROM metrics_is {_ORDER} LIMIT 5)")
def _(t):
    return B.out_of_sample(_both(t), "top")


@query("r7_r8_degradation", "scoring allocation ~sharpe_degradation ~ann_return_degradation ~ann_vol_degradation assessment", "SELECT *, CASE WHEN sharpe_degradation < 15 THEN 'excellent' WHEN sharpe_degradation < 30 THEN 'good' WHEN sharpe_degradation < 50 THEN 'moderate' ELSE 'severe' END AS assessment FROM (SELECT i.scoring, i.allocation, " + ", ".join(f"100 * (i.{c} - o.{c}) / nullif(abs(i.{c}), 0) AS {c}_degradation" for c in ("sharpe", "ann_return", "ann_vol")) + " FROM metrics_is i JOIN metrics_oos o ON o.scoring = i.scoring AND o.allocation = i.allocation)")
def _(t):
    return B.degradation(_both(t))


_REPORT = "SELECT scoring, allocation, date, strategy, coalesce(last_value(f1 IGNORE NULLS) OVER p, first_value(f1 IGNORE NULLS) OVER a) * 0.001 AS rf, coalesce(last_value(f2 IGNORE NULLS) OVER p, first_value(f2 IGNORE NULLS) OVER a) * 0.01 + coalesce(last_value(f1 IGNORE NULLS) OVER p, first_value(f1 IGNORE NULLS) OVER a) * 0.001 AS benchmark FROM (SELECT c.scoring, c.allocation, c.date, equity_simple / lag(equity_simple) OVER s - 1 AS strategy, row_number() OVER s AS rn FROM curve c WINDOW s AS (PARTITION BY scoring, allocation ORDER BY c.date)) LEFT JOIN factors USING (date) WHERE rn > 1 WINDOW p AS (PARTITION BY scoring, allocation ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY scoring, allocation ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_MONTHLY = f"SELECT scoring, allocation, last_day(date) AS date, product(1 + strategy) - 1 AS strategy, product(1 + rf) - 1 AS rf, product(1 + benchmark) - 1 AS benchmark FROM ({_REPORT}) GROUP BY 1, 2, 3"
for _freq, _body in (("daily", _REPORT), ("monthly", _MONTHLY)):

    @query(f"r9_r10_report_{_freq}", "scoring allocation date freq ~strategy ~rf ~benchmark ~excess", f"SELECT *, strategy - rf AS excess, '{_freq}' AS freq FROM ({_body})")
    def _(t, freq=_freq):
        return B.report(B.portfolio_returns(B.grid_weights(t.signals)), t.factors.select("date", (0.01 * F.col("f2")).alias("mktrf"), (0.001 * F.col("f1")).alias("rf")), freq, days=t.bars)


@query("src11_src12_report_sink", "scoring allocation date freq ~strategy ~excess", f"SELECT *, strategy - rf AS excess, 'daily' AS freq FROM ({_REPORT})")
def _(t):
    """Written by scoring, allocation and frequency, and read back."""
    rows = B.report(B.portfolio_returns(B.grid_weights(t.signals)), t.factors.select("date", (0.01 * F.col("f2")).alias("mktrf"), (0.001 * F.col("f1")).alias("rf")), days=t.bars)
    T.write_report(rows, path := T.scratch(t.spark))
    return t.spark.read.parquet(path)


@query("src12_report_by_runs", "scoring allocation date freq ~strategy ~excess", f"SELECT *, strategy - rf AS excess, 'daily' AS freq FROM ({_REPORT})")
def _(t):
    """Runs of some pairs at a time leave the others' rows, and a repeated run changes nothing."""
    rows = T.stored(B.report(B.portfolio_returns(B.grid_weights(t.signals)), t.factors.select("date", (0.01 * F.col("f2")).alias("mktrf"), (0.001 * F.col("f1")).alias("rf")), days=t.bars))
    path = T.scratch(t.spark)
    for part in ("scoring = 'S1'", "scoring <> 'S1' AND allocation = 'A1'", "scoring <> 'S1'", "allocation = 'A3'"):
        T.write_report(rows.filter(part), path)
    return t.spark.read.parquet(path)


_TRADES = "SELECT permno, prob_up, expected_return, w AS weight, abs(score) AS conviction, CASE WHEN w > 0 THEN 'BUY' ELSE 'SELL-SHORT' END AS action FROM weights WHERE scoring = 'S1' AND allocation = 'A1' AND date = (SELECT max(date) FROM bars) AND w <> 0"


def _trades(t):
    return B.trade_list(B.grid_weights(t.signals, ("A1",)).filter("scoring = 'S1'"))


@query("r11_trade_list", "permno ~prob_up ~expected_return ~weight ~conviction action", _TRADES)
def _(t):
    return _trades(t).orderBy(F.col("weight").desc(), "permno")


@query("ag20_scenarios", "~expected ~volatility ~pessimistic ~optimistic", f"SELECT *, expected - 1.96 * volatility AS pessimistic, expected + 1.96 * volatility AS optimistic FROM (SELECT coalesce(sum(weight * expected_return), 0) AS expected, coalesce(sqrt(sum(weight * weight)), 0) * 0.015 AS volatility FROM ({_TRADES}))")
def _(t):
    return B.scenarios(_trades(t))


_LINEAR = "0.4 * ret_lag1 + 0.2 * ret_lag2"


@query("r11_next_day", "permno ~prob_up ~expected_return ~weight ~conviction action", f"SELECT permno, prob_up, expected_return, w AS weight, abs((prob_up - 0.5) * expected_return) AS conviction, CASE WHEN w > 0 THEN 'BUY' ELSE 'SELL-SHORT' END AS action FROM (SELECT *, CASE WHEN c > 0 THEN c / sum(CASE WHEN c > 0 THEN c END) OVER () * 0.5 WHEN c < 0 THEN c / sum(CASE WHEN c < 0 THEN -c END) OVER () * 0.5 ELSE 0 END AS w FROM (SELECT *, greatest(least(CASE WHEN up THEN x / sum(CASE WHEN up THEN x END) OVER () * 0.5 WHEN down THEN -x / sum(CASE WHEN down THEN x END) OVER () * 0.5 ELSE 0 END, 0.05), -0.05) AS c FROM (SELECT *, prob_up > 0.55 AND expected_return > 0.001 AS up, prob_up < 0.45 AND expected_return < -0.001 AS down, 1 / (volatility + 1e-8) AS x FROM (SELECT permno, date, 1 / (1 + exp(-({_LINEAR}))) AS prob_up, 0.01 * ({_LINEAR}) AS expected_return, CASE WHEN count(ret) OVER v >= 20 THEN stddev_samp(ret) OVER v END AS volatility FROM (SELECT *, lag(ret, 1) {_W} AS ret_lag1, lag(ret, 2) {_W} AS ret_lag2 FROM returns) WINDOW {frame(20)}) WHERE date = (SELECT max(date) FROM bars)))) WHERE w <> 0")
def _(t):
    names, one = ["ret_lag1", "ret_lag2"], {"ret_lag1": (0.0, 1.0), "ret_lag2": (0.0, 1.0)}
    up, mean = M.Fitted(names, one, [0.4, 0.2], 0.0, True), M.Fitted(names, one, [0.004, 0.002], 0.0, False)
    return B.next_day(X.lagged(t.returns, {"ret": [1, 2]}), up, mean, "S2", "A7", "ret")


# Data quality


@query("v1_price_findings", "rule severity #n", "SELECT unnest(['negative_l_tax', 'zero_l_tax', 'negative_price', 'repeated_key']) AS rule, unnest(['error', 'warn', 'warn', 'error']) AS severity, unnest([count(*) FILTER (WHERE l_tax < 0), count(*) FILTER (WHERE l_tax = 0), count(*) FILTER (WHERE l_extendedprice < 0), (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))]) AS n FROM lineitem")
def _(t):
    return S.price_findings(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_tax"], "l_extendedprice")


@query("v2_interval_findings", "rule severity #n", "SELECT unnest(['start_after_end', 'overlap']) AS rule, unnest(['error', 'warn']) AS severity, unnest([count(*) FILTER (WHERE namedt > nameenddt), count(*) FILTER (WHERE o)]) AS n FROM (SELECT *, coalesce(lead(namedt) OVER (PARTITION BY custkey ORDER BY namedt, orderkey) <= coalesce(nameenddt, DATE '9999-12-31'), false) AS o FROM intervals)")
def _(t):
    return S.interval_findings(t.intervals, "custkey", "namedt", "nameenddt", "orderkey")


@query("v3_factor_findings", "rule severity #n", "SELECT unnest(['missing_f1', 'missing_f2', 'infinite_f1', 'infinite_f2', 'infinite_f3', 'large_f1', 'large_f2', 'large_rf', 'repeated_key']) AS rule, unnest(['warn', 'warn', 'warn', 'warn', 'warn', 'warn', 'warn', 'warn', 'error']) AS severity, unnest([count(*) FILTER (WHERE f1 IS NULL), count(*) FILTER (WHERE f2 IS NULL), count(*) FILTER (WHERE isinf(f1)), count(*) FILTER (WHERE isinf(f2)), count(*) FILTER (WHERE isinf(f3)), count(*) FILTER (WHERE abs(f1) > 0.5), count(*) FILTER (WHERE abs(f2) > 0.5), count(*) FILTER (WHERE abs(f3) > 0.05), (SELECT count(*) FROM (SELECT date FROM factors GROUP BY 1 HAVING count(*) > 1))]) AS n FROM factors")
def _(t):
    return S.factor_findings(t.factors, ["f1", "f2"], "f3")


_MULTI = "SELECT 'multi_row_key' AS rule, 'info' AS severity, count(*) AS n FROM (SELECT key, date FROM snapshots {0} GROUP BY 1, 2 HAVING count(*) > 1)"


@query("v4_consensus_findings", "rule severity #n", _MULTI.format(""))
def _(t):
    return S.consensus_findings(t.snapshots.select(F.col("key").alias("official_ticker"), F.col("date").alias("stat_date"), "periodicity", "fpi", F.col("id").alias("n_analysts"), F.col("n").alias("cons_mean")))


@query("v5_actuals_findings", "rule severity #n", _MULTI.format("WHERE id % 3 = 0"))
def _(t):
    rows = t.snapshots.filter("id % 3 = 0").select(F.col("key").alias("oftic"), F.col("date").alias("anndats"), F.col("periodicity").alias("pdicity"), F.lit("EPS").alias("act_measure"), F.col("n").alias("act_value"), F.lit(1).alias("usfirm"))
    return S.actuals_findings(rows)


@query("v6_post_join_findings", "#repeated ~id ~n", f"SELECT count(*) - count(DISTINCT (permno, b.date)) AS repeated, avg(CAST(id IS NULL AS INT)) AS id, avg(CAST(n IS NULL AS INT)) AS n FROM bars b LEFT JOIN ({_D1}) s ON s.key = b.permno AND s.date = b.date")
def _(t):
    joined = P.by_key(t.bars, _consensus(t), {"permno": "key", "date": "date"})
    return S.repeated_keys(joined, ["permno", "date"]).select(F.col("n").alias("repeated")).crossJoin(S.missing_rates(joined, ["id", "n"]))


@query("v7_name_join_findings", "rule severity #n", "SELECT unnest(['missing_ticker', 'tiny_price', 'negative_cap']) AS rule, unnest(['warn', 'warn', 'error']) AS severity, unnest([count(*) FILTER (WHERE label IS NULL), count(*) FILTER (WHERE price < 1000), count(*) FILTER (WHERE price * quantity < 0)]) AS n FROM shipped LEFT JOIN intervals ON custkey = cust AND date >= namedt AND date <= coalesce(nameenddt, DATE '9999-12-31')")
def _(t):
    joined = P.interval_join(t.shipped, t.intervals, {"cust": "custkey"}, "date", "namedt", "nameenddt", "left")
    return S.findings(joined, {"missing_ticker": ("warn", F.col("label").isNull()), "tiny_price": ("warn", F.col("price") < 1000), "negative_cap": ("error", F.col("price") * F.col("quantity") < 0)})


@query("v8_entities_without_names", "#cust #n", "SELECT cust, count(*) AS n FROM (SELECT cust, label FROM shipped LEFT JOIN intervals ON custkey = cust AND date >= namedt AND date <= coalesce(nameenddt, DATE '9999-12-31')) GROUP BY cust HAVING count(*) FILTER (WHERE label IS NULL) = 0")
def _(t):
    joined = P.interval_join(t.shipped, t.intervals, {"cust": "custkey"}, "date", "namedt", "nameenddt", "left").select("cust", "label")
    return P.without_any(joined, "cust", F.col("label").isNull()).groupBy("cust").agg(F.count("*").alias("n"))


@query("v9_coverage", "#n_entities #n_shapes equal", f"SELECT count(*) AS n_entities, count(DISTINCT (n, lo, hi)) AS n_shapes, count(DISTINCT (n, lo, hi)) <= 1 AS equal FROM (SELECT permno, count(*) AS n, min(date) AS lo, max(date) AS hi FROM {_GAPS} WHERE date >= {_START} GROUP BY 1)")
def _(t):
    return S.coverage(P.aligned(t.bars, ["close"]))
