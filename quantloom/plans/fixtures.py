"""Panels derived from the star-schema tables, each as a DataFrame and as the SQL of a common table expression.

bars: daily prices of 25 entities from lineitem. macro: daily order prices per priority. factors: their log changes.
intervals: validity of a customer's last order. snapshots: several rows per (key, date). signals: closed-form model outputs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import log_ratio
from ..operators.features import volatility
from ..operators.panel import cross_section_filled, history
from ..operators.signals import scores, signals
from ..sources.tables import widened

SERIES = ("p1", "p2", "p3", "p4", "p5")
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


class Fixtures:
    """Lazily made tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        return self.lineitem.select((F.col("l_partkey") % 25).alias("permno"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.struct(*LINE_KEY).alias("k"), "l_quantity", "l_orderkey", "l_tax")

    @cached_property
    def bars(self) -> DataFrame:
        return self.lines.groupBy("permno", "date").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("l_quantity").alias("vol"))

    @cached_property
    def macro(self) -> DataFrame:
        long = self.orders.select(F.col("o_orderdate").cast("date").alias("date"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("series"), F.col("o_totalprice").alias("x"))
        return widened(long, SERIES, {"avg": F.avg("x"), "min": F.min("x"), "max": F.max("x")})

    @cached_property
    def factors(self) -> DataFrame:
        w = Window.orderBy("date")  # one row a date
        return self.macro.select("date", *[log_ratio(F.col(f"{s}_avg"), F.lag(f"{s}_avg").over(w)).alias(f"f{s[1]}") for s in SERIES])

    @cached_property
    def intervals(self) -> DataFrame:
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        return self.orders.select(F.col("o_custkey").alias("custkey"), F.col("o_orderdate").cast("date").alias("namedt"), F.date_sub(F.lead(F.col("o_orderdate").cast("date")).over(w), 1).alias("nameenddt"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("orderkey"))

    @cached_property
    def shipped(self) -> DataFrame:
        """Lines with their customer: l_orderkey, k, custkey, date."""
        line = self.lineitem.select("l_orderkey", F.struct(*LINE_KEY).alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_shipdate").cast("date").alias("date"))
        return line.join(self.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust")), "l_orderkey").drop("k")

    @cached_property
    def snapshots(self) -> DataFrame:
        first = F.substring("o_orderpriority", 1, 1)
        return self.orders.select((F.col("o_custkey") % 100).alias("key"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("id"), F.when(first == "1", "Q").when(first == "2", "S").when(first == "3", "A").otherwise("X").alias("periodicity"), F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise((F.col("o_orderkey") % 5).cast("string")).alias("fpi"), F.col("o_totalprice").alias("n"))

    @cached_property
    def returns(self) -> DataFrame:
        return self.bars.select("permno", "date", "close", log_ratio(F.col("close"), F.lag("close").over(history())).alias("ret"))

    @cached_property
    def outputs(self) -> DataFrame:
        w = history()
        lag = lambda k: F.coalesce(F.lag("ret", k).over(w), F.lit(0.0))
        df = self.returns.withColumns({"prob_up": 1 / (1 + F.exp(-0.5 * lag(1))), "expected_return": 0.004 * lag(1) + 0.002 * lag(2), "target": 0.01 * F.lead("ret").over(w), "small": 0.01 * F.col("ret")})
        return df.withColumn("volatility", volatility("small", 20, 5, None)).select("permno", "date", "prob_up", "expected_return", "target", "volatility")

    @cached_property
    def signals(self) -> DataFrame:
        return scores(signals(cross_section_filled(self.outputs, "volatility")))


_LINE = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
_W = "OVER (PARTITION BY permno ORDER BY date)"
#: Common table expressions by name, in the order of their use of each other.
CTES = {
    "lines": f"SELECT l_partkey % 25 AS permno, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS p, {_LINE} AS k, l_quantity, l_orderkey, l_tax FROM lineitem",
    "bars": "SELECT permno, date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(l_quantity) AS vol FROM lines GROUP BY ALL",
    "macro": "SELECT CAST(o_orderdate AS DATE) AS date, " + ", ".join(f"{f}(o_totalprice) FILTER (WHERE o_orderpriority[1] = '{s[1]}') AS {s}_{f}" for s in SERIES for f in ("avg", "min", "max")) + " FROM orders GROUP BY 1",
    "factors": "SELECT date, " + ", ".join(f"ln({s}_avg / lag({s}_avg) OVER (ORDER BY date)) AS f{s[1]}" for s in SERIES) + " FROM macro",
    "intervals": "SELECT o_custkey AS custkey, CAST(o_orderdate AS DATE) AS namedt, CAST(lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - INTERVAL 1 DAY AS DATE) AS nameenddt, o_orderpriority AS label, o_orderkey AS orderkey FROM orders",
    "shipped": "SELECT l_orderkey, l_linenumber AS line, l_partkey AS partkey, l_suppkey AS suppkey, l_extendedprice AS price, l_quantity AS quantity, CAST(l_shipdate AS DATE) AS date, o_custkey AS cust FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "snapshots": "SELECT o_custkey % 100 AS key, CAST(o_orderdate AS DATE) AS date, o_orderkey AS id, CASE o_orderpriority[1] WHEN '1' THEN 'Q' WHEN '2' THEN 'S' WHEN '3' THEN 'A' ELSE 'X' END AS periodicity, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 5 AS VARCHAR) END AS fpi, o_totalprice AS n FROM orders",
    "returns": f"SELECT permno, date, close, ln(close / lag(close) {_W}) AS ret FROM bars",
    "lagged": f"SELECT permno, date, coalesce(lag(ret, 1) {_W}, 0) AS r1, coalesce(lag(ret, 2) {_W}, 0) AS r2, 0.01 * lead(ret) {_W} AS target, 0.01 * ret AS small FROM returns",
    "rawvol": "SELECT *, CASE WHEN count(small) OVER v >= 5 THEN stddev_samp(small) OVER v END AS vol0 FROM lagged WINDOW v AS (PARTITION BY permno ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "outputs": "SELECT permno, date, 1 / (1 + exp(-0.5 * r1)) AS prob_up, 0.004 * r1 + 0.002 * r2 AS expected_return, target, vol0 AS volatility FROM rawvol",
    "flagged": "SELECT permno, date, prob_up, expected_return, target, coalesce(volatility, median(volatility) OVER (PARTITION BY date)) AS volatility, prob_up > 0.55 AS logistic_signal_long, prob_up < 1 - CAST(0.55 AS DOUBLE) AS logistic_signal_short, expected_return > 0.001 AS linear_signal_long, expected_return < -0.001 AS linear_signal_short FROM outputs",
    "signals": "SELECT *, 1 - prob_up AS prob_down, 2 * prob_up - 1 AS logistic_score, logistic_signal_long AND linear_signal_long AS agreed_long, logistic_signal_short AND linear_signal_short AS agreed_short, (logistic_signal_long AND linear_signal_long) OR (logistic_signal_short AND linear_signal_short) AS agreed_any, NOT ((logistic_signal_long AND linear_signal_long) OR (logistic_signal_short AND linear_signal_short)) AS disagreed, CASE WHEN (logistic_signal_long AND linear_signal_long) OR (logistic_signal_short AND linear_signal_short) THEN 2 * prob_up - 1 ELSE 0 END AS ensemble_score, prob_up * expected_return AS score_S1, (prob_up - 0.5) * expected_return AS score_S2, (2 * prob_up - 1) * abs(expected_return) AS score_S6 FROM flagged",
    "scored": "SELECT *, unnest(['S1', 'S2', 'S6']) AS scoring, unnest([score_S1, score_S2, score_S6]) AS score FROM signals",
}
_PRE = "WINDOW d AS (PARTITION BY scoring, date)"


def _share(x: str, up: str = "0.5", down: str = "0.5") -> str:
    return f"CASE WHEN agreed_long AND sum(CASE WHEN agreed_long THEN {x} END) OVER d > 0 THEN coalesce({x} / sum(CASE WHEN agreed_long THEN {x} END) OVER d * {up}, 0) WHEN agreed_short AND sum(CASE WHEN agreed_short THEN {x} END) OVER d > 0 THEN coalesce(-{x} / sum(CASE WHEN agreed_short THEN {x} END) OVER d * {down}, 0) ELSE 0 END"


def _normal(w: str) -> str:
    return f"CASE WHEN {w} > 0 THEN {w} / sum(CASE WHEN {w} > 0 THEN {w} END) OVER d * 0.5 WHEN {w} < 0 THEN {w} / sum(CASE WHEN {w} < 0 THEN -({w}) END) OVER d * 0.5 ELSE {w} END"


NAMES = ("A1", "A2", "A3", "A4", "A5", "A7", "A8", "A9")
CTES |= {
    "thresholds": f"SELECT *, quantile_cont(CASE WHEN agreed_long THEN score END, 0.8) OVER d AS q_long, quantile_cont(CASE WHEN agreed_short THEN score END, 0.2) OVER d AS q_short, quantile_cont(score, 0.6) OVER d AS q_all, greatest(least(0.25 * expected_return / (volatility * volatility + 1e-8), 0.1), -0.1) AS kelly FROM scored {_PRE}",
    "raw": "SELECT scoring, permno, date, prob_up, expected_return, score, target, agreed_long, agreed_short, "
    + ", ".join(
        f"{v} AS {k}"
        for k, v in {
            "A1": _share("1.0"),
            "A2": _share("abs(score)"),
            "A3": "CASE WHEN agreed_long AND score >= q_long THEN 0.5 / count(CASE WHEN agreed_long AND score >= q_long THEN 1 END) OVER d WHEN agreed_short AND score <= q_short THEN -0.5 / count(CASE WHEN agreed_short AND score <= q_short THEN 1 END) OVER d ELSE 0 END",
            "A4": "CASE WHEN agreed_any AND score >= q_all THEN 1.0 / count(CASE WHEN agreed_any AND score >= q_all THEN 1 END) OVER d ELSE 0 END",
            "A5": _share("abs(score / (volatility + 1e-8))"),
            "A7": _share("(1 / (volatility + 1e-8))"),
            "A8": _share("exp(2 * score)"),
            "A9": "coalesce(CASE WHEN agreed_any THEN kelly END, 0)",
        }.items()
    )
    + f" FROM thresholds {_PRE}",
    "raw9": f"SELECT * REPLACE ({_normal('A9')} AS A9) FROM raw {_PRE}",
    "clipped": "SELECT * REPLACE (" + ", ".join(f"greatest(least({n}, 0.1), -0.1) AS {n}" for n in NAMES) + ") FROM raw9",
    "wide": "SELECT * REPLACE (" + ", ".join(f"{_normal(n)} AS {n}" for n in NAMES) + f") FROM clipped {_PRE}",
    "weights": f"SELECT scoring, permno, date, prob_up, expected_return, score, target, unnest([{', '.join(repr(n) for n in NAMES)}]) AS allocation, unnest([{', '.join(NAMES)}]) AS w FROM wide",
    "grid": "SELECT * FROM weights WHERE allocation IN ('A1', 'A2', 'A3', 'A4', 'A5')",
    "daily": "SELECT scoring, allocation, date, coalesce(sum(w * target), 0) AS port_ret FROM grid GROUP BY ALL",
    "curve0": "SELECT *, exp(sum(port_ret) OVER c) AS equity_log, product(1 + port_ret) OVER c AS equity_simple FROM daily WINDOW c AS (PARTITION BY scoring, allocation ORDER BY date)",
    "curve": "SELECT *, (equity_log - max(equity_log) OVER c) / max(equity_log) OVER c AS drawdown FROM curve0 WINDOW c AS (PARTITION BY scoring, allocation ORDER BY date)",
}
for _name, _where in (("", ""), ("_is", "WHERE in_sample"), ("_oos", "WHERE NOT in_sample")):
    CTES[f"metrics{_name}"] = (
        "SELECT scoring, allocation, count(*) AS n_periods, 100 * (exp(sum(port_ret)) - 1) AS total_return, 100 * avg(port_ret) * 252 AS ann_return, 100 * stddev_samp(port_ret) * sqrt(252) AS ann_vol,"
        " CASE WHEN stddev_samp(port_ret) > 0 THEN avg(port_ret) * 252 / (stddev_samp(port_ret) * sqrt(252)) ELSE 0 END AS sharpe,"
        " CASE WHEN stddev_samp(port_ret) FILTER (WHERE port_ret < 0) > 0 THEN avg(port_ret) * 252 / (stddev_samp(port_ret) FILTER (WHERE port_ret < 0) * sqrt(252)) ELSE 0 END AS sortino,"
        " CASE WHEN min(drawdown) < 0 THEN avg(port_ret) * 252 / abs(min(drawdown)) ELSE 0 END AS calmar, 100 * min(drawdown) AS max_drawdown,"
        " 100 * avg(CASE WHEN port_ret > 0 THEN 1.0 ELSE 0 END) AS win_rate, 100 * avg(port_ret) AS avg_daily_ret, 100 * stddev_samp(port_ret) AS daily_vol"
        f" FROM {'curve' if not _name else 'curve' + _name} GROUP BY ALL"
    )
_CURVE = "(SELECT *, exp(sum(port_ret) OVER c) AS equity_log FROM daily_split WHERE {0} WINDOW c AS (PARTITION BY scoring, allocation ORDER BY date))"
CTES = {
    **{k: v for k, v in CTES.items() if not k.startswith("metrics")},
    "calendar": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)",
    "daily_split": "SELECT *, date < (SELECT date FROM calendar WHERE t = floor(n * 0.65)) AS in_sample FROM daily",
    **{f"curve_{s}": f"SELECT *, (equity_log - max(equity_log) OVER c) / max(equity_log) OVER c AS drawdown FROM {_CURVE.format(x)} WINDOW c AS (PARTITION BY scoring, allocation ORDER BY date)" for s, x in (("is", "in_sample"), ("oos", "NOT in_sample"))},
    **{k: v.replace(" WHERE in_sample", "").replace(" WHERE NOT in_sample", "") for k, v in CTES.items() if k.startswith("metrics")},
}


#: Added before rounding on both sides: quotients of cents lie on the half of a sixth place, where two engines round apart.
NUDGE = "3.3e-9"


def sql(body: str, out: str) -> str:
    """`body` with the expressions that it uses in front, and the columns of `out`: ~x a double of six places, %x one of nine significant digits, #x a big integer."""
    import re

    def uses(text: str) -> list[str]:
        return [n for n in CTES if re.search(rf"\b(FROM|JOIN)\s+{n}\b", text)]

    needed, todo = set(), [body]
    while todo:
        for n in uses(todo.pop()):
            if n not in needed:
                needed.add(n)
                todo.append(CTES[n])
    order = sorted(needed, key=list(CTES).index)
    shown = ", ".join(f"round(CAST({c[1:]} AS DOUBLE) + {NUDGE}, 6) + 0.0 AS {c[1:]}" if c[0] == "~" else f"CAST(printf('%.8e', CAST({c[1:]} AS DOUBLE)) AS DOUBLE) + 0.0 AS {c[1:]}" if c[0] == "%" else f"CAST({c[1:]} AS BIGINT) AS {c[1:]}" if c[0] == "#" else c for c in out.split())
    head = "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in order) + " " if order else ""
    return f"{head}SELECT {shown} FROM ({body}) AS q"


def shown(df: DataFrame, out: str) -> DataFrame:
    kinds = {
        "~": lambda c: F.round(F.col(c).cast("double") + float(NUDGE), 6) + 0.0,
        "%": lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.8e", F.col(c).cast("double")).cast("double") + 0.0),
        "#": lambda c: F.col(c).cast("long"),
    }
    return df.select(*[kinds[c[0]](c[1:]).alias(c[1:]) if c[0] in kinds else F.col(c) for c in out.split()])
