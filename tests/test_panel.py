"""Hand-made edge cases of the panel operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions.numeric import log1p, log_ratio, ratio
from quantloom.operators import allocate as A
from quantloom.operators import augment as G
from quantloom.operators import backtest as B
from quantloom.operators import daily as E
from quantloom.operators import features as X
from quantloom.operators import models as M
from quantloom.operators import panel as P
from quantloom.operators import quantiles as Q
from quantloom.operators import recursive as R
from quantloom.operators import running as U
from quantloom.operators import summaries as S
from quantloom.operators.signals import signals
from quantloom.sources import snapshots as H
from quantloom.sources import tables as T

D = [dt.date(2020, 1, d) for d in range(1, 31)]


def panel(spark, rows):
    return spark.createDataFrame(rows, "permno long, date date, x double, s string")


def test_numbers_never_raise(spark):
    r = spark.createDataFrame([(1.0, 0.0), (-1.0, 2.0), (None, 1.0), (2.0, 2.0)], "a double, b double").select(ratio("a", "b").alias("q"), log_ratio("a", "b").alias("l"), log1p("a").alias("p")).collect()
    assert [x.q for x in r] == [None, -0.5, None, 1.0]
    assert [x.l for x in r] == [None, None, None, 0.0]
    assert r[1].p is None


def test_fill_sentinel_and_trim(spark):
    df = panel(spark, [(1, D[0], None, None), (1, D[1], 2.0, None), (1, D[2], None, None), (2, D[0], None, "a"), (3, D[0], 1.0, "b")])
    out = P.forward_filled(df, ["x", "s"]).orderBy("permno", "date").collect()
    assert [(r.permno, r.x, r.s) for r in out] == [(1, 2.0, "missing"), (1, 2.0, "missing"), (2, -9999.0, "a"), (3, 1.0, "b")]
    again = P.filled(P.filled(df, ["x"]), ["x"]).exceptAll(P.filled(df, ["x"]))
    assert again.count() == 0


def test_align_starts_at_the_latest_first_date(spark):
    df = panel(spark, [(1, D[0], 1.0, "a"), (1, D[3], 4.0, "a"), (2, D[1], 9.0, "a"), (2, D[2], None, "a")])
    out = P.aligned(df, ["x"])
    assert [(r.permno, r.date.day, r.x) for r in out.orderBy("permno", "date").collect()] == [(1, 2, 1.0), (1, 3, 1.0), (1, 4, 4.0), (2, 2, 9.0), (2, 3, 9.0), (2, 4, 9.0)]
    assert S.coverage(out).first().equal


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 7, D[4]), (2, 7, D[20]), (3, 8, D[4]), (4, None, D[4])], "id long, k long, date date")
    spans = spark.createDataFrame([(7, D[0], D[9], "old"), (7, D[3], D[6], "new"), (8, D[9], None, "late")], "key long, a date, b date, name string")
    out = {r.id: r.name for r in P.as_of_interval(rows, spans, {"k": "key"}, ["id"], "date", "a", "b").collect()}
    assert out == {1: "new", 2: None, 3: None, 4: None}
    assert [r.id for r in P.as_of_interval(rows, spans, {"k": "key"}, ["id"], "date", "a", "b", drop_uncovered=True).collect()] == [1]
    found = {r.rule: r.n for r in S.interval_findings(spans, "key", "a", "b").collect()}
    assert found == {"start_after_end": 0, "overlap": 1}


def test_bucketed_intervals(spark):
    rng = np.random.default_rng(5)
    day = lambda i: dt.date(2019, 1, 1) + dt.timedelta(days=int(i))
    rows = spark.createDataFrame([(i, int(rng.integers(0, 3)), None if i % 50 == 0 else day(rng.integers(0, 800))) for i in range(500)], "id long, k long, at date")
    spans = [(int(rng.integers(0, 3)), a, a + int(rng.integers(-3, 90))) for a in rng.integers(-500, 1500, 150).tolist()]
    spans = spark.createDataFrame([(k, None if i == 3 else day(a), None if i % 9 == 0 else day(b), i) for i, (k, a, b) in enumerate(spans)], "k long, a date, b date, n long")
    key = lambda out: sorted(map(str, out.collect()))
    for how in ("inner", "left"):
        want = key(P.interval_join(rows, spans, {"k": "k"}, "at", "a", "b", how))
        assert len(want) > 500
        for days in (1, 7, 365, 100_000):
            assert key(P.interval_join(rows, spans, {"k": "k"}, "at", "a", "b", how, days)) == want
    empty = rows.limit(0)
    assert P.interval_join(empty, spans, {"k": "k"}, "at", "a", "b", "left", 7).count() == 0
    assert P.interval_join(rows, spans.limit(0), {"k": "k"}, "at", "a", "b", "left", 7).count() == 500
    same = rows.select("id", "k", F.col("at").alias("a"))  # both sides from one table
    assert P.interval_join(same, same.withColumn("b", F.col("a")), {"id": "id"}, "a", "a", "b").count() == 490


def _intervals_of_many_keys(spark):
    day = lambda c: F.date_add(F.lit(dt.date(2019, 1, 1)), c.cast("int"))
    rows = spark.range(8000).select("id", (F.col("id") % 2000).alias("k"), day(F.col("id") % 701).alias("at"))
    spans = spark.range(4000).select((F.col("id") % 2000).alias("key"), day(F.col("id") % 350).alias("a"), F.when(F.col("id") % 2 == 0, day(F.col("id") % 350 + 200)).alias("b"), F.col("id").alias("n"))
    return rows, spans


def test_only_hot_keys_are_cut_into_buckets(spark):
    rows, spans = _intervals_of_many_keys(spark)
    ids = lambda out: sorted((r.id, r.n) for r in out.select("id", "n").collect())
    join = lambda x, y, *more: P.interval_join(x, y, {"k": "key"}, "at", "a", "b", "left", *more)
    assert "Generate" not in join(rows, spans, 7)._jdf.queryExecution().executedPlan().toString()  # intervals stay one row
    assert ids(join(rows, spans, 7)) == ids(join(rows, spans))
    # One key has a fourth of all rows and only two intervals, another one half of all intervals.
    rows = rows.withColumn("k", F.when(F.col("id") % 4 == 0, 7).otherwise(F.col("k")))
    spans = spans.withColumn("key", F.when((F.col("n") % 2 == 0) & (F.col("n") > 99), 11).otherwise(F.col("key")))
    assert "Generate" in join(rows, spans, 7)._jdf.queryExecution().executedPlan().toString()
    assert ids(join(rows, spans, 7)) == ids(join(rows, spans))
    _, cut, hot = P._bucketed(rows, spans, {"k": "key"}, "at", "a", "b", 7)
    assert hot and {r.key for r in cut.filter("_bucket > 0").select("key").distinct().collect()} == {7, 11}


def test_as_of_tells_rows_apart_where_the_join_put_them(spark):
    rows, spans = _intervals_of_many_keys(spark)
    rows = rows.unionByName(rows.filter("id < 50")).unionByName(rows.filter("id < 50").withColumn("at", F.date_add("at", 40)))  # rows come twice, and on two dates
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for drop in (False, True):
            exchanges, found = [], []
            for one_key in (False, True):
                for days in (None, 31):
                    out = P.as_of_interval(rows, spans, {"k": "key"}, ["id"], "at", "a", "b", ["n"], drop, days, one_key)
                    found.append(sorted((r.id, str(r.a), r.n) for r in out.select("id", "a", "n").collect()))
                    exchanges.append(out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hash"))
            assert all(f == found[0] for f in found) and len({f[0] for f in found[0]}) == len(found[0])
            assert exchanges == [3, 3, 2, 2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    orders = spark.createDataFrame([(1, 5), (1, 5), (2, None), (2, None), (None, 3)], "o long, c long")
    assert P.determined(orders, ["o"], ["c"])
    assert not P.determined(orders.union(spark.createDataFrame([(2, 6)], "o long, c long")), ["o"], ["c"])
    assert not P.determined(orders.union(spark.createDataFrame([(None, 6)], "o long, c long")), ["o"], ["c"])


def test_one_key_with_all_intervals(spark):
    import time

    days = F.date_add(F.lit(dt.date(1990, 1, 1)), (F.col("id") % 12_000).cast("int"))
    rows = spark.range(100_000).select("id", F.lit(1).alias("k"), days.alias("at"))
    spans = spark.range(100_000).select(F.lit(1).alias("k"), days.alias("a"), F.date_add(days, 1).alias("b"), F.col("id").alias("n"))
    began = time.time()
    out = P.as_of_interval(rows, spans, {"k": "k"}, ["id"], "at", "a", "b", ["n"], bucket_days=2)
    assert out.select("id", "n").filter("n % 12000 = id % 12000").count() == 100_000 and time.time() - began < 120


def test_tuning_and_the_run_to_trades(spark):
    from quantloom.operators import strategy as Y
    from quantloom.plans.catalog import _features
    from quantloom.plans.fixtures import Fixtures

    rows, names = _features(Fixtures(spark, "/root/testdata/sf0.001"))
    rows = T.stored(rows)
    grids = {"C": (0.1, 1.0), "l1_ratio": (0.8, 0.9)}, {"alpha": (1e-3, 1e-4), "l1_ratio": (0.4, 0.6)}
    run = Y.fit_to_trades(rows.drop("in_sample"), names, "ret", "ret_lead1", *grids, folds=3)
    inside = rows.filter("in_sample")
    assert len(run.up.found) == len(run.mean.found) == 4 and run.up.best == M.best_setting(run.up.found)
    assert [x["l1_ratio"] for x in run.up.per_ratio()] == [0.8, 0.9] and min(x["error"] for x in run.up.per_ratio()) == run.up.best["error"]
    want = M.fit_linear(inside, names, "ret_lead1", run.mean.best["alpha"], run.mean.best["l1_ratio"])
    assert np.allclose(run.mean.model.coefficients, want.coefficients) and np.isclose(run.mean.model.intercept, want.intercept)
    best = max((r for r in run.metrics.filter("in_sample").collect()), key=lambda r: r.sharpe)
    assert np.isclose(best.sharpe, run.metrics.filter((F.col("scoring") == run.scoring) & (F.col("allocation") == run.allocation) & F.col("in_sample")).first().sharpe)
    assert run.metrics.count() == 30 and run.classification.count() == 2 and run.regression.first().rmse > 0
    last = rows.agg(F.max("date")).first()[0]
    trades = run.trades.collect()
    assert {r.permno for r in trades} <= {r.permno for r in rows.filter(F.col("date") == last).collect()} and all(r.weight for r in trades)


def test_a_panel_that_fails_its_checks_is_not_published(spark, tmp_path):
    from quantloom.operators import build as N

    prices = spark.createDataFrame([(e, f"T{e}", d, 10.0 * e, 1.0, 1.0) for e in (1, 2, 3) for d in D[:4]], "permno long, ticker string, date date, prc double, cfacpr double, cfacshr double")
    side = lambda rows: N.Side(spark.createDataFrame(rows, "name string, day date, x double"), {"ticker": "name", "date": "day"}, ["x"])
    path, good = f"{tmp_path}/panel", [("T1", D[1], 5.0), ("T2", D[0], 7.0), ("T9", D[0], 1.0), ("T9", D[0], 2.0)]
    found = N.build(prices, [side(good)], path, ["T1", "T2"])
    assert ("repeated_side_key", "error", 0) in found
    rows = lambda: sorted((r.permno, r.date.day, r.x) for r in spark.read.parquet(path).collect())
    want = [(1, 2, 5.0), (1, 3, 5.0), (1, 4, 5.0)] + [(2, d, 7.0) for d in (1, 2, 3, 4)]
    assert rows() == want and "_copies" not in spark.read.parquet(path).columns
    with pytest.raises(ValueError, match="repeated_side_key: 1 rows"):
        N.build(prices, [side([*good, ("T1", D[2], 6.0), ("T1", D[2], 6.5)])], path, ["T1", "T2"])
    with pytest.raises(ValueError, match="odd: 1 rows"):
        N.build(prices, [side(good)], path, ["T1"], {"odd": ("error", F.col("date") == D[2])})
    assert rows() == want and {f.name for f in tmp_path.iterdir()} == {"panel"}  # nothing staged is left
    assert ("odd", "warn", 2) in N.build(prices, [side(good)], path, ["T1", "T2"], {"odd": ("warn", F.col("date") == D[2])})
    assert rows() == want


def test_cleaning_thresholds_are_strict(spark):
    rows = [(1, float(i), 1.0) for i in range(1, 100)] + [(1, -5.0, 1.0)] + [(2, float(i), 1.0) for i in range(1, 99)] + [(2, -1.0, 1.0), (2, -2.0, 1.0)] + [(3, 1.0, 0.0), (3, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "permno long, prc double, cfacpr double")
    out = P.clean_prices(df, ["cfacpr"], "prc")
    assert {r.permno for r in out.select("permno").distinct().collect()} == {1}
    assert out.filter("prc < 0").count() == 0


def test_snapshots_rank_then_number_then_count(spark):
    df = spark.createDataFrame([(1, "A", "1", 9.0, 1), (1, "Q", "x", 9.0, 2), (1, "Q", "2", 1.0, 3), (1, "Q", "2", 5.0, 4), (2, None, None, None, 5)], "k long, p string, f string, n double, id long")
    assert {r.k: r.id for r in P.consensus_per_day(df, ["k"], "p", "f", "n", [F.col("id")]).collect()} == {1: 4, 2: 5}


def test_guards_raise(spark):
    df = panel(spark, [(1, D[0], 1.0, "a"), (1, D[0], 2.0, "a")])
    with pytest.raises(ValueError):
        P.assert_unique(df, ["permno", "date"])
    with pytest.raises(ValueError):
        P.require(df, ["absent"])
    with pytest.raises(FileNotFoundError):
        T.assert_present(spark, "/nowhere", ["a", "b"])
    with pytest.raises(ValueError):
        S.raise_errors(S.price_findings(df, ["permno"], ["x"], "x"))
    with pytest.raises(ValueError):
        A.allocate(df, ["A99"])


def test_snapshots_are_published_reused_and_extended(spark, tmp_path):
    folder = f"file://{tmp_path}/snapshots"
    now = lambda rows: H.table("t", spark.createDataFrame(rows, "k date, x long"))
    first, later = [(D[0], 1), (D[1], 2), (D[1], 2), (None, 3)], [(D[0], 9), (D[2], 4), (D[5], 5)]
    rows = lambda parts, *c: sorted(map(tuple, H.read(spark, parts, "part").select("x", *c).collect()))
    a = H.snapshot(spark, now(first), folder, "t", "k", partitions=3)
    assert [(p.number, p.rows, p.low, p.high) for p in a] == [(0, 4, "'2020-01-01'", "'2020-01-02'")]
    assert H.snapshot(spark, now(first + later), folder, "t", "k") == a  # as it is
    b = H.snapshot(spark, now(first + later), folder, "t", "k", "extend", partitions=3)
    assert rows(b, "part") == [(1, 0), (2, 0), (2, 0), (3, 0), (4, 1), (5, 1)]
    assert H.snapshot(spark, now(first + later), folder, "t", "k", "extend") == b  # nothing new
    # A run that broke before its rename, a part without a manifest, and one whose file is cut are not read.
    base = tmp_path / "snapshots" / "t" / now([]).digest
    (base / "_staged-x").mkdir()
    (base / "g000000-000002").mkdir()
    assert H.published(spark, now([]), folder, "t") == b
    cut = next((base / "g000000-000001").glob("*.parquet"))
    cut.write_bytes(cut.read_bytes()[:-1])
    assert H.published(spark, now([]), folder, "t") == a
    assert H.snapshot(spark, now(first + later), folder, "t", "k", "extend", partitions=2)[1:] == b[1:] and len(H.published(spark, now([]), folder, "t")) == 2
    H.snapshot(spark, now([*first, *later, (D[7], 6)]), folder, "t", "k", "extend")
    cut = next((base / "g000000-000001").glob("*.parquet"))
    cut.write_bytes(cut.read_bytes()[:-1])  # what is behind a damaged part isn't read, and comes again with it
    d = H.snapshot(spark, now([*first, *later, (D[7], 6)]), folder, "t", "k", "extend")
    assert [p.rows for p in d] == [4, 3] and not (base / "g000000-000002").exists() and H.published(spark, now([]), folder, "t") == d
    c = H.snapshot(spark, now(first + later), folder, "t", "k", "replace", partitions=3)
    assert [p.generation for p in c] == [1] and rows(c) == [(x,) for x in (1, 2, 2, 3, 4, 5, 9)] and not (base / "g000000-000000").exists()
    assert H.published(spark, H.table("u", spark.range(1)), folder, "t") == []  # another query
    bad = spark.createDataFrame([(1,)], "k long").withColumn("x", F.assert_true(F.lit(False)))
    with pytest.raises(Exception):
        H.snapshot(spark, H.table("bad", bad), folder, "t", "k")
    assert H.published(spark, H.table("bad", bad), folder, "t") == []
    empty = H.table("empty", spark.range(0).select(F.col("id").alias("k")))
    nulls = [H.table("nulls", spark.createDataFrame(x, "k long")) for x in ([(None,)], [(None,), (1,)])]  # no mark to extend from
    assert [p.rows for s in nulls for p in H.snapshot(spark, s, folder, "n", "k", "extend")] == [1, 2]
    assert [p.rows for p in H.snapshot(spark, empty, folder, "t", "k")] == [0] and H.read(spark, H.snapshot(spark, empty, folder, "t", "k", "extend")).count() == 0


def test_days_from_kept_state_are_those_of_whole_histories(spark, tmp_path):
    rng = np.random.default_rng(5)
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(60)]
    rows = [(p, d, float(x), float(x + 1), float(x - 1), float(x + rng.normal() / 2), None if rng.random() < 0.05 else 100.0) for p in range(4) for d in days[(0, 0, 58, 3)[p] :] if (p, d.day) != (1, 28) for x in [50 + rng.normal()]]
    df = spark.createDataFrame(rows, "permno long, date date, open double, high double, low double, close double, vol double")
    names = dict(high="high", low="low", close="close")
    features = lambda x: X.windowed_indicators(x, "open", "high", "low", "close", "vol")
    whole = features(R.recursive_indicators(df, **names))
    folder = f"file://{tmp_path}/daily"
    part = lambda a, b: df.filter((F.col("date") >= days[a]) & (F.col("date") < days[b - 1] + dt.timedelta(1)))
    assert E.begin(df.limit(0), folder, **names) is None and E.begin(part(0, 50), folder, rows=30, **names) == str(days[49])
    got = [r for a, b in ((50, 51), (51, 52), (51, 52), (52, 60)) for r in E.run_days(part(a, b), folder, features, rows=30, **names).select(whole.columns).collect()]
    want = {(r.permno, r.date): r for r in whole.collect()}
    assert {(r.permno, r.date) for r in got} == {k for k in want if k[1] >= days[50]}
    for r in got:  # the second day twice, equally
        assert all(x == y or (x is not None and y is not None and abs(x - y) < 1e-9 * max(1, abs(y))) for x, y in zip(r[2:], want[r.permno, r.date][2:]))
    assert E.states(spark, folder) == [str(days[i]) for i in (49, 50, 51, 59)]
    with pytest.raises(ValueError):
        E.run_days(part(10, 20), folder, **names)


def test_even_partitions_of_a_skewed_database_key(spark, tmp_path):
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    keys = [i**3 for i in range(2000)] + [None] * 5  # uniform strides would put most rows into the first range
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, x long")
    df.write.jdbc(url, "skewed", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    source = H.jdbc(spark, url, 'SELECT "k", "x" FROM skewed', driver="org.apache.derby.jdbc.EmbeddedDriver")
    quote = lambda c: f'"{c}"'
    where = H.even_ranges(source, "k", None, 8, quote)
    sizes = [len(p) for p in source.rows(where).rdd.glom().collect()]
    assert len(sizes) == 8 and sum(sizes) == len(keys) and max(sizes) < 270
    parts = H.snapshot(spark, source, f"file://{tmp_path}/s", "skewed", "k", partitions=8, quote=quote)
    assert sorted(r.x for r in H.read(spark, parts).collect()) == list(range(len(keys)))
    spark.createDataFrame([(10**11 + i, -i) for i in range(10)], "k long, x long").write.mode("append").jdbc(url, "skewed", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    parts = H.snapshot(spark, source, f"file://{tmp_path}/s", "skewed", "k", "extend", partitions=4, quote=quote)
    assert [p.rows for p in parts] == [len(keys), 10] and H.read(spark, parts).count() == len(keys) + 10


def test_jdbc_extraction(spark, tmp_path):
    url = "jdbc:derby:memory:panel;create=true"
    rows = spark.createDataFrame([(i, float(i) / 2) for i in range(100)], "id long, x double")
    rows.coalesce(1).write.jdbc(url, "prices", mode="overwrite")
    folder = str(tmp_path)
    for force, factor in ((False, 1), (False, 1), (True, 3)):
        paths = T.extract_all(spark, url, {"prices": f'SELECT "id", "x" * {factor} AS "x" FROM prices'}, folder, "id", (0, 100), force=force, partitions=3)
        got = T.read(spark, paths, "prices").agg(F.count("*"), F.sum("x")).first()
        assert tuple(got) == (100, 2475.0 * factor)
    with pytest.raises(KeyError):
        T.read(spark, paths, "absent")
    assert T.load(spark, folder, ["prices"])["prices"].count() == 100
    paths = T.extract_all(spark, url, {"prices": 'SELECT "id", "x" * 9 AS "x" FROM prices'}, folder, "id", (0, 100))
    assert T.read(spark, paths, "prices").agg(F.sum("x")).first()[0] == 2475.0 * 3  # what is there stays


def day(spark, rows):
    df = spark.createDataFrame(rows, "date date, permno long, prob_up double, expected_return double, volatility double")
    return signals(df).withColumn("score", F.col("prob_up") * F.col("expected_return"))


def test_weights_add_up(spark):
    rng = np.random.default_rng(1)
    rows = [(D[d], i, float(rng.uniform(0.3, 0.7)), float(rng.normal(0, 0.01)), float(rng.uniform(0.01, 0.03))) for d in range(10) for i in range(12)]
    rows += [(D[11], 1, 0.5, 0.0, 0.01), (D[12], 1, 0.9, 0.1, 0.01), (D[13], 1, 0.55, 0.1, 0.01), (D[13], 2, 0.9, 0.001, 0.01)]
    names = ["A1", "A2", "A3", "A4", "A5", "A7", "A8", "A9"]
    w = A.allocate(day(spark, rows), names)
    for n in names:
        for r in w.groupBy("date").agg(F.sum(F.when(F.col(n) > 0, F.col(n))).alias("up"), F.sum(F.when(F.col(n) < 0, F.col(n))).alias("down")).collect():
            assert r.up is None or abs(r.up - 0.5) < 1e-9
            assert r.down is None or abs(r.down + 0.5) < 1e-9
    empty = w.filter(F.col("date").isin(D[11], D[13])).select(*names).collect()  # thresholds are strict
    assert all(v == 0 for r in empty for v in r)


def test_metrics_guards(spark):
    rows = [("S1", "up", D[i], 0.01 * (i + 1)) for i in range(3)] + [("S1", "one", D[i], x) for i, x in enumerate((0.02, -0.01, 0.03))] + [("S1", "flat", D[i], 0.0) for i in range(3)]
    out = {r.allocation: r for r in B.metrics(spark.createDataFrame(rows, "scoring string, allocation string, date date, port_ret double")).collect()}
    assert out["up"].sortino == 0 and out["up"].calmar == 0 and out["up"].max_drawdown == 0
    assert out["one"].sortino == 0 and out["one"].calmar > 0
    assert out["flat"].sharpe == 0


def test_recursive_against_pandas():
    import pandas as pd

    x = np.cumsum(np.random.default_rng(0).normal(size=200)) + 50
    assert np.allclose(R.smoothed(x, 2 / 13), pd.Series(x).ewm(span=12, adjust=False).mean())
    assert np.allclose(R.macd(x)[25:], (pd.Series(x).ewm(span=12, adjust=False).mean() - pd.Series(x).ewm(span=26, adjust=False).mean())[25:])
    h, low = x + 1, x - 1
    assert np.isnan(R.atr(h, low, x, 14)[:13]).all() and (R.atr(h, low, x, 14)[13:] > 0).all()
    a = R.psar_acceleration(h, low)
    assert a.min() == 0.02 and a.max() <= 0.2
    for f in (lambda n: R.rsi(x[:n]), lambda n: R.adx(h[:n], low[:n], x[:n]), lambda n: R.psar_acceleration(h[:n], low[:n])):
        assert np.array_equal(f(150), f(200)[:150], equal_nan=True)  # nothing looks ahead


def _prices(n, gaps):
    rng = np.random.default_rng(n)
    c = np.cumsum(rng.normal(size=n)) + 80
    h, low = c + rng.random(n), c - rng.random(n)
    for x in (h, low, c) if gaps else ():
        x[rng.random(n) < 0.1] = np.nan
    return h, low, c


def test_recursive_state_goes_on_from_batch_to_batch():
    for gaps in (False, True):
        h, low, c = _prices(500, gaps)
        whole = R.History()(h, low, c)
        for size in (1, 7, 499):
            state = R.History()
            parts = [state(h[i : i + size], low[i : i + size], c[i : i + size]) for i in range(0, 500, size)]
            assert all(np.array_equal(np.concatenate([p[n] for p in parts]), whole[n], equal_nan=True) for n in R.NAMES)


def test_smoothings_compose():
    rng = np.random.default_rng(2)
    x = np.where(rng.random(300) < 0.3, np.nan, rng.normal(size=300))
    x[:20] = np.nan
    want = R.smoothed(x, 0.2)
    for size in (1, 7, 1000):
        blocks = [x[i : i + size] for i in range(0, 300, size)]
        maps = [R.affine(b, 0.2) for b in blocks]
        starts = R.composed([tuple(y[-1] for y in m) for m in maps])
        got = np.concatenate([u if np.isnan(s) else a * s + b for s, (a, b, u) in zip(starts, maps)])
        assert np.allclose(got, want, equal_nan=True)


def test_scan_over_blocks_equals_the_stream(spark):
    rows = []
    for entity, n, gaps in ((1, 400, False), (2, 5, False), (3, 300, True), (4, 1, False)):
        rows += [(entity, dt.date(2020, 1, 1) + dt.timedelta(days=i), *(None if np.isnan(v) else float(v) for v in x)) for i, x in enumerate(zip(*_prices(n, gaps)))]
    df = spark.createDataFrame(rows, "permno long, date date, askhi double, bidlo double, adj_prc double")
    key = lambda out: {(r.permno, r.date): r for r in out.collect()}
    want = key(R.recursive_indicators(df))
    assert len(want) == len(rows) and any(r.ti_adx_14 is not None for r in want.values())
    for days in (1, 7, 1000):
        got = key(R.scanned_indicators(df, block_days=days))
        assert got.keys() == want.keys()
        for k, r in want.items():
            for n in R.NAMES[:-1]:
                a, b = r[f"ti_{n}"], got[k][f"ti_{n}"]
                assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6), (days, k, n, a, b)
    assert R.scanned_indicators(df.limit(0)).collect() == [] and R.recursive_indicators(df.limit(0)).collect() == []


def test_densify_on_a_calendar_of_ones_own(spark):
    df = panel(spark, [(1, D[1], 1.0, "a"), (1, D[4], 4.0, "a"), (2, D[9], 9.0, "a"), (3, D[2], 3.0, "a"), (3, D[2], 3.5, "a")])
    days = spark.createDataFrame([(D[i],) for i in (0, 2, 4, 4, 5)] + [(None,)], "date date")
    got = [(r.permno, r.date.day, r.x) for r in P.densified(df, ["x"], days, from_latest_start=False).collect()]
    want = [(e, d, {(1, 5): 4.0}.get((e, d))) for e in (1, 2) for d in (1, 3, 5, 6)] + [(3, 1, None), (3, 3, 3.0), (3, 3, 3.5), (3, 5, None), (3, 6, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert P.densified(df, ["x"], days).count() == 0  # entity 2 starts behind the last of these days
    assert P.densified(df.limit(0), ["x"]).count() == 0 and P.aligned(df.limit(0), ["x"]).count() == 0
    plan = P.aligned(df, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(8)
    columns = {"even": rng.normal(size=4000), "ties": np.repeat([1.0, 2.0, 2.0, 7.0], 1000), "wide": np.exp(rng.normal(size=4000) * 40) * rng.choice([-1, 1], 4000), "gaps": np.where(rng.random(4000) < 0.5, np.nan, rng.random(4000)), "none": np.full(4000, np.nan)}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], ", ".join(f"{c} double" for c in columns)).repartition(5)
    asked = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]
    for most, accuracy in ((20_000, 10_000), (200, 200), (1, 500)):
        got = Q.quantiles(df, {c: asked for c in columns}, most, accuracy)
        for c, x in columns.items():
            known = x[~np.isnan(x)]
            want = np.quantile(known, asked).tolist() if len(known) else [None] * len(asked)
            assert got[c] == (pytest.approx(want, rel=1e-12) if len(known) else want), (c, most)
    assert Q.median(df.limit(0), ["even"]) == {"even": None} and Q.quantiles(df, {}) == {}
    with pytest.raises(ValueError):
        Q.quantiles(df, {"even": [1.5]})


def test_running_blocks_equal_one_window(spark):
    rng = np.random.default_rng(6)
    rows = [(e, dt.date(2020, 1, 1) + dt.timedelta(days=int(i)), None if rng.random() < 0.3 else float(rng.normal())) for e, n in ((1, 300), (2, 1), (None, 40)) for i in sorted(rng.choice(900, n, replace=False))]
    df = spark.createDataFrame(rows, "permno long, date date, x double")
    kinds = {k: (k, F.col("x")) for k in U.KINDS}
    w = P.until_now()
    want = df.withColumns({k: KIND(F.col("x")).over(w) for k, (KIND, _) in U.KINDS.items()})
    key = lambda out: sorted(((str(r.permno), r.date, *(None if r[k] is None else round(r[k], 9) for k in kinds)) for r in out.collect()), key=str)
    for days in (1, 7, 1000):
        assert key(U.running(df, kinds, block_days=days)) == key(want)
    assert U.running(df.limit(0), kinds).count() == 0
    with pytest.raises(ValueError):
        U.running(df, {"y": ("mode", F.col("x"))})


def test_user_weights_fail_by_date(spark):
    rows = [(e, d, float(e), 0.01 * e) for d in D[:4] for e in (1, 2, 3)]
    df = spark.createDataFrame(rows, "permno long, date date, score double, target double")

    def weigh(day):
        k = day["date"].iloc[0].day
        if k == 2:
            raise KeyError("gone")
        return [1.0] if k == 3 else [float("nan")] * 3 if k == 4 else day["score"] / day["score"].sum()

    out = B.user_weights(df, weigh, by=("date",)).orderBy("date", "permno").collect()
    assert [r.w for r in out] == [1 / 6, 2 / 6, 3 / 6] + [0.0] * 9
    assert [r.error and r.error.split(":")[0] for r in out[::3]] == [None, "KeyError", "ValueError", "ValueError"]


def test_report_runs_of_different_pairs_leave_each_other(spark, tmp_path):
    row = lambda s, a, x: (s, a, "daily", D[0], x)
    put = lambda rows: T.write_report(spark.createDataFrame(rows, "scoring string, allocation string, freq string, date date, strategy double"), f"{tmp_path}/r")
    put([row("S1", "A1", 1.0), row("S1", "A2", 2.0)])
    for _ in range(2):
        put([row("S2", "A1", 3.0), row("S1", "A1", 4.0)])
    got = {(r.scoring, r.allocation): r.strategy for r in spark.read.parquet(f"{tmp_path}/r").collect()}
    assert got == {("S1", "A1"): 4.0, ("S1", "A2"): 2.0, ("S2", "A1"): 3.0} and spark.read.parquet(f"{tmp_path}/r").count() == 3


def test_folds_and_split(spark):
    df = spark.createDataFrame([(d,) for d in D], "date date")
    g = M.fold_geometry(30, 4)
    rows = M.fold_dates(df, g).collect()
    for k in range(g.n):
        train, val = ({r.date for r in rows if r.fold == k and r.role == x} for x in ("train", "val"))
        assert max(train) < min(val) and len(train) == g.train and len(val) == g.val
    got = M.split(df, 0.65).groupBy("in_sample").count().collect()
    assert {r.in_sample: r["count"] for r in got} == {True: 19, False: 11}
    assert M.split_date(df, 0.65) == D[19]


def test_elastic_net_against_coordinate_descent(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = 0.02 * x[:, 0] - 0.01 * x[:, 1] + 0.01 * rng.normal(size=300)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    model = M.fit_linear(df, ["a", "b", "c"], "y", alpha=1e-3, l1_ratio=0.5)
    z = (x - x.mean(0)) / x.std(0)
    b, c = np.zeros(3), y - y.mean()
    for _ in range(500):
        for j in range(3):
            r = z[:, j] @ (c - z @ b + z[:, j] * b[j]) / 300
            b[j] = np.sign(r) * max(abs(r) - 5e-4, 0) / (1 + 5e-4)
    assert np.allclose(model.coefficients, b, atol=1e-6)
    flat = M.fit_logistic(df, ["a", "b", "c"], "y", C=0.1, l1_ratio=0.9)
    assert flat.coefficients[0] > 0 > flat.coefficients[1]


def test_grid_search_is_registered_whole(spark, monkeypatch):
    from quantloom.plans import catalog

    seen = []
    monkeypatch.setattr(catalog.M, "grid_search", lambda rows, folds, names, target, grid, logistic, **limits: seen.append((folds.select("fold").distinct().count(), grid, limits)) or [])
    catalog.QUERIES["m8_m9_grid_search"](spark, "/root/testdata/sf0.001")
    assert all(n >= 10 and not limits for n, _, limits in seen)
    assert [{k: sorted(v) for k, v in grid.items()} for _, grid, _ in seen] == [{"C": [0.1, 0.5, 1.0], "l1_ratio": [0.8, 0.9]}, {"alpha": [1e-6, 5e-6, 1e-5, 5e-5, 1e-4, 5e-4], "l1_ratio": [0.4, 0.5, 0.6]}]


def test_grid_search_over_parts_without_rows(spark):
    rng = np.random.default_rng(11)
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(40)]
    rows = spark.createDataFrame([(d, *map(float, rng.normal(size=3))) for d in days], "date date, a double, b double, y double")
    folds = M.fold_dates(rows, M.fold_geometry(40))
    for grid, logistic in (({"C": (0.1, 1.0), "l1_ratio": (0.9,)}, True), ({"alpha": (1e-3, 1e-1), "l1_ratio": (0.5,)}, False)):
        one = M.grid_search(rows.coalesce(1), folds, ["a", "b"], "y", grid, logistic)
        many = M.grid_search(rows.repartition(48, "date"), folds, ["a", "b"], "y", grid, logistic)
        assert len(one) == 2 and np.allclose([x["error"] for x in one], [x["error"] for x in many], atol=1e-12)


def test_max_sharpe_looks_back_a_year(spark, monkeypatch):
    from quantloom.operators import allocate
    from quantloom.plans import catalog

    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(300)]
    ret = {p: np.random.default_rng(p).normal(0, 0.01, 300) for p in (1, 2)}
    returns = spark.createDataFrame([(p, d, float(r)) for p in ret for d, r in zip(days, ret[p])], "permno long, date date, ret double")
    signals = spark.createDataFrame([(p, days[-1], True) for p in ret], "permno long, date date, agreed_any boolean")
    cov = allocate.covariances(returns, signals.select("date", "permno"))
    want = np.cov(ret[1][-253:-1], ret[2][-253:-1])[0, 1]
    assert abs(cov.filter("a = 1 AND b = 2").first()["cov"] - want) < 1e-12
    seen = []
    whole = allocate._with_history
    monkeypatch.setattr(allocate, "_with_history", lambda r, n, lookback, *a: seen.append(lookback) or whole(r, n, lookback, *a))
    catalog.QUERIES["k9_a6_max_sharpe"](spark, "/root/testdata/sf0.001")
    assert seen == [252]


@pytest.mark.parametrize("lookback", [7, 252])
def test_max_sharpe_in_one_map(spark, lookback):
    rng = np.random.default_rng(11)
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(40)]
    returns = spark.createDataFrame([(p, d, float(rng.normal(0, 0.01))) for p in range(6) for d in days if rng.random() < 0.9], "permno long, date date, ret double")
    rows = [(d, p, float(rng.normal(0, 0.01)), bool(s > 0), bool(s < 0)) for d in [*days, dt.date(2021, 1, 1)] for p in range(7) for s in [rng.integers(-1, 2)]]
    df = spark.createDataFrame(rows, "date date, permno long, expected_return double, agreed_long boolean, agreed_short boolean")
    cov = A.covariances(returns, df.filter("agreed_long OR agreed_short").select("date", "permno"), lookback)
    want = {(r.date, r.permno): r.A6 for r in A.max_sharpe(df, cov).collect()}
    got = {(r.date, r.permno): r.A6 for r in A.max_sharpe_from_returns(df, returns, lookback=lookback).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len({d for d, _ in got}) == 41  # the calendar lacks the last one: equal weights
    assert A.max_sharpe_from_returns(df, returns.limit(0)).count() == len(got) and A.max_sharpe_from_returns(df.limit(0), returns).count() == 0


def test_covariances_of_names_with_gaps(spark):
    rng = np.random.default_rng(3)
    rows = [(p, D[i], None if rng.random() < 0.1 else float(rng.normal(0, 0.01))) for p in range(5) for i in range(30) if rng.random() < 0.8]
    returns = spark.createDataFrame(rows, "permno long, date date, ret double")
    names = spark.createDataFrame([(D[i], p) for i in (0, 3, 20, 29) for p in range(5)], "date date, permno long")
    got = {(r.date, r.a, r.b): r["cov"] for r in A.covariances(returns, names, 15).collect()}
    by = {(p, d): x or 0.0 for p, d, x in rows}
    days = sorted({d for _, d, _ in rows})
    for day in (D[3], D[20], D[29]):
        if day not in days:
            continue
        past = days[max(0, days.index(day) - 15) : days.index(day)]
        for a in range(5):
            for b in range(5):
                both = [(by[a, d], by[b, d]) for d in past if (a, d) in by and (b, d) in by]
                if both:
                    want = (np.cov(*zip(*both))[0, 1] if len(both) > 1 else 0.0) + (1e-4 if a == b else 0.0)
                    assert abs(got[day, a, b] - want) < 1e-12
    assert not [k for k in got if k[0] == days[0]]


def test_max_sharpe_weights(spark):
    rng = np.random.default_rng(4)
    half = rng.normal(size=(6, 6))
    s = half @ half.T / 1e4 + 1e-4 * np.eye(6)
    rows = [(D[0], i, float(rng.normal(0, 0.01)), i % 2 == 0, i % 2 == 1) for i in range(6)] + [(D[1], 1, 0.01, True, False), (D[2], 1, 0.01, True, False), (D[2], 2, -0.01, False, True), (D[3], 9, 0.01, False, False)]
    df = spark.createDataFrame(rows, "date date, permno long, expected_return double, agreed_long boolean, agreed_short boolean")
    cov = spark.createDataFrame([(D[0], a, b, float(s[a, b])) for a in range(6) for b in range(6)] + [(D[2], a, b, 1.0) for a in (1, 2) for b in (1, 2)], "date date, a long, b long, cov double")
    got = {(r.date, r.permno): r.A6 for r in A.max_sharpe(df, cov, most=10.0).collect()}
    mu = np.array([r[2] for r in rows[:6]])
    w = np.array([got[D[0], i] for i in range(6)])
    assert abs(w.sum()) < 1e-9 and abs(w[w > 0].sum() - 0.5) < 1e-9
    # First-order condition: the gradient of mean over variance is the same for all names but for a shift.
    k = (w @ mu) / (w @ s @ w)
    gradient = mu - k * (s @ w)
    assert np.ptp(gradient) < 1e-6 * np.abs(mu).max()
    assert got[D[1], 1] == 0.5 and (got[D[2], 1], got[D[2], 2]) == (0.5, -0.5)  # one name; a singular matrix
    assert (D[3], 9) not in got
    capped = {r.permno: r.A6 for r in A.max_sharpe(df, cov, most=0.2).filter(F.col("date") == D[0]).collect()}
    cut = np.clip(w, -0.2, 0.2)
    assert np.allclose([capped[i] for i in range(6)], np.where(cut > 0, cut / cut[cut > 0].sum(), -cut / cut[cut < 0].sum()) * 0.5)


def test_logistic_against_proximal_gradient(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 4)) * [1, 2, 3, 1]
    up = rng.random(200) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1])))
    df = spark.createDataFrame([(*map(float, r), 1.0 if u else -1.0) for r, u in zip(x, up)], "a double, b double, c double, d double, y double")
    model = M.fit_logistic(df, ["a", "b", "c", "d"], "y", C=0.1, l1_ratio=0.9)
    z = (x - x.mean(0)) / x.std(0)
    penalty, b, b0 = 1 / (0.1 * 200), np.zeros(4), 0.0
    for _ in range(20000):  # mean log loss + penalty (0.9 |b| + 0.05 b^2), by steps of 1 over its curvature
        g = 1 / (1 + np.exp(-(z @ b + b0))) - up
        b0 -= 0.5 * g.mean()
        v = b - 0.5 * (z.T @ g / 200 + 0.1 * penalty * b)
        b = np.sign(v) * np.maximum(np.abs(v) - 0.5 * 0.9 * penalty, 0)
    assert np.allclose(model.coefficients, b, atol=1e-4) and abs(model.intercept - b0) < 1e-4
    scored = np.array([r.p for r in model.scored(df, "p").collect()])
    assert np.allclose(scored, 1 / (1 + np.exp(-(z @ np.array(model.coefficients) + model.intercept))))
    found = M.top_predictors(M.Fitted(["a", "b", "c"], {}, [0.1, 0.0, -0.4], 0.0, False), spark).collect()
    assert [(r.feature, r.coefficient) for r in found] == [("c", -0.4), ("a", 0.1)]


def test_grid_search_over_folds(spark):
    rng = np.random.default_rng(7)
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(40)]
    rows = [(d, p, float(a), float(b), float(0.02 * a + 0.01 * rng.normal())) for d in days for p in range(6) for a, b in [rng.normal(size=2)]]
    df = spark.createDataFrame(rows, "date date, permno long, a double, b double, y double")
    folds = M.fold_dates(df, M.fold_geometry(40, 2))
    grid = {"alpha": (1e-4, 1e-1), "l1_ratio": (0.5, 0.6)}
    found = M.grid_search(df, folds, ["a", "b"], "y", grid, False)
    assert [(x["alpha"], x["l1_ratio"], x["combo_order"]) for x in found] == [(1e-4, 0.5, 0), (1e-4, 0.6, 1), (1e-1, 0.5, 2), (1e-1, 0.6, 3)]
    role = {}
    for r in folds.collect():
        role.setdefault(r.fold, {}).setdefault(r.role, set()).add(r.date)
    for x in found[::2]:
        errors = []
        for k in role.values():
            fit, val = ([r for r in rows if r[0] in k[name]] for name in ("train", "val"))
            model = M.fit_linear(spark.createDataFrame(fit, df.schema), ["a", "b"], "y", alpha=x["alpha"], l1_ratio=x["l1_ratio"])
            p = [model.intercept + sum(c * (v - model.scale[n][0]) / model.scale[n][1] for c, n, v in zip(model.coefficients, "ab", r[2:4])) for r in val]
            errors.append(np.sqrt(np.mean((np.array(p) - [r[4] for r in val]) ** 2)))
        assert abs(x["error"] - np.mean(errors)) < 1e-9
    called = M.grid_search(df, folds, ["a", "b"], "y", {"C": (0.01, 1.0), "l1_ratio": (0.8,)}, True)
    for x in called:
        errors = []
        for k in role.values():
            fit, val = ([r for r in rows if r[0] in k[name]] for name in ("train", "val"))
            scored = M.fit_logistic(spark.createDataFrame(fit, df.schema), ["a", "b"], "y", C=x["C"], l1_ratio=0.8).scored(spark.createDataFrame(val, df.schema), "p")
            errors.append(np.mean([(r.p > 0.5) != (r.y > 0) for r in scored.collect()]))
        assert abs(x["error"] - np.mean(errors)) < 1e-9
    assert M.best_setting(found)["alpha"] == 1e-4
    best = {r.l1_ratio: r.best for r in S.best_per(spark.createDataFrame([(x["l1_ratio"], x["error"]) for x in found], "l1_ratio double, error double"), "l1_ratio", "error").collect()}
    assert best == {k: min(x["error"] for x in found if x["l1_ratio"] == k) for k in (0.5, 0.6)}


def test_next_day(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(25)]
    rows = [(p, d, float(0.001 * ((i * 7 + p * 3) % 5)), float(x)) for p, x in ((1, 2.0), (2, -2.0), (3, 0.0)) for i, d in enumerate(days)]
    matrix = spark.createDataFrame(rows, "permno long, date date, adj_prc_logret double, x double")
    up, mean = M.Fitted(["x"], {"x": (0.0, 1.0)}, [1.0], 0.0, True), M.Fitted(["x"], {"x": (0.0, 1.0)}, [0.01], 0.0, False)
    for allocation in ("A1", "A5", "A7"):
        got = {r.permno: r for r in B.next_day(matrix, up, mean, "S1", allocation).collect()}
        assert {p: r.action for p, r in got.items()} == {1: "BUY", 2: "SELL-SHORT"}
        assert abs(got[1].weight - 0.5) < 1e-9 and abs(got[2].weight + 0.5) < 1e-9
        assert abs(got[1].conviction - 0.02 / (1 + np.exp(-2.0))) < 1e-12
    assert B.next_day(matrix.withColumn("x", F.lit(0.0)), up, mean, "S1", "A1").count() == 0
    assert B.scenarios(B.next_day(matrix.limit(0), up, mean, "S1", "A1")).first().expected == 0


def test_augmented_without_macro_series(spark):
    rows = [(p, dt.date(2020, 1, 1) + dt.timedelta(i), 1.0 + i % 3, 3.0 + i % 2, 0.5, 2.0 + i % 5, 10.0, 0.01) for p in (1, 2) for i in range(70)]
    df = spark.createDataFrame(rows, "permno long, date date, openprc double, askhi double, bidlo double, adj_prc double, vol double, ret double")
    macro = df.select("date", F.lit(1.0).alias("comm_XLK_close")).distinct()
    out = G.augmented(df, macro)
    assert out.count() == len(rows) and not [c for c in out.columns if c.startswith(("ratio_", "comm_ti_"))]
    assert {"ti_rsi_14", "ti_skew_63", "vol_logret", "comm_XLK_close_logret", "adj_prc_logret_lag5", "adj_prc_logret_lead1"} <= set(out.columns)
    assert G.augmented(df.limit(0), macro).count() == 0
    matrix = G.model_matrix(df, macro)
    assert S.coverage(matrix).first().equal and {"adj_prc", "ret"}.isdisjoint(matrix.columns)


def test_required_columns_of_checks(spark):
    df = spark.createDataFrame([(D[0], float("inf"), 0.1), (D[0], None, 0.0)], "date date, mktrf double, rf double")
    assert {r.rule: r.n for r in S.factor_findings(df, ["mktrf"], "rf").collect()} == {"missing_mktrf": 1, "infinite_mktrf": 1, "infinite_rf": 0, "large_mktrf": 1, "large_rf": 1, "repeated_key": 1}
    for check in (S.consensus_findings, S.actuals_findings, lambda x: S.factor_findings(x, ["smb"])):
        with pytest.raises(ValueError):
            check(df)
    both = df.withColumns({"cusip": F.lit("a"), "ncusip": F.lit("b")})
    assert P.prefer_latest(both).columns == ["date", "mktrf", "rf", "ncusip"]


def test_out_of_sample_of_the_chosen(spark):
    rng = np.random.default_rng(9)
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(100)]
    rows = [(s, a, d, float(rng.normal(0.001 * k, 0.01))) for k, (s, a) in enumerate((s, a) for s in ("S1", "S2") for a in ("A1", "A2")) for d in days]
    returns = spark.createDataFrame(rows, "scoring string, allocation string, date date, port_ret double")
    both = B.metrics(B.sides(returns), (*B.COMBO, "in_sample"))
    inside, outside = (B.metrics(returns.filter(c)) for c in (F.col("date") < days[65], F.col("date") >= days[65]))
    for how, k in (("best", 1), ("top", 3), ("all", 4)):
        want = outside.join(B.chosen(inside, how, 3), list(B.COMBO), "left_semi")
        got = B.out_of_sample(both, how, 3)
        assert got.count() == k and sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert B.degradation(both).count() == 4


def test_partition_count_changes_nothing(spark):
    import __spark_entry__ as entry

    q = entry.queries()["r1_r3_grid"]
    out = []
    for n in ("1", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(tuple, q(spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1] and len(out[0]) == 15
