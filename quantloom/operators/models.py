"""Chronological splits, rolling folds, elastic-net models on pyspark.ml, scoring and evaluation."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Distinct dates with their number from 0 (thousands of rows, so a window without a key)."""
    return df.select(F.col(date).alias("date")).distinct().withColumn("t", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))


def split_date(df: DataFrame, share: float = 0.65, date: str = "date"):
    """The first date out of sample: that of number int(dates x share)."""
    days = calendar(df, date)
    at = int(days.count() * share)
    row = days.filter(F.col("t") == at).first()
    return row["date"] if row else None


def split(df: DataFrame, share: float = 0.65, date: str = "date") -> DataFrame:
    """in_sample per row, by one broadcast row of the calendar."""
    days = calendar(df, date)
    n = days.agg(F.count("*").alias("_n"))
    cut = days.crossJoin(n).filter(F.col("t") == F.floor(F.col("_n") * share)).select(F.col("date").alias("_cut"))
    return df.join(F.broadcast(cut), F.lit(True), "left").withColumn("in_sample", F.coalesce(F.col(date) < F.col("_cut"), F.lit(True))).drop("_cut")


@dataclass(frozen=True)
class Folds:
    train: int
    val: int
    step: int
    n: int


def fold_geometry(n: int, folds: int = 10, train: float = 0.6, val: float = 0.2) -> Folds:
    a, b = int(train * n), int(val * n)
    step = max(1, (n - a - b) // (folds - 1))
    return Folds(a, b, step, (n - a - b) // step + 1)


def fold_dates(df: DataFrame, geometry: Folds, date: str = "date") -> DataFrame:
    """(fold, role, date): training dates of each fold, then its validation dates. The fold table has `n` rows."""
    days = calendar(df, date)
    folds = df.sparkSession.range(geometry.n).select(F.col("id").alias("fold"), (F.col("id") * geometry.step).alias("a"))
    b, c = F.col("a") + geometry.train, F.col("a") + geometry.train + geometry.val
    hit = days.join(F.broadcast(folds), (F.col("t") >= F.col("a")) & (F.col("t") < c))
    return hit.select("fold", F.when(F.col("t") < b, "train").otherwise("val").alias("role"), "date")


def scale_of(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature; one row reaches the driver."""
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in features}


def scaled(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()})


@dataclass
class Fitted:
    features: list[str]
    scale: dict[str, tuple[float, float]]
    coefficients: list[float]
    intercept: float
    logistic: bool

    def scored(self, df: DataFrame, out: str) -> DataFrame:
        """The linear form in built-in expressions, through the logistic function for a classifier."""
        z = F.lit(self.intercept)
        for c, b in zip(self.features, self.coefficients):
            if b:
                m, s = self.scale[c]
                z = z + (F.col(c) - m) * (b / s)
        return df.withColumn(out, 1 / (1 + F.exp(-z)) if self.logistic else z)


def _assembled(df: DataFrame, features: Sequence[str], target: str, scale: dict) -> DataFrame:
    known = df.dropna(subset=[*features, target])
    return VectorAssembler(inputCols=list(features), outputCol="_x").transform(scaled(known, scale)).select("_x", F.col(target).cast("double").alias("_y"))


def fit_logistic(df: DataFrame, features: Sequence[str], target: str, C: float = 0.1, l1_ratio: float = 0.9, max_iter: int = 500, tol: float = 1e-8) -> Fitted:
    """Elastic-net classifier of target > 0, with scikit-learn's C: the penalty is 1 / (C n)."""
    df = df.dropna(subset=[*features, target]).withColumn("_up", (F.col(target) > 0).cast("double"))
    scale, n = scale_of(df, features), df.count()
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1 / (C * max(n, 1)), elasticNetParam=l1_ratio, standardization=False, maxIter=max_iter, tol=tol).fit(_assembled(df, features, "_up", scale))
    return Fitted(list(features), scale, model.coefficients.toArray().tolist(), model.intercept, True)


def fit_linear(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1e-4, l1_ratio: float = 0.5, max_iter: int = 500, tol: float = 1e-10) -> Fitted:
    """Elastic-net regression with scikit-learn's alpha. pyspark.ml divides the label by its deviation, so the penalties are mapped."""
    df = df.dropna(subset=[*features, target])
    scale = scale_of(df, features)
    sd = df.agg(F.stddev_samp(target)).first()[0] or 1.0
    weight = l1_ratio / sd + 1 - l1_ratio
    rows = _assembled(df.withColumn(target, F.col(target) / sd), features, target, scale)
    model = LinearRegression(featuresCol="_x", labelCol="_y", regParam=alpha * weight, elasticNetParam=l1_ratio / sd / weight, standardization=False, maxIter=max_iter, tol=tol).fit(rows)
    return Fitted(list(features), scale, (model.coefficients.toArray() * sd).tolist(), model.intercept * sd, False)


def grid_search(df: DataFrame, folds: DataFrame, features: Sequence[str], target: str, grid: dict[str, Sequence[float]], logistic: bool, max_iter: int = 100, tol: float = 1e-8) -> list[dict]:
    """Error of each setting, averaged over rolling folds, in the order that breaks ties (first key outermost).

    Rows are read once for all folds and settings of a linear model: a fold's sums of products are all that its fits and errors
    need. A classifier takes one pass a Newton step, in which each fold's models of all settings add up their gradients and
    curvatures, and one for the errors. What reaches the driver is (features + 2)^2 numbers a fold and setting. Scalers are fitted
    per fold, on its training rows alone; penalties are those of fit_logistic and fit_linear. There may be 62 folds.
    """
    settings = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    ids = [r.fold for r in folds.select("fold").distinct().orderBy("fold").collect()]
    if ids and not 0 <= ids[0] <= ids[-1] < 62:
        raise ValueError("folds are numbered from 0 to 61")
    bits = [F.coalesce(F.expr(f"bit_or(CASE WHEN role = '{r}' THEN shiftleft(1L, CAST(fold AS INT)) END)"), F.lit(0)).alias(f"_{r}") for r in ("train", "val")]
    days = folds.groupBy("date").agg(*bits)  # a row a date
    rows = df.dropna(subset=[*features, target]).join(F.broadcast(days), "date").select("_train", "_val", *features, target).persist()
    try:
        sums = _added(rows, lambda of: ((f"{r} {k}", z.T @ z) for r in ("train", "val") for k in ids for z in [np.column_stack(of(r, k))]))
        fits = [_Moments(sums[f"train {k}"], len(features)) for k in ids]
        if logistic:
            errors = _classified(rows, ids, fits, settings, max_iter, tol)
        else:
            errors = [[_rmse(sums[f"val {k}"], m.linear(**s)) for k, m in zip(ids, fits)] for s in settings]
    finally:
        rows.unpersist()
    return [s | {"error": sum(e) / len(e), "combo_order": i} for i, (s, e) in enumerate(zip(settings, errors))]


def _added(rows: DataFrame, of) -> dict[str, np.ndarray]:
    """Sums over all rows of the arrays that `of` names for a batch; it gets a function from role and fold to ([1, x], y) of the batch's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack((np.ones(len(batch)), batch.iloc[:, 2:-1].to_numpy("f8")))
            y, masks = batch.iloc[:, -1].to_numpy("f8"), {r: batch[f"_{r}"].to_numpy("i8") for r in ("train", "val")}

            def part(role: str, fold: int) -> tuple[np.ndarray, np.ndarray]:
                at = (masks[role] >> fold & 1).astype(bool)
                return x[at], y[at]

            for key, value in of(part):
                total[key] = total.get(key, 0.0) + value
        if total:  # a part without rows has no sums, and Arrow no type for a column of no lists
            yield pd.DataFrame({"key": list(total), "shape": [list(v.shape) for v in total.values()], "v": [v.ravel() for v in total.values()]})

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": g["key"].iloc[:1], "shape": g["shape"].iloc[:1], "v": [np.sum(np.stack(g["v"].to_list()), axis=0)]})

    kind = "key string, shape array<int>, v array<double>"
    return {r.key: np.array(r.v).reshape(r.shape) for r in rows.mapInPandas(run, kind).groupBy("key").applyInPandas(add, kind).collect()}


class _Moments:
    """A fold's training rows by their sums of products of (1, x, y), and fits that need no more."""

    def __init__(self, sums: np.ndarray, k: int):
        self.n, x = sums[0, 0], slice(1, k + 1)
        self.mean, self.y = sums[0, x] / self.n, sums[0, -1] / self.n
        sd = np.sqrt(np.maximum(sums[x, x].diagonal() / self.n - self.mean**2, 0))
        self.sd = np.where(sd > 0, sd, 1.0)
        self.products = (sums[x, x] / self.n - np.outer(self.mean, self.mean)) / np.outer(self.sd, self.sd)
        self.target = (sums[x, -1] / self.n - self.mean * self.y) / self.sd

    def raw(self, b: np.ndarray, b0: float) -> np.ndarray:
        """Intercept and coefficients of features as they come, from those of scaled ones."""
        return np.concatenate(([b0 - (b * self.mean / self.sd).sum()], b / self.sd))

    def linear(self, alpha: float, l1_ratio: float) -> np.ndarray:
        b = _descent(-self.target, self.products, np.zeros(len(self.mean)), np.full(len(self.mean), alpha), l1_ratio)
        return self.raw(b, self.y)


def _descent(slope: np.ndarray, curve: np.ndarray, b: np.ndarray, penalty: np.ndarray, l1_ratio: float, sweeps: int = 10_000, tol: float = 1e-13) -> np.ndarray:
    """The b that minimises slope b + b curve b / 2 + penalty (l1_ratio |b| + (1 - l1_ratio) b^2 / 2), by coordinate descent."""
    b = b.copy()
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(b)):
            below = curve[j, j] + penalty[j] * (1 - l1_ratio)
            v = curve[j, j] * b[j] - slope[j] - curve[j] @ b
            new = np.sign(v) * max(abs(v) - penalty[j] * l1_ratio, 0.0) / below if below > 0 else 0.0
            most, b[j] = max(most, abs(new - b[j])), new
        if most < tol:
            break
    return b


def _rmse(sums: np.ndarray, w: np.ndarray) -> float:
    e = np.append(w, -1.0)
    return float(np.sqrt(max(e @ sums @ e, 0.0) / sums[0, 0]))


def _classified(rows: DataFrame, ids: list[int], fits: list[_Moments], settings: list[dict], max_iter: int, tol: float) -> list[list[float]]:
    """Shares of wrongly called validation rows, by setting and fold, of classifiers fitted together by proximal Newton steps."""
    k = len(fits[0].mean) + 1 if fits else 1
    names = [(i, j) for i in range(len(settings)) for j in range(len(ids))]
    now = {m: np.zeros(k) for m in names}  # intercept and coefficients of scaled features
    before, best, open_ = dict(now), dict.fromkeys(names, np.inf), set(names)

    def raw(m: tuple[int, int]) -> np.ndarray:
        return fits[m[1]].raw(now[m][1:], now[m][0])

    for _ in range(max_iter):
        if not open_:
            break
        asked = {m: raw(m) for m in open_}

        def of(part):
            for i, j in sorted(asked):
                x, y = part("train", ids[j])
                z, up = x @ asked[i, j], y > 0
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                loss = np.logaddexp(0, z).sum() - z[up].sum()
                yield f"{i} {j}", np.vstack((np.append(loss, np.zeros(k))[None, :k], (x.T @ (p - up))[None], x.T @ (x * (p * (1 - p))[:, None])))

        found = _added(rows, of)
        for m in sorted(open_):
            fit, got = fits[m[1]], found[f"{m[0]} {m[1]}"] / fits[m[1]].n
            ratio_, penalty = settings[m[0]]["l1_ratio"], np.append(0.0, np.full(k - 1, 1 / (settings[m[0]]["C"] * fit.n)))
            value = got[0, 0] + (penalty * (ratio_ * np.abs(now[m]) + (1 - ratio_) / 2 * now[m] ** 2)).sum()
            if value > best[m] + 1e-12:  # too long a step
                now[m] = (now[m] + before[m]) / 2
                continue
            scale = np.eye(k)
            scale[0, 1:], scale[range(1, k), range(1, k)] = -fit.mean / fit.sd, 1 / fit.sd
            slope, curve = scale.T @ got[1], scale.T @ got[2:] @ scale
            new = _descent(slope - curve @ now[m], curve, now[m], penalty, ratio_)
            best[m], before[m] = value, now[m]
            if np.abs(new - now[m]).max() < tol:
                open_.discard(m)
            now[m] = new
    final = {m: raw(m) for m in names}

    def wrong(part):
        for i, j in names:
            x, y = part("val", ids[j])
            yield f"{i} {j}", np.array([((x @ final[i, j] > 0) != (y > 0)).sum(), len(y)], "f8")

    counts = _added(rows, wrong)
    return [[float(counts[f"{i} {j}"][0] / counts[f"{i} {j}"][1]) for j in range(len(ids))] for i in range(len(settings))]


def best_setting(found: list[dict]) -> dict:
    return min(found, key=lambda x: (x["error"], x["combo_order"]))


def top_predictors(model: Fitted, spark, k: int = 10) -> DataFrame:
    rows = [(c, float(b)) for c, b in zip(model.features, model.coefficients) if b]
    return spark.createDataFrame(rows, "feature string, coefficient double").orderBy(F.abs("coefficient").desc(), "feature").limit(k)


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """A row a class (0, 1): precision, recall, f1, support, and the accuracy and error of all."""
    c = df.filter(F.col(label).isNotNull() & F.col(predicted).isNotNull()).agg(*[F.count_if((F.col(label) == a) & (F.col(predicted) == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])
    all_ = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    right = F.try_divide(F.col("n00") + F.col("n11"), all_)

    def one(k: int) -> DataFrame:
        hit, called, there = F.col(f"n{k}{k}"), F.col(f"n0{k}") + F.col(f"n1{k}"), F.col(f"n{k}0") + F.col(f"n{k}1")
        return c.select(F.lit(k).alias("label"), F.try_divide(hit, called).alias("precision"), F.try_divide(hit, there).alias("recall"), F.try_divide(2 * hit, called + there).alias("f1"), there.alias("support"), right.alias("accuracy"), (1 - right).alias("error"))

    return one(0).unionByName(one(1))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def regression_report(df: DataFrame, actual: str, predicted: str, baseline: str) -> DataFrame:
    """RMSE, R2, MAE, the RMSE of predicting the column `baseline` (a constant), and the percent gained on it."""
    a, e = F.col(actual), F.col(actual) - F.col(predicted)
    g = df.filter(a.isNotNull() & F.col(predicted).isNotNull()).agg(F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.sum(a * a) - F.sum(a) * F.avg(a))).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg((a - F.col(baseline)) * (a - F.col(baseline)))).alias("baseline_rmse"))
    return g.withColumn("improvement_pct", 100 * F.try_divide(F.col("baseline_rmse") - F.col("rmse"), F.col("baseline_rmse")))
