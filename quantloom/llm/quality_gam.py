"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins at quantiles; each feature has a lookup table of one addend per bin, each of a few pairs of
features a table per pair of coarser bins. The tables are learned by cyclic boosting: round after round, each feature in turn
gets a shallow tree (three leaves; four quadrants for a pair) fitted to the logistic gradients of the rows, whose leaf values
times the learning rate are added to its table. A score is the logistic function of the intercept plus one addend of each
table, found for whole batches at once.

Fitting uses a bounded sample: at most `max_rows` labelled documents, those with the least hash of their doc_id. Features of
the sampled documents are computed in Spark; only their numbers (some hundred bytes a row) reach the driver. Scoring covers
every whole text in one narrow pass.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, edited

FEATURES = ("log_words", "word_length", "upper_words", "distinct_words", "same_as_before", "symbols", "bangs", "bars", "marks", "digits", "letters", "same_lines", "stop_marks")
MAX_ROWS = 20_000


def features(text: str) -> list[float]:
    """Numbers of a whole text; all zero without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), "u1"), minlength=256)
    total = raw.sum()
    lines = text.split("\n")
    share = lambda chars: float(raw[list(chars)].sum()) / n
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        sum(map(str.isupper, words)) / n,
        len(set(words)) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        share(b"#*$%&<>"),
        share(b"!"),
        share(b"|"),
        share(b".,;:?"),
        share(b"0123456789"),
        float(raw[65:91].sum() + raw[97:123].sum() + raw[128:].sum()) / total,
        1 - len(set(lines)) / len(lines),
        sum(map(str.endswith, words, itertools.repeat((".", "!", "?")))) / n,
    ]


@dataclass
class Model:
    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features: bins by search, then one addition a table."""
        out = np.full(len(x), self.intercept)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            out += table[np.searchsorted(cuts, x[:, j], "right")]
        for a, b, cuts_a, cuts_b, table in self.pairs:
            out += table[np.searchsorted(cuts_a, x[:, a], "right"), np.searchsorted(cuts_b, x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges midway between neighbouring values at quantiles."""
    values = np.unique(x)
    if len(values) < 2:
        return np.empty(0)
    middle = (values[1:] + values[:-1]) / 2
    at = np.searchsorted(values, np.quantile(x, np.arange(1, bins) / bins))
    spread = np.searchsorted(values, np.linspace(values[0], values[-1], 9)[1:-1])  # rare values far out get edges too
    return middle[np.unique(np.clip(np.concatenate((at, spread)), 0, len(middle) - 1))]


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values per bin of the best tree of three leaves: the best cut, then the best cut of either side."""

    def cut(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        left_g, left_h = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        all_g, all_h = g[lo:hi].sum(), h[lo:hi].sum()
        gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
        k = int(np.argmax(gain))
        return float(gain[k]), lo + k + 1

    n = len(g)
    edges = [0, n]
    gain, first = cut(0, n)
    if gain > 1e-9:
        edges = [0, first, n]
        (gain_l, at_l), (gain_r, at_r) = cut(0, first), cut(first, n)
        if max(gain_l, gain_r) > 1e-9:
            edges = sorted([*edges, at_l if gain_l >= gain_r else at_r])
    out = np.zeros(n)
    for lo, hi in itertools.pairwise(edges):
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(gain, values) of the best pair of cuts of a table of sums."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = cg.shape
    if a < 2 or b < 2:
        return 0.0, np.zeros((a, b))
    q = [(c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1]) for c in (cg, ch)]
    gain = sum(x**2 / (y + ridge) for x, y in zip(*q))
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    v = [q[0][k][i, j] / (q[1][k][i, j] + ridge) for k in range(4)]
    out = np.empty((a, b))
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, rate: float = 0.15, n_pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 40, ridge: float = 1.0) -> Model:
    """Fit on rows of features and labels 0 and 1. Without rows, or with one label alone, every score is the prior (0.5 for none)."""
    n, k = x.shape
    prior = (y.sum() + 0.5) / (n + 1)
    cuts = [_cuts(x[:, j], bins) for j in range(k)] if n else [np.empty(0)] * k
    model = Model(float(np.log(prior / (1 - prior))), cuts, [np.zeros(len(c) + 1) for c in cuts], [])
    if not n or len(np.unique(y)) < 2:
        return model
    binned = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    f = np.full(n, model.intercept)
    for _ in range(rounds):
        for j in range(k):
            p = 1 / (1 + np.exp(-f))
            g, h = np.bincount(binned[j], y - p, len(cuts[j]) + 1), np.bincount(binned[j], p * (1 - p), len(cuts[j]) + 1)
            step = rate * _tree(g, h, ridge)
            model.tables[j] += step
            f += step[binned[j]]
    coarse = [_cuts(x[:, j], pair_bins) for j in range(k)]
    at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse)]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        flat = at[a] * shape[1] + at[b]
        return np.bincount(flat, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(flat, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    ranked = sorted(itertools.combinations(range(k), 2), key=lambda ab: -_quadrants(*sums(*ab), ridge)[0])[:n_pairs]
    model.pairs = [(a, b, coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for a, b in ranked]
    for _ in range(pair_rounds):
        for a, b, _, _, table in model.pairs:
            step = rate * _quadrants(*sums(a, b), ridge)[1]
            table += step
            f += step[at[a], at[b]]
    return model


def _remainder(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model of labels.quality from documents whose crc32(doc_id) mod 3 is not 1; labels that are null or contradict each other are left out."""
    known = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (_remainder("doc_id") != 1))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", F.col("quality").cast("double").alias("quality"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")  # max_rows ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            x = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    got = rows.mapInArrow(run, "doc_id long, quality double, x array<double>").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).orderBy("doc_id").collect()
    x = np.array([r.x for r in got], "f8").reshape(len(got), len(FEATURES))
    return fit(x, np.array([r.quality for r in got]))


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score): every whole text's score; null texts count as empty, whose features are all zero."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            x = np.array([features(t or "") for t in batch.column(1).to_pylist()], "f8").reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], names=[key, "score"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose texts score `least` or more, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def edit(texts: list[str | None]) -> tuple[list, list]:
        x = np.array([features(t or "") for t in texts], "f8").reshape(-1, len(FEATURES))
        return texts, (shared.value.score(x) >= least).tolist()

    return edited(docs, edit)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of documents: doc_id, held_out, score, predicted.

    Every row keeps its row, repeated ones too. A null doc_id is not held out and never learned from; rows of one doc_id are
    learned from as the least of them. Null and empty texts have all features zero and a score like others. Texts of any length
    are scored whole. An empty table gives no rows; without labels, or with one label alone, scores are the prior (0.5 for none).
    Other columns are not read.
    """
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(_remainder("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
