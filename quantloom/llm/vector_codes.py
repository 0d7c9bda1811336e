"""Compression of vectors to codes: a codebook per part of the vector, learned in rounds of whole-number arithmetic.

The nearest entry of a codebook is found by slicing and intersecting. Each coordinate of the entries is sorted once, and beside
each place of the sorted list stands a bit mask of all entries up to it. For a vector and a radius, two binary searches a
coordinate give the range of entries whose coordinate is no farther off; the mask of a range is one prefix mask less another, and
the AND over the coordinates is the set of entries in the box of that radius. The first radius is a guess of the codebook's own
spacing. If the box is empty it doubles; else its best entry's distance is the last radius, whose box holds every entry that is
as near or nearer. What the masks leave is compared exactly.

Each round reads the vectors, with the codebooks in the task (256 entries times the vector's length: bounded, however many rows
there are). A task adds up its rows by part and entry; Spark adds up the tasks, and no row moves. Codebooks of a round reach the
driver, rows don't.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, discard, stored
from .vectors import integers, pack, unpack

#: Components beyond are refused: squared distances must fit in 63 bits.
LARGEST = 1 << 26
MAX_BROADCAST = 100_000


class SliceIndex:
    """The entries of a codebook (rows of whole numbers) by sorted coordinates with prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        m, d = entries.shape
        self.words = -(-m // 64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, 0)
        bits = np.zeros((m, self.words), "u8")
        bits[np.arange(m), np.arange(m) // 64] = np.uint64(1) << (np.arange(m) % 64).astype("u8")
        self.all = np.bitwise_or.reduce(bits, axis=0)
        self.prefix = np.zeros((d, m + 1, self.words), "u8")
        for j in range(d):
            np.bitwise_or.accumulate(bits[order[:, j]], axis=0, out=self.prefix[j, 1:])
        gaps = np.diff(self.sorted, axis=0)
        self.radius = max(1, int(gaps.mean() * m / 8)) if m > 1 and d else 1

    def within(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Of each row of x: bit masks of the entries none of whose coordinates is farther off than its radius."""
        mask = np.tile(self.all, (len(x), 1))
        for j in range(x.shape[1]):
            lo = np.searchsorted(self.sorted[:, j], x[:, j] - radius, "left")
            hi = np.searchsorted(self.sorted[:, j], x[:, j] + radius, "right")
            mask &= self.prefix[j, hi] & ~self.prefix[j, lo]
        return mask

    def best(self, x: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of each row's masked entries (the first of those that tie; -1 if there is none), and the squared distance to it."""
        m = len(self.entries)
        chosen = np.unpackbits(masks.astype("<u8").view("u1"), axis=1, bitorder="little")[:, :m].astype(bool)
        far = np.full(chosen.shape, np.iinfo("i8").max)
        largest = max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        if 4 * chosen.sum() > chosen.size and largest * largest * 4 * max(x.shape[1], 1) < 1 << 53:  # many: side by side, exact in doubles
            f, e = x.astype("f8"), self.entries.astype("f8")
            d = ((f * f).sum(1)[:, None] - 2 * (f @ e.T) + (e * e).sum(1)).astype("i8")
            far[chosen] = d[chosen]
        else:
            i, j = np.nonzero(chosen)
            d = np.zeros(len(i), "i8")
            for a, b in zip(x.T, self.entries.T):
                d += (a[i] - b[j]) ** 2
            far[i, j] = d
        at = far.argmin(1)
        return np.where(chosen.any(1), at, -1), far[np.arange(len(x)), at]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of x: the nearest entry, the first of those that tie, and the squared distance."""
        at, far = np.zeros(len(x), "i8"), np.zeros(len(x), "i8")
        todo, radius = np.arange(len(x)), np.full(len(x), self.radius, "i8")
        while len(todo):
            which, d = self.best(x[todo], self.within(x[todo], radius[todo]))
            none = which < 0
            root = np.ceil(np.sqrt(np.where(none, 0, d).astype("f8")) + 1e-3).astype("i8")  # no less than the distance
            known = ~none & (root <= radius[todo])
            at[todo[known]], far[todo[known]] = which[known], d[known]
            radius[todo] = np.where(none, 2 * radius[todo], root)
            todo = todo[~known]
        return at, far


def _cleaned(rows: DataFrame, vector: str, keep: list[str], scale: int) -> DataFrame:
    """The columns `keep` with the packed whole numbers of a vector, `code`, and its length, `dim`; rows that are no vectors are left out."""
    schema = rows.select(*keep).schema.add("code", "binary").add("dim", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            good, values, lengths = integers(batch.column(0), scale)
            if len(values) and max(values.max(), -values.min()) >= LARGEST:
                raise ValueError(f"components must stay below {LARGEST // scale}")
            rest = [c.filter(pa.array(good)) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(pack(values, lengths), pa.binary()), pa.array(lengths.astype("i4"))], names=[*keep, "code", "dim"])

    return rows.select(F.col(vector).cast("array<double>").alias("_vector"), *keep).mapInArrow(run, schema)


def _parts(codes: list[bytes], parts: int, dim: int) -> np.ndarray:
    return unpack(codes, parts * dim).reshape(len(codes), parts, dim)


def learn(rows: DataFrame, parts: int, dim: int, entries: int, rounds: int, key: str) -> np.ndarray:
    """The codebooks, as whole numbers by part, entry and component, of rows (key, code), after so many rounds."""
    start = rows.select(key, "code").orderBy(F.asc_nulls_last(key), "code").limit(entries).collect()
    books = _parts([bytes(r.code) for r in start], parts, dim).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        given = books

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = [SliceIndex(b) for b in given]
            sums, counts = np.zeros(given.shape, "i8"), np.zeros(given.shape[:2], "i8")
            for batch in bounded(batches):
                x = _parts(batch.column(0).to_pylist(), parts, dim)
                for p in range(parts):
                    at, _ = index[p].nearest(x[:, p])
                    np.add.at(sums[p], at, x[:, p])
                    counts[p] += np.bincount(at, minlength=given.shape[1])
            part, entry = np.nonzero(counts)
            for lo in range(0, len(part), 1024):
                p, e = part[lo : lo + 1024], entry[lo : lo + 1024]
                place = np.tile(np.arange(dim), len(p))
                columns = [np.repeat(p, dim).astype("i4"), np.repeat(e, dim).astype("i4"), place.astype("i4"), sums[p, e].ravel(), np.repeat(counts[p, e], dim)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["part", "entry", "place", "total", "n"])

        told = rows.select("code").mapInArrow(run, "part int, entry int, place int, total long, n long")
        table = told.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()  # at most a row a component of the codebooks
        part, entry, place, total, n = (c.to_numpy() for c in table.columns)
        books = books.copy()
        books[part, entry, place] = total // n
    return books


def encoded(rows: DataFrame, books: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns `keep` of rows with `_code` (two hex digits a part) and `_error` of each."""
    parts, _, dim = books.shape
    schema = rows.select(*keep).schema.add("_code", "string").add("_error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = [SliceIndex(b) for b in books]
        for batch in bounded(batches):
            x = _parts(batch.column(0).to_pylist(), parts, dim)
            found = [index[p].nearest(x[:, p]) for p in range(parts)]
            digits = np.stack([at for at, _ in found], 1).astype("u1")
            codes = [row.tobytes().hex() for row in digits]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(codes, pa.string()), pa.array(sum(d for _, d in found))], names=schema.names)

    return rows.select("code", *keep).mapInArrow(run, schema)


def _joined(rows: DataFrame, totals: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """rows with the column of `totals` of their (null-safe) key: broadcast if a count shows the table to be small, else spread over salts."""
    marked = totals.select(F.col(key).alias("_key"), F.lit(True).alias("_same"), "label_error")
    if totals.count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(marked), rows[key].eqNullSafe(F.col("_key")), "left").drop("_key", "_same")
    spread = marked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_own", (F.monotonically_increasing_id() % salts).cast("int"))
    return salted.join(spread, salted[key].eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_salt")), "left").drop("_key", "_same", "_own", "_salt")


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256): a row for each row of `vectors` whose vector is whole.

    Rows whose vector is null, or has null or non-finite components, are dropped. Vectors shorter than the longest, or whose
    longest length can't be cut into equal parts, count as zero beyond their end. Codebooks start as the rows of least keys, null
    keys last, rows of equal keys by their components; of fewer rows than `entries` they have an entry each. A repeated row
    counts each time. Components must stay below 65,536 (they are refused with an error). An empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number must fit in two hex digits")
    spark, kept = vectors.sparkSession, []
    named = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = stored(_cleaned(named, "vector", ["key", "label"], scale), kept)
    longest = rows.agg(F.max("dim")).first()[0]
    kinds = {n: named.schema[n].dataType.simpleString() for n in ("key", "label")}
    if longest is None:
        return spark.createDataFrame([], f"{key} {kinds['key']}, code string, error long, label_error long, codebooks_sha256 string")
    books = learn(rows, parts, -(-longest // parts), entries, rounds, "key")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    codes = stored(encoded(rows, books, ["key", "label"]))
    totals = stored(codes.groupBy("label").agg(F.sum("_error").alias("label_error")))
    discard(kept)
    out = _joined(codes, totals, "label")
    return out.select(F.col("key").alias(key), F.col("_code").alias("code"), F.col("_error").alias("error"), "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as codes of four parts and 256 entries after four rounds: vec_id, code, error, label_error, codebooks_sha256.

    Equal labels share the sum of their errors, null labels too. `compress` says what holds for broken, short, empty and repeated
    vectors, null keys and empty tables. Other columns of embeddings are not read.
    """
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
