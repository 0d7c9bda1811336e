"""Benchmark decontamination: windows of benchmark words, broadcast as a hash set, are looked for in documents.

Words: A-Z in lower case, then runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`. A window is `size` consecutive words of an item; an
item of fewer words, but not none, is one window of its own length. A document word inside any occurrence is hit.

Windows are cut and made different from each other in Spark, each with a name of its set of owners, so that rows and passages which
repeat count once. They are broadcast only up to `max_windows` of them (a documented bound, see WindowSet); a larger benchmark
goes through the same scan in slices by a hash of the window, one pass over the documents for each, whose hits are joined by
document. One slice at a time reaches the driver, which makes its hash table. Items of occurring windows are named behind the scan:
by a table that goes along while it has the same bound, or by a join. Every document is scanned whole: a polynomial
hash of each token window is looked up in a bit table first, survivors in the sorted hashes, and then verified word by word.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, discard, edited, stored

SIZE = 10
#: A-Z to lower case; the separators to blanks; 0-9, a-z and every byte from 0x80 on stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_SALTS = 16


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_windows(text: str, size: int = SIZE) -> Iterator[bytes]:
    """An item's windows as words joined by blanks, in order, repeats included; of few words, all of them are one window."""
    w = words(text)
    n = min(size, len(w))
    return (b" ".join(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0))


class WindowSet:
    """Different windows by length: for each length the sorted hashes, where each window's words are, a number of its set of owners, and a bit table.

    `names` holds what is reported of each set of owners, once a set: its items, or a name of the set itself. A window of ten words
    takes some 52 bytes: a million windows are held in 60 MB and made in some 300.
    """

    def __init__(self, items: Iterable[tuple[str | None, str | None]], size: int = SIZE):
        owners: dict[bytes, set] = {}
        for item, text in items:
            for w in item_windows(text or "", size):
                owners.setdefault(w, set()).add(item)
        of = {}
        sets = [of.setdefault(frozenset(x), len(of)) for x in owners.values()]
        self._index(list(owners), np.array(sets, "i4"), [sorted(x for x in s if x is not None) for s in of])

    @classmethod
    def of_windows(cls, windows: Sequence[bytes], sets: np.ndarray, names: Sequence[Sequence[str]]) -> WindowSet:
        """From different windows, the number of each one's set of owners, and the names of each set."""
        self = cls.__new__(cls)
        self._index(windows, sets, names)
        return self

    def _index(self, windows: Sequence[bytes], sets: np.ndarray, names: Sequence[Sequence[str]]) -> None:
        self.ids: dict[bytes, int] = {}
        self.names = names
        flat, sizes = array("I"), np.empty(len(windows), "i8")
        for i, w in enumerate(windows):
            known = [self.ids.setdefault(x, len(self.ids) + 1) for x in w.split()]
            flat.extend(known)
            sizes[i] = len(known)
        self.flat = np.array(flat, "u4")
        starts = np.cumsum(sizes) - sizes
        self.by: dict[int, tuple] = {}
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            h = self._hash(self.flat, starts[own], n)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << _BITS, bool)
            bits[h >> np.uint64(64 - _BITS)] = True
            self.by[n] = (h[order], starts[own][order], sets[own][order], bits)

    @staticmethod
    def _hash(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(starts), "u8")
        for i in range(n):
            out = (out ^ ids[starts + i]) * _MULT
            out ^= out >> np.uint64(29)
        return out * _MULT

    def scan(self, text: str) -> tuple[int, np.ndarray, set]:
        """Word count, which words are hit, and the names of the owners of occurring windows."""
        w = words(text)
        get = self.ids.get
        ids = np.fromiter((get(x, 0) for x in w), "u4", len(w))
        hit, found = np.zeros(len(w) + 1, "i4"), set()
        total = np.concatenate(([0], np.cumsum(ids != 0)))
        for n, (hashes, places, owners, bits) in self.by.items():
            if len(w) < n:
                continue
            starts = np.flatnonzero(total[n:] - total[:-n] == n)  # of runs of n known words
            if not len(starts):
                continue
            out = self._hash(ids, starts, n)
            keep = np.flatnonzero(bits[out >> np.uint64(64 - _BITS)])
            if not len(keep):
                continue
            starts, out = starts[keep], out[keep]
            lo, hi = np.searchsorted(hashes, out, "left"), np.searchsorted(hashes, out, "right")
            for s, a, b in zip(starts.tolist(), lo.tolist(), hi.tolist()):
                for k in range(a, b):
                    if (self.flat[places[k] : places[k] + n] == ids[s : s + n]).all():  # verified: not the hash alone
                        hit[s] += 1
                        hit[s + n] -= 1
                        found.add(int(owners[k]))
        return len(w), np.cumsum(hit[:-1]) > 0, {x for k in found for x in self.names[k]}


def _owned(benchmark: DataFrame, size: int) -> DataFrame:
    """(window, item), each pair once, of all items of the benchmark; equal rows are merged before they are cut."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text")).filter(F.col("text").isNotNull()).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                left = item_windows(text, size)
                while part := list(itertools.islice(left, 20_000)):  # of an item of any length
                    part = list(dict.fromkeys(part))
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([item] * len(part), pa.string())], names=["window", "item"])

    return items.mapInArrow(run, "window binary, item string").distinct()


def _fits(df: DataFrame, column: str, max_windows: int) -> int:
    """How many slices the rows of `df` take of about max_windows rows, and 100 bytes a row, at most."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return max(1, -(-n // max_windows), -(-size // (100 * max_windows)))


def _slices(windows: DataFrame, max_windows: int) -> tuple[int, Iterator[tuple[list[bytes], list[str]]]]:
    """How many slices different (window, owners) rows make, by a hash of the window, and the slices; one is fetched at a time."""
    n = _fits(windows, "window", max_windows)

    def parts() -> Iterator[tuple[list[bytes], list[str]]]:
        for k in range(n):
            rows = (windows if n == 1 else windows.filter(F.pmod(F.xxhash64("window"), F.lit(n)) == k)).toArrow()
            yield rows.column("window").to_pylist(), rows.column("owners").to_pylist()

    return n, parts()


def _set(part: tuple[list[bytes], list[str]], names: Mapping[str, Sequence[str]] | None = None) -> WindowSet:
    """The windows of a slice; of their sets of owners, `names` or the sets' own names are reported."""
    of: dict[str, int] = {}
    numbers = np.array([of.setdefault(x, len(of)) for x in part[1]], "i4")
    return WindowSet.of_windows(part[0], numbers, [[x] if names is None else names.get(x, []) for x in of])


def scan(docs: DataFrame, windows: WindowSet, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row key, n_words, hit ranges, items): every document against one set of windows."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in bounded(batches):
            n_words, hits, items = [], [], []
            for t in batch.column(1).to_pylist():
                n, hit, who = found.scan(t)
                n_words.append(n)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])))).tolist() if len(hit) and hit.any() else []
                hits.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2])])
                items.append(sorted(x for x in who if x is not None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))], names=[key, "n_words", "hits", "items"])

    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    return plain.mapInArrow(run, f"{key} {kind}, n_words long, hits array<struct<start:int,end:int>>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, max_windows: int = 1_000_000) -> DataFrame:
    """A row per document: doc_id, n_words, hits (word ranges, merged and in order), items (ids, sorted as strings).

    Null and empty texts have no words. Items of null text have no windows; an item of null id makes hits but isn't listed;
    items of equal id count as one. Rows of equal doc_id and text keep a row each and have equal results. An empty benchmark hits nothing.
    """
    made: list[str] = []
    owned = stored(_owned(benchmark, size), made)
    # A set of owners is named by its size and two sums that don't depend on order: no list of owners is ever gathered.
    name = F.md5(F.concat_ws(":", F.count(F.lit(1)), F.sum(F.xxhash64("item").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit("set"), "item"))).cast("binary"))
    windows = stored(owned.groupBy("window").agg(name.alias("owners")), made)
    one = windows.groupBy("owners").agg(F.min("window").alias("window"))
    members = stored(one.join(owned, "window").filter("item is not null").select("owners", "item"), made)
    n, parts = _slices(windows, max_windows)
    if n == 1 and _fits(members, "item", max_windows) == 1:
        names: dict[str, list[str]] = {}
        for r in members.toLocalIterator():
            names.setdefault(r.owners, []).append(r.item)
        found = _set(next(parts), names)
        discard(made)
        return scan(docs, found)
    keyed = stored(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    merged = _merged(keyed, parts)
    sets = merged.select("row", F.explode("items").alias("owners"), F.pmod(F.xxhash64("row"), F.lit(_SALTS)).alias("salt"))
    spread = members.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    named = sets.join(spread, ["owners", "salt"]).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))  # a document's own list
    out = keyed.select("row", "doc_id").join(merged.drop("items"), "row").join(named, "row", "left")
    return out.select("doc_id", "n_words", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _merged(keyed: DataFrame, parts: Iterable[tuple[list[bytes], list[str]]]) -> DataFrame:
    """(row, n_words, hits, items) of the stored (row, text): one pass a slice over the whole texts, then the union of what the slices found."""
    found = None
    for part in parts:
        one = stored(scan(keyed, _set(part), key="row"))
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )  # a row's lists: as many as slices
    union = F.aggregate(
        "hits",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return merged.withColumn("hits", union)


def decontaminate(docs: DataFrame, benchmark: DataFrame, drop_share: float = 0.5, size: int = SIZE, max_windows: int = 1_000_000) -> DataFrame:
    """The documents with hit spans cut out of their texts; one of whose words drop_share or more are hit goes.

    A span runs from its first word's first character to its last word's end. Other columns stay as they are; null texts stay null.
    The hits of all slices of a larger benchmark are found on the texts as they came, and cut at once. Repeated rows meet the same
    fate, each by itself. An empty table gives no rows, an empty benchmark cuts nothing.
    """
    made: list[str] = []
    windows = stored(_owned(benchmark, size).select("window", F.lit("").alias("owners")).distinct(), made)
    n, parts = _slices(windows, max_windows)
    if n == 1:
        shared = docs.sparkSession.sparkContext.broadcast(_set(next(parts)))
        discard(made)

        def edit(texts: list[str | None]) -> tuple[list, list]:
            out, keep = [], []
            for t in texts:
                _, hit, _ = shared.value.scan(t or "")
                share = hit.mean() if len(hit) else 0.0
                keep.append(share < drop_share)
                out.append(cut(t, hit) if share else t)
            return out, keep

        return edited(docs, edit)
    names, renamed = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    at = names.index("text")
    rows = stored(docs.toDF(*renamed).withColumn("row", F.monotonically_increasing_id()))
    found = _merged(rows.select("row", F.col(renamed[at]).alias("text")), parts)
    discard(made)
    joined = rows.join(found.filter("size(hits) > 0").select("row", "n_words", "hits"), "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            out, keep = [], []
            for t, words_of, spans in zip(*(batch.column(i).to_pylist() for i in (at, len(names), len(names) + 1))):
                hit = np.zeros(words_of or 0, bool)
                for span in spans or ():
                    hit[span["start"] : span["end"]] = True
                keep.append((hit.mean() if spans else 0.0) < drop_share)
                out.append(cut(t, hit) if spans else t)
            columns = [pa.array(out, pa.string()) if i == at else x for i, x in enumerate(batch.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays(columns, names=renamed).filter(pa.array(np.array(keep, bool)))

    return joined.select(*renamed, "n_words", "hits").mapInArrow(run, rows.select(*renamed).schema).toDF(*names)


def cut(text: str, hit: np.ndarray) -> str:
    """`text` without the runs of hit words and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    solid = np.frombuffer(raw.translate(_FOLD), "u1") != 32
    edge = np.diff(np.concatenate(([0], solid.astype("i1"), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.diff(np.concatenate(([0], hit.astype("i1"), [0])))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1)):
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents against benchmark: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Every row keeps its row, repeated ones and null doc_ids too; null and empty texts have no words. Texts of any length are
    scanned whole. An empty table gives no rows, an empty benchmark no hits. Other columns are not read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
