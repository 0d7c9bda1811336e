"""Snapshots of extracted tables: parts with manifests, published by one rename, reused, extended by what is new, or replaced.

A snapshot lies below {folder}/{name}/{digest of its source}: another query never meets its files. Its parts are folders
g{generation}-{number}; part 0 is a whole extraction, later ones hold rows whose keys are above the high-water mark of those
before. A part's manifest lists its files and their lengths, its rows and bounds of the key. It is written behind the files and
before the rename that publishes the part, so that what a broken run leaves is never read. One writer at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

MANIFEST = "_manifest.json"


@dataclass
class Source:
    """What a snapshot is taken of: `identity` is what its digest is made of, `rows` gives the rows of disjoint SQL conditions."""

    identity: str
    rows: Callable[[Sequence[str]], DataFrame]

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.identity.encode()).hexdigest()[:16]


def jdbc(spark: SparkSession, url: str, query: str, fetch: int = 10_000, **properties: str) -> Source:
    """A database's query: each condition is read over a connection of its own, in a partition of its own."""
    settings = {"fetchsize": str(fetch)} | properties
    return Source(f"{url}\n{query}", lambda where: spark.read.jdbc(url, f"({query}) q", predicates=list(where), properties=settings))


def table(identity: str, df: DataFrame) -> Source:
    """A DataFrame; conditions reach its scan as filters."""
    return Source(identity, lambda where: df.filter(" OR ".join(f"({c})" for c in where)))


def literal(text: str, kind: DataType) -> str:
    """A key, as Spark casts it to a string, in SQL that databases and Spark read alike."""
    return text if isinstance(kind, NumericType) else f"'{text}'"


def even_ranges(source: Source, key: str, above: str | None, partitions: int, quote: Callable[[str], str] = str) -> list[str]:
    """Conditions of about equally many rows each, however uneven the keys: cut at quantiles of the keys, which are read first, alone.

    Keys are numbers, dates or timestamps (of the session's time zone). One key value is never cut: where it has more rows than a
    range, its range is larger. Rows of null keys are in the first range, unless `above` asks for keys above a mark.
    """
    name = quote(key)
    keys = source.rows([f"{name} > {above}" if above else "1 = 1"]).select(F.col(key).alias("k"))
    shares = [i / partitions for i in range(1, partitions)]
    found = keys.agg(F.percentile_approx("k", shares, 10_000).alias("q")).select(F.array_distinct(F.col("q").cast("array<string>")).alias("q")).first().q if shares else None
    cuts = [literal(x, keys.schema["k"].dataType) for x in found or []]  # quantiles ascend
    edges = [f"{name} > {above}" if above else None, *[f"{name} >= {c}" for c in cuts]]
    ranges = [" AND ".join(c for c in (low, high) if c) or "1 = 1" for low, high in zip(edges, [*[f"{name} < {c}" for c in cuts], None])]
    return ranges if above or not cuts else [f"{ranges[0]} OR {name} IS NULL", *ranges[1:]]


class _Files:
    """Paths of whatever file system a folder names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.fs = spark, self.at_of(spark, folder).getFileSystem(spark._jsc.hadoopConfiguration())

    @staticmethod
    def at_of(spark: SparkSession, path: str):
        return spark._jvm.org.apache.hadoop.fs.Path(path)

    def at(self, path: str):
        return self.at_of(self.spark, path)

    def listed(self, path: str) -> dict[str, int]:
        """Names and lengths of what lies in a folder; nothing, if it isn't there."""
        return {f.getPath().getName(): f.getLen() for f in self.fs.listStatus(self.at(path))} if self.fs.exists(self.at(path)) else {}

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self.at(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


@dataclass
class Part:
    path: str
    generation: int
    number: int
    rows: int
    low: str | None
    high: str | None


def published(spark: SparkSession, source: Source, folder: str, name: str) -> list[Part]:
    """The parts of the last whole generation, in order; none, if there is no whole part 0.

    A part counts if its manifest is there and its files are those that the manifest lists; so do those behind it as long as none
    is missing or damaged.
    """
    base, files = f"{folder.rstrip('/')}/{name}/{source.digest}", _Files(spark, folder)
    by: dict[int, dict[int, Part]] = {}
    for part in files.listed(base):
        if not part.startswith("g") or MANIFEST not in (there := files.listed(f"{base}/{part}")):
            continue
        m = json.loads(files.read(f"{base}/{part}/{MANIFEST}"))
        if all(there.get(f) == size for f, size in m["files"].items()):
            by.setdefault(m["generation"], {})[m["number"]] = Part(f"{base}/{part}", m["generation"], m["number"], m["rows"], m["low"], m["high"])
    for generation in sorted(by, reverse=True):
        parts = by[generation]
        if 0 in parts:
            return [parts[i] for i in range(next(i for i in range(len(parts) + 1) if i not in parts))]
    return []


def snapshot(spark: SparkSession, source: Source, folder: str, name: str, key: str, mode: str = "reuse", partitions: int = 32, quote: Callable[[str], str] = str) -> list[Part]:
    """The parts of a source's snapshot, extracted where they must be.

    mode: "reuse" takes what is published, else extracts all; "extend" extracts only rows whose key is above those published (rows
    of null keys and late rows of old keys come with a replacement alone); "replace" extracts all anew and then deletes what was.
    quote: how the source writes a column's name. Nothing is published for an extension without rows; an empty source is a part.
    """
    if mode not in ("reuse", "extend", "replace"):
        raise ValueError(f"unknown mode {mode!r}")
    have = published(spark, source, folder, name)
    if have and mode == "reuse":
        return have
    above = next((p.high for p in reversed(have) if p.high is not None), None) if mode == "extend" else None
    extend = above is not None  # without a mark all is extracted anew
    base, files = f"{folder.rstrip('/')}/{name}/{source.digest}", _Files(spark, folder)
    number = len(have) if extend else 0
    taken = [tuple(map(int, x[1:].split("-"))) for x in files.listed(base) if x.startswith("g")]
    generation = have[0].generation if extend else max((g for g, _ in taken), default=-1) + 1
    for g, n in taken:
        if g == generation and n >= number:  # damaged parts, and what is behind them: nobody reads these
            files.fs.delete(files.at(f"{base}/g{g:06d}-{n:06d}"), True)
    seen, staged = Observation(), f"{base}/_staged-{uuid.uuid4().hex}"
    rows = source.rows(even_ranges(source, key, above, partitions, quote))
    try:
        rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(key).cast("string").alias("low"), F.max(key).cast("string").alias("high")).write.parquet(staged)
        got = seen.get
        if extend and not got["rows"]:
            return have
        mark = lambda x: None if x is None else literal(x, rows.schema[key].dataType)
        listed = {f: size for f, size in files.listed(staged).items() if f.endswith(".parquet")}
        part = Part(f"{base}/g{generation:06d}-{number:06d}", generation, number, got["rows"], mark(got["low"]), mark(got["high"]))
        manifest = {"source": source.identity, "generation": generation, "number": number, "rows": part.rows, "low": part.low, "high": part.high, "files": listed}
        files.write(f"{staged}/{MANIFEST}", json.dumps(manifest, indent=1))
        if not files.fs.rename(files.at(staged), files.at(part.path)):
            raise OSError(f"{staged} could not be renamed to {part.path}")
    finally:
        if files.fs.exists(files.at(staged)):
            files.fs.delete(files.at(staged), True)
    if not extend:
        for p in have:
            files.fs.delete(files.at(p.path), True)
    return [*(have if extend else []), part]


def read(spark: SparkSession, parts: Sequence[Part], number: str | None = None) -> DataFrame:
    """The rows of a snapshot's parts; `number` names a column that tells each row's part."""
    df = spark.read.parquet(*[p.path for p in parts])
    return df if number is None else df.withColumn(number, F.regexp_extract(F.col("_metadata.file_path"), r"/g\d{6}-(\d{6})/", 1).cast("int"))


def reuse_or_extract(spark: SparkSession, sources: Mapping[str, tuple[Source, str]], folder: str, mode: str = "reuse", **options) -> dict[str, DataFrame]:
    """Named snapshots of (source, key), each reused or extracted as `mode` says, as DataFrames."""
    return {name: read(spark, snapshot(spark, source, folder, name, key, mode, **options)) for name, (source, key) in sources.items()}
