"""Tables: reading, checking, extracting and writing them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numeric import ratio


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read(spark: SparkSession, artifacts: Mapping[str, str], name: str, schema: StructType | None = None) -> DataFrame:
    """A named Parquet artifact; KeyError for an unknown name, FileNotFoundError for a missing file."""
    if name not in artifacts:
        raise KeyError(f"no artifact {name!r}; there are {sorted(artifacts)}")
    if not exists(spark, artifacts[name]):
        raise FileNotFoundError(artifacts[name])
    return (spark.read.schema(schema) if schema else spark.read).parquet(artifacts[name])


def missing(spark: SparkSession, folder: str, names: Sequence[str]) -> list[str]:
    return [n for n in names if not exists(spark, f"{folder}/{n}.parquet")]


def assert_present(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, str]:
    """Paths by name; FileNotFoundError names all that are missing."""
    if gone := missing(spark, folder, names):
        raise FileNotFoundError(f"{folder} lacks {', '.join(gone)}")
    return {n: f"{folder}/{n}.parquet" for n in names}


def load(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """DataFrames of a snapshot folder, all checked before any is read."""
    return {n: read(spark, paths, n) for paths in [assert_present(spark, folder, names)] for n in names}


def extract(spark: SparkSession, url: str, query: str, out: str, key: str, bounds: tuple, partitions: int = 32, fetch: int = 10_000, mode: str = "overwrite", **options: str) -> None:
    """A JDBC query to Parquet: `key` ranges over `bounds` in parallel partitions, rows are fetched in batches.

    mode: overwrite, or ignore to keep what is there.
    """
    if mode == "ignore" and exists(spark, out):
        return
    settings = {"url": url, "dbtable": f"({query}) q", "partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions), "fetchsize": str(fetch)} | options
    spark.read.format("jdbc").options(**settings).load().write.mode(mode).parquet(out)


def extract_all(spark: SparkSession, url: str, queries: Mapping[str, str], folder: str, key: str, bounds: tuple, force: bool = False, **options) -> dict[str, str]:
    """Extract named queries; those whose Parquet is there stay unless `force`."""
    for name, query in queries.items():
        extract(spark, url, query, f"{folder}/{name}.parquet", key, bounds, mode="overwrite" if force else "ignore", **options)
    return assert_present(spark, folder, list(queries))


def scratch(spark: SparkSession) -> str:
    """A new folder name in storage that all executors share, below spark.checkpoint.dir. Where that is unset: a temporary folder of one machine, if Spark runs on one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of `df`, written once to storage that all executors share and read back: what reads them more than once doesn't make them again."""
    df.write.parquet(path := scratch(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def half_open(df: DataFrame, start: str | None, end: str | None, column: str = "date") -> DataFrame:
    """Rows of [start, end); a bound of None is open. Reaches the scan as a pushed filter."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start).cast("date"))
    return df if end is None else df.filter(F.col(column) < F.lit(end).cast("date"))


def adjusted(df: DataFrame) -> DataFrame:
    """Daily stock rows with adjusted prices, volume, shares and market cap; NULL where the factor is zero."""
    price = lambda c: ratio(F.abs(F.col(c)), F.nullif(F.col("cfacpr"), F.lit(0.0)))
    return df.withColumns({f"adj_{c}": price(c) for c in ("prc", "bidlo", "askhi", "openprc")} | {"adj_vol": F.col("vol") * F.col("cfacshr"), "adj_shrout": F.col("shrout") * F.col("cfacshr")}).withColumn("adj_mktcap", F.col("adj_prc") * F.col("adj_shrout"))


def dispersion(mean: str, stdev: str, high: str, low: str) -> dict[str, Column]:
    """Coefficient of variation and range share of consensus estimates; NULL for a mean of zero or NULL."""
    size = F.abs(F.nullif(F.col(mean), F.lit(0.0)))
    return {"cons_cv": ratio(F.col(stdev), size), "cons_range_pct": ratio(F.col(high) - F.col(low), size)}


def widened(long: DataFrame, series: Sequence[str], values: Mapping[str, Column], key: str = "date", name: str = "series") -> DataFrame:
    """A long table, one row a (key, series, ...), as one row a key with columns {series}_{value}. Series are listed, so no job finds them."""
    return long.groupBy(key).pivot(name, list(series)).agg(*[c.alias(v) for v, c in values.items()])


def write_report(df: DataFrame, path: str) -> None:
    """Report rows by scoring, allocation and frequency. Those of the combinations that `df` has replace what was there, others stay.

    Files are staged and moved into place when the job commits, so a run that breaks leaves the report as it was, and one that is
    repeated changes nothing.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scoring", "allocation", "freq").parquet(path)


def write_macro(df: DataFrame, folder: str, name: str = "common_features") -> str:
    """The table of macro series, a row a date, as a named artifact of a snapshot folder; its path."""
    df.write.mode("overwrite").parquet(path := f"{folder}/{name}.parquet")
    return path


def publish(df: DataFrame, path: str, rules: Mapping[str, tuple[str, Column]], drop: Sequence[str] = ()) -> list[tuple[str, str, int]]:
    """Write, audit, publish: (rule, severity, rows that break it) of a table that is written once, and seen in the same pass.

    rules: of each name, its severity and the condition of rows that break it; `drop` names columns that conditions need and the
    table doesn't keep. The table is staged beside `path`. If a rule of severity
    error has rows, the staged files go and ValueError names the rules: what was published before stays as it was. Else the staged
    folder takes the place of the old one, by renames. A table without rows breaks no rule.
    """
    spark, seen = df.sparkSession, Observation()
    counts = [F.count_if(F.coalesce(bad, F.lit(False))).alias(rule) for rule, (_, bad) in rules.items()]
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("_rows"), *counts).drop(*drop).write.parquet(staged)
    found = [(rule, severity, int(seen.get[rule])) for rule, (severity, _) in rules.items()]
    at = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if bad := [f"{rule}: {n} rows" for rule, severity, n in found if severity == "error" and n]:
        fs.delete(at(staged), True)
        raise ValueError(f"not published: {', '.join(bad)}")
    old = f"{staged}.old"
    if was := fs.exists(at(path)):
        fs.rename(at(path), at(old))
    if not fs.rename(at(staged), at(path)):
        if was:
            fs.rename(at(old), at(path))
        raise OSError(f"{staged} could not be renamed to {path}")
    if was:
        fs.delete(at(old), True)
    return found
