"""What the training-data operators share: shared storage, bounded batches and edits of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir. Where that is unset: a temporary folder of one machine, if Spark runs on one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, into: list[str] | None = None) -> DataFrame:
    """The rows of `df`, written once to the shared folder and read back: lineage ends there and no lost executor takes them along.

    The table's folder is added to `into`, for `discard`.
    """
    spark, path, cleanup = df.sparkSession, shared_dir(df.sparkSession), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")  # the shuffle files of a written table serve nobody any more
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, was)
    if into is not None:
        into.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(paths: list[str]) -> None:
    """Delete stored tables that nothing will read any more; the list is empty then."""
    while paths:
        fs, path = pa.fs.FileSystem.from_uri(paths.pop())
        fs.delete_dir(path)


def bounded(batches: Iterable[pa.RecordBatch], rows: int = 2000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches that a Python worker gets, in parts of so many rows and bytes at most (one row at least): what a task makes of its rows stays small, whatever the session's options."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            n = part.num_rows
            if n > 1 and (n > rows or part.nbytes > size):
                todo += [part.slice(n // 2), part.slice(0, n // 2)]
            else:
                yield part


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the text alone, null texts as empty ones: other columns of `df` can't clash with what an operator adds."""
    return df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def edited(docs: DataFrame, edit, text: str = "text") -> DataFrame:
    """`docs` with texts as `edit` returns them; edit takes a list of texts (None where null) and returns as many, and a list of bools, the rows that stay.

    All other columns pass through as they are, of whatever type and name.
    """
    import numpy as np

    at = docs.columns.index(text)

    def run(batches):
        for batch in bounded(batches):
            new, keep = edit(batch.column(at).to_pylist())
            columns = [pa.array(new, pa.string()) if i == at else x for i, x in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(np.array(keep, bool)))

    return docs.mapInArrow(run, docs.schema)
