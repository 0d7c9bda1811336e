"""WARC archives with a two-level capture index.

Writing: tasks stream records into `NNNNN-<attempt>.warc.gz`, each record a gzip member of its own, so that a byte range is a record. Of
records with equal payloads of at least `least` bytes the one with the largest page_id is written whole (response), the others
as revisit records that name it and hold no payload. Which payloads are equal is known from digests, counted before anything is
written; only digests that occur twice or more take part in the join, spread over salts.

Index: captures are sorted by the URL's key, its host reversed (`com,example,www)/path`), then page_id. Key ranges make shards; a
shard is a file of compressed blocks of lines (level one) and a sparse directory of each block's first key and place (level
two). A look-up finds the shard by the shards' first keys, searches the directory in memory, opens one block and searches it,
and the record is read from its archive by byte range.

A file's name holds the task attempt that wrote it, and is known only from the rows that the attempt returns: of a task that
runs twice, or fails behind its last write, Spark commits one attempt's rows, and nobody asks for the other's files.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, shared_dir, stored

LEAST = 1000
BLOCK_LINES = 256


def _fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def url_key(url: str | None, page_id: int | None) -> str:
    """The sort key of a capture; a URL that can't be parsed stays as it is, a null one is empty."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
        top = ",".join(reversed(host.split("."))) + port + ")" if host else ""
        key = f"{top}{parts.path or '/'}{'?' + parts.query if parts.query else ''}" if host else url or ""
    except ValueError:
        key = url or ""
    return f"{key} {'-' if page_id is None else format(page_id, '020d')}"


def member(head: list[str], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


def info(name: str, date: str) -> bytes:
    """The record that opens a file."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return member(head, b"format: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """A gzip member with one record. payload None: a revisit of refers_to, with HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return member(head, block)


def parse(packed: bytes) -> dict:
    """What a record holds: page_id, type, refers_to, payload (None for revisits), payload_bytes and payload_digest."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")))
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    whole = fields["WARC-Type"] == "response"
    digest = hashlib.sha1(payload).hexdigest() if whole else fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if whole and (digest != fields["WARC-Payload-Digest"].removeprefix("sha1:") or len(payload) != size):
        raise ValueError(f"the record of page {fields['WARC-Record-ID']} is damaged")
    return {"page_id": number(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if whole else None, "payload_bytes": size, "payload_digest": digest}


def write(pages: DataFrame, path: str, least: int = LEAST, salts: int = 16, date: str | None = None) -> DataFrame:
    """Archive `pages` (page_id, url, html) below `path`; the captures: key, page_id, file, offset, length.

    Null html is an empty payload. Rows with the largest page_id of their payload are responses (all of them, should it repeat);
    null page_ids count as the smallest. Records are named by their page_id, which rows of equal page_id share. `date` is that
    of the captures (YYYY-MM-DDThh:mm:ssZ); the time of this call, if there is none.
    """
    date = date or f"{datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    twice = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).filter("n > 1").select("digest", "first")
    spread = stored(twice).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("salt", (F.monotonically_increasing_id() % salts).cast("int")).join(spread, ["digest", "salt"], "left")
    refers = F.when((F.col("size") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select("page_id", "url", "html", "size", "digest", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _fs(path)
        name, out, at = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in bounded(batches):
            found = []
            for page_id, url, html, size, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)  # members are compressed already
                    out.write(first := info(name, date))
                    at = len(first)
                packed = record(page_id, url, html.encode() if refers_to is None else None, size, digest, refers_to, date)
                out.write(packed)
                found.append({"key": url_key(url, page_id), "page_id": page_id, "file": name, "offset": at, "length": len(packed)})
                at += len(packed)
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out is not None:
            out.close()

    return stored(rows.mapInArrow(run, "key string, page_id long, file string, offset long, length long"))


def build_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, str]]:
    """Write the shards of the index below `path`; the name and first key of every shard, in order of keys.

    There are as many as shuffle partitions at most, and none for no captures. Captures of one key may lie in several.
    """
    spark = captures.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _fs(path)
        name, lines, directory, out, at = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", [], [], None, 0

        def flush() -> None:
            nonlocal at
            block = zlib.compress("\n".join(lines).encode())
            out.write(block)
            directory.append([lines[0].split("\t")[0], at, len(block)])
            at += len(block)
            lines.clear()

        for batch in bounded(batches):
            for key, _, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{name}.blocks")
                lines.append("\t".join((key.replace("\t", "%09").replace("\n", "%0A"), file, str(offset), str(length))))
                if len(lines) == block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with fs.open_output_stream(f"{top}/{name}.directory") as f:
                f.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([directory[0][0]])], names=["shard", "first"])

    order = ("key", "file", "offset")
    sorted_ = captures.select(clean(F.col("key")).alias("key"), "page_id", "file", "offset", "length").repartitionByRange(shards, *order).sortWithinPartitions(*order)
    made = stored(sorted_.mapInArrow(run, "shard string, first string"))
    return [(r.shard, r["first"]) for r in made.orderBy("first", "shard").collect()]


def clean(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("\t"), F.lit("%09")), F.lit("\n"), F.lit("%0A"))


@functools.lru_cache(16)
def _directory(path: str, shard: str) -> tuple[list[str], list[list]]:
    fs, top = _fs(path)
    with fs.open_input_file(f"{top}/{shard}.directory") as f:
        rows = json.loads(zlib.decompress(f.read()))
    return [r[0] for r in rows], rows


@functools.lru_cache(16)
def _block(path: str, shard: str, offset: int, length: int) -> tuple[list[str], list[list[str]]]:
    fs, top = _fs(path)
    with fs.open_input_file(f"{top}/{shard}.blocks") as f:
        lines = [x.split("\t") for x in zlib.decompress(f.read_at(length, offset)).decode().split("\n")]
    return [x[0] for x in lines], lines


def search(path: str, shard: str, key: str) -> list[tuple[str, int, int]]:
    """(file, offset, length) of every capture of a key in a shard: directory, then block, by binary search."""
    firsts, rows = _directory(path, shard)
    at, out = max(0, bisect.bisect_left(firsts, key) - 1), []
    while at < len(rows) and firsts[at] <= key:
        keys, lines = _block(path, shard, rows[at][1], rows[at][2])
        i = bisect.bisect_left(keys, key)
        while i < len(keys) and keys[i] == key:
            out.append((lines[i][1], int(lines[i][2]), int(lines[i][3])))
            i += 1
        at += 1
    return out


def look_up(requests: DataFrame, path: str, shards: list[tuple[str, str]]) -> DataFrame:
    """(key, file, offset, length) of all captures of each requested (url, page_id); requests count once, unknown ones have none."""
    order, firsts = [s for s, _ in shards], [f for _, f in shards]
    if not shards:
        return requests.sparkSession.createDataFrame([], "key string, file string, offset long, length long")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            keys = [url_key(u, p).replace("\t", "%09").replace("\n", "%0A") for u, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            asked = [(k, at) for k in keys for at in range(max(0, bisect.bisect_left(firsts, k) - 1), max(1, bisect.bisect_right(firsts, k)))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in asked], kind) for i, kind in enumerate((pa.string(), pa.int32()))], names=["key", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found = [{"key": k, "file": f, "offset": o, "length": n} for k, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f, o, n in search(path, order[at], k)]
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    asked = requests.select("url", F.col("page_id").cast("long").alias("page_id")).distinct().mapInArrow(route, "key string, at int")
    return asked.repartitionById(max(1, len(shards)), "at").sortWithinPartitions("key").mapInArrow(run, "key string, file string, offset long, length long")


def fetch(places: DataFrame, path: str, whole: bool = False, chunk: int = 4 << 20) -> DataFrame:
    """The records at (file, offset, length), by byte range in the archives' order; with their payloads if `whole`."""
    ddl = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * whole
    kinds = {"page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string()} | ({"payload": pa.binary()} if whole else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _fs(path)
        name, f = None, None
        for batch in bounded(batches):
            out = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    name, f = file, fs.open_input_file(f"{top}/{file}")
                out.append({k: v for k, v in parse(f.read_at(length, offset)).items() if k in kinds})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(kinds.items())))

    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = places.withColumn("chunk", F.floor(F.col("offset") / chunk)).repartition(parts, "file", "chunk").sortWithinPartitions("file", "offset").drop("chunk")
    return dealt.mapInArrow(run, ddl)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages archived, indexed, looked up by URL and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Every row keeps its row, repeated ones too; null html is an empty payload, null urls and page_ids are keys like others, and
    null page_ids count as the smallest. Payloads of any length are written whole. An empty table makes an empty archive and no
    rows. Other columns of pages are not read.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    top = shared_dir(spark)
    captures = write(pages, f"{top}/archive")
    shards = build_index(captures, f"{top}/index")
    places = look_up(pages, f"{top}/index", shards)
    return fetch(places, f"{top}/archive").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
