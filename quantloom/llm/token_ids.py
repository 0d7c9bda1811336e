"""Token-ID output: flat files of unsigned integers with 64-bit document offsets.

A data set is a folder of shards in ascending key order. A shard has three flat little-endian files under one name:

* `NAME.ids`   ids, unsigned 16-bit where the vocabulary allows it, else 32-bit
* `NAME.off`   signed 64-bit, documents + 1: where each document's ids start in the shard, and the shard's total
* `NAME.key`   signed 64-bit document keys; the first `n_null` of them (see the manifest) stand for null

and a row of the manifest (Parquet): shard, name, n_docs, n_null, n_ids and base, the ids in all shards before it, as a prefix
sum over the shards. A name is that of the shard and of the attempt that wrote it. Any document is found by base + offset, and a reader maps the files into memory.

Encoding runs before the shuffle, so that 2 or 4 bytes a token move rather than text. Shards are key ranges, dealt out by
bounds that are approximate quantiles of the keys; a key that fills more than a shard's worth (null, or one repeated without
end) is spread over shards by a checksum of its ids. Files are written as rows stream by, never gathered. Nothing is renamed or
overwritten: a task that runs again writes files of its own, and the manifest, which Spark commits, names those of one attempt.
Files that no manifest names are left-overs of lost attempts.
"""

from __future__ import annotations

import functools
import itertools
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, shared_dir, texts

#: Pieces up to this many characters are encoded once per Python worker and kept, so many of them at most.
KEPT_CHARS, KEPT_PIECES = 48, 1_000_000
#: Words of printable ASCII and the letters of Latin-1 (fixed values): their small letters are one character each, and no normal form changes them.
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
#: The pieces of the vocabulary's own pre-tokeniser, over the small letters of plain words (fixed values).
_PIECE = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer.from_file(path)


def _gathered(values: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items `at` of a ragged array (values, and where each item ends), one behind the other, and where each ends."""
    sizes = np.diff(ends, prepend=0)
    out = np.cumsum(sizes[at])
    from_ = np.repeat((ends - sizes)[at] - out + sizes[at], sizes[at])
    return values[from_ + np.arange(len(from_))], out


class WordEncoder:
    """Texts to ids, as the tokenizers library encodes them, for a vocabulary none of whose pieces crosses a blank.

    Blanks and line ends separate pieces in such a vocabulary and are dropped, so a text's ids are those of its words in turn.
    The distinct words of a batch are parted into the library's pieces if they are of plain characters, and the new ones of the
    distinct pieces go through the library together; other words (any that a normal form or a change of case could touch, or
    that may hold a special token) go through it as they are.
    """

    def __init__(self, path: str, dtype: str):
        self.model, self.dtype = _tokenizer(path), np.dtype(dtype)
        vocabulary = self.model.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {}

    def each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, pieces: list[str], together: int = 500) -> None:
        """Keep the ids of pieces: many are encoded as one text, in which the ids that end a word tell them apart."""
        if len(self.kept) + len(pieces) > KEPT_PIECES:
            self.kept.clear()
        for lo in range(0, len(pieces), 20_000):
            part = pieces[lo : lo + 20_000]
            found = self.model.encode_batch_fast([" ".join(part[i : i + together]) for i in range(0, len(part), together)], add_special_tokens=False)
            ids = np.array(list(itertools.chain.from_iterable(e.ids for e in found)), self.dtype)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(part):
                raw, ends = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
                self.kept.update((x, raw[a:b]) for x, a, b in zip(part, [0, *ends], ends))
            else:
                self.kept.update(zip(part, self.each(part)))

    def ragged(self, items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(items), self.dtype), np.cumsum(np.fromiter(map(len, items), "i8", len(items))) // self.dtype.itemsize

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one behind the other, and where each word's end."""
        plain = pc.and_not(pc.match_substring_regex(words, _PLAIN), pc.match_substring(words, "<|")).to_numpy(zero_copy_only=False)
        small = pc.utf8_lower(words.filter(pa.array(plain)))
        split = pc.split_pattern(pc.replace_substring_regex(small, _PIECE, "\\1 "), " ")  # a blank behind each piece: the last is empty
        pieces = split.flatten().dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        self.learn([x for x in distinct if x and x not in self.kept])
        get = self.kept.get
        values, ends = self.ragged([get(x, b"") for x in distinct])
        values, ends = _gathered(values, ends, pieces.indices.to_numpy(zero_copy_only=False))
        ends = np.concatenate(([0], ends))[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]
        for x in distinct:
            if len(x) > KEPT_CHARS:
                self.kept.pop(x, None)
        if plain.all():
            return values, ends
        odd, odd_ends = self.ragged(self.each(words.filter(pa.array(~plain)).to_pylist()))
        at = np.empty(len(plain), "i8")
        at[plain], at[~plain] = np.arange(len(ends)), len(ends) + np.arange(len(odd_ends))
        return _gathered(np.concatenate((values, odd)), np.concatenate((ends, len(values) + odd_ends)), at)

    def __call__(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        values, ends = self.words(words.dictionary)
        values, ends = _gathered(values, ends, words.indices.to_numpy(zero_copy_only=False))
        raw, ends = values.tobytes(), (np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()] * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in itertools.pairwise(ends)]


@functools.cache
def word_encoder(path: str, dtype: str) -> WordEncoder:
    return WordEncoder(path, dtype)


_FIRST = -(2**63)


def shard_bounds(docs: DataFrame, key: str, shards: int) -> list[int]:
    """The keys that part `docs` into `shards` ranges of about equal row counts, from a scan of the keys alone.

    Null counts as the least key. A key that fills more than one range is there more than once.
    """
    if shards < 2:
        return []
    keys = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_FIRST)).alias(key))
    return sorted(int(x) for x in keys.approxQuantile(key, [i / shards for i in range(1, shards)], 0.2 / shards))


def shard_of(keys: np.ndarray, ties: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each (key, tie), ties being 32 bits: in order of both, equal keys spread over all the ranges that their bounds name."""
    lo, hi = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
    return (lo + (ties.astype("u8") * np.maximum(hi - lo, 1).astype("u8") >> np.uint64(32)).astype("i8")).astype("i4")


def encode(docs: DataFrame, tokenizer: str, end_id: int | None, dtype: str, bounds: list[int], key: str = "doc_id") -> DataFrame:
    """(key, tie, ids, shard): the little-endian ids of every text, with end_id behind each, and the number of its key range.

    Null texts count as empty; null keys belong to the first ranges. `tie`, a checksum of the ids, orders rows of equal keys.
    """
    end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
    edges = np.array(bounds, "i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = word_encoder(tokenizer, dtype)
        for batch in bounded(batches):
            ids = [x + end for x in encoded(batch.column(1))]
            keys = batch.column(0).cast(pa.int64())
            ties = np.fromiter(map(zlib.crc32, ids), "u4", len(ids))
            shard = shard_of(keys.fill_null(_FIRST).to_numpy(zero_copy_only=False), ties, edges)
            yield pa.RecordBatch.from_arrays([keys, pa.array(ties.astype("i8")), pa.array(ids, pa.binary()), pa.array(shard)], names=[key, "tie", "ids", "shard"])

    return texts(docs, key).mapInArrow(run, f"{key} long, tie long, ids binary, shard int")


def _open_fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def write(encoded: DataFrame, path: str, dtype: str, shards: int, key: str = "doc_id") -> DataFrame:
    """Write (key, tie, ids, shard) rows as a data set at `path`; its manifest. Rows of equal keys follow each other, by their ties and ids.

    An empty input makes a data set of no shards.
    """
    spark, width = encoded.sparkSession, np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open_fs(path)
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        name = f"{shard:05d}-{attempt}"
        files, total, n, nulls = {}, 0, 0, 0
        for batch in bounded(batches):
            if not batch.num_rows:
                continue
            if not files:
                fs.create_dir(top, recursive=True)
                files = {x: fs.open_output_stream(f"{top}/{name}.{x}") for x in ("ids", "off", "key")}
                files["off"].write(np.zeros(1, "<i8").tobytes())
            lengths = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype("i8") // width
            files["off"].write((total + np.cumsum(lengths)).astype("<i8").tobytes())
            files["key"].write(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            for x in batch.column(1):
                files["ids"].write(x.as_buffer())
            total, n, nulls = total + int(lengths.sum()), n + batch.num_rows, nulls + batch.column(0).null_count
        if files:
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "name": name, "n_docs": n, "n_null": nulls, "n_ids": total}])

    dealt = encoded.repartitionById(shards, "shard").select(key, "tie", "ids")
    parts = dealt.sortWithinPartitions(F.asc_nulls_first(key), "tie", "ids").select(key, "ids").mapInArrow(run, "shard long, name string, n_docs long, n_null long, n_ids long")
    parts.write.parquet(f"{path}/parts")
    parts = spark.read.parquet(f"{path}/parts")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def reader(uri: str, dtype: str) -> Callable[[int, int], np.ndarray]:
    """What returns items a to b of a flat file: a view of the file mapped into memory if it is a local one, else that range read."""
    fs, name = _open_fs(uri)
    if fs.type_name == "local":
        whole = np.memmap(name, dtype, "r") if os.path.getsize(name) else np.empty(0, dtype)
        return lambda a, b: whole[a:b]
    f, width = fs.open_input_file(name), np.dtype(dtype).itemsize
    return lambda a, b: np.frombuffer(f.read_at((b - a) * width, a * width), dtype)


def scan(spark: SparkSession, path: str, dtype: str, use: Callable[[np.ndarray], dict], schema: str, key: str = "doc_id", block: int = 1024) -> DataFrame:
    """Map `use` over every document's ids, read back from the files: key, start, n_tokens and what `use` returns (of `schema`).

    A task holds `block` documents of a shard at a time, however large the shard.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            for row in batch.to_pylist():
                at = f"{path}/{row['name']}"
                ids, off, keys = reader(f"{at}.ids", dtype), reader(f"{at}.off", "<i8"), reader(f"{at}.key", "<i8")
                for lo in range(0, row["n_docs"], block):
                    hi = min(lo + block, row["n_docs"])
                    ends, names, out = off(lo, hi + 1).tolist(), keys(lo, hi).tolist(), []
                    held = ids(ends[0], ends[-1])
                    for i, (a, b) in enumerate(itertools.pairwise(ends)):
                        out.append({key: None if lo + i < row["n_null"] else names[i], "start": row["base"] + a, "n_tokens": b - a} | use(held[a - ends[0] : b - ends[0]]))
                    yield pa.RecordBatch.from_pylist(out, schema=out_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"{key} long, start long, n_tokens long, {schema}"
    out_schema = to_arrow_schema(StructType.fromDDL(ddl))
    manifest = spark.read.parquet(f"{path}/manifest")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(shards, "shard").mapInArrow(run, ddl)


def crc32_of_ids(ids: np.ndarray) -> dict:
    return {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}


def op10_token_ids(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """documents encoded, written in ascending doc_id order and read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone; null doc_ids come first; rows of equal doc_ids all stay, ordered by a checksum of
    their ids; an empty table gives no rows. doc_id must be a whole number, as its files hold 64-bit keys. Texts of any length are encoded whole. Special tokens' names in a text count as the
    library takes them by default. Other columns of documents are not read.
    """
    import public_tokenizers

    path, dtype = shared_dir(spark), "<u2"  # 49,408 ids
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bounds = shard_bounds(docs, "doc_id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    write(encode(docs, vocabulary or public_tokenizers.path("word_bpe_49k.json"), 1, dtype, bounds), path, dtype, len(bounds) + 1)
    return scan(spark, path, dtype, crc32_of_ids, "ids_crc32 long")
