"""Byte-level BPE: encoding with a segment tree over byte positions, and decoding.

A piece (a match of the vocabulary's split pattern) starts as its bytes. Leaf i of the tree holds the rank of the pair that
the live token at byte i makes with its right neighbour, or NONE; inner nodes hold the smallest rank below, and ties go left,
so the root leads to the leftmost pair of minimum rank. A merge changes three leaves (the merged token's, its left
neighbour's, and the swallowed one's), each in a logarithmic number of steps: O(n log n) a piece, however long it is.

Equal pieces have equal ids, so each distinct chunk of text (a blank and the word behind it) is encoded once per task and
kept, within a bound. The new pieces of a batch are merged side by side: their trees are the rows of an array.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, texts

#: The split pattern (a fixed value) whose pieces' borders are known without a search; texts of others go through their pattern whole.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 40
KEPT_CHARS, KEPT_CHUNKS = 48, 250_000
#: White space other than the blank and the line end, after Unicode's White_Space and Python's str.isspace.
_RARE = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file (base64 token, blank, rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], NONE)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    ends = list(range(1, n + 1))  # of the live token that starts at a byte; also where its right neighbour starts
    before = list(range(-1, n - 1))
    while (least := tree[1]) < NONE:
        k = 1
        while k < size:  # down to the leftmost leaf of that rank
            k *= 2
            if tree[k] != least:
                k += 1
        i = k - size
        j = ends[i]
        end = ends[i] = ends[j]
        if end < n:
            before[end] = i
        changed = [(j, NONE), (i, get(piece[i : ends[end]], NONE) if end < n else NONE)]
        if (p := before[i]) >= 0:
            changed.append((p, get(piece[p:end], NONE)))
        for leaf, rank in changed:
            k = size + leaf
            tree[k] = rank
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a <= b else b
                if tree[k] == low:
                    break
                tree[k] = low
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


@functools.cache
def _pairs(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of tokens that join into a token, as sorted keys (left << 20 | right), their ranks, and the ranks of the bytes."""
    ranks = load_ranks(path)
    found = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                found[left << 20 | right] = rank
    keys = np.array(sorted(found), "i8")
    return keys, np.array([found[k] for k in keys.tolist()], "i4"), np.array([ranks[bytes([i])] for i in range(256)], "i4")


def merge_many(pieces: list[bytes], path: str) -> list[bytes]:
    """Little-endian ids of many pieces: the trees of pieces of a size class stand side by side, and each step merges once in each."""
    ranks = load_ranks(path)
    out: list = [None] * len(pieces)
    classes: dict[int, list[int]] = {}
    for at, piece in enumerate(pieces):
        if (whole := ranks.get(piece)) is not None:
            out[at] = whole.to_bytes(4, "little")
        elif len(piece) > 64:
            out[at] = np.array(merge(piece, ranks), "<u4").tobytes()
        else:
            classes.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(at)
    for size, where in classes.items():
        for lo in range(0, len(where), 20_000):
            part = where[lo : lo + 20_000]
            ids, counts = _merge_class([pieces[at] for at in part], size, path)
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
            for at, a, b in zip(part, [0, *ends[:-1].tolist()], ends.tolist()):
                out[at] = raw[a:b]
    return out


def _merge_class(pieces: list[bytes], size: int, path: str) -> tuple[np.ndarray, np.ndarray]:
    keys, key_ranks, byte_ranks = _pairs(path)
    none = np.int32(1 << 30)

    def rank_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype("i8") << 20 | right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, key_ranks[at], none)

    m = len(pieces)
    length = np.fromiter(map(len, pieces), "i4", m)
    token = byte_ranks[np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), "u1")].reshape(m, size)
    live = np.arange(size) < length[:, None]
    tree = np.full((m, 2 * size), none, "i4")
    tree[:, size : 2 * size - 1] = np.where(live[:, 1:], rank_of(token[:, :-1], token[:, 1:]), none)
    k = size
    while k > 1:
        np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2], out=tree[:, k // 2 : k])
        k //= 2
    after = np.tile(np.arange(1, size + 1, dtype="i4"), (m, 1))
    before = np.tile(np.arange(-1, size, dtype="i4"), (m, 1))
    flat, levels = tree.reshape(-1), size.bit_length() - 1

    def put(base: np.ndarray, leaf: np.ndarray, rank: np.ndarray | np.int32) -> None:
        k = leaf + size
        flat[base + k] = rank
        for _ in range(levels):
            k >>= 1
            flat[base + k] = np.minimum(flat[base + 2 * k], flat[base + 2 * k + 1])

    r = np.flatnonzero(tree[:, 1] < none)
    while len(r):
        base = r * (2 * size)
        least = flat[base + 1]
        k = np.ones(len(r), "i8")
        for _ in range(levels):  # down to the leftmost leaf of that rank
            k *= 2
            k += flat[base + k] != least
        i = k - size
        j = after[r, i]
        e = after[r, j]
        token[r, i], after[r, i], before[r, e], live[r, j] = least, e, i, False
        put(base, j, none)
        put(base, i, np.where(e < length[r], rank_of(least, token[r, np.minimum(e, size - 1)]), none))
        p = before[r, i]
        has = np.flatnonzero(p >= 0)
        put(base[has], p[has], rank_of(token[r[has], p[has]], least[has]))
        r = r[flat[base + 1] < none]
    return token[live], live.sum(1)


class Encoder:
    """Lists of texts to little-endian unsigned 32-bit ids. One per task; chunks that came up are kept."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.path, self.known = path, pattern == PATTERN
        self.pieces = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}
        self.kept_pieces: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """The text in chunks whose pieces are the text's pieces in turn."""
        if not text:
            return []
        if not self.known:
            return self.pieces(text)
        # No piece goes on across a lone blank or line end between other characters: a blank starts a piece, a line end is one.
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\0" in text or _RARE.search(text):
            return self.pieces(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def split(self, chunk: str) -> list[str]:
        if not self.known:
            return [chunk]
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():  # \p{L}+
            return [chunk]
        if word[-1:] in ".,!?;:" and word[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pieces(chunk)

    def learn(self, chunks: set[str]) -> None:
        split = {x: self.split(x) for x in chunks}
        kept = self.kept_pieces
        new = list({p for x in split.values() for p in x}.difference(kept))
        kept.update(zip(new, merge_many([x.encode("utf-8", "replace") for x in new], self.path)))
        self.kept.update((x, b"".join([kept[p] for p in ps])) for x, ps in split.items())

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.kept) > KEPT_CHUNKS:
            self.kept.clear()
        if len(self.kept_pieces) > KEPT_CHUNKS:
            self.kept_pieces.clear()
        split = [self.chunks(t) for t in texts]
        new = set().union(*split).difference(self.kept)
        self.learn(new)
        get = self.kept.__getitem__
        out = [b"".join(map(get, x)) for x in split]
        for x in new:
            if len(x) > KEPT_CHARS:
                del self.kept[x]
        for x in [x for x in self.kept_pieces if len(x) > KEPT_CHARS] if any(len(x) > KEPT_CHARS for x in new) else []:
            del self.kept_pieces[x]
        return out


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, ids): every text's ids as little-endian unsigned 32-bit integers. Null texts count as empty, which have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in bounded(batches, size=4 << 20):
            ids = encoder(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=[key, "ids"])

    return texts(docs, key).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids binary")


def decoder(path: str) -> Callable[[bytes], bytes]:
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return lambda ids: b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with a column `decoded`, the bytes that its ids stand for; null ids give null."""
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = decoder(path)
        for batch in bounded(batches, size=4 << 20):
            out = [None if x is None else decoded(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, encoded.withColumn("decoded", F.lit(None).cast("binary")).schema)


def tokenized(docs: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """`docs` without their texts, with n_tokens, ids (array of int) and round_trip: whether the ids decode to the text.

    A null text is empty. A column of `docs` with one of these names gives way.
    """
    kept = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "round_trip")]
    kinds = {f.name: f.dataType for f in docs.schema}
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoded = Encoder(path, pattern), decoder(path)
        for batch in bounded(batches, size=4 << 20):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            ids = encoder(texts)
            same = [decoded(i) == t.encode("utf-8", "replace") for i, t in zip(ids, texts)]
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype("i4")
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype("i4"))
            columns = [pa.array(np.diff(ends).astype("i8")), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *columns], names=[*kept, "n_tokens", "ids", "round_trip"])

    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

    schema = StructType([StructField(c, kinds[c]) for c in kept] + [StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())])
    return docs.select(*kept, "text").mapInArrow(run, schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """documents encoded and decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Every row keeps its row, repeated ones and null doc_ids too. Null and empty texts have no ids; special tokens' names are plain
    text. Texts of any length are encoded whole, a piece of n bytes in n log n steps. An empty table gives no rows. Other columns
    are not read.
    """
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decode(encode(docs, path, public_tokenizers.PATTERN), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
