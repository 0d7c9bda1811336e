"""Alignment of the tokens of two tokenizers, A (byte-level BPE) and B (pieces with byte fallback), by byte offsets.

Interval coalescing: all A and B tokens of a batch lie on one line of bytes. They are sorted by where they start; a running
maximum of where they end tells where a group breaks: at a token that starts no earlier than all before it end. A and B tokens
of a group are linked with each other, and the rows of links per group come from expanding A's and B's lists within it.

What is a batch: both tokenizers part a text before a blank behind anything that is no white space (A's split pattern does, and
no piece of B has its blank sign behind another sign), so a text's tokens and groups are those of its words in turn, a word being
a blank and what follows up to the next such place. Distinct words of a batch of texts are put in a row, tokenized, coalesced and
checked once, and documents take their words' results.

Two passes over the documents, words in memory only. The first counts, per pair of ids, the documents that hold it linked; a task
adds up its own before it hands them on. The second looks counts up. Pairs are at most as many as A's ids times B's; the `most`
most frequent are in every task's memory, and the occurrences of others, rare by definition, are joined by pair and added up by
document.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, discard, stored

_CUT = re.compile(r"(?<=\S) ")
_ODD = r"^ |[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
BLANK = "▁"
#: Letters and signs that all versions of Unicode class alike (fixed values), so that any library splits them by a pattern alike.
_SETTLED = re.compile("[\\x00-\u024f\u0400-\u04ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")
#: The split pattern of byte-level vocabularies (a fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words are tokenized in rows of about so many characters.
TOGETHER = 1 << 14
MOST_PAIRS = 4_000_000


@functools.cache
def _byte_of() -> dict[str, int]:
    """The byte that a character of a byte-level vocabulary stands for: printable ones for themselves, the others for 256 and on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers, their tokens' bytes, and what a batch of words comes to."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        byte_of, vocabulary = _byte_of(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(byte_of.get, token)) if all(c in byte_of for c in token) else token.encode()
        self.fast = self.by_ranks(path_a, vocabulary)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, x)), "i8") for x in (self.bytes_a, self.bytes_b))
        names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.shown = [n + mark for mark in ",|;" for n in names]
        self.width = len(names)
        self.digits = np.array(list(map(len, names)), "i8")

    def by_ranks(self, path: str, vocabulary: dict[str, int]):
        """The same tokenizer by ranks, which is several times as fast, if it is plain byte-level BPE whose ids rank its merges; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, split = told["model"], told["pre_tokenizer"] or {}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", ())]
        rising = all(vocabulary[x] < vocabulary[y] for x, y in itertools.pairwise(merged))
        plain = model["type"] == "BPE" and not (told["normalizer"] or told["post_processor"] or model.get("dropout") or model.get("ignore_merges"))
        if not (plain and rising and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and set(_byte_of()) <= set(vocabulary)):
            return None
        added = {x["content"] for x in told["added_tokens"]}
        ranks = {self.bytes_a[i]: i for token, i in vocabulary.items() if token not in added}
        return tiktoken.Encoding("aligner", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of A and B of words put in a row, each behind a blank."""
        row = " ".join(words)
        if self.fast and _SETTLED.fullmatch(row):
            a = self.fast.encode_ordinary(f" {row}")
        else:
            a = self.a.encode_batch_fast([f" {row}"], add_special_tokens=False)[0].ids
        return a, self.b.encode(row, num_threads=1) or [self.b.piece_to_id(BLANK)]

    def whole(self, row: list[int], of: list[bytes], want: bytes) -> bool:
        return b"".join(map(of.__getitem__, row)) == want

    def tokens(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B over all words in a row, where each word ends (in bytes), and which words both tokenizers give back.

        A word that one of them doesn't give back has no tokens and no bytes. One that ends in white space ends its text, and is
        tokenized alone: the blank behind it would change it.
        """
        sizes, good = sizes + 1, np.ones(len(words), bool)
        alone = np.array([not w or w[-1].isspace() for w in words], bool)
        row = np.cumsum(sizes) // TOGETHER + np.cumsum(alone) + np.concatenate(([0], np.cumsum(alone)[:-1]))[: len(words)]
        ids_a, ids_b = [], []
        for lo, hi in itertools.pairwise([*np.flatnonzero(np.diff(row, prepend=-1)).tolist(), len(words)]):
            part = words[lo:hi]
            a, b = self.encode(part)
            want = f" {' '.join(part)}".encode()
            if not ((self.fast or self.whole(a, self.bytes_a, want)) and self.whole(b, self.bytes_b, want)):
                a, b = [], []
                for i, w in enumerate(part, lo):
                    x, y = self.encode([w])
                    want = f" {w}".encode()
                    if self.whole(x, self.bytes_a, want) and self.whole(y, self.bytes_b, want):
                        a += x
                        b += y
                    else:
                        good[i], sizes[i] = False, 0
            ids_a.append(np.array(a, "i8"))
            ids_b.append(np.array(b, "i8"))
        none = np.zeros(0, "i8")
        return np.concatenate([none, *ids_a]), np.concatenate([none, *ids_b]), np.cumsum(sizes), good

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of A's and B's ids that cover the same bytes: the group of each, and where each group ends."""
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.concatenate((end_a, end_b))
        starts = ends - np.concatenate((self.size_a[a], self.size_b[b]))
        order = np.lexsort((np.arange(len(ends)), starts))
        reach = np.maximum.accumulate(ends[order])
        breaks = np.ones(len(order), bool)
        breaks[1:] = starts[order[1:]] >= reach[:-1]
        group = np.empty(len(order), "i8")
        group[order] = np.cumsum(breaks) - 1
        last = np.flatnonzero(np.append(breaks[1:], True)) if len(order) else np.zeros(0, "i8")
        return group[: len(a)], group[len(a) :], reach[last]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, ... of ranges of `sizes`, one range behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, "i8")
    return keys[first], np.add.reduceat(weights, first) if len(keys) else weights


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


class Batch:
    """The words of a batch of texts, aligned: numbers of each distinct word, and links as (word, pair, how often)."""

    def __init__(self, aligner: Aligner, texts: pa.Array, strings: bool):
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, _ODD)
        if pc.any(odd).as_py():
            cut = pa.array([_CUT.split(t) if o else t.split(" ") for t, o in zip(texts.to_pylist(), odd.to_pylist())], pa.large_list(pa.large_string()))
        else:
            cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        self.at = coded.indices.to_numpy(zero_copy_only=False)
        offsets = cut.offsets.to_numpy()
        self.offsets = offsets - offsets[0]
        a, b, ends, self.good = aligner.tokens(self.words, pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype("i8"))
        ga, gb, group_ends = aligner.groups(a, b)
        n_groups = len(group_ends)
        word_of = np.searchsorted(ends, group_ends, "left")  # the first word that ends no earlier: those without bytes end where the one before does
        count = lambda of, n: np.bincount(of, minlength=n)
        na, nb = count(ga, n_groups), count(gb, n_groups)
        self.n_a, self.n_b = (np.bincount(word_of, x, len(self.words)).astype("i8") for x in (na, nb))
        self.n_groups = count(word_of, len(self.words))
        self.n_links = np.bincount(word_of, na * nb, len(self.words)).astype("i8") if n_groups else np.zeros(len(self.words), "i8")
        self.whole = (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0) & self.all_of(self.good)
        self.links(aligner, a, b, ga, gb, na, nb, word_of)
        if strings:
            self.name(aligner, a, b, ga, gb, word_of)

    def links(self, aligner, a, b, ga, gb, na, nb, word_of) -> None:
        base = len(aligner.bytes_b)
        first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
        large = na * nb > 4096  # ids of such a group are counted first
        ones_a, ones_b = np.ones(len(a), "i8"), np.ones(len(b), "i8")
        if large.any():
            def counted(ids, of, n):
                many = large[of]
                keys, times = _summed(of[many] * (1 << 20) + ids[many], np.ones(int(many.sum()), "i8"))
                ids, of, ones = np.concatenate((ids[~many], keys & (1 << 20) - 1)), np.concatenate((of[~many], keys >> 20)), np.concatenate((np.ones(int((~many).sum()), "i8"), times))
                order = np.argsort(of, kind="stable")
                return ids[order], ones[order], np.bincount(of, minlength=n)

            a, ones_a, na = counted(a, ga, len(na))
            b, ones_b, nb = counted(b, gb, len(nb))
            first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
        group = np.repeat(np.arange(len(na)), na)  # of each A token, which meets each B token of its group
        i = np.repeat(np.arange(len(group)), nb[group])
        j = _ragged(first_b[group], nb[group])
        word, pair, times = word_of[group[i]], a[i] * base + b[j], ones_a[i] * ones_b[j]
        order = np.lexsort((pair, word))
        word, pair, times = word[order], pair[order], times[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (pair[1:] != pair[:-1])
        first = np.flatnonzero(new)
        self.word, self.pair = word[first], pair[first]
        self.times = np.add.reduceat(times, first) if len(first) else times

    def name(self, aligner, a, b, ga, gb, word_of) -> None:
        """Each word's groups as text, `;` behind each."""
        group, ids = np.concatenate((ga, gb)), np.concatenate((a, b))
        side = np.repeat((0, 1), (len(a), len(b)))
        order = np.lexsort((np.arange(len(ids)), side, group))
        group, ids, side = group[order], ids[order], side[order]
        last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)[: len(ids)]
        text = "".join(map(aligner.shown.__getitem__, (ids + aligner.width * np.where(last, 1 + side, 0)).tolist()))
        size = np.bincount(word_of[group], aligner.digits[ids] + 1, len(self.words)).astype("i8") if len(ids) else np.zeros(len(self.words), "i8")
        ends = np.cumsum(size).tolist()
        self.names = [text[i:j] for i, j in itertools.pairwise([0, *ends])]

    def totals(self, values: np.ndarray) -> np.ndarray:
        """Of each text, the sum of a value of its words; zero where a text has no tokens."""
        run = np.concatenate(([0], np.cumsum(values[self.at])))
        return np.where(self.whole, run[self.offsets[1:]] - run[self.offsets[:-1]], 0)

    def all_of(self, good: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(~good[self.at])))
        return run[self.offsets[1:]] == run[self.offsets[:-1]]

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, word) of all texts with tokens: each distinct word of a text once."""
        text = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        of = self.whole[text]
        both = _distinct(text[of] * len(self.words) + self.at[of])
        return both // max(len(self.words), 1), both % max(len(self.words), 1)

    def documents_of_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each pair that texts hold linked, and how many texts do."""
        text, word = self.held()
        sizes = np.bincount(self.word, minlength=len(self.words))
        first, size = (np.cumsum(sizes) - sizes)[word], sizes[word]
        distinct, code = np.unique(self.pair, return_inverse=True)
        both = _distinct(np.repeat(text, size) * len(distinct) + code[_ragged(first, size)])
        n = np.bincount(both % max(len(distinct), 1), minlength=len(distinct))
        return distinct[n > 0], n[n > 0]


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def pair_counts(docs: DataFrame, path_a: str, path_b: str, most_held: int = 2_000_000) -> DataFrame:
    """(pair, n): of each linked pair of ids (A's id times the number of B's, and B's) the number of rows of docs(text) that hold it linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, parts, size = aligner(path_a, path_b), [], 0
        merged = lambda: _summed(*(np.concatenate(c) for c in zip(*parts)))
        for batch in bounded(batches):
            parts.append(Batch(both, batch.column(0), False).documents_of_pairs())
            size += len(parts[-1][0])
            if size > most_held:
                parts = [merged()]
                size = len(parts[0][0])
                if size > most_held // 2:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, parts[0])), names=["pair", "n"])
                    parts, size = [], 0
        if parts:
            pairs, n = merged()
            for lo in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[lo : lo + 100_000]), pa.array(n[lo : lo + 100_000])], names=["pair", "n"])

    return docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


@functools.lru_cache(1)
def _table(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pair in order, n, best of a stored table."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    files = [x.path for x in fs.get_file_info(pa.fs.FileSelector(path)) if x.path.endswith(".parquet")]
    table = pa.dataset.dataset(files, filesystem=fs, format="parquet").to_table(columns=["pair", "n", "best"]) if files else pa.table({"pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "best": pa.array([], pa.bool_())})
    pair, n, best = (c.to_numpy() for c in table.columns)
    order = np.argsort(pair)
    return pair[order], n[order], best[order].astype("i8")


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", most: int = MOST_PAIRS) -> DataFrame:
    """A row per row of docs(key, text): key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those that a tokenizer doesn't give back byte by byte, have no tokens: zeros and an empty groups_sha256.
    Rows of equal keys or texts each keep their row and each count as a document. Texts of any length are aligned whole; a text's
    distinct linked pairs are in a task's memory. An empty table gives no rows.
    """
    base, kept, tables = len(aligner(path_a, path_b).bytes_b), [], []
    counts = stored(pair_counts(docs, path_a, path_b), kept)
    by_a = Window.partitionBy("a")
    judged = counts.withColumn("a", F.floor(F.col("pair") / base)).withColumn("best", F.col("n") == F.max("n").over(by_a)).drop("a")
    if (size := counts.count()) > most:
        judged = stored(judged, kept)
        run, least = 0, 0
        for r in judged.groupBy("n").count().orderBy(F.desc("n")).limit(most + 1).collect():  # distinct counts: few, as high ones are rare
            run += r["count"]
            if run > most:
                least = r.n + 1
                break
        frequent, rare = judged.filter(F.col("n") >= least), judged.filter(F.col("n") < least)
    else:
        frequent, rare = judged, None
    stored(frequent, tables)
    uri, kind = tables[0], docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rare array<struct<pair: long, times: long>>"
    rare_type = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in bounded(batches):
            x = Batch(both, batch.column(1), True)
            pair, n, best = _table(uri)
            distinct, code = np.unique(x.pair, return_inverse=True)
            at = np.minimum(np.searchsorted(pair, distinct), max(len(pair) - 1, 0))
            found = (pair[at] == distinct) if len(pair) else np.zeros(len(distinct), bool)
            value, top = (np.where(found, y[at], 0) if len(pair) else np.zeros(len(distinct), "i8") for y in (n, best))
            by_word = lambda v: np.bincount(x.word, v[code] * x.times, len(x.words)).astype("i8")
            sums = [x.totals(v) for v in (x.n_a, x.n_b, x.n_groups, x.n_links, by_word(top), by_word(value))]
            names, at = x.names, x.at.tolist()
            digests = [hashlib.sha256("".join([names[w] for w in at[i:j]])[:-1].encode()).hexdigest() if good else "" for (i, j), good in zip(itertools.pairwise(x.offsets.tolist()), x.whole.tolist())]
            others = [[] for _ in digests]
            if not found.all():
                some = ~found[code]
                word, p, times = x.word[some], x.pair[some], x.times[some]
                uses = np.flatnonzero(np.isin(x.at, word) & x.whole[np.repeat(np.arange(len(digests)), np.diff(x.offsets))])
                for u in uses.tolist():
                    text = int(np.searchsorted(x.offsets, u, "right")) - 1
                    lo, hi = np.searchsorted(word, (x.at[u], x.at[u] + 1))
                    others[text] += [{"pair": int(a), "times": int(t)} for a, t in zip(p[lo:hi], times[lo:hi])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums), pa.array(digests, pa.string()), pa.array(others, rare_type)], names=[f.split()[0] for f in schema.split(", ", 8)])

    rows = stored(docs.select(key, "text").mapInArrow(run_all, schema))
    if rare is None:
        out = rows.drop("rare")
    else:
        numbered = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
        asked = numbered.select("_row", F.explode("rare").alias("x")).select("_row", "x.pair", "x.times")
        more = asked.join(rare, "pair").groupBy("_row").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.col("times") * F.col("best").cast("long")).alias("_best"))
        some = lambda c: F.coalesce(F.col(c), F.lit(0))
        joined = numbered.join(more, "_row", "left").withColumns({"n_best": F.col("n_best") + some("_best"), "count_sum": F.col("count_sum") + some("_sum")})
        out = stored(joined.select(*rows.drop("rare").columns))
    discard(kept + tables)
    return out


def op12_alignment(spark: SparkSession, sf_dir: str, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """documents aligned by two vocabularies: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    `align` says what holds for null, empty, long and repeated texts, null ids, and empty tables. Other columns of documents are
    not read.
    """
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model"))
