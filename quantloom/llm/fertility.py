"""Quality rules with tokeniser fertility.

Base rules count words, symbols, repeated lines and repeated three-word windows. The fertility rules encode every word with two
public vocabularies and measure, by each, characters per token, the share of byte-fallback tokens, and the entropy of the token
distribution. Text of the kind that a vocabulary was made for has a typical fertility; shouting, symbol runs, mojibake or
keyboard noise fall apart into many short tokens, and boiler-plate loops into few distinct ones.

Bands are per language (the lang column; the script where it is null or absent) and octave of the word count, as entropy depends
on length: the quartiles of the documents that pass the base rules, widened by `width` interquartile ranges, and by a floor. They
are functions of the corpus alone, however its rows are dealt: measures are compared as whole numbers of 1 / `GRID`, trends come
from exact sums of these, and quartiles from counts of each value per group. There is no group too
small for a band, and no size at which a rule sets in: the edges of each group are drawn towards those of the group around it,
n to `strength` for a group of n documents. A language at an octave lies in its language, that in its script, and that in the
fixed bands of `PRIOR`. Entropy is compared less the corpus's own trend over octaves, which is drawn towards none likewise.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, stored

#: Ids of words that a Python worker keeps, about (once there are more, it starts again).
KEPT_TOKENS = 4_000_000
MEASURES = ("chars_per_token", "fallback", "entropy", "byte_chars_per_token", "byte_fallback", "byte_entropy")
#: Interquartile ranges beyond the quartiles; how many documents' worth the group around has; the least half width of a band.
WIDTH, STRENGTH = 3.5, 100
FLOORS = {"chars_per_token": 0.08, "fallback": 0.02, "entropy": 0.06}
#: Bands where nothing is known yet, by script (any other as the last one).
PRIOR = {"latin": {"chars_per_token": (1.2, 8.0), "fallback": (0.0, 0.1), "entropy": (0.4, 1.0)}, "": {"chars_per_token": (0.2, 8.0), "fallback": (0.0, 1.0), "entropy": (0.3, 1.0)}}
#: Measures are told apart to this part, so that a group has a bounded number of values.
GRID = 100_000
#: Which edges reject: a low and a high one.
SIDES = {"chars_per_token": (True, True), "fallback": (False, True), "entropy": (True, False)}
#: Bands are broadcast up to this many rows (a few hundred bytes each), and dealt to salts beyond.
MAX_BROADCAST = 100_000
#: The first code point of Unicode blocks that tell scripts apart.
SCRIPTS = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"))


def kind(measure: str) -> str:
    """The measure without its vocabulary."""
    return measure.removeprefix("byte_")


class Words:
    """The words and lines of a batch of texts: numbers of distinct words, text by text."""

    def __init__(self, texts: pa.Array):
        self.n, self.texts = len(texts), texts.cast(pa.large_string())
        split = pc.split_pattern(pc.replace_substring_regex(self.texts, "[\t-\r ]+", " "), " ")
        found = split.flatten().dictionary_encode()
        ids, of = found.indices.to_numpy(zero_copy_only=False), self._owner(split)
        blank = found.dictionary.index("").as_py()
        some = ids != blank
        self.distinct, self.ids, self.of = found.dictionary, ids[some], of[some]
        self.sizes = np.bincount(self.of, minlength=self.n)

    def _owner(self, lists: pa.Array) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(lists.offsets.to_numpy()))

    def per_text(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights, self.n).astype("i8")

    def characters(self) -> np.ndarray:
        return self.per_text(pc.utf8_length(self.distinct).to_numpy(zero_copy_only=False)[self.ids])

    def repeated_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier one of their text."""
        split = pc.split_pattern(self.texts, "\n")
        found = split.flatten().dictionary_encode()
        told = pc.match_substring_regex(found.dictionary, "[^\t-\r ]").to_numpy(zero_copy_only=False)
        ids, of = found.indices.to_numpy(zero_copy_only=False), self._owner(split)
        ids, of = ids[told[ids]], of[told[ids]]
        first = np.unique(of * max(1, len(told)) + ids) // max(1, len(told))
        return np.bincount(of, minlength=self.n) - np.bincount(first, minlength=self.n)

    def repeated_words(self) -> np.ndarray:
        """Words in a three-word window that their text has twice or more."""
        if len(self.ids) < 4:
            return np.zeros(self.n, "i8")
        v = len(self.distinct)
        pairs = np.unique(self.ids[:-1].astype("i8") * v + self.ids[1:], return_inverse=True)[1]
        inside = self.of[2:] == self.of[:-2]
        windows = np.unique(pairs[:-1][inside] * v + self.ids[2:][inside], return_inverse=True)[1]
        _, at, count = np.unique(windows * self.n + self.of[2:][inside], return_inverse=True, return_counts=True)
        again = np.zeros(len(self.ids) - 2, bool)
        again[inside] = count[at] > 1
        covered = np.zeros(len(self.ids), bool)
        for k in range(3):
            covered[k : len(covered) - 2 + k] |= again
        return np.bincount(self.of[covered], minlength=self.n)


def script_of(text: str) -> str:
    """The script of most letters of a text (Latin for none)."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    points = points[(points >= 0x80) | ((points | 32) >= 97) & ((points | 32) <= 122)]
    if not len(points):
        return "latin"
    at = np.searchsorted(np.array([s for s, _ in SCRIPTS]), points, "right") - 1
    return SCRIPTS[int(np.bincount(at, minlength=len(SCRIPTS)).argmax())][1]


class Fertility:
    """Token ids of words by a SentencePiece vocabulary with byte fallback; words that came up are kept."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.kept: dict[str, int] = {}  # a word's number
        self.values, self.sizes, self.starts = np.empty(0, "i4"), np.empty(0, "i8"), np.empty(0, "i8")  # all words' ids, and where they are

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, one behind the other, and how many each has."""
        found = self.model.encode(words, num_threads=1)
        sizes = np.fromiter(map(len, found), "i8", len(found))
        return np.fromiter(itertools.chain.from_iterable(found), "i4", int(sizes.sum())), sizes

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.values) > KEPT_TOKENS:
            self.clear()
        get = self.kept.get
        new = [w for w in words if get(w) is None]
        if new:
            values, sizes = self.encode(new)
            self.starts = np.concatenate((self.starts, len(self.values) + np.cumsum(sizes) - sizes))
            self.values, self.sizes = np.concatenate((self.values, values)), np.concatenate((self.sizes, sizes))
            self.kept.update(zip(new, range(len(self.kept), len(self.kept) + len(new))))
        return np.fromiter(map(self.kept.__getitem__, words), "i8", len(words))

    def measure(self, words: Words, characters: np.ndarray) -> list[np.ndarray]:
        """Characters per token, byte-fallback share, and entropy in bits over the most that so many tokens can have; NaN without words."""
        numbers = self.numbers(words.distinct.to_pylist())[words.ids]
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[numbers] - ends + sizes, sizes)
        at += np.arange(len(at))
        tokens, of = self.values[at], np.repeat(words.of, sizes)
        n = np.bincount(of, minlength=words.n).astype("f8")
        n[n == 0] = np.nan
        keys = of * len(self.is_byte)
        keys += tokens
        keys.sort()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else keys
        counts = np.diff(np.append(first, len(keys)))
        own = np.bincount(keys[first] // len(self.is_byte), counts * np.log2(counts), words.n)
        entropy = (np.log2(n) - own / n) / np.log2(n + 1)
        return [characters / n, np.bincount(of, self.is_byte[tokens], words.n) / n, entropy]


class ByteFertility(Fertility):
    """The same by the ranks of a byte-level vocabulary; what falls back is a token of a lone byte that is no character."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.model = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self.is_byte, self.lengths = np.zeros(size, bool), np.zeros(size, "i8")
        for token, rank in ranks.items():
            self.is_byte[rank], self.lengths[rank] = len(token) == 1 and token[0] >= 128, len(token)
        self.clear()

    def encode(self, words: list[str], together: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """Each word's ids with a blank before it: no token crosses that blank, so many are encoded as one text."""
        values, sizes = [np.empty(0, "i4")], [np.empty(0, "i8")]
        for lo in range(0, len(words), together):
            part = words[lo : lo + together]
            text = " " + " ".join(part)
            ids = np.array(self.model.encode_ordinary(text), "i4")
            bytes_of = np.fromiter(map(len, part), "i8", len(part)) if text.isascii() else np.fromiter((len(w.encode("utf-8", "replace")) for w in part), "i8", len(part))
            ends, reach = np.cumsum(bytes_of + 1), np.cumsum(self.lengths[ids])
            at = np.searchsorted(reach, ends)
            if not np.array_equal(reach[at], ends):
                each = [self.model.encode_ordinary(f" {w}") for w in part]
                ids, at = np.array(list(itertools.chain.from_iterable(each)), "i4"), np.cumsum([len(x) for x in each]) - 1
            values.append(ids)
            sizes.append(np.diff(at, prepend=-1))
        return np.concatenate(values), np.concatenate(sizes)


@functools.cache
def fertility(path: str) -> Fertility:
    return Fertility(path)


@functools.cache
def byte_fertility(path: str, pattern: str) -> ByteFertility:
    return ByteFertility(path, pattern)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = ", ".join([*(f"{c} long" for c in _COUNTS), "script string", *(f"{m} double" for m in MEASURES)])


def base_counts(words: Words) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    symbols = pc.count_substring_regex(words.texts, "[#*$%&|<>]").to_numpy(zero_copy_only=False)
    return [words.sizes, words.characters(), symbols, words.repeated_lines(), words.repeated_words()]


def measures(docs: DataFrame, vocabulary: str, byte_vocabulary: str, pattern: str, key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Base counts and fertility of every whole text: key, lang (null without such a column) and the columns of _SCHEMA. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = fertility(vocabulary), byte_fertility(byte_vocabulary, pattern)
        for batch in bounded(batches, size=4 << 20):
            if not batch.num_rows:
                continue
            texts = batch.column(2).fill_null("")
            words = Words(texts)
            counts = base_counts(words)
            plain = pc.string_is_ascii(texts).to_pylist()
            scripts = ["latin" if p else script_of(t.as_py()) for p, t in zip(plain, texts)]
            found = [x for v in vocabularies for x in v.measure(words, counts[1])]
            columns = [*(pa.array(c.astype("i8")) for c in counts), pa.array(scripts, pa.string()), *(pa.array(x, pa.float64(), from_pandas=True) for x in found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[key, lang, *(x.split()[0] for x in _SCHEMA.split(", "))])

    of = docs.schema[key].dataType.simpleString()
    tongue = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    return docs.select(key, tongue.alias(lang), "text").mapInArrow(run, f"{key} {of}, {lang} string, {_SCHEMA}")


def failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _groups(rows: DataFrame, lang: str) -> DataFrame:
    """`rows` with what their bands go by: script, tongue and octave, and the exact octave `at` that entropies are compared at."""
    at = F.log2(F.nullif(F.col("n_words"), F.lit(0)))
    return rows.withColumns({"tongue": F.coalesce(F.col(lang), F.col("script")), "octave": F.floor(at), "at": at})


def bands(measured: DataFrame, width: float = WIDTH, strength: int = STRENGTH, lang: str = "lang") -> DataFrame:
    """(script, tongue, octave, trend and middle of each entropy, and per measure _lo and _hi): a row for each group of documents that pass the base rules."""
    good = _groups(measured.filter(~failed()), lang)
    entropies = [m for m in MEASURES if kind(m) == "entropy"]
    # The slope of entropy over octaves, as if `strength` documents more had none. Sums of whole numbers don't depend on their order.
    whole = lambda x: F.round(x * GRID).cast("long")
    total = lambda x: F.sum(x.cast("decimal(20,0)")).cast("double")
    a = whole(F.col("at"))
    sums = {"n": F.count("at").cast("double"), "x": total(a), "xx": total(a * a)}
    for m in entropies:
        sums |= {f"{m}_n": F.count(m).cast("double"), f"{m}_y": total(whole(F.col(m))), f"{m}_x": total(F.when(F.col(m).isNotNull(), a)), f"{m}_xy": total(a * whole(F.col(m)))}
    row = good.agg(*[x.alias(n) for n, x in sums.items()])

    def slope(m: str) -> Column:
        n, c = F.col(f"{m}_n"), float(GRID) ** 2
        covariance = F.try_divide(F.col(f"{m}_xy"), n) - F.try_divide(F.col(f"{m}_x"), n) * F.try_divide(F.col(f"{m}_y"), n)
        variance = F.try_divide(F.col("xx"), F.col("n")) - F.try_divide(F.col("x"), F.col("n")) * F.try_divide(F.col("x"), F.col("n"))
        return covariance / c * n / (variance / c * n + strength)

    told = lambda x: F.coalesce(F.round(x, 9), F.lit(0.0))
    trend = row.select(*[told(slope(m)).alias(f"{m}_trend") for m in entropies], told(F.try_divide(F.col("x"), F.col("n")) / GRID).alias("middle"))
    level = good.crossJoin(F.broadcast(trend)).withColumns({m: F.col(m) - F.col(f"{m}_trend") * (F.col("at") - F.col("middle")) for m in entropies})
    # How often each value of each measure (-1: any row) occurs in a group, first of the smallest groups, then of those around them.
    values = F.array(F.struct(F.lit(-1).alias("m"), F.lit(0).cast("long").alias("v")), *[F.struct(F.lit(i).alias("m"), whole(F.col(m)).alias("v")) for i, m in enumerate(MEASURES)])
    names = ["script", "tongue", "octave"]
    fine = level.select(*names, F.explode(values).alias("z")).select(*names, "z.m", "z.v").filter("v IS NOT NULL").groupBy(*names, "m", "v").agg(F.count("*").alias("c"))
    spread = fine.select(*names, "m", "v", "c", F.explode(F.array(*map(F.lit, range(3)))).alias("depth")).withColumns({"tongue": F.when(F.col("depth") > 0, F.col("tongue")), "octave": F.when(F.col("depth") > 1, F.col("octave"))})
    counts = spread.groupBy("depth", *names, "m", "v").agg(F.sum("c").alias("c"))
    of = Window.partitionBy("depth", *names, "m")  # at most as many rows as a measure has values
    run = counts.withColumns({"run": F.sum("c").over(of.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("c").over(of)})
    at = lambda q: F.min(F.when(4 * F.col("run") >= q * F.col("all"), F.col("v"))) / GRID
    found = run.groupBy("depth", *names, "m").agg(F.max("all").alias("all"), F.array(at(1), at(3)).alias("q"))
    groups = found.groupBy("depth", *names).agg(F.max(F.when(F.col("m") == -1, F.col("all"))).alias("n"), *[F.max(F.when(F.col("m") == i, F.col("q"))).alias(m) for i, m in enumerate(MEASURES)])

    def edges(m: str) -> list[Column]:
        q = F.col(m)
        wide = F.greatest(width * (q[1] - q[0]), F.lit(FLOORS[kind(m)]))
        return [(q[0] - wide).alias(f"{m}_lo"), (q[1] + wide).alias(f"{m}_hi")]

    names = [f"{m}_{side}" for m in MEASURES for side in ("lo", "hi")]
    groups = stored(groups.select("depth", "script", "tongue", "octave", "n", *[e for m in MEASURES for e in edges(m)]))
    fixed = lambda m, side: F.when(F.col("script") == "latin", F.lit(PRIOR["latin"][kind(m)][side])).otherwise(F.lit(PRIOR[""][kind(m)][side]))
    around = groups.filter("depth = 0").select("script", "n", *names).withColumns({f"{m}_{side}": _drawn(F.col(f"{m}_{side}"), fixed(m, k), strength) for m in MEASURES for k, side in enumerate(("lo", "hi"))}).drop("n")
    for d, keys in enumerate((["script"], ["script", "tongue"]), 1):
        outer = around.select(*keys, *[F.col(x).alias(f"_{x}") for x in names])
        inner = groups.filter(F.col("depth") == d).join(outer, keys)
        around = inner.select("script", "tongue", *(["octave"] if d == 2 else []), *[_drawn(F.col(x), F.col(f"_{x}"), strength).alias(x) for x in names])
    return around.crossJoin(F.broadcast(trend))


def _drawn(own: Column, outer: Column, strength: int) -> Column:
    return (F.col("n") * own + strength * outer) / (F.col("n") + strength)


def judged(measured: DataFrame, band: DataFrame, lang: str = "lang", salts: int = 16) -> DataFrame:
    """`measured` with base_failed, in_bands and kept."""
    band = stored(band)
    rows, keys = _groups(measured, lang), ["script", "tongue", "octave"]
    if band.count() <= MAX_BROADCAST:
        joined = rows.join(F.broadcast(band), keys, "left")
    else:
        spread = band.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("salt", (F.monotonically_increasing_id() % salts).cast("int")).join(spread, [*keys, "salt"], "left")
    within = F.lit(True)
    for m in MEASURES:
        x = F.col(m) - F.col(f"{m}_trend") * (F.col("at") - F.col("middle")) if kind(m) == "entropy" else F.col(m)
        low, high = SIDES[kind(m)]
        if low:
            within &= F.coalesce(x >= F.col(f"{m}_lo"), F.lit(True))
        if high:
            within &= F.coalesce(x <= F.col(f"{m}_hi"), F.lit(True))
    return joined.select(*measured.columns, failed().alias("base_failed"), within.alias("in_bands"), (~failed() & within).alias("kept"))


def op5_fertility(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, byte_vocabulary: str | None = None) -> DataFrame:
    """Quality rules over documents: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the measures.

    Every row keeps its row, repeated ones and null doc_ids too, and each counts in the bands; null and empty texts have no words
    and fail. Texts of any length are measured whole. An empty table gives no rows. Of other columns, `lang` alone is read.
    """
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = public_tokenizers.path
    measured = stored(measures(docs, vocabulary or path("piece_bpe_32k.model"), byte_vocabulary or path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
    return judged(measured, bands(measured)).select("doc_id", *_COUNTS, "base_failed", "kept", *MEASURES)
