"""Substring dedup: passages of `window` or more words that occur twice, by FM-indexes of shards.

A window (35 consecutive words of one text) is repeated if its word sequence also starts anywhere else. Which windows could be
is narrowed down by hashes, and FM-indexes decide:

1. Texts of the same bytes are counted once, with the number of their copies.
2. Of each window the least hash of its `k`-word grams is taken (its minimizer). The windows of a text that share a minimizer's
   occurrence lie next to each other: their words are a segment. Equal windows have equal minimizers, and so meet in a shard.
3. Minimizers that occur once in all texts are dropped: their windows can't repeat. Equal segments are counted before their
   words travel: of those, one text brings the words, with the number of occurrences as a weight.
4. A shard holds the segments of some minimizers, as one text with separators. Its FM-index is built: suffixes sorted by prefix
   doubling, the Burrows-Wheeler transform in a wavelet tree of bit vectors with rank samples. Segments are streamed against it
   by backward search, many at once; a matching statistic of `window` words whose suffix interval weighs two or more marks a window.
5. Marks go back to all texts with the segment, and words under marked windows go.

A minimizer with more than `hot` different segments (a frequent passage with ever new neighbours) is no shard of its own: its
segments are cut into single windows, and the hashes of grams that hold all words of a window between them join the minimizer in
the name of the shard, so that equal windows still meet, and few others do, whichever words of a template change. Equal ones of a batch of texts travel as one row, and all that
arrive are one row of the index, with their number as its weight.

A word stands for its 64-bit XXH3 hash, and texts, segments and windows count as equal at equal digests of 128 bits (a text's
MD5; a segment's or window's hash together with its minimizer's). Of n different windows a wrong pair is expected with
n^2 / 2^129, 4e-13 for the 1.6e13 windows of 100 TB; two different words of 1e10 share a hash with 2.7 such pairs expected, which
mark something only where the 34 words around them are equal too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, stored, texts

WINDOW, GRAM, HOT = 35, 14, 2048
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a batch of texts as 64-bit hashes, one text behind the other, and where each text's end."""

    def __init__(self, texts: pa.Array):
        import xxhash

        split = pc.split_pattern(pc.replace_substring_regex(texts.cast(pa.large_string()), "[\t-\r ]+", " "), " ")
        found = split.flatten().dictionary_encode()
        h = xxhash.xxh3_64_intdigest
        distinct = np.fromiter(map(h, found.dictionary.to_pylist()), "u8", len(found.dictionary))
        ids = found.indices.to_numpy(zero_copy_only=False)
        some = ids != found.dictionary.index("").as_py()  # blanks around a text part off an empty word
        self.hashes = distinct[ids[some]]
        offsets = split.offsets.to_numpy().astype("i8")
        self.ends = np.concatenate(([0], np.cumsum(some)))[offsets[1:] - offsets[0]]
        self.starts = np.concatenate(([0], self.ends[:-1])) if len(self.ends) else self.ends


def _rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, by doubling."""
    if len(h) < size:
        return np.empty(0, "u8")
    have, out, done = h, None, 0
    step = 1
    while True:
        if size & step:
            out = have if out is None else _join(out, have, done)
            done += step
        step *= 2
        if step > size:
            break
        have = _join(have, have, step // 2)
    return out[: len(h) - size + 1]


def _join(a: np.ndarray, b: np.ndarray, at: int) -> np.ndarray:
    """Hashes of a's run followed by b's run that starts `at` words later."""
    n = len(b) - at
    x = (a[:n] * _MULT) ^ (a[:n] >> np.uint64(32))
    return (x + b[at:]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ (b[at:] >> np.uint64(29))


def segments(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, minimizer, first window, windows, content hash) of the segments of a batch's texts, in order."""
    h = words.hashes
    n = len(h) - window + 1
    if n < 1:
        none = np.empty(0, "i8")
        return none, none.view("u8"), none, none, none.view("u8")
    grams = _rolling(h, gram)
    width = window - gram + 1
    # leftmost least gram of each window: least over two overlapping runs of a power of two
    at, low, span = np.arange(len(grams)), grams, 1
    while span * 2 <= width:
        a, b = low[:-span], low[span:]
        left = a <= b
        low, at = np.where(left, a, b), np.where(left, at[:-span], at[span:])
        span *= 2
    a, b = low[:n], low[width - span : width - span + n]
    place = np.where(a <= b, at[:n], at[width - span : width - span + n])
    # windows of one text, and where another segment starts
    text = np.repeat(np.arange(len(words.ends)), words.ends - words.starts)
    inside = np.flatnonzero(text[:n] == text[window - 1 :])
    place, text = place[inside], text[inside]
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])))) if len(inside) else inside
    counts = np.diff(np.append(first, len(inside)))
    starts, place, text = inside[first], place[first], text[first]
    # content: the first and the last window, how many, and where the minimizer stands
    whole = _rolling(h, window)
    content = _mix(_mix(whole[starts], whole[starts + counts - 1]), (counts.astype("u8") << np.uint64(8)) | (place - starts).astype("u8"))
    return text, grams[place], starts - words.starts[text], counts, content


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * _MULT)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(31))


class Bits:
    """A bit vector packed to 64-bit words with counts before each word: rank in constant time, for arrays of places."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        raw = np.packbits(np.concatenate((bits, np.zeros(-n % 64 + 64, bool))), bitorder="little").view("<u8")
        self.words = raw
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(raw), dtype="i8")))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype("u8")) - np.uint64(1)))


class WaveletTree:
    """A sequence of symbols below 2^levels as a bit vector a level, most significant bit first (stable partition at each)."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.bits, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            ones = (symbols >> level & 1).astype(bool)
            self.bits.append(Bits(ones))
            self.zeros.append(int(len(symbols) - ones.sum()))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))
        self.first = np.searchsorted(self._order(symbols), self._order(np.arange(1 << levels)))

    def _order(self, symbols: np.ndarray) -> np.ndarray:
        """Where symbols stand after the last level: by their bits read backwards."""
        out = np.zeros_like(symbols)
        for k in range(self.levels):
            out |= (symbols >> k & 1) << (self.levels - 1 - k)
        return out

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each of the places."""
        at = list(places)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            bits, zeros = self.bits[k], self.zeros[k]
            for i, x in enumerate(at):
                r = bits.rank(x)
                at[i] = np.where(one, zeros + r, x - r)
        return [x - self.first[symbol] for x in at]


def _ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first `depth` symbols, by prefix doubling. Ends compare equal: no search crosses them."""
    rank, span, n = text, 1, len(text)
    while span < depth:
        key = rank * (rank.max() + 1)
        key[: n - span] += rank[span:]
        rank = np.unique(key, return_inverse=True)[1]
        span *= 2
    return rank


class FMIndex:
    """Weighted FM-index of segments of symbols."""

    def __init__(self, parts: list[np.ndarray], weights: np.ndarray, depth: int):
        """Suffixes are sorted by their first `depth` symbols, as many as a search can ask for."""
        sizes = np.array([len(p) for p in parts])
        words = np.concatenate(parts)
        self.alphabet, ids = np.unique(words, return_inverse=True)
        # Symbol 0 ends each segment.
        n = len(words) + len(parts)
        text = np.zeros(n, "i8")
        starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        inside = np.ones(n, bool)
        inside[starts + sizes] = False
        text[inside] = ids + 1
        order = np.argsort(_ranks(text, depth), kind="stable")
        #: Ranks of the text read backwards: windows in this order share their last words with their neighbours.
        self.backwards = _ranks(text[::-1], depth)[::-1]
        self.levels = max(1, int(len(self.alphabet)).bit_length())
        self.tree = WaveletTree(text[order - 1], self.levels)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))))
        weight = np.repeat(weights, sizes + 1)
        self.weight = np.concatenate(([0], np.cumsum(weight[order])))
        self.text, self.starts, self.sizes, self.n = text, starts, sizes, n

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: suffix intervals of symbol + pattern."""
        a, b = self.tree.rank(symbol, lo, hi)
        return self.below[symbol] + a, self.below[symbol] + b

    def repeated(self, window: int) -> np.ndarray:
        """Streams the segments against the index: for each place of the text whether the window that starts there weighs two or more.

        A search steps back from a window's last word. It ends as soon as its interval weighs less than two (the matching
        statistic is short), or holds one suffix alone that weighs two or more: that is the window's own segment, which stands
        for copies, and stays the only one. Windows are searched in the order of their last words, so that those in the same
        interval that ask for the same symbol are neighbours and step once.
        """
        ends = np.concatenate([np.arange(s + window - 1, s + z) for s, z in zip(self.starts, self.sizes)])
        ends = ends[np.argsort(self.backwards[ends], kind="stable")]
        state, lo, hi = np.zeros(len(ends), "i8"), np.zeros(1, "i8"), np.full(1, self.n, "i8")
        out = np.zeros(self.n, bool)
        for step in range(window):
            symbol = self.text[ends - step]
            new = np.concatenate(([True], (state[1:] != state[:-1]) | (symbol[1:] != symbol[:-1])))
            first = np.flatnonzero(new)
            lo, hi = self.extend(symbol[first], lo[state[first]], hi[state[first]])
            which = np.cumsum(new) - 1
            heavy, lone = self.weight[hi] - self.weight[lo] >= 2, hi - lo == 1
            out[ends[(heavy & lone)[which]] - window + 1] = True
            live = (heavy & ~lone)[which]
            ends, state = ends[live], which[live]
            if not len(ends):
                return out
        out[ends - window + 1] = True
        return out


def window_shards(edges: np.ndarray, place: np.ndarray, minimizers: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The shards of the windows at `place`: named by their minimizer and by grams (edges: the hash of the gram at each place) that hold all of their words between them."""
    name = minimizers.view("u8")
    for off in (*range(0, window - gram, gram), window - gram):
        name = _mix(edges[place + off], name)
    return name.view("i8")


def occurrences(docs: DataFrame, window: int, gram: int, text: str = "text") -> DataFrame:
    """(same, pick, grams, starts, counts, contents): the segments of each text of `window` words or more; `same` is a digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, size=4 << 20):
            text, grams, starts, counts, contents = segments(Words(batch.column(1)), window, gram)
            some, sizes = np.unique(text, return_counts=True)
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype("i4"))
            values = (grams.view("i8"), starts.astype("i4"), counts.astype("i4"), contents.view("i8"))
            columns = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in values]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), batch.column(2).take(pa.array(some)), *columns], names=["same", "pick", "grams", "starts", "counts", "contents"])

    return docs.select("same", text, "pick").mapInArrow(run, "same binary, pick long, grams array<long>, starts array<int>, counts array<int>, contents array<long>")


def _digest():
    return F.unhex(F.md5(F.col("text").cast("binary")))


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_words: int = 1_000_000) -> DataFrame:
    """(same, ranges): for each different text with repeated windows, the words they cover, as ranges of word numbers in order.

    `window` is `gram` plus 61 words at most. `docs` has `text`, without nulls, and `pick`, longs that tell copies of a text apart: of a group of copies one brings its words.
    """
    spark = docs.sparkSession
    plain = docs.select(_digest().alias("same"), "text", "pick")
    found = stored(occurrences(plain, window, gram))
    once = found.groupBy("same").agg(F.count("*").alias("copies"), F.min("pick").alias("pick"), *[F.first(c).alias(c) for c in ("grams", "starts", "counts", "contents")])
    zipped = F.explode(F.arrays_zip("grams", "starts", "counts", "contents")).alias("z")
    one = stored(once.select("same", "pick", "copies", zipped).select("same", "pick", "copies", F.col("z.grams").alias("gram"), F.col("z.starts").alias("start"), F.col("z.counts").alias("n"), F.col("z.contents").alias("content")))
    often = stored(one.groupBy("gram").agg(F.sum("copies").alias("total")).filter("total > 1").select("gram"))
    hits = stored(one.join(often, "gram"))
    # Each different segment once: how often it occurs, and where its words can be had.
    kinds = stored(hits.groupBy("gram", "content").agg(F.sum("copies").alias("weight"), F.min(F.struct("same", "pick", "start", "n")).alias("at")).select("gram", "content", "weight", "at.*"))
    crowded = stored(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > hot).select("gram", F.lit(True).alias("cut")))
    kinds = kinds.join(crowded, "gram", "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    asked = stored(kinds.groupBy("same", "pick").agg(F.collect_list(F.struct("gram", "content", "weight", "start", "n", "cut")).alias("asked")))  # of one text

    names = ["shard", "gram", "contents", "parts", "weight", "words"]
    kinds_of = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary()]

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, size=4 << 20):
            words, asked = Words(batch.column(0)), batch.column(1)
            h, flat = words.hashes, asked.flatten()
            want = {x: flat.field(x).to_numpy(zero_copy_only=False) for x in ("gram", "content", "weight", "start", "n", "cut")}
            of = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            at = want["start"] + words.starts[of]
            out = [
                (g, g, [c], [0], w, h[a : a + n + window - 1].tobytes())
                for g, c, w, a, n in zip(*(x[~want["cut"]].tolist() for x in (want["gram"], want["content"], want["weight"], at, want["n"])))
            ]
            cut = np.flatnonzero(want["cut"])
            if len(cut):
                n = want["n"][cut]
                row = np.repeat(cut, n)
                part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                place, grams = at[row] + part, want["gram"][row]
                edges, whole = _rolling(h, gram), _rolling(h, window)[place]
                shard = window_shards(edges, place, grams, window, gram)
                # Equal windows of the batch are one row.
                order = np.lexsort((whole, grams, shard))
                shard, grams, whole, place, part, row = (x[order] for x in (shard, grams, whole, place, part, row))
                content, weight = want["content"][row], want["weight"][row]
                new = np.concatenate(([True], (shard[1:] != shard[:-1]) | (grams[1:] != grams[:-1]) | (whole[1:] != whole[:-1])))
                first = np.flatnonzero(new)
                total = np.add.reduceat(weight, first).tolist()
                for i, (a, b) in enumerate(zip(first.tolist(), np.append(first[1:], len(new)).tolist())):
                    out.append((int(shard[a]), int(grams[a]), content[a:b], part[a:b].astype("i4"), total[i], h[place[a] : place[a] + window].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds_of)], names=names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []  # words, weight, what they are windows of: (minimizer, contents, parts)
        shard, first, total = None, 0, 0  # the shard of the last row, its first row, and the words held
        bits = 1 << np.arange(window - gram + 1)  # a segment's windows at most: fewer than 63

        def done() -> pa.RecordBatch:
            out: list[tuple] = []
            if rows:
                index = FMIndex([np.frombuffer(x[0], "u8") for x in rows], np.array([x[1] for x in rows]), window)
                marks = index.repeated(window)
                for (_, _, members), s, z in zip(rows, index.starts.tolist(), index.sizes.tolist()):
                    if (own := marks[s : s + z - window + 1]).any():
                        mark = int(own @ bits[: len(own)])
                        out += [(g, c, p, mark) for g, contents, parts in members for c, p in zip(contents, parts)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["gram", "content", "part", "marks"])

        def lone() -> bool:
            """Whether the last shard holds one window alone, that of one place: it can't repeat."""
            return len(rows) == first + 1 and rows[first][1] < 2 and len(rows[first][0]) == 8 * window

        for batch in batches:
            for name, g, contents, parts, weight, words in zip(*(c.to_pylist() for c in batch.columns)):
                if name != shard:
                    if rows and lone():
                        total -= window
                        rows.pop()
                    if total >= shard_words:  # an index ends between shards
                        yield done()
                        rows, total = [], 0
                    shard, first = name, len(rows)
                elif rows[-1][0] == words and rows[-1][2][-1][0] == g:
                    rows[-1][1] += weight
                    rows[-1][2].append((g, contents, parts))
                    continue
                rows.append([words, weight, [(g, contents, parts)]])
                total += len(words) // 8
        if rows and lone():
            rows.pop()
        yield done()

    # Rows of equal text and key are one from here on, merged before they move.
    each = plain.groupBy("same", "pick").agg(F.first("text").alias("text"))
    brought = each.join(asked, ["same", "pick"]).select("text", "asked").mapInArrow(words_of, "shard long, gram long, contents array<long>, parts array<int>, weight long, words binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    brought = brought.repartition(parts, "shard").sortWithinPartitions("shard", "gram", "words")
    marked = stored(brought.mapInArrow(search, "gram long, content long, part int, marks long"))
    back = hits.join(marked, ["gram", "content"]).select("same", (F.col("start") + F.col("part")).alias("start"), "marks")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.arange(window - gram + 1)
        for batch in bounded(batches, size=4 << 20):
            out = []
            for starts, marks in zip(batch.column(1), batch.column(2)):
                start, mark = starts.values.to_numpy(), marks.values.to_numpy()
                at = (start[:, None] + shift)[(mark[:, None] >> shift & 1).astype(bool)]
                at.sort()
                cut = np.flatnonzero(np.diff(at) > window)
                lo, hi = at[np.concatenate(([0], cut + 1))], at[np.append(cut, len(at) - 1)] + window
                out.append([{"start": a, "end": b} for a, b in zip(lo.tolist(), hi.tolist())])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["same", "ranges"])

    gathered = back.groupBy("same").agg(F.collect_list(F.struct("start", "marks")).alias("rows"))  # of one text
    return stored(gathered.select("same", F.col("rows.start").alias("starts"), F.col("rows.marks").alias("marks")).mapInArrow(ranges, "same binary, ranges array<struct<start:int,end:int>>"))


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, key: str = "doc_id", salts: int = 16) -> DataFrame:
    """A row per row of `docs`: key, n_words, n_removed, kept (the words left, joined by one blank).

    Null and empty texts have no words; texts of fewer words than a window keep all. Two rows of equal text are two places.
    """
    plain = texts(docs, key)
    found = repeats(plain.select("text", F.xxhash64(key).alias("pick")), window, gram, hot)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, size=4 << 20):
            n_words, n_removed, kept = [], [], []
            for t, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = t.encode("utf-8", "surrogatepass").split()
                left, at = [], 0
                for r in cut or ():
                    left += words[at : r["start"]]
                    at = r["end"]
                left += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            columns = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "n_words", "n_removed", "kept"])

    # The ranges of a text are one row; copies of a text (empty ones too) are spread over the salts they are dealt to.
    spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = plain.withColumns({"same": _digest(), "salt": (F.monotonically_increasing_id() % salts).cast("int")}).join(spread, ["same", "salt"], "left").select(key, "text", "ranges")
    return rows.mapInArrow(run, f"{key} {kind}, n_words long, n_removed long, kept string")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without repeated passages of 35 words: doc_id, n_words, n_removed, kept_sha256.

    Every row keeps its row, and null doc_ids; rows of equal text are places of their own, so that each loses all of its windows.
    Null and empty texts have no words, shorter texts than a window lose none. Texts of any length are taken whole. An empty
    table gives no rows. Other columns are not read.
    """
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
