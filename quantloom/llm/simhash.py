"""SimHash near-duplicates: fingerprints, links by BK-trees, and classes.

A text's fingerprint has a bit for each bit position, 1 if it is set in over half of the XXH64 values of its word shingles.
Fingerprints link at `radius` or fewer differing bits. Equal fingerprints are one node from the start (a partial aggregate: a
group of copies is one row, however large). Links are found without comparing all pairs:

* the 64 bits are parted into radius + 2 blocks; two fingerprints that link agree on at least two blocks, so each fingerprint
  is dealt to a shard for every two blocks, named by the blocks' bits (10 shards of 25 bits for radius 3);
* in a shard a BK-tree is built (children keyed by their integer Hamming distance to the parent); a search for x follows only
  edges d with |d - distance(x, node)| <= radius. Only links that join two so far separate parts of a shard are kept, so a
  shard of n fingerprints yields n - 1 links at most;
* a shard of more than `shard_rows` fingerprints is cut into slices, and a task builds the trees of one slice and searches
  them for another: every pair of slices meets in one of the tasks. A shard of more than `finer` slices is no shard: what is in
  it is dealt again by more and smaller blocks, all but `radius` of which name a shard (8 blocks, 56 shards of 40 bits; at last
  16 blocks, 560 shards of 52 bits, which hold 4,096 fingerprints at most). No shard is dropped, capped or sampled.

Classes are connected components over fingerprints, by minimum labels and pointer jumping, each round written to the shared
folder. Nothing goes through the driver but a count of changed labels.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, discard, stored

#: Shards of more than `shard_rows` rows whose sizes are broadcast, at most (some 40 bytes each); beyond, Spark splits skewed joins itself.
MAX_LARGE = 100_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, A-Z in lower case, repeats included. Fewer words: one shingle of all."""
    import xxhash

    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.empty(0, "u8")
    joined, n, h = b" ".join(words), max(1, len(words) - size + 1), xxhash.xxh64_intdigest
    if n == 1:
        return np.array([h(joined, 42)], "u8")
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())), "u8", n)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64 bits; zero for no hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, "i8")
    for lo in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[lo : lo + 8192].astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp). Null texts have no words, and so fingerprint zero like empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            fps = [fingerprint(shingle_hashes(t or "", shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, fp long")


class BKTree:
    """Nodes in lists; a node's children are a dict from distance to node."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children = radius, [], []

    def add(self, x: int) -> None:
        self.values.append(x)
        self.children.append({})
        at = len(self.values) - 1
        node = 0
        while at:
            d = (x ^ self.values[node]).bit_count()
            down = self.children[node].get(d)
            if down is None:
                self.children[node][d] = at
                return
            node = down

    def near(self, x: int) -> list[int]:
        """The nodes within the radius of x."""
        r, values, children, found, todo = self.radius, self.values, self.children, [], [0] if self.values else []
        while todo:
            node = todo.pop()
            d = (x ^ values[node]).bit_count()
            if d <= r:
                found.append(node)
            if below := children[node]:
                if len(below) <= 2 * r + 1:
                    todo += [c for k, c in below.items() if -r <= k - d <= r]
                else:
                    todo += [below[k] for k in range(d - r, d + r + 1) if k in below]
        return found


def tree_links(index: list[tuple], queries: list[tuple] | None, radius: int, alike=None) -> list[tuple[int, int]]:
    """Links that join separate parts: among `index` (queries None), or of `queries` to `index`, whose own are another task's.

    Rows are (node, code, signature). `alike`, given a signature and a list of others, says which of these it links to. Then the
    radius only tells which rows are asked first: those that stay apart are all asked, however far their codes.
    """
    tree, rows = BKTree(radius), [*index, *(queries or ())]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for i, (node, code, signature) in enumerate(rows):
        if queries is None or i >= len(index):
            todo = tree.near(code)
            if alike is not None:
                first = set(todo)
                todo += [j for j in range(len(tree.values)) if j not in first]
            some = 1  # by growing parts, as the first link to a part of the shard settles the rest of it
            while todo := [j for j in todo if root(j) != root(i)]:
                asked, todo = (todo, []) if alike is None else (todo[:some], todo[some:])
                for j, yes in zip(asked, itertools.repeat(True) if alike is None else alike(signature, [rows[j][2] for j in asked])):
                    if yes and (a := root(i)) != (b := root(j)):
                        parent[a] = b
                        out.append((node, rows[j][0]))
                some *= 4
        if i < len(index):
            tree.add(code)
    return out


def _masks(radius: int, blocks: int) -> list[int]:
    """Masks of all sets of `blocks` - `radius` of as many blocks of about equal width: values within the radius agree under one."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [sum(some) for some in itertools.combinations(each, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, radius: int = 3, shard_rows: int = 512, finer: int = 64) -> DataFrame:
    """(a, b): links that connect all fingerprints of `nodes` (distinct, column fp) within the radius, as a forest of each shard."""
    found, levels = [], (radius + 2, radius + 5, max(16, radius + 5))
    for blocks in levels:
        shards = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(_masks(radius, blocks))])
        dealt = nodes.select("fp", F.explode(shards).alias("shard")).select("shard.*", F.col("fp").alias("node"))
        sizes = stored(shard_sizes(dealt))
        large = sizes.filter(F.col("n") > finer * shard_rows)
        if blocks == levels[-1] or large.isEmpty():
            found.append(shard_links(dealt, radius, shard_rows, sizes=sizes))
            break
        found.append(shard_links(dealt, radius, shard_rows, sizes=sizes.filter(F.col("n") <= finer * shard_rows)))
        nodes = stored(dealt.join(large, ["k", "bits"], "left_semi").select(F.col("node").alias("fp")).distinct())
    return functools.reduce(DataFrame.union, found)


def shard_sizes(dealt: DataFrame) -> DataFrame:
    """(k, bits, n) of the shards of two rows or more; most hold one row and end here."""
    return dealt.groupBy("k", "bits").agg(F.count("*").alias("n")).filter("n > 1")


def shard_links(dealt: DataFrame, radius: int, shard_rows: int = 512, alike=None, about: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(a, b): links between nodes that share a shard, from rows (k, bits, node) with shard (k, bits).

    `about` has what is compared, a row a node: (node, code, signature), the signature for `alike`; without it, a node is its own
    code. It comes in once the rows of shards of one row are gone, which most are. `sizes` are the shards to look at, as a stored
    table of shard_sizes; all where none are given.
    """
    sizes = stored(shard_sizes(dealt)) if sizes is None else sizes
    large = sizes.filter(F.col("n") > shard_rows).select("k", "bits", F.col("n").alias("_many"))
    if large.limit(MAX_LARGE + 1).count() <= MAX_LARGE:
        # Rows of large shards get their size from a broadcast; in the join that gives the others theirs they stand apart.
        spread = F.when(F.col("_many").isNotNull(), 1 + F.pmod(F.xxhash64("node"), F.lit(1024))).otherwise(0)
        told = dealt.join(F.broadcast(large), ["k", "bits"], "left").withColumn("_apart", spread.cast("long"))
        few = sizes.filter(F.col("n") <= shard_rows).withColumn("_apart", F.lit(0).cast("long"))
        rows = told.join(few.hint("merge"), ["k", "bits", "_apart"], "left").withColumn("n", F.coalesce("_many", "n")).filter("n IS NOT NULL").drop("_many", "_apart")
    else:
        rows = dealt.join(sizes.hint("merge"), ["k", "bits"])
    dealt = stored(rows.withColumn("code", F.col("node")) if about is None else rows.join(about.hint("merge"), "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index, queries = None, [], []

        def done() -> list[tuple[int, int]]:
            return tree_links(index, queries if held[2] else None, radius, alike) if held else []

        def told(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in bounded(batches):
            out: list[tuple[int, int]] = []
            columns = [c.to_pylist() for c in batch.columns]
            for k, bits, pair, cross, asked, node, code, *signature in zip(*columns):
                if held != (k, bits, cross, pair):
                    out += done()
                    held, index, queries = (k, bits, cross, pair), [], []
                (queries if asked else index).append((node, code & 0xFFFFFFFFFFFFFFFF, signature[0] if signature else None))
            yield told(out)
        yield told(done())

    # A shard of n rows has s = ceil(n / shard_rows) slices; slice i meets slice j >= i in task (i, j).
    s = F.ceil(F.col("n") / shard_rows).cast("int")
    mine = F.pmod(F.xxhash64("node"), s).cast("int")
    meet = F.transform(
        F.sequence(F.lit(0), s - 1),
        lambda o: F.struct((F.least(mine, o) * s + F.greatest(mine, o)).cast("long").alias("pair"), (o != mine).alias("cross"), (o < mine).alias("asked")),
    )
    rest = ["node", "code", *(c for c in dealt.columns if c == "signature")]
    tasks = dealt.select("k", "bits", F.explode(meet).alias("m"), *rest).select("k", "bits", "m.pair", "m.cross", "m.asked", *rest)
    spark = dealt.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = tasks.repartition(parts, "k", "bits", "pair").sortWithinPartitions("k", "bits", "pair", "asked", "node")
    return tasks.mapInArrow(run, "a long, b long").distinct()


def components(nodes: DataFrame | None, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(fp, label): for every fingerprint the least one that it is connected to, or for linked ones alone without `nodes`. `edges` (a, b) is a forest-like set of links.

    Rounds of hooking (a root takes the least label that its tree's nodes see) and pointer jumping; each halves the depth, so
    the number of rounds follows the logarithm of the longest chain. Only linked nodes take part.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    kept: list[str] = []  # tables of the round before, which nothing reads once the next stands
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")), kept)
    for _ in range(max_rounds):
        made: list[str] = []
        # pointer jumping: the label of my label
        target = labels.select(F.col("v").alias("label"), F.col("label").alias("up"))
        jumped = stored(labels.join(target, "label").select("v", F.col("up").alias("label")), made)
        # hooking: what my neighbours are labelled, for me and for my root
        seen = both.join(jumped.select(F.col("v").alias("b"), F.col("label").alias("seen")), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        mine = stored(jumped.join(seen.withColumnRenamed("a", "v"), "v").select("v", "label", F.least("label", "seen").alias("low")), made)
        roots = mine.filter("low < label").groupBy("label").agg(F.min("low").alias("low"))
        own = mine.select("v", F.col("low").alias("label"))
        last: list[str] = []
        new = stored(own.join(roots.select(F.col("label").alias("v"), "low"), "v", "left").select("v", F.coalesce(F.least("label", "low"), "label").alias("label")), last)
        changed = not new.join(labels.withColumnRenamed("label", "was"), "v").filter("label <> was").isEmpty()
        discard(kept + made)
        labels, kept = new, last
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = labels.select(F.col("v").alias("fp"), "label")
    return labels if nodes is None else nodes.select("fp").join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, key: str = "doc_id") -> DataFrame:
    """A row per document: doc_id, fp (signed 64 bits), component_id (the least doc_id reachable over links, itself included).

    Empty texts have fingerprint zero and link like others. A null doc_id is nobody's component_id unless all of a class are null.
    Rows of equal doc_id each keep their row.
    """
    fps = stored(fingerprints(docs, shingle, key))
    nodes = stored(fps.groupBy("fp").agg(F.min(key).alias("least")))
    labels = components(nodes, links(nodes, radius))
    classes = nodes.join(labels, "fp")
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = stored(classes.select("fp", "label").join(least, "label").select("fp", "component_id"))
    # A fingerprint may be a third of all rows' (copies): each fingerprint's class is dealt to `salts` tasks and rows spread over them.
    salts = 16
    spread = by_fp.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = fps.withColumn("salt", (F.monotonically_increasing_id() % salts).cast("int"))
    return salted.join(spread, ["fp", "salt"]).select(key, "fp", "component_id")


#: For near copies by similarity: bands of two minima that name shards, bins of the signature, and the radius of a BK-tree search.
BANDS, BINS, RADIUS = 8, 256, 22


def _minima(h: np.ndarray) -> list[int]:
    """Shard names: the least values of a text's shingle hashes under 2 x BANDS orders, two and two."""
    out = []
    for k in range(2 * BANDS):
        mixed = (h ^ np.uint64(0xD1B54A32D192ED03 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        out.append(int((mixed ^ (mixed >> np.uint64(31))).min()))
    return [_signed((a * 3 + (b >> 1) * 5) & 0xFFFFFFFFFFFFFFFF) for a, b in zip(out[::2], out[1::2])]


def _signature(h: np.ndarray) -> bytes:
    """The least shingle hash of each of BINS bins, 16 bits of it; 0 where a bin is empty."""
    h = np.unique(h * np.uint64(0x9E3779B97F4A7C15))
    bins = (h >> np.uint64(56)).astype("i8")
    first = np.concatenate(([True], bins[1:] != bins[:-1]))
    out = np.zeros(BINS, "<u2")
    out[bins[first]] = (h[first] >> np.uint64(20)) % np.uint64(65535) + np.uint64(1)
    return out.tobytes()


def similarities(a: bytes, others: list[bytes]) -> np.ndarray:
    """Jaccard similarity of the shingle sets behind a signature and others, estimated over the bins that either of two fills."""
    x, y = np.frombuffer(a, "<u2"), np.frombuffer(b"".join(others), "<u2").reshape(-1, BINS)
    filled = (x | y) != 0
    n = filled.sum(1)
    return np.where(n > 0, ((x == y) & filled).sum(1) / np.maximum(n, 1), 1.0)


def shingle_set(h: np.ndarray) -> bytes:
    """The distinct shingle hashes in order, 32 bits of each."""
    return np.unique((h >> np.uint64(32)).astype("<u4")).tobytes()


def jaccard(a: bytes, b: bytes, least: float) -> bool:
    """Whether two shingle sets are similar."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = RADIUS, doubt: float = 0.12) -> DataFrame:
    """(_row, _class): the classes of documents whose shingle sets are similar.

    `docs` has a column `_row`, unique longs. Texts of equal words (A-Z in lower case) are one node. Nodes are dealt to shards by
    minima of their shingle hashes, two to a name: of two texts of similarity 0.8 one of the BANDS shards is common but for 1 in
    3,500. In a shard a pair is a candidate if its signatures agree on `least` of their bins, less `doubt`. Connected candidates
    make shards of their own, in which the shingle sets themselves decide. Fingerprints are of distinct shingles, as the sets are,
    and BK-trees find those within `radius` bits, which are asked first; pairs beyond it are asked too while their rows are apart,
    so no link hangs on the radius. Texts without words are one class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in bounded(batches):
            out = []
            for t in batch.column(1).to_pylist():
                h = shingle_hashes(t or "", shingle)
                same = xxhash.xxh3_128_digest(b" ".join((t or "").encode("utf-8", "replace").translate(_LOWER).split()))
                out.append((same, fingerprint(np.unique(h)), _minima(h), _signature(h)) if len(h) else (same, 0, [0] * BANDS, bytes(2 * BINS)))
            columns = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["_row", "same", "code", "bands", "signature"])

    signed = stored(docs.select("_row", "text").mapInArrow(run, "_row long, same binary, code long, bands array<long>, signature binary"))
    copies = stored(signed.groupBy("same").agg(F.min("_row").alias("node")))
    # The row that stands for a group of copies brings what describes them all.
    nodes = signed.join(copies.select(F.col("node").alias("_row")), "_row", "left_semi").withColumnRenamed("_row", "node")
    dealt = nodes.select(F.posexplode("bands").alias("k", "bits"), "node")
    candidates = shard_links(dealt, radius, alike=lambda a, others: similarities(a, others) >= least - doubt, about=nodes.select("node", "code", "signature"))
    members = components(None, candidates).withColumnRenamed("fp", "_row")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            h = [shingle_hashes(t or "", shingle) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([fingerprint(np.unique(x)) for x in h], pa.int64()), pa.array([shingle_set(x) for x in h], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "code", "signature"])

    exact = docs.select("_row", "text").join(members.select("_row"), "_row").mapInArrow(sets, "node long, code long, signature binary")
    shards = members.select(F.lit(0).alias("k"), F.col("label").alias("bits"), F.col("_row").alias("node"))
    edges = shard_links(shards, radius, alike=lambda a, others: [jaccard(a, b, least) for b in others], about=stored(exact))
    classes = components(copies.select(F.col("node").alias("fp")), edges)
    by_copy = stored(copies.join(classes.withColumnRenamed("fp", "node"), "node").select("same", F.col("label").alias("_class")))
    salts = 16  # one text may be a third of all rows'
    spread = by_copy.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return signed.select("_row", "same", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int").alias("salt")).join(spread, ["same", "salt"]).select("_row", "_class")


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8, key: str = "doc_id") -> DataFrame:
    """`docs` with one row left of each class of near copies: that of the least doc_id, nulls last, then any one of these.

    Other columns pass through. The rows are written once with a number of their own, and the losers' numbers taken out.
    """
    names, renamed = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    at = lambda name: renamed[names.index(name)]
    rows = stored(docs.toDF(*renamed).withColumn("_row", F.monotonically_increasing_id()))
    classes = near_copies(rows.select("_row", F.col(at("text")).alias("text")), shingle, least)
    ranked = stored(classes.join(rows.select("_row", F.col(at(key)).alias("id")), "_row"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("_row").alias("_row"))
    best = ranked.groupBy("_class").agg(F.min(order).alias("best"), F.count("*").alias("n"))
    stays = best.select(F.col("best._row").alias("_row"))
    return rows.join(stays, "_row", "left_semi").select(*renamed).toDF(*names)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents' fingerprints of 3-word shingles, linked at 3 or fewer bits: doc_id, fingerprint (hex), component_id.

    Every row keeps its row, repeated ones too. Null and empty texts have fingerprint zero, linked like any other; a null doc_id is
    nobody's component_id unless all of a class are null. Texts of any length are taken whole. An empty table gives no rows. Other
    columns are not read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
