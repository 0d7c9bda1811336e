"""Exact search for the largest inner products: ball trees of shards, branch and bound.

Candidates are dealt to shards around pivots (vectors of a bounded sample); a shard's ball has its pivot's place and the radius
of its farthest row. No inner product of a query q with a row in a ball of centre c and radius r exceeds q.c + |q| r. A query
goes to the shard with the highest such bound first. The k-th best score found there goes along to all other shards, and only to
those whose bound reaches it. In a shard, a block of queries walks the tree side by side: down to the best leaf first, then over
all nodes whose bound reaches the query's k-th score so far, best leaves first, in rounds that share the scores found.

Scores are sums of whole numbers and exact: products run in floating point only where every partial sum is a whole number that
it holds, else in whole numbers. Bounds are widened by more than their rounding.

At scale: a shard has a bounded number of values, so a task's memory is bounded. A shard that many queries go to is copied to
several tasks, each with a part of the queries; a pivot with many rows is cut into slices. Of equal vectors only the k + 1 least
keys can be in a result, so copies are cut to these before they move. Pivots (1,024 at most) and one row a shard reach the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, discard, stored
from .vectors import integers, pack, unpack

NO_SCORE = -(2**63)


class BallTree:
    """A balanced tree over the rows of a matrix of whole numbers; level by level, the 2^level nodes of a level are equal parts of the rows."""

    def __init__(self, x: np.ndarray, leaf: int = 64):
        self.n, self.depth = len(x), 0
        while len(x) > leaf << self.depth:
            self.depth += 1
        points, order = x.astype("f8"), np.arange(self.n)
        self.centres, self.radii = [], []
        for level in range(self.depth + 1):
            edges = self.edges(level)
            centres, radii = np.zeros((1 << level, x.shape[1])), np.zeros(1 << level)
            for i, (a, b) in enumerate(itertools.pairwise(edges)):
                own = points[order[a:b]]
                if not len(own):
                    continue
                centres[i] = own.mean(0)
                away = ((own - centres[i]) ** 2).sum(1)
                radii[i] = np.sqrt(away.max())
                if level < self.depth:  # halves along the line between two far points
                    one = own[away.argmax()]
                    other = own[((own - one) ** 2).sum(1).argmax()]
                    order[a:b] = order[a:b][np.argpartition(own @ (other - one), min(self.edges(level + 1)[2 * i + 1] - a, b - a - 1))]
            self.centres.append(centres)
            self.radii.append(radii)
        self.order, self.x = order, x[order]
        self.longest = float(np.sqrt((points * points).sum(1).max())) if self.n else 0.0
        self.held: dict[type, np.ndarray] = {}

    def edges(self, level: int) -> list[int]:
        return [self.n * i >> level for i in range((1 << level) + 1)]

    def rows(self, kind: type) -> np.ndarray:
        if kind not in self.held:
            self.held[kind] = self.x.astype(kind)
        return self.held[kind]

    def search(self, q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, row), in this order, the k best rows of each query, earlier rows first among equal scores.

        `least`: the score that another shard's k-th row has (NO_SCORE if none); rows of lower scores needn't be found.
        """
        norm = np.sqrt((q.astype("f8") ** 2).sum(1))
        longest = self.longest * float(norm.max(initial=0.0)) + 1
        kind = np.float32 if longest < 1 << 24 else np.float64 if longest < 1 << 53 else object
        floats, exact, rows = q.astype("f8"), q.astype(kind), self.rows(kind)
        if kind is object and longest >= 2.0**62:
            raise ValueError("inner products must stay below 2^62")
        slack = norm * (self.longest + 1) * 1e-9 + 1e-3
        least = least.copy()
        best = [np.zeros(0, "i8")] * 3
        edges = self.edges(self.depth)

        def bounds(level: int) -> np.ndarray:
            return floats @ self.centres[level].T + norm[:, None] * self.radii[level] + slack[:, None]

        def visit(who: np.ndarray, leaves: np.ndarray) -> None:
            nonlocal best
            by = np.argsort(leaves, kind="stable")
            who, leaves = who[by], leaves[by]
            found = [best]
            cuts = np.flatnonzero(np.diff(leaves, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(leaves)]):
                lo, hi = edges[leaves[a]], edges[leaves[a] + 1]
                scores = (exact[who[a:b]] @ rows[lo:hi].T).astype("i8")
                i, j = np.nonzero(scores >= least[who[a:b], None])
                found.append([who[a:b][i], scores[i, j], self.order[lo + j]])
            one, score, row = (np.concatenate(c) for c in zip(*found))
            by = np.lexsort((row, -score, one))
            one, score, row = one[by], score[by], row[by]
            rank = np.arange(len(one)) - np.searchsorted(one, one)
            last = rank == k - 1
            least[one[last]] = np.maximum(least[one[last]], score[last])
            best = [c[rank < k] for c in (one, score, row)]

        every = np.arange(len(q))
        if not self.n or not len(q):
            return tuple(best)
        node = np.zeros(len(q), "i8")
        for level in range(1, self.depth + 1):
            up = bounds(level)
            node = 2 * node + (up[every, 2 * node + 1] > up[every, 2 * node])
        first = node
        visit(every, first)
        who, node = every, np.zeros(len(q), "i8")
        up = bounds(0)[:, 0]
        who, node, up = who[up >= least], node[up >= least], up[up >= least]
        for level in range(1, self.depth + 1):
            who, node = np.repeat(who, 2), (2 * node[:, None] + (0, 1)).ravel()
            up = bounds(level)[who, node]
            alive = up >= least[who]
            who, node, up = who[alive], node[alive], up[alive]
        left = node != first[who]
        who, node, up = who[left], node[left], up[left]
        by = np.lexsort((-up, who))
        who, node, up = who[by], node[by], up[by]
        turn = np.arange(len(who)) - np.searchsorted(who, who)
        done, size = 0, 1
        while done <= turn.max(initial=-1):
            now = (turn >= done) & (turn < done + size) & (up >= least[who])
            if now.any():
                visit(who[now], node[now])
            done, size = done + size, 2 * size
        return tuple(best)


def cleaned(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(key, code, dim): packed vectors of whole numbers; rows that are no vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            keep, values, lengths = integers(batch.column(1), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(pack(values, lengths), pa.binary()), pa.array(lengths.astype("i4"))], names=["key", "code", "dim"])

    return vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).mapInArrow(run, "key long, code binary, dim int")


def _placed(rows: DataFrame, pivots: list[bytes], dim: int) -> DataFrame:
    """`rows` with the nearest pivot, and the square of the distance to it."""
    p = unpack(pivots, dim).astype("f8")
    squares = (p * p).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            x = unpack(batch.column(1).to_pylist(), dim).astype("f8")
            at = (squares - 2 * (x @ p.T)).argmin(1)
            far = ((x - p[at]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(at.astype("i4")), pa.array(far)], names=["key", "code", "pivot", "far"])

    return rows.select("key", "code").mapInArrow(run, "key long, code binary, pivot int, far double")


def _searched(shards: DataFrame, queries: DataFrame, k: int, dim: int, part_rows: int) -> DataFrame:
    """(key, code, n, home, scores, keys): of each query (key, code, n, least, home, shards), the best rows of each of the shards it goes to."""
    spark = shards.sparkSession
    asked = queries.select("key", "code", "n", "least", "home", F.explode("shards").alias("shard"))
    parts = [(r.shard, -(-r["count"] // part_rows)) for r in asked.groupBy("shard").count().collect()]  # a row a shard
    table = F.broadcast(spark.createDataFrame(parts, "shard int, parts long"))
    part = F.pmod(F.xxhash64("key", "code"), F.col("parts")).cast("int")
    order = ["shard", "part", "asks", "key", "code", "n", "least", "home"]
    copies = shards.join(table, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    left = copies.withColumns({"asks": F.lit(False), "n": F.lit(None).cast("long"), "least": F.lit(None).cast("long"), "home": F.lit(None).cast("int")})
    right = asked.join(table, "shard").withColumns({"part": part, "asks": F.lit(True)})
    rows = left.select(order).unionByName(right.select(order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, tree, keys = None, [], None, []
        for batch in bounded(batches, rows=1024):
            shard, part, asks = (np.asarray(batch.column(i)) for i in range(3))
            cuts = np.flatnonzero((np.diff(shard, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0) | (np.diff(asks.astype("i1"), prepend=-1) != 0)).tolist()
            for a, b in itertools.pairwise([*cuts, batch.num_rows]):
                if (int(shard[a]), int(part[a])) != group:
                    group, held, tree, keys = (int(shard[a]), int(part[a])), [], None, []
                piece = batch.slice(a, b - a)
                codes = piece.column(4).to_pylist()
                if not asks[a]:
                    held.append(unpack(codes, dim))
                    keys += piece.column(3).to_pylist()
                    continue
                if tree is None:
                    tree, held = BallTree(np.concatenate(held)), []
                least = np.array([NO_SCORE if x is None else x for x in piece.column(6).to_pylist()], "i8")
                who, score, row = tree.search(unpack(codes, dim), least, k)
                ends = pa.array(np.searchsorted(who, np.arange(b - a + 1)).astype("i4"))
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(score), pa.array([keys[i] for i in row.tolist()], pa.int64()))]
                yield pa.RecordBatch.from_arrays([piece.column(3), piece.column(4), piece.column(5), piece.column(7), *lists], names=["key", "code", "n", "home", "scores", "keys"])

    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "part")
    ordered = dealt.sortWithinPartitions("shard", "part", "asks", F.asc_nulls_last("key"), "code")
    return ordered.mapInArrow(run, "key long, code binary, n long, home int, scores array<long>, keys array<long>")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int, key: str = "vec_id", vector: str = "embedding", shard_values: int = 1 << 22, part_rows: int = 1 << 14, most_pivots: int = 1024) -> DataFrame:
    """(query_id, rank, <key>, score): of every row of `queries`, itself a row of `vectors`, the k rows of `vectors` but its own with the largest inner products.

    Components x count as floor(scale * x). Ties go to smaller keys, null keys last. Rows whose vector is null, or has null or
    non-finite components, take no part. A shorter vector counts as zero beyond its end. A repeated row is a candidate each time
    but for the query itself, and a query each time. Fewer candidates than k give all. An empty table gives no rows.
    """
    spark, kept = vectors.sparkSession, []
    some = Window.partitionBy("code").orderBy(F.asc_nulls_last("key"))
    rows = stored(cleaned(vectors, key, vector, scale).withColumn("nth", F.row_number().over(some)).filter(F.col("nth") <= k + 1).drop("nth"), kept)
    asked = stored(cleaned(queries, key, vector, scale).groupBy("key", "code").agg(F.count("*").alias("n"), F.max("dim").alias("dim")), kept)
    size = rows.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    if not size.n:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score long")
    n, dim = size.n, max(size.dim, 1)
    most = max(256, shard_values // dim)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(max(-(-n // most), min(n // 256, 2 * tasks), 1), most_pivots)
    sample = rows.select("code").orderBy(F.xxhash64("code"), "code").limit(wanted * (k + 1))
    pivots = list(dict.fromkeys(bytes(r.code) for r in sample.collect()))[:wanted]
    placed = stored(_placed(rows, pivots, dim), kept)
    first, slices, radii, at = [0] * len(pivots), [0] * len(pivots), [-1.0] * len(pivots), 0
    for r in sorted(placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()):
        first[r.pivot], slices[r.pivot], radii[r.pivot] = at, -(-r.n // most), r.far**0.5 * (1 + 1e-9)
        at += slices[r.pivot]
    table = spark.createDataFrame([x for x in zip(range(len(pivots)), first, slices) if x[2]], "pivot int, first int, slices int")
    shards = placed.join(F.broadcast(table), "pivot").select((F.col("first") + F.pmod(F.xxhash64("code"), F.col("slices"))).cast("int").alias("shard"), "key", "code")
    centres, radius, begin, cut = unpack(pivots, dim).astype("f8"), np.array(radii), np.array(first), np.array(slices)

    def bound(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x * x).sum(1))[:, None]
        up = x @ centres.T
        return np.where(cut > 0, up + norm * radius + 1e-9 * (np.abs(up) + norm) + 1e-3, -np.inf)

    def to_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, rows=1024):
            best = bound(unpack(batch.column(1).to_pylist(), dim).astype("f8")).argmax(1)
            home = begin[best] + np.arange(len(best)) % np.maximum(cut[best], 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1).astype("i4")), pa.array(home.astype("i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.nulls(len(best), pa.int64()), pa.array(home.astype("i4")), lists], names=["key", "code", "n", "least", "home", "shards"])

    def to_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, rows=1024):
            up = bound(unpack(batch.column(1).to_pylist(), dim).astype("f8"))
            least = [s[-1] if len(s) == k + 1 else None for s in batch.column(4).to_pylist()]
            fits = up >= np.array([-np.inf if x is None else x for x in least])[:, None]
            lists = [[s for p in np.flatnonzero(f & (cut > 0)).tolist() for s in range(first[p], first[p] + slices[p]) if s != h] for f, h in zip(fits, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(least, pa.int64()), batch.column(3), pa.array(lists, pa.list_(pa.int32()))], names=["key", "code", "n", "least", "home", "shards"])

    routed = "key long, code binary, n long, least long, home int, shards array<int>"
    one = stored(_searched(shards, stored(asked.mapInArrow(to_first, routed), kept), k + 1, dim, part_rows), kept)
    two = _searched(shards, stored(one.select("key", "code", "n", "home", "scores").mapInArrow(to_others, routed), kept), k + 1, dim, part_rows)
    found = stored(one.unionByName(two).select("key", "code", "n", F.explode(F.arrays_zip("scores", "keys")).alias("hit")), kept)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            x = unpack(batch.column(1).to_pylist(), dim)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array((x * x).sum(1)), *batch.columns[3:]], names=["key", "code", "n", "self", "score", "row"])

    hits = found.select("key", "code", "n", F.col("hit.scores").alias("score"), F.col("hit.keys").alias("row")).mapInArrow(own, "key long, code binary, n long, self long, score long, row long")
    ranked = Window.partitionBy("key", "code").orderBy(F.desc("score"), F.asc_nulls_last("row"))
    hits = hits.withColumn("nth", F.row_number().over(ranked)).filter(F.col("nth") <= k + 1)
    mine = (F.col("row").eqNullSafe(F.col("key")) & (F.col("score") == F.col("self"))).cast("int")
    hits = hits.withColumn("seen", F.sum(mine).over(ranked.rowsBetween(Window.unboundedPreceding, 0))).withColumn("mine", mine)
    hits = hits.filter((F.col("mine") == 0) | (F.col("seen") > 1)).withColumn("rank", (F.col("nth") - F.least("seen", F.lit(1))).cast("int")).filter(F.col("rank") <= k)
    out = hits.select("n", F.col("key").alias("query_id"), "rank", F.col("row").alias(key), "score")
    out = stored(out.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n"))
    discard(kept)
    return out


def op11_ball_tree(spark: SparkSession, sf_dir: str, every: int = 50, k: int = 5) -> DataFrame:
    """Each query's 5 highest integer inner products over embeddings: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by 50 (a null vec_id is no query, and comes last among ties); candidates are
    all rows but the query's own. `top_k` says what holds for vectors that are null, broken, short, empty or repeated, and for
    empty tables. vec_id must be a number. Other columns of embeddings are not read.
    """
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k, 256)
