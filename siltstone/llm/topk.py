"""Exact top-k by inner product: best-first search in paged M-trees."""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship

#: Vectors of one tree and entries of one page.
TREE, PAGE = 4096, 64
#: Vectors that the others are gathered around at most, and bytes of them; both bound what is broadcast.
PIVOTS, PIVOT_BYTES = 1024, 8 << 20
#: Bytes of the queries that go through all trees together: one broadcast, one pass.
BLOCK_BYTES = 16 << 20
#: Distances and scores that are held at once.
STEP = 1 << 20
#: Products of components whose sum stays below this are exact in floating point.
EXACT = float(1 << 53)


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component, a whole number as double; null for a vector that is null or holds null, NaN or infinity."""
    x = lambda v: v.cast("double")
    fine = ~F.exists(vector, lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf")))
    # From 2**53 on a double is whole already, and beyond what floor() can give.
    whole = lambda v: F.when(F.abs(x(v)) * 256 < EXACT, F.floor(x(v) * 256).cast("double")).otherwise(x(v) * 256)
    return F.when(fine, F.transform(vector, whole))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of doubles, filled up with zeros to ``dims``."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), sizes)
    out[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def narrow(vectors: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that has them all."""
    most = float(np.abs(vectors).max()) if vectors.size else 0.0
    kind = next((k for k, top in ((np.int8, 127), (np.int16, 32767), (np.int32, 2**31 - 1)) if most <= top), np.float64)
    return vectors.astype(kind)


def lift(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component that gives all of them the squared norm ``top``.

    Then the inner product with a query falls as the Euclidean distance to it grows.
    """
    return np.concatenate((vectors, np.sqrt(np.maximum(top - (vectors * vectors).sum(1), 0.0))[:, None]), 1)


def away(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    gap = points - pivot
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: floating point as far as it is exact, else Python's integers."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1) < EXACT:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    return whole(a) @ whole(b).T


class Queries:
    """Queries that are searched together, with the ``k`` best that each has found so far.

    ``floor`` is a score that a query's k-th best is known to reach. ``best`` and ``ids`` are in order, best
    first; a place that is still empty has the score minus infinity.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, top: float, k: int):
        self.id, self.v, self.floor, self.top, self.k = ids, vectors, floor, top, k
        self.point = np.concatenate((vectors, np.zeros((len(ids), 1))), 1)
        self.norm = (vectors * vectors).sum(1)
        self.slack = 1e-6 * (1 + np.sqrt(top + self.norm))
        self.best = np.full((len(ids), k), -np.inf)
        self.ids = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.scored = 0

    def wide(self) -> None:
        if self.best.dtype != object:
            self.best = self.best.astype(object)

    def least(self, who: np.ndarray) -> np.ndarray:
        """The score that a vector must reach to matter to each of these queries."""
        return np.maximum(self.floor[who], self.best[who, -1].astype(np.float64))

    def reach(self, who: np.ndarray) -> np.ndarray:
        """The distance beyond which nothing matters to each of these queries."""
        least, both = self.least(who), self.norm[who] + self.top
        room = np.where(np.isfinite(least), both - 2 * least + 1e-9 * (1 + both), np.inf)
        return np.sqrt(np.maximum(room, 0.0)) + self.slack[who]

    def offer(self, who: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Scores vectors for these queries and keeps the best, ties to smaller ids; none of a query's own id."""
        for at in range(0, len(who), max(1, STEP // max(len(ids), 1))):
            w = who[at : at + max(1, STEP // max(len(ids), 1))]
            score = products(self.v[w], vectors)
            self.scored += score.size
            if score.dtype == object:
                self.wide()
            hit = (score >= self.least(w)[:, None]) & (ids[None, :] != self.id[w][:, None])
            some = np.flatnonzero(hit.any(1))
            if not len(some):
                continue
            w, score, hit = w[some], score[some], hit[some]
            none = -np.inf if score.dtype != object else float("-inf")
            score = np.concatenate((self.best[w], np.where(hit, score, none)), 1)
            names = np.concatenate((self.ids[w], np.where(hit, ids[None, :], np.iinfo(np.int64).max)), 1)
            if score.dtype == object:
                order = np.array([sorted(range(len(s)), key=lambda j, s=s, n=n: (-s[j], n[j]))[: self.k] for s, n in zip(score, names.tolist(), strict=True)])
            else:
                order = np.lexsort((names, -score), axis=1)[:, : self.k]
            self.best[w], self.ids[w] = np.take_along_axis(score, order, 1), np.take_along_axis(names, order, 1)

    def found(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(query row, id, score) of what was found and reaches the floor."""
        who, rank = np.nonzero((self.best >= self.floor[:, None]) & (self.ids != np.iinfo(np.int64).max))
        score = [int(s) for s in self.best[who, rank].tolist()]
        if any(abs(s) >= 1 << 63 for s in score):
            raise OverflowError("an inner product is beyond a long")
        return who, self.ids[who, rank], score


class Tree:
    """An M-tree over vectors, all lifted to the squared norm ``top``.

    A page has a pivot, a covering radius and, for each entry, the distance to the pivot; entries of an
    inner page are pages, entries of a leaf are vectors. ``ids`` and ``vectors`` are in the order of the leaves.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float):
        self.points = lift(vectors, top)
        # A page: (first row of a leaf or -1, pivot, distance of each entry, child pages, radius).
        self.pages: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, float]] = []
        leaves: list[np.ndarray] = []
        self.at = 0
        self.build(np.arange(len(ids)), leaves)
        rows = np.concatenate(leaves)
        self.ids, self.vectors = ids[rows], narrow(vectors[rows])
        del self.points

    def build(self, rows: np.ndarray, leaves: list[np.ndarray]) -> int:
        """Adds the page of these rows and all below it; gives its number."""
        pts = self.points[rows]
        pivot = pts.mean(0) if len(rows) else np.zeros(self.points.shape[1])
        own = away(pts, pivot)
        me = len(self.pages)
        self.pages.append(None)  # type: ignore[arg-type]
        if len(rows) <= PAGE:
            leaves.append(rows)
            self.pages[me] = (self.at, pivot, own, np.zeros(0, np.int64), float(own.max(initial=0.0)))
            self.at += len(rows)
            return me
        seeds = np.unique(pts[np.linspace(0, len(rows) - 1, min(PAGE, -(-len(rows) // (PAGE // 2)))).astype(int)], axis=0)
        near = ((seeds**2).sum(1) - 2 * pts @ seeds.T).argmin(1)
        groups = [g for j in range(len(seeds)) if len(g := np.flatnonzero(near == j))]
        if max(map(len, groups)) > len(rows) // 2:  # equal or crowded vectors: even parts, whose radii show it
            groups = np.array_split(np.lexsort((np.arange(len(rows)), near)), -(-len(rows) // PAGE))
        kids = [self.build(rows[g], leaves) for g in groups]
        reach = np.array([away(self.pages[c][1][None], pivot)[0] for c in kids])
        self.pages[me] = (-1, pivot, reach, np.array(kids), float(own.max()))
        return me

    def search(self, q: Queries, who: np.ndarray) -> None:
        """Offers the queries ``who`` all vectors that may be among their best.

        Pages are opened in the order of the least distance that a query may have to what they hold. With a
        page go the queries it may matter to; when its turn comes, those it no longer matters to drop out.
        A distance to an entry is computed only if the triangle inequality over the entry's stored distance
        to the page's pivot leaves it a chance.
        """
        far = away(q.point[who], self.pages[0][1])
        least = np.maximum(far - self.pages[0][4], 0.0)
        queue = [(float(least.min(initial=np.inf)), 0, who, far, least)] if len(who) else []
        while queue:
            _, page, who, far, least = heapq.heappop(queue)
            reach = q.reach(who)
            fit = least <= reach
            who, far, reach = who[fit], far[fit], reach[fit]
            if not len(who):
                continue
            at, _, own, kids, _ = self.pages[page]
            if at >= 0:
                near = np.concatenate([np.abs(far[i : i + 4096, None] - own) <= reach[i : i + 4096, None] for i in range(0, len(who), 4096)])
                rows, some = np.flatnonzero(near.any(0)), near.any(1)
                q.offer(who[some], self.ids[at + rows], self.vectors[at + rows].astype(np.float64))
                continue
            for child, gap in zip(kids.tolist(), own.tolist(), strict=True):
                _, pivot, _, _, radius = self.pages[child]
                maybe = np.flatnonzero(np.abs(far - gap) - radius <= reach)
                if len(maybe):
                    d = away(q.point[who[maybe]], pivot)
                    low = np.maximum(d - radius, 0.0)
                    fit = low <= reach[maybe]
                    if fit.any():
                        heapq.heappush(queue, (float(low[fit].min()), child, who[maybe[fit]], d[fit], low[fit]))

    def to_bytes(self) -> bytes:
        """The tree as pages of arrays, readable without pickle."""
        out = io.BytesIO()
        np.savez(
            out, ids=self.ids, vectors=self.vectors, sizes=np.array([[p[0], len(p[2]), len(p[3])] for p in self.pages], np.int64), pivots=np.array([p[1] for p in self.pages]),
            radii=np.array([p[4] for p in self.pages]), own=np.concatenate([p[2] for p in self.pages]), kids=np.concatenate([p[3] for p in self.pages]),
        )
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        self, z = cls.__new__(cls), np.load(io.BytesIO(data))
        self.ids, self.vectors = z["ids"], z["vectors"]
        self.pages, o, c = [], 0, 0
        own, kids = z["own"], z["kids"].astype(np.int64)
        for (at, n, m), pivot, radius in zip(z["sizes"].tolist(), z["pivots"], z["radii"].tolist(), strict=True):
            self.pages.append((at, pivot, own[o : o + n], kids[c : c + m], radius))
            o, c = o + n, c + m
        return self


def forest(rows: DataFrame, dims: int, top: float, n: int, k: int, every: int) -> DataFrame:
    """Trees over rows (vec_id, v): one row (tree, data, asked, floor) each, kept in the shared folder.

    Every vector goes to the nearest of some sampled pivots; the rows are range-sorted by pivot and
    distance to it and cut into trees of at most TREE, so a tree holds a ring around one pivot, and a
    pivot with a third of all rows is many rings over many tasks. Each tree is searched for the
    queries it holds itself at once: ``asked`` are their rows in the tree, ``floor`` the k-th best scores.
    """
    spark = rows.sparkSession
    many = max(1, min(PIVOTS, -(-n // TREE), PIVOT_BYTES // (8 * (dims + 1))))
    drawn = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(many).toArrow()
    pivots = lift(matrix(drawn.column("v").combine_chunks(), dims), top)
    sent = spark.sparkContext.broadcast((pivots, (pivots**2).sum(1)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, norm = sent.value
        for b in batches:
            points = lift(matrix(b.column("v"), dims), top)
            near = np.concatenate([(norm - 2 * points[i : i + 512] @ at.T).argmin(1) for i in range(0, len(points), 512)] or [np.zeros(0, np.int64)])
            gap = points - at[near]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int64()), pa.array(np.sqrt((gap * gap).sum(1)))], names=["vec_id", "v", "pivot", "away"])

    ranged = ["pivot", "away", "vec_id"]
    placed = rows.mapInArrow(place, "vec_id long, v array<double>, pivot long, away double")
    parts = max(1, min(-(-n // TREE), max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * dims * 8 >> 25)))
    placed = cut(placed).repartitionByRange(parts, *ranged).sortWithinPartitions(*ranged)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows, now = 0, None

        def made(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            tree = Tree(t.column("vec_id").to_numpy(), matrix(t.column("v").combine_chunks(), dims), top)
            own = np.flatnonzero(tree.ids % every == 0)
            q = Queries(tree.ids[own], tree.vectors[own].astype(np.float64), np.full(len(own), -np.inf), top, k)
            tree.search(q, np.arange(len(own)))
            floor = q.best[:, -1].astype(np.float64)
            return pa.RecordBatch.from_arrays([pa.array([tree.to_bytes()], pa.binary()), pa.array([own.tolist()], pa.list_(pa.int32())), pa.array([np.nextafter(floor, -np.inf).tolist()], pa.list_(pa.float64()))], names=["data", "asked", "floor"])

        for b in batches:
            pivot = b.column("pivot").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for i, j in zip(edges, edges[1:], strict=False):
                if pivot[i] != now and rows:
                    yield made(pa.concat_tables(held))
                    held, rows = [], 0
                now = pivot[i]
                held.append(pa.Table.from_batches([b.slice(i, j - i)]).select(["vec_id", "v"]))
                rows += j - i
                if rows >= TREE:
                    t = pa.concat_tables(held)
                    for at in range(0, rows - TREE + 1, TREE):
                        yield made(t.slice(at, TREE))
                    held, rows = [t.slice(rows // TREE * TREE)], rows % TREE
        if rows:
            yield made(pa.concat_tables(held))

    return cut(placed.mapInArrow(grow, "data binary, asked array<int>, floor array<double>"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its ``k`` best others.

    The score is the inner product of the components turned to floor(256 * x), exact however large they
    are. The vectors become a forest of M-trees, each around one of some pivots (see ``forest``), which
    also gives every query a score that its k-th best is sure to reach. Then blocks of queries of bounded
    bytes pass through all trees: a block is broadcast, each task takes its trees one after the other, and what
    a query has found in one tree, like the score it is sure of, spares it pages and whole trees later. So
    vectors are shuffled once, and a task gives at most k rows a query, only those that may be among the
    best. The search is exact; how much it skips depends on how far the vectors cluster.

    Vectors that are null or hold null, NaN or infinite components take no part, nor do rows without id.
    Equal rows count as often as they occur, as candidates and as queries; rows of a query's own id are no
    candidates of it. Ties go to smaller ids. Shorter vectors count as filled up with zeros. Fewer than k
    others give fewer rows; an empty table gives none. A score beyond a long is an OverflowError.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = cut(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(vector)).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, dims, top = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    schema = "query_id long, vec_id long, score long"
    if not np.isfinite(top):
        raise OverflowError("an inner product is beyond a long")
    trees = forest(rows, dims, top, n, k, every)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, own, floor in zip(b.column("data"), b.column("asked"), b.column("floor"), strict=True):
                if len(own.values):
                    tree, at = Tree.from_bytes(data.as_py()), own.values.to_numpy()
                    v = pa.array(tree.vectors[at].astype(np.float64).tolist(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(tree.ids[at]), v, floor.values], names=["id", "v", "floor"])

    queries = cut(trees.mapInArrow(asked, "id long, v array<double>, floor double"))
    blocks = max(1, -(-queries.count() * 8 * (dims + 3) // BLOCK_BYTES))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))

    def find(block: int) -> DataFrame:
        t = queries.where(F.col("block") == block).orderBy("id", "v").toArrow()
        v = t.column("v").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.float64()))
        sent = spark.sparkContext.broadcast((t.column("id").to_numpy(), matrix(v, dims), t.column("floor").to_numpy()))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, v, floor = sent.value
            q = Queries(ids, v, floor, top, k)
            for b in batches:
                for data in b.column("data"):
                    Tree.from_bytes(data.as_py()).search(q, np.arange(len(ids)))
            who, names, score = q.found()
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(names), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

        found = trees.select("data").mapInArrow(search, schema)
        if blocks > 1:  # block by block, so that one broadcast is held at a time
            found = cut(found)
            sent.unpersist()
        return found

    out = find(0)
    for b in range(1, blocks):
        out = out.union(find(b))
    # Spark keeps k rows a query in each task before the shuffle, so trees add no more than that.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
