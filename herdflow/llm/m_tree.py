"""Exact top-k inner products by M-trees searched best first.

A vector is read as whole numbers, ``floor(1024 * x)`` of each component. One
more coordinate, ``sqrt(M * M - |x|^2)`` with ``M`` the longest vector's length
(zero for a query), turns the largest inner product into the least Euclidean
distance: ``d^2 = |q|^2 + M^2 - 2 q.x``. Over that metric every index task bulk
loads M-trees: pages of entries, each routing entry with its covering radius and
its distance to the parent's routing object, each leaf entry with its distance to
the leaf's. A query takes pages from a queue by their least possible distance and
ends when that exceeds its k-th best; before a distance is computed, the stored
parent distances decide by the triangle inequality whether it can matter. Pages
are skipped with a margin for rounding, so ties are always compared; scores are
exact whole numbers.

Equal vectors are one entry with their ``k + 1`` smallest ids (no other copy can
be among k results that leave the query's own row out). Rows are dealt to the
nearest of a bounded, deterministic sample of vectors, and by hash within such a
cell, so a crowded cell becomes many trees. Queries are the distinct query
vectors in bounded blocks; a block first meets the trees of its own cells, whose
k-th best scores are the floors for all other trees.

Defined results: null vectors and vectors with a null, NaN or infinite component
take no part, neither as queries nor as rows; a shorter vector counts as filled up
with zeros; rows with the query's id are its own and no candidates; of several
vectors with one query id the least in array order is the query; a null id is
never a query and sorts last among ties; components and scores
saturate at 2^63 - 1 and its negative; empty tables give no rows. Only the id and vector columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdflow.operators.joins import materialize

K = 10
SCALE = 1024
PAGE = 256           # entries of a leaf page
FANOUT = 64          # routing entries of an inner page
TREE_ROWS = 8192     # entries of one tree
CELL_ROWS = 8192     # entries per cell aimed at
MAX_CELLS = 1024     # sampled cell centres at most
QUERY_BLOCK = 4096   # distinct query vectors searched at once
SALTS = 8
LAST = np.iinfo(np.int64).max
EXACT = 2 ** 53      # sums below this are exact in doubles


def whole_vector(vector: Column) -> Column:
    """``floor(1024 * x)`` of each component as longs; null for vectors that take no part."""
    doubles = vector.cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = F.lit(float(2 ** 63 - 1024))
    whole = F.transform(doubles, lambda x: F.floor(F.greatest(F.least(x * F.lit(float(SCALE)), top), -top)))
    return F.when(~F.coalesce(bad, F.lit(True)), whole)


class Tree:
    """An M-tree over the rows of ``vectors`` (whole numbers); ``first`` are the
    rows' ids for ties, ``longest`` is the square of M."""

    def __init__(self, vectors: np.ndarray, first: np.ndarray, longest: float):
        self.vectors, self.first = vectors, first
        self.square = np.einsum("ij,ij->i", vectors, vectors)
        self.extra = np.sqrt(np.maximum(longest - self.square, 0.0))
        self.longest = longest
        self.order = np.arange(len(vectors))
        self.to_parent = np.zeros(len(vectors))
        # Nodes: routing row, covering radius, distance to the parent's routing
        # row, children [a, b) (nodes, or rows for a leaf).
        self.nodes: list[tuple[int, float, float, bool, int, int]] = []
        self._load()
        # Rows are kept in page order, so that a page is one stretch of them.
        self.vectors, self.first = vectors[self.order], first[self.order]
        self.centre = np.argsort(self.order)[[n[0] for n in self.nodes]]
        self.radius = np.array([n[1] for n in self.nodes])
        self.parent = np.array([n[2] for n in self.nodes])

    def _distances(self, rows: np.ndarray, centre: int) -> np.ndarray:
        gap = self.square[rows] + self.square[centre] - 2 * (self.vectors[rows] @ self.vectors[centre])
        return np.sqrt(np.maximum(gap + (self.extra[rows] - self.extra[centre]) ** 2, 0.0))

    def _load(self) -> None:
        """Bulk load from the root: the rows of a subtree go to the nearest of up to
        FANOUT routing objects."""
        self.nodes.append((0, 0.0, 0.0, True, 0, len(self.order)))
        waiting = [0]
        while waiting:
            at = waiting.pop()
            centre, _, parent, _, a, b = self.nodes[at]
            rows = self.order[a:b]
            far = self._distances(rows, centre)
            radius = float(far.max(initial=0.0))
            if b - a <= PAGE or radius == 0.0:
                by = np.argsort(far, kind="stable")
                self.order[a:b], self.to_parent[a:b] = rows[by], far[by]
                self.nodes[at] = (centre, radius, parent, True, a, b)
                continue
            # Routing objects at even steps of the distance to the parent's.
            steps = np.linspace(0, b - a - 1, min(FANOUT, -(-(b - a) // PAGE))).astype(int)
            centres = rows[np.argsort(far, kind="stable")[steps]].tolist()
            gaps = [self._distances(rows, c) for c in centres]
            near = np.argmin(gaps, axis=0)
            if near.min() == near.max():  # nothing left to tell rows apart by
                self.order[a:b], self.to_parent[a:b] = rows[np.argsort(far, kind="stable")], np.sort(far)
                self.nodes[at] = (centre, radius, parent, True, a, b)
                continue
            by = np.argsort(near, kind="stable")
            self.order[a:b] = rows[by]
            ends = a + np.searchsorted(near[by], np.arange(len(centres) + 1))
            self.nodes[at] = (centre, radius, parent, False, len(self.nodes), len(self.nodes) + len(centres))
            for i, other in enumerate(centres):
                waiting.append(len(self.nodes))
                gap = float(self._distances(np.array([other]), centre)[0])
                self.nodes.append((other, 0.0, gap, True, int(ends[i]), int(ends[i + 1])))

    def search(self, query: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best rows of score ``floor`` or more by (score, first id), their
        scores, and how many distances were computed. Rows are places in page order."""
        square = float(query @ query)
        margin = 1e-6 * (1.0 + np.sqrt(self.longest + square))

        def distance(scores):
            return np.sqrt(np.maximum(square + self.longest - 2.0 * scores, 0.0))

        limit = float(distance(floor)) + margin if np.isfinite(floor) else np.inf
        rows, scores, weakest = np.empty(0, np.int64), np.empty(0), floor
        root = float(distance(self.vectors[self.centre[0]] @ query))
        queue = [(root - self.radius[0], 0, root)]
        computed = 1
        while queue:
            bound, at, gap = heapq.heappop(queue)
            if bound > limit:
                break
            _, _, _, leaf, a, b = self.nodes[at]
            if leaf:
                # Sorted by distance to the routing object: the triangle
                # inequality leaves one stretch of the page.
                lo, hi = a, b
                if gap > limit or gap + limit < self.radius[at]:
                    lo, hi = a + self.to_parent[a:b].searchsorted((gap - limit, gap + limit + margin))
                    if lo == hi:
                        continue
                score = self.vectors[lo:hi] @ query
                computed += int(hi - lo)
                if score.max() < weakest:
                    continue
                good = np.flatnonzero(score >= weakest)
                rows, scores = np.r_[rows, lo + good], np.r_[scores, score[good]]
                best = np.lexsort((self.first[rows], -scores))[:k]
                rows, scores = rows[best], scores[best]
                if len(scores) == k:
                    weakest = max(weakest, scores[-1])
                    limit = min(limit, float(distance(weakest)) + margin)
            else:
                child = np.arange(a, b)
                child = child[np.abs(gap - self.parent[a:b]) - self.radius[a:b] <= limit + margin]
                gaps = distance(self.vectors[self.centre[child]] @ query)
                computed += len(child)
                bounds = gaps - self.radius[child]
                for i in np.flatnonzero(bounds <= limit):
                    heapq.heappush(queue, (float(bounds[i]), int(child[i]), float(gaps[i])))
        return rows, scores, computed


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """List column -> whole-number matrix, shorter rows filled up with zeros."""
    starts = column.offsets.to_numpy()
    flat = column.values.to_numpy()[starts[0]:starts[-1]]
    many = np.diff(starts)
    if len(flat) == len(column) * width:
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), many), np.concatenate([np.arange(m) for m in many] or [many])] = flat
    return out


def _spaced(width: int, largest: int) -> bool:
    """Whether inner products of such vectors are exact in doubles."""
    return width * largest * largest < EXACT


def _with_cell(entries: DataFrame, centres: np.ndarray, width: int) -> DataFrame:
    """Each entry's nearest centre."""
    shared = entries.sparkSession.sparkContext.broadcast(centres.astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        half = np.einsum("ij,ij->i", centres, centres) / 2
        for batch in batches:
            x = _matrix(batch.column(0), width).astype(float)
            cell = np.argmax(x @ centres.T - half, axis=1).astype(np.int32) if len(x) else np.empty(0, np.int32)
            yield batch.append_column("cell", pa.array(cell))

    return entries.mapInArrow(run, "v array<long>, ids array<long>, cell int")


def _index(entries: DataFrame, width: int, longest: float) -> DataFrame:
    """Trees of at most TREE_ROWS entries of one cell, one row each."""
    def tree(cell: int, batch: pa.Table) -> pa.RecordBatch:
        vectors = _matrix(batch.column("v").combine_chunks(), width)
        ids = batch.column("ids").combine_chunks()
        starts = ids.offsets.to_numpy()
        flat = ids.values.slice(starts[0], starts[-1] - starts[0])
        first = flat.fill_null(LAST).to_numpy(zero_copy_only=False)[starts[:-1] - starts[0]]
        t = Tree(vectors.astype(float), first, longest)
        nodes = np.column_stack([np.array(t.nodes, float)[:, 1:], t.centre])
        cols = [pa.array([cell], pa.int32()), pa.array([len(vectors)], pa.int32())]
        cols += [pa.array([x.tobytes()], pa.binary()) for x in (vectors[t.order], t.to_parent, nodes)]
        cols.append(pa.array([ids.take(pa.array(t.order)).to_pylist()], pa.list_(pa.list_(pa.int64()))))
        return pa.record_batch(cols, names=["cell", "n", "vectors", "to_parent", "nodes", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, rows = None, [], 0
        for batch in batches:
            cells = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1), len(cells)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                while a < b:
                    if held and (cells[a] != cell or rows == TREE_ROWS):
                        yield tree(cell, pa.Table.from_batches(held))
                        held, rows = [], 0
                    cell, take = int(cells[a]), min(b - a, TREE_ROWS - (rows if held else 0))
                    held.append(batch.slice(a, take))
                    rows += take
                    a += take
        if held:
            yield tree(cell, pa.Table.from_batches(held))

    dealt = entries.repartitionByRange("cell", F.xxhash64("v")).sortWithinPartitions("cell")
    schema = "cell int, n int, vectors binary, to_parent binary, nodes binary, ids array<array<long>>"
    return materialize(dealt.mapInArrow(run, schema), "m-trees")


def _opened(row: dict, width: int, longest: float) -> Tree:
    """The tree of an index row."""
    t = Tree.__new__(Tree)
    t.vectors = np.frombuffer(row["vectors"], np.int64).reshape(row["n"], width).astype(float)
    t.first = np.array([LAST if i[0] is None else i[0] for i in row["ids"]], np.int64)
    t.to_parent = np.frombuffer(row["to_parent"])
    nodes = np.frombuffer(row["nodes"]).reshape(-1, 6)
    t.nodes = [(int(c), r, p, bool(leaf), int(a), int(b)) for r, p, leaf, a, b, c in nodes]
    t.centre, t.radius, t.parent = nodes[:, 5].astype(int), nodes[:, 0], nodes[:, 1]
    t.longest = longest
    return t


def _by_brute_force(vectors: np.ndarray, first: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
    """For components too large for exact doubles: whole numbers of any length."""
    scores = [min(max(int(s), -LAST), LAST) for s in vectors.astype(object) @ query.astype(object)]
    rows = sorted(range(len(scores)), key=lambda r: (-scores[r], first[r]))[:k]
    return np.array(rows, int), [scores[r] for r in rows]


def _search(trees: DataFrame, block, own: bool, k: int, width: int, longest: float, exact: bool) -> DataFrame:
    """The k best entries of each query of a block in each task's trees: those of
    the query's own cell, or all others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, cells, floors = block.value
        best: dict[int, list] = {}
        floors = floors.copy()
        for batch in batches:
            for row in batch.to_pylist():
                t = _opened(row, width, longest)
                whole = np.frombuffer(row["vectors"], np.int64).reshape(row["n"], width)
                for q in np.flatnonzero((cells == row["cell"]) == own):
                    if exact:
                        rows, scores, _ = t.search(queries[q].astype(float), k, floors[q])
                    else:
                        rows, scores = _by_brute_force(whole, t.first, queries[q], k)
                    kept = [(-int(s), int(t.first[r]), row["ids"][r]) for r, s in zip(rows, scores, strict=True)
                            if s >= floors[q]]
                    if kept:
                        best[q] = sorted(best.get(q, []) + kept, key=lambda x: x[:2])[:k]
                        if len(best[q]) == k:
                            floors[q] = -best[q][-1][0]
        hits = [(q, -s, ids) for q, found in best.items() for s, _, ids in found]
        if hits:
            q, s, ids = zip(*hits, strict=True)
            yield pa.record_batch([pa.array(q, pa.int32()), pa.array(s, pa.int64()),
                                   pa.array(ids, pa.list_(pa.int64()))], names=["q", "score", "ids"])

    mine = trees.filter(F.col("cell").isin(sorted({int(c) for c in block.value[1]}))) if own else trees
    return materialize(mine.mapInArrow(run, "q int, score long, ids array<long>"), "hits")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last(F.col("ids")[0]))
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def top_inner_products(rows: DataFrame, *, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
                       query_modulus: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of every row whose id
    is divisible by ``query_modulus``."""
    spark = rows.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    held = materialize(rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_vector(F.col(f"`{vector_col}`"))
                                   .alias("v")).filter(F.col("v").isNotNull()), "vectors")
    largest = F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0))
    lengths = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, width, largest, longest = held.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(largest), F.max(lengths)).first()
    if not n:
        return spark.createDataFrame([], result)
    width, keep = max(1, width), k + 1

    # Copies: the k + 1 smallest ids of each vector, cut before the shuffle too.
    order = Window.partitionBy("v").orderBy(F.asc_nulls_last("id"))
    few = held.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
    entries = materialize(few.groupBy("v").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))),
                                                           lambda x: x["id"]).alias("ids")), "entries")
    many = entries.count()
    cells = min(MAX_CELLS, max(1, many // CELL_ROWS))
    spread = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(cells).collect()
    centres = np.zeros((len(spread), width), np.int64)
    for i, r in enumerate(spread):
        centres[i, :len(r.v)] = r.v
    trees = _index(_with_cell(entries, centres, width), width, longest)

    asked = held.filter(F.pmod("id", F.lit(query_modulus)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = materialize(asked, "queries")
    distinct = materialize(_with_cell(asked.select("v").distinct().withColumn("ids", F.array().cast("array<long>")),
                                      centres, width).select("v", "cell"), "query-vectors")
    total = distinct.count()
    blocks = -(-total // QUERY_BLOCK)
    part = F.pmod(F.xxhash64("v"), F.lit(max(1, blocks)))
    answers = None
    for block in range(blocks):
        mine = sorted((r.cell, r.v) for r in distinct.filter(part == block).collect())
        queries = np.zeros((len(mine), width), np.int64)
        for i, (_, v) in enumerate(mine):
            queries[i, :len(v)] = v
        at = np.array([c for c, _ in mine])
        found = []
        floors = np.full(len(mine), -np.inf)
        for own in (True, False):
            shared = spark.sparkContext.broadcast((queries, at, floors))
            found.append(_search(trees, shared, own, keep, width, longest, _spaced(width, largest)))
            if own:
                for r in _best(found[0], keep).filter(F.col("place") == keep).collect():
                    floors[r.q] = r.score
        hits = _best(found[0].unionByName(found[1]), keep).groupBy("q").agg(
            F.collect_list(F.struct("score", "ids")).alias("hits"))
        names = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(mine)], "q int, v array<long>")
        block_answers = materialize(names.join(hits, "q").select("v", "hits"), "answers")
        answers = block_answers if answers is None else answers.unionByName(block_answers)
    if answers is None:
        return spark.createDataFrame([], result)

    # Many queries may share a vector: both sides are salted.
    salted = answers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own_salt = asked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    both = own_salt.join(salted, ["v", "salt"])
    each = F.flatten(F.transform("hits", lambda h: F.transform(h["ids"], lambda i: F.struct(
        (-h["score"]).alias("down"), i.isNull().alias("nameless"), i.alias("vec_id"), h["score"].alias("score")))))
    others = F.filter(each, lambda x: ~x["vec_id"].eqNullSafe(F.col("id")))
    ranked = both.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.sort_array(others), 1, k)).alias("p", "x"))
    return ranked.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"),
                         F.col("x.score").alias("score"))
