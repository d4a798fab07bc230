"""Ranked lexical search of all documents for a set of items, by dual-tree search.

Terms are maximal runs of digits, letters A-Z (lower-cased) and every character
beyond ASCII. A document is a sparse vector: per term the integer that the term
adds to a score. An item is a vector of ones on its terms, so a score is their
inner product. Both sides are hierarchies whose nodes hold coordinate maxima
(for items: the union of the terms). The product of two nodes' maxima bounds the
score of every pair below them, so a pair of nodes is dropped as soon as that
bound is less than the weakest k-th best score among the node's items. Equal
bounds are kept: the ranking stays exact, ties included.

Items are taken in blocks of a bounded number of (item, term) pairs, one pass
over the documents a block. The documents of a block are searched in two waves,
each document once: a first share by hash, whose k-th best scores are the floors
from which every task of the second wave starts. So tasks of the second wave drop
whole batches at the root and return few rows, however many tasks there are.

Defined results: a null or empty text has no terms and is never found; rows that
share an ``item_id`` are one item with the terms of all of them; every document
row counts as a document, repeated rows too; a null ``doc_id`` sorts last among
equal scores; an item without a term in any document gives no row; empty tables
give none. Only the id and text columns are read, whatever others are called.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from herdflow.operators.joins import materialize

K = 50
BLOCK_PAIRS = 200_000
ITEM_FAN, DOC_FAN, LEAF_DOCS, BATCH_DOCS = 8, 8, 8, 4096
FIRST_WAVE = 16  # the first wave is one document in so many
SLICE = 1 << 22
LAST = np.iinfo(np.int64).max

# Bytes of a term: ASCII digits, letters (upper case lowered), every byte of a
# character beyond ASCII. All others separate.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))


def term_counts(text: str) -> Counter:
    """Occurrences of each term (UTF-8) of a text; long texts go in slices, so
    that never more than a slice's terms are held besides the counts."""
    data = text.encode().translate(_TERM_BYTES)
    if len(data) <= SLICE:
        return Counter(data.split())
    counts: Counter = Counter()
    start = 0
    while start < len(data):
        end = data.find(b" ", start + SLICE)
        end = len(data) if end < 0 else end
        counts.update(data[start:end].split())
        start = end
    return counts


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (item_id, term) of all items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(term_counts(text or ""))
                ids += [i] * len(found)
                terms += found
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])

    picked = items.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    return materialize(picked.mapInArrow(run, "item_id long, term binary").distinct(), "item-terms")


def alike(row: np.ndarray, term: np.ndarray, n: int, enough: int) -> np.ndarray:
    """An order of ``n`` rows that keeps rows with common terms together: parts of
    more than ``enough`` rows are halved again and again, each by the term that
    splits it most evenly. ``row`` and ``term`` are the pairs of the rows' terms."""
    part = np.zeros(n, np.int64)
    width = int(term.max(initial=0)) + 1
    while True:
        size = np.bincount(part)
        large = size[part[row]] > enough
        pair, count = np.unique(part[row[large]] * width + term[large], return_counts=True)
        of = pair // width
        even = np.minimum(count, size[of] - count)
        order = np.lexsort((-even, of))
        lead = order[np.r_[True, of[order][1:] != of[order][:-1]]] if len(order) else order
        lead = lead[even[lead] > 0]
        if not len(lead):
            return np.argsort(part, kind="stable")
        split = np.full(len(size), -1, np.int64)
        split[of[lead]] = pair[lead] % width
        has = np.zeros(n, bool)
        has[row[split[part[row]] == term]] = True
        part = np.unique(2 * part + ~has, return_inverse=True)[1]


class ItemTree:
    """Hierarchy over a block of items: ``post[l]`` lists, for every term, the
    level's nodes whose union of terms has it; level 0 are the items."""

    def __init__(self, pairs: list[tuple[object, bytes]]):
        by_item: dict[object, set[bytes]] = {}
        for item, term in pairs:
            by_item.setdefault(item, set()).add(term)
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for _, t in pairs}))}
        everyone = sorted(by_item, key=lambda i: (i is None, i))
        n = len(everyone)
        row = np.repeat(np.arange(n), [len(by_item[i]) for i in everyone])
        term = np.array([self.vocabulary[t] for i in everyone for t in by_item[i]], np.int64)
        order = alike(row, term, n, ITEM_FAN)
        self.ids = [everyone[i] for i in order]
        node = np.argsort(order)[row]
        self.sizes, self.post = [], []
        while True:
            both = np.unique(term * n + node)
            term, node = both // n, both % n
            starts = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
            self.sizes.append(n)
            self.post.append((starts, node))
            if n == 1:
                return
            node, n = node // ITEM_FAN, -(-n // ITEM_FAN)

    def products(self, level: int, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n_rows: int) -> np.ndarray:
        """Inner products of sparse rows with every node of a level (exact)."""
        starts, nodes = self.post[level]
        many = starts[terms + 1] - starts[terms]
        ends = np.cumsum(many)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[terms] - (ends - many), many)
        out = np.zeros(n_rows * self.sizes[level], np.int64)
        np.add.at(out, np.repeat(rows * self.sizes[level], many) + nodes[at], np.repeat(values, many))
        return out.reshape(n_rows, self.sizes[level])


class DocTree:
    """Hierarchy over a batch of documents; every level holds its nodes' rows
    (term, largest value) one after the other."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, values: np.ndarray):
        n = len(ids)
        doc = np.repeat(np.arange(n), np.diff(starts))
        order = alike(doc, terms, n, LEAF_DOCS)
        self.ids = ids[order]
        node = np.argsort(order)[doc]
        self.levels = []
        fan = 1
        while True:
            n = -(-n // fan)
            node = node // fan
            by = np.lexsort((terms, node))
            node, terms, values = node[by], terms[by], values[by]
            new = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (terms[1:] != terms[:-1])])
            node, terms, values = node[new], terms[new], np.maximum.reduceat(values, new)
            self.levels.append((n, np.searchsorted(node, np.arange(n + 1)), terms, values))
            if n == 1:
                return
            fan = LEAF_DOCS if len(self.levels) == 1 else DOC_FAN

    def children(self, level: int, node: int) -> tuple[int, int]:
        """First and end of a node's children on the level below."""
        fan = LEAF_DOCS if level == 1 else DOC_FAN
        return node * fan, min((node + 1) * fan, self.levels[level - 1][0])


class Search:
    """k best documents of every item of a tree, over any number of batches."""

    def __init__(self, tree: ItemTree, floor: np.ndarray, k: int):
        self.tree, self.k = tree, k
        self.floor = floor
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in tree.ids]
        self.compared = 0
        self.weak = [floor.copy()]
        for n in tree.sizes[1:]:
            self.weak.append(np.empty(n, np.int64))
        self._lift()

    def _lift(self) -> None:
        for level in range(1, len(self.weak)):
            below = self.weak[level - 1]
            self.weak[level] = np.minimum.reduceat(below, np.arange(0, len(below), ITEM_FAN))

    def add(self, docs: DocTree) -> None:
        """Search a batch: best first by the pair bounds, both trees descended together."""
        top_doc, top_item = len(docs.levels) - 1, len(self.tree.sizes) - 1
        alive = np.zeros(self.tree.sizes[top_item], bool)
        alive[:] = True
        heap = [(-LAST, 0, top_doc, 0, top_item, alive)]
        count = 1
        while heap:
            bound, _, level, node, item_level, alive = heapq.heappop(heap)
            alive = alive & (-bound >= self.weak[item_level])
            if not alive.any():
                continue
            a, b = docs.children(level, node) if level else (node, node + 1)
            below = max(level - 1, 0)
            _, starts, terms, values = docs.levels[below]
            rows = np.repeat(np.arange(b - a), np.diff(starts[a:b + 1]))
            here = slice(starts[a], starts[b])
            # Documents meet items; nodes meet the level below, or the items' leaves.
            down = 0 if below == 0 else max(item_level - 1, min(1, item_level))
            for step in range(item_level - 1, down - 1, -1):
                alive = np.repeat(alive, ITEM_FAN)[: self.tree.sizes[step]]
            met = alive
            bounds = self.tree.products(down, rows, terms[here], values[here], b - a)
            alive = alive & (bounds >= self.weak[down])
            if below:
                for c in np.flatnonzero(alive.any(axis=1)):
                    heapq.heappush(heap, (-int(bounds[c][alive[c]].max()), count, below, a + c, down, alive[c]))
                    count += 1
            else:
                self.compared += int((b - a) * met.sum())
                self._take(docs.ids[a:b], bounds, alive)

    def _take(self, ids: np.ndarray, scores: np.ndarray, alive: np.ndarray) -> None:
        changed = False
        for item in np.flatnonzero(alive.any(axis=0)):
            mine = alive[:, item]
            score, doc = self.best[item]
            score, doc = np.r_[score, scores[mine, item]], np.r_[doc, ids[mine]]
            order = np.lexsort((doc, -score))[: self.k]
            self.best[item] = (score[order], doc[order])
            if len(order) == self.k and score[order[-1]] > self.weak[0][item]:
                self.weak[0][item] = score[order[-1]]
                changed = True
        if changed:
            self._lift()


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """What terms add to a score: weight times saturated frequency, in whole numbers."""
    m = 100 - 50 + (50 * n * total_docs) // total_terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def _vectors(docs: DataFrame, id_col: str, text_col: str, shared) -> DataFrame:
    """Every document with a term: its number of terms and the counts of those
    in the block's vocabulary."""
    get = _cached(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = get().vocabulary
        for batch in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = term_counts(text.as_py() or "")
                if counts:
                    known = sorted((vocabulary[t], counts[t]) for t in counts.keys() & vocabulary.keys())
                    ids.append(i)
                    sizes.append(counts.total())
                    terms.append([t for t, _ in known])
                    tfs.append([c for _, c in known])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                                   pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                                  names=["doc_id", "n", "terms", "tfs"])

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string"))
    return materialize(picked.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>"), "term-vectors")


_TREES: dict[str, ItemTree] = {}


def _cached(shared):
    """A function that gives a broadcast block's tree, built once in a worker."""
    name = uuid.uuid4().hex

    def get() -> ItemTree:
        if name not in _TREES:
            _TREES.clear()
            _TREES[name] = ItemTree(shared.value)
        return _TREES[name]
    return get


def _search(vectors: DataFrame, shared, weights: np.ndarray, floors: dict, totals: tuple[int, int], k: int) -> DataFrame:
    """The k best documents of every item within each task's share of the vectors."""
    get = _cached(shared)
    context = vectors.sparkSession.sparkContext
    known = context.broadcast((weights, floors))

    def batch_tree(batch: pa.RecordBatch, weights: np.ndarray) -> DocTree | None:
        terms, tfs = batch.column(2), batch.column(3)
        starts = terms.offsets.to_numpy().astype(np.int64)
        flat = terms.values.to_numpy()[starts[0]:starts[-1]].astype(np.int64)
        if not len(flat):
            return None
        ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
        tf = tfs.values.to_numpy()[starts[0]:starts[-1]]
        n = np.repeat(batch.column(1).to_numpy(), np.diff(starts))
        return DocTree(ids, starts - starts[0], flat, impacts(tf, n, weights[flat], *totals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = get()
        weights, floors = known.value
        search = Search(tree, np.array([floors.get(i, 1) for i in tree.ids], np.int64), k)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                docs = batch_tree(batch.slice(at, BATCH_DOCS), weights)
                if docs:
                    search.add(docs)
        for item, (scores, docs) in zip(tree.ids, search.best, strict=True):
            if len(scores):
                yield pa.record_batch([pa.array([item] * len(scores), pa.int64()),
                                       pa.array(docs, mask=docs == LAST), pa.array(scores)],
                                      names=["item_id", "doc_id", "score"])

    held = vectors.filter(F.size("terms") > 0)
    return materialize(held.mapInArrow(run, "item_id long, doc_id long, score long"), "ranked")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = K, id_col: str = "doc_id", text_col: str = "text",
                   item_id_col: str = "item_id", item_text_col: str = "text",
                   block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents."""
    context = docs.sparkSession.sparkContext
    pairs = _item_terms(items, item_id_col, item_text_col)
    blocks = max(1, -(-pairs.count() // block_pairs))
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = None
    for block in range(blocks):
        held = [(r.item_id, bytes(r.term)) for r in pairs.filter(part == block).collect()]
        if not held:
            continue
        shared = context.broadcast(held)
        vectors = _vectors(docs, id_col, text_col, shared)
        totals = tuple(int(x or 0) for x in vectors.agg(F.count(F.lit(1)), F.sum("n")).first())
        weights = np.zeros(len({t for _, t in held}), np.int64)
        for term, df in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            weights[term] = math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * df + 1)))
        early = F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST_WAVE)) == 0
        first = _search(vectors.filter(early), shared, weights, {}, totals, k)
        floors = {r.item_id: r.score for r in _best(first, k).filter(F.col("rank") == k).collect()}
        second = _search(vectors.filter(~early), shared, weights, floors, totals, k)
        found = first.unionByName(second)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    return _best(out, k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
