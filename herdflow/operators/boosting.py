"""Out-of-fold training of several tasks at once (K2-K4): gradient boosting over
distributed histograms.

A task is a regression, a binary or a multiclass label; rows without the label
take no part in it. Each task has its own stratified group folds (deciles are the
strata of a regression) and one model per fold and class, multiclass by softmax.
All models grow together: for every level of a round one pass over the written
table sums gradients per (model, node, feature, bin) in the tasks, Spark adds
these up, and a window over the bins finds each node's best split. Only the splits
reach the driver; their number depends on tasks, folds, classes and depth, not on
rows. A row's prediction comes from the models that have not seen its fold.

The passes read one binary column: a row's bins, folds and labels, written once the
bin edges are known. Below the root a pass sums only the smaller child of each
split; the sums of the other are those of the node above less these.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from herdflow.operators.joins import bounded_broadcast, materialize
from herdflow.operators.learn import fold_of_groups, quantile_bins
from herdflow.operators.rows import select_numeric


@dataclass(frozen=True)
class Task:
    """A label column and what kind of label it is; classes are 0 .. n_class - 1."""

    name: str
    kind: str               # regression, binary or multiclass
    label: str
    n_class: int = 1

    @property
    def scores(self) -> int:
        return self.n_class if self.kind == "multiclass" else 1


@dataclass(frozen=True)
class Settings:
    n_folds: int = 5
    rounds: int = 5
    depth: int = 3
    max_bin: int = 31
    learning_rate: float = 0.3
    min_child: int = 20
    reg_lambda: float = 1.0
    quantile_error: float = 0.005   # of the bin edges' ranks


# Joint bins of a group of features: their sums stay in a core's cache.
JOINT_BINS = 1024


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """K4: the numeric columns that are not excluded (keys, labels, outcomes)."""
    return select_numeric(df, exclude).columns


def task_folds(df: DataFrame, tasks: Sequence[Task], *, group: str, n_folds: int, seed: int | None) -> DataFrame:
    """(group, fold_<task>...): every task's folds over the groups of its valid rows (K1, K2)."""
    strata = {}
    for task in tasks:
        strata[task.name] = F.col(task.label).cast("double")
        if task.kind == "regression":
            binned = quantile_bins(df, task.label, f"__{task.name}", q=10)
            df, strata[task.name] = binned, F.col(f"__{task.name}").cast("double")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("task"), s.alias("stratum")) for i, s in enumerate(strata.values())]))
    rows = df.select(group, each.alias("__t")).select(group, "__t.task", "__t.stratum").filter("stratum IS NOT NULL")
    every = fold_of_groups(rows, group=group, label="stratum", n_folds=n_folds, seed=seed, by=["task"])
    return every.groupBy(group).agg(*[F.max(F.when(F.col("task") == i, F.col("fold"))).alias(f"fold_{t.name}")
                                      for i, t in enumerate(tasks)])


class Forest:
    """The trees so far. ``feature`` and ``bin`` hold, per model and round, the
    split of every inner node (rows with a larger bin go right), ``value`` the
    leaves. Models are ordered by task, fold and class."""

    def __init__(self, tasks: Sequence[Task], settings: Settings, edges: list[np.ndarray]):
        self.tasks, self.settings, self.edges = list(tasks), settings, edges
        self.first, n = {}, 0
        for t in tasks:
            self.first[t.name] = n
            n += settings.n_folds * t.scores
        self.n_models = n
        inner = 2 ** settings.depth - 1
        self.base = np.zeros(n)
        self.feature = np.zeros((n, settings.rounds, inner), np.int32)
        self.bin = np.full((n, settings.rounds, inner), settings.max_bin + 1, np.int32)
        self.right = np.ones((n, settings.rounds, inner), bool)     # the right child is the smaller one
        self.value = np.zeros((n, settings.rounds, inner + 1))

    def models(self, task: Task, fold: int) -> range:
        at = self.first[task.name] + fold * task.scores
        return range(at, at + task.scores)

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        """Bin of every feature, one row each: 0 for a missing value, then 1 + edges below it."""
        out = np.zeros((len(columns), len(columns[0]) if columns else 0), np.uint8)
        for i, (x, edges) in enumerate(zip(columns, self.edges, strict=True)):
            known = ~np.isnan(x)
            out[i, known] = 1 + np.searchsorted(edges, x[known], side="left")
        return out

    def of(self, task: Task) -> range:
        return range(self.first[task.name], self.first[task.name] + self.settings.n_folds * task.scores)

    def predicted(self, task: Task, walk: Walk, fold: int) -> np.ndarray:
        """Means, or probabilities, one row per class (one row for a regression and a binary task)."""
        raw = np.stack([walk.raw(m) for m in self.models(task, fold)])
        if task.kind == "regression":
            return raw
        if task.kind == "binary":
            return 1 / (1 + np.exp(-raw))
        p = np.exp(raw - raw.max(axis=0))
        return p / p.sum(axis=0)


class Paths:
    """The splits of the first ``rounds`` trees of every model (or of ``models``) and of
    ``levels`` levels of the next tree, prepared once per task. Models share most splits,
    so each (feature, bin) is compared once per batch; a row's way through eight nodes is
    one byte of their results, looked up in a table of nodes."""

    def __init__(self, forest: Forest, rounds: int, levels: int = 0, models: range | None = None):
        self.forest, self.rounds, self.levels = forest, rounds, levels
        trees = rounds + (levels > 0)
        which = slice(None) if models is None else slice(models.start, models.stop)
        keys = forest.feature[which, :trees].astype(np.int64) * 256 + forest.bin[which, :trees]
        self.splits, at = np.unique(keys, return_inverse=True)
        self.at = np.zeros((forest.n_models, *keys.shape[1:]), np.int64)
        self.at[which] = at.reshape(keys.shape)
        depth = forest.settings.depth
        self.leaf, self.node = self._table(depth), self._table(levels)
        self.short = depth <= 3
        if self.short:
            self.value = forest.value[:, :rounds][:, :, self.leaf]

    @staticmethod
    def _table(levels: int) -> np.ndarray:
        """Node, from 0 in its row of nodes, for each byte of results (bit n: node n goes right)."""
        code, at = np.arange(256), np.zeros(256, np.int64)
        for _ in range(min(levels, 3)):
            at = 2 * at + 1 + (code >> at & 1)
        return at - (2 ** min(levels, 3) - 1)


class Walk:
    """One batch of binned rows and its comparisons with all splits of ``paths``."""

    def __init__(self, paths: Paths, bins: np.ndarray):
        self.paths, self.n, self.skip = paths, bins.shape[1], 0
        marks = np.zeros((len(paths.splits), -(-self.n // 8) * 8), np.uint8)
        for mark, key in zip(marks, paths.splits.tolist(), strict=True):
            np.greater(bins[key >> 8], key & 255, out=mark[:self.n].view(bool))
        self.marks = marks.view(np.uint64)      # eight rows a word: shifts by up to 7 stay inside a byte

    def part(self, first: int, end: int) -> Walk:
        """The walk of the rows from ``first`` up to ``end``, with the comparisons made here."""
        part = copy.copy(self)
        part.n, part.skip = end - first, (self.skip + first) % 8
        part.marks = self.marks[:, (self.skip + first) // 8:-(-(self.skip + end) // 8)]
        return part

    def code(self, model: int, round_: int, inner: int) -> np.ndarray:
        """A byte per row: bit n is set if the row is larger than node n's bin."""
        at = self.paths.at[model, round_, :inner].tolist()
        out = self.marks[at[0]].copy()
        for n, split in enumerate(at[1:], 1):
            out |= self.marks[split] << np.uint64(n)
        return out.view(np.uint8)[self.skip:self.skip + self.n]

    def node(self, model: int, round_: int, levels: int) -> np.ndarray:
        """Where the rows stand after some levels of a tree, from 0 in their row of nodes."""
        if not levels:
            return np.zeros(self.n, np.int64)
        if levels <= 3:
            table = self.paths.node if levels == self.paths.levels else self.paths.leaf
            return table.take(self.code(model, round_, 2 ** levels - 1))
        at = np.zeros(self.n, np.int64)
        marks = self.marks.view(np.uint8)[:, self.skip:self.skip + self.n]
        split = self.paths.at[model, round_]
        for level in range(levels):
            at = 2 * at + 1 + marks[split[at], np.arange(self.n)]
        return at - (2 ** levels - 1)

    def raw(self, model: int) -> np.ndarray:
        """Sum of the first rounds' trees."""
        forest, depth = self.paths.forest, self.paths.forest.settings.depth
        out = np.full(self.n, forest.base[model])
        for r in range(self.paths.rounds):
            if self.paths.short:
                out += self.paths.value[model, r].take(self.code(model, r, 2 ** depth - 1))
            else:
                out += forest.value[model, r].take(self.node(model, r, depth))
        return out


def _bundles(widths: Sequence[int]) -> list[list[int]]:
    """Features in groups whose joint bins number at most ``JOINT_BINS``: one count over
    the joint bins of a group holds the histograms of all its features."""
    groups: list[list[int]] = []
    for f in sorted(range(len(widths)), key=lambda f: -widths[f]):
        fits = [g for g in groups if widths[f] * np.prod([widths[x] for x in g]) <= JOINT_BINS]
        if fits:
            fits[0].append(f)
        else:
            groups.append([f])
    return groups


def _columns(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]


def _layout(features: int, tasks: int) -> np.dtype:
    """A packed row: bins of the features, then fold (-1: none) and label (NaN: none) of each task."""
    return np.dtype([("bins", "u1", (features,)), ("fold", "<i4", (tasks,)), ("label", "<f8", (tasks,))])


def _packed(data: DataFrame, shared, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(key..., __packed): every row's bins, folds and labels as one binary value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        layout = _layout(len(features), len(forest.tasks))
        for batch in batches:
            rows = np.zeros(batch.num_rows, layout)
            rows["bins"] = forest.bins(_columns(batch, features)).T
            for i, task in enumerate(forest.tasks):
                label, fold = _columns(batch, [f"label_{task.name}", f"fold_{task.name}"])
                rows["label"][:, i], rows["fold"][:, i] = label, np.where(np.isnan(fold), -1, fold)
            ends = np.arange(len(rows) + 1, dtype=np.int32) * layout.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])
            yield pa.record_batch([*[batch.column(c) for c in key], packed], names=[*key, "__packed"])

    schema = ", ".join(f"`{c}` {data.schema[c].dataType.simpleString()}" for c in key)
    return data.mapInArrow(run, schema + ", __packed binary")


def _unpacked(batches: Iterator[pa.RecordBatch], layout: np.dtype, least: int = 40_000) -> Iterator[
        tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bins, folds and labels, one row per feature or task, of ``least`` rows or more at a time."""
    held: list[np.ndarray] = []
    for batch in batches:
        packed = batch.column("__packed").cast(pa.binary(layout.itemsize))
        if len(packed):
            held.append(np.frombuffer(packed.buffers()[1], layout, len(packed), packed.offset * layout.itemsize))
        if sum(map(len, held)) >= least:
            yield _turned(held)
            held = []
    if held:
        yield _turned(held)


def _turned(rows: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    return tuple(np.ascontiguousarray(np.concatenate([r[name] for r in rows]).T) for name in ("bins", "fold", "label"))


def _by_fold(fold: np.ndarray, label: np.ndarray, n_folds: int) -> tuple[np.ndarray, np.ndarray]:
    """A task's rows in the order of their folds, and where each fold begins (and the last one ends)."""
    known = np.flatnonzero(~np.isnan(label) & (fold >= 0))
    small = np.min_scalar_type(n_folds)
    fold = fold[known].astype(small)
    return known[np.argsort(fold, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(fold, minlength=n_folds))])


HISTOGRAM = "model int, node int, feature int, bin int, g double, h double, n double"


def _histograms(data: DataFrame, shared, round_: int, level: int, above: DataFrame | None) -> DataFrame:
    """(model, node, feature, bin, g, h, n): gradients of all training rows at a level.
    Below the root only the rows of each split's smaller child are summed; ``above``,
    the histograms of the level above, less these are those of the other child."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        n_folds = forest.settings.n_folds
        layout = _layout(len(forest.edges), len(forest.tasks))
        paths = [Paths(forest, round_, level, forest.of(task)) for task in forest.tasks]
        widths = [len(e) + 2 for e in forest.edges]
        groups = _bundles(widths)
        shapes = [[widths[f] for f in g] for g in groups]
        sizes = [int(np.prod(s)) for s in shapes]
        # Per group of features and model (split above, joint bin).
        splits = 2 ** level // 2 or 1
        sums = [np.zeros((forest.n_models, 3, splits * size)) for size in sizes]
        right = forest.right[:, round_, splits - 1:2 * splits - 1]
        nodes = 2 * np.arange(splits) + right if level else np.zeros((forest.n_models, 1), int)
        taken = np.zeros((forest.n_models, 2 ** level), bool)
        np.put_along_axis(taken, nodes, True, axis=1)
        for bins, folds, labels in _unpacked(batches, layout):
            joint = [np.ravel_multi_index([bins[f].astype(np.int64) for f in g], s) for g, s in zip(groups, shapes)]
            for task, path, fold, label in zip(forest.tasks, paths, folds, labels, strict=True):
                order, starts = _by_fold(fold, label, n_folds)
                # Twice in a row: the rows of all folds but one are one range, from its end round to its start.
                order, m = np.concatenate([order, order]), len(order)
                walk = Walk(path, bins.take(order, axis=1))
                label = label.take(order)
                hit = [label == c for c in range(task.scores)] if task.kind == "multiclass" else [label]
                joints = [j.take(order) for j in joint]
                for k in range(n_folds):
                    first, end = starts[k + 1], starts[k] + m
                    if first == end:
                        continue
                    part = walk.part(first, end)
                    p = forest.predicted(task, part, k)
                    cells = [j[first:end] for j in joints]
                    counts = None
                    for c, model in enumerate(forest.models(task, k)):
                        g = p[c] - hit[c][first:end]
                        h = None if task.kind == "regression" else p[c] * (1 - p[c])
                        if level:
                            if level <= 3:
                                code = part.code(model, round_, 2 ** level - 1)
                                at = np.flatnonzero(taken[model, path.node].take(code))
                                split = (path.node >> 1).take(code.take(at)) if level > 1 else 0
                            else:
                                node = part.node(model, round_, level)
                                at = np.flatnonzero(taken[model].take(node))
                                split = node.take(at) >> 1
                            g, h = g.take(at), None if h is None else h.take(at)
                            cells = [j[first:end].take(at) + split * size for j, size in zip(joints, sizes)]
                        if level or counts is None:     # all classes share the root and its counts
                            counts = [np.bincount(cell, None, s.shape[2]) for s, cell in zip(sums, cells)]
                        for s, cell, n in zip(sums, cells, counts, strict=True):
                            s[model, 0] += np.bincount(cell, g, s.shape[2])
                            s[model, 1] += n if h is None else np.bincount(cell, h, s.shape[2])
                            s[model, 2] += n
        for s, group, shape in zip(sums, groups, shapes, strict=True):
            whole = s.swapaxes(0, 1).reshape(3, forest.n_models, splits, *shape)
            for i, f in enumerate(group):
                each = whole.sum(axis=tuple(3 + x for x in range(len(group)) if x != i))
                model, split, bin_ = np.nonzero(each[2])
                values, node = [e[model, split, bin_] for e in each], nodes[model, split]
                for node, sign in ((node, 1.0), (node ^ 1, -1.0)) if level else ((node, 1.0),):
                    yield pa.record_batch([pa.array(x.astype(np.int32)) for x in (model, node, np.full(len(model), f), bin_)]
                                          + [pa.array(sign * v) for v in values],
                                          names=["model", "node", "feature", "bin", "g", "h", "n"])

    rows = data.select("__packed").mapInArrow(run, HISTOGRAM)
    if above is not None:
        rows = rows.unionByName(above)
    key = ["model", "node", "feature", "bin"]
    return rows.groupBy(*key).agg(*[F.sum(c).alias(c) for c in "ghn"]).filter("n > 0")


def _larger_children(histograms: DataFrame, forest: Forest, round_: int, level: int) -> DataFrame:
    """The histograms of a level under the numbers of each split's larger child."""
    right = forest.right[:, round_, 2 ** level - 1:2 ** (level + 1) - 1]
    larger = [(m, n, int(2 * n + (not right[m, n]))) for m, n in np.ndindex(right.shape)]
    larger = histograms.sparkSession.createDataFrame(larger, "model int, node int, child int")
    return histograms.join(F.broadcast(larger), ["model", "node"]).select(
        "model", F.col("child").alias("node"), "feature", "bin", *"ghn")


def best_splits(histograms: DataFrame, settings: Settings) -> DataFrame:
    """Per (model, node) the split of largest gain, with both sides' sums; gain 0
    (all rows to the left) where no split leaves enough rows on both sides."""
    whole = Window.partitionBy("model", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sides = histograms.select("model", "node", "feature", "bin", *[F.sum(c).over(upto).alias(f"{c}l") for c in "ghn"],
                              *[F.sum(c).over(whole).alias(c) for c in "ghn"])
    lam = F.lit(settings.reg_lambda)
    score = {s: F.col(f"g{s}") * F.col(f"g{s}") / (F.col(f"h{s}") + lam) for s in ("", "l", "r")}
    sides = sides.withColumns({f"{c}r": F.col(c) - F.col(f"{c}l") for c in "ghn"})
    enough = (F.col("nl") >= settings.min_child) & (F.col("nr") >= settings.min_child)
    gain = F.when(enough, F.greatest(score["l"] + score["r"] - score[""], F.lit(0.0))).otherwise(F.lit(0.0))
    best = F.max_by(F.struct("gl", "hl", "nl", "gr", "hr", "nr", "g", "h", "feature", "bin", "gain"),
                    F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
    return sides.withColumn("gain", gain).groupBy("model", "node").agg(best.alias("s")).select("model", "node", "s.*")


def _grow(forest: Forest, splits: list, round_: int, level: int) -> None:
    s = forest.settings
    for r in splits:
        at = 2 ** level - 1 + r.node
        split = r.gain > 0
        if split:
            forest.feature[r.model, round_, at], forest.bin[r.model, round_, at] = r.feature, r.bin
            forest.right[r.model, round_, at] = r.nr <= r.nl
        if level == s.depth - 1:
            sides = ((r.gl, r.hl), (r.gr, r.hr)) if split else ((r.g, r.h), (r.g, r.h))
            for side, (g, h) in enumerate(sides):
                forest.value[r.model, round_, 2 * r.node + side] = -s.learning_rate * g / (h + s.reg_lambda)


def _base(forest: Forest, data: DataFrame) -> None:
    """Every model starts from the mean label, or the log odds or log share of its class."""
    tasks, n_folds = forest.tasks, forest.settings.n_folds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Per task and fold: rows and sum of the labels (regression), or the rows of each class and of no class.
        classes = [1 if t.kind == "regression" else max(t.n_class, 2) for t in tasks]
        sums = [np.zeros((n_folds, n + 1)) for n in classes]
        for _, folds, labels in _unpacked(batches, _layout(len(forest.edges), len(tasks))):
            for task, s, n, fold, label in zip(tasks, sums, classes, folds, labels, strict=True):
                order, _ = _by_fold(fold, label, n_folds)
                fold, label = fold.take(order), label.take(order)
                if task.kind == "regression":
                    s += np.stack([np.bincount(fold, None, n_folds), np.bincount(fold, label, n_folds)], axis=1)
                else:
                    hit = [label == c for c in range(n)]
                    for c, each in enumerate([*hit, ~np.any(hit, axis=0)]):
                        s[:, c] += np.bincount(fold, each, n_folds)
        for i, s in enumerate(sums):
            fold, at = np.nonzero(s)
            yield pa.record_batch([pa.array(x.astype(np.int32)) for x in (np.full(len(fold), i), fold, at)]
                                  + [pa.array(s[fold, at])], names=["task", "fold", "at", "total"])

    rows = data.select("__packed").mapInArrow(run, "task int, fold int, at int, total double")
    rows = rows.groupBy("task", "fold", "at").agg(F.sum("total").alias("total")).collect()
    for i, task in enumerate(tasks):
        for k in range(n_folds):
            train = [r for r in rows if r.task == i and r.fold != k]
            of = lambda c: sum(r.total for r in train if r["at"] == c)  # noqa: B023, E731
            n = of(0) if task.kind == "regression" else sum(r.total for r in train)
            if not n:
                continue
            for c, model in enumerate(forest.models(task, k)):
                if task.kind == "regression":
                    forest.base[model] = of(1) / n
                    continue
                share = (of(1 if task.kind == "binary" else c) + 1.0) / (n + 2.0)
                forest.base[model] = np.log(share / (1 - share)) if task.kind == "binary" else np.log(share)


def out_of_fold_tasks(df: DataFrame, *, key: Sequence[str], tasks: Sequence[Task], features: Sequence[str], group: str,
                      settings: Settings = Settings(), seed: int | None = 42) -> DataFrame:
    """One row per row and task with a label: (key..., task, fold, label,
    prediction, probabilities). ``prediction`` is the mean, or the likeliest class;
    ``probabilities`` are one per class, null for a regression."""
    if settings.max_bin > 250 or settings.depth > 7:
        raise ValueError("at most 250 bins and 7 levels")
    labels = {f"label_{t.name}": F.col(t.label).cast("double") for t in tasks}
    rows = df.select(*key, F.col(group).alias("__group"), *[F.col(c).cast("double").alias(c) for c in features],
                     *[label.alias(name) for name, label in labels.items()])
    # Read by the folds, the edges and the passes: written once, dealt evenly whatever a join left.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(rows.repartition(parts, *[c for c in rows.columns if c != "__group"]), "oof-rows")
    folds, _ = bounded_broadcast(task_folds(rows, [replace(t, label=f"label_{t.name}") for t in tasks], group="__group",
                                            n_folds=settings.n_folds, seed=seed).withColumnRenamed("__group", "__of"))
    probs = [i / settings.max_bin for i in range(1, settings.max_bin)]
    quantiles = rows.approxQuantile(list(features), probs, settings.quantile_error)
    forest = Forest(tasks, settings, [np.unique(q) for q in quantiles])
    context = df.sparkSession.sparkContext
    data = rows.join(folds, F.col("__group").eqNullSafe(F.col("__of")), "left")
    data = materialize(_packed(data, context.broadcast(forest), key, features), "oof-packed")
    _base(forest, data)
    for round_ in range(settings.rounds):
        above = None
        for level in range(settings.depth):
            shared = context.broadcast(forest)
            sums = _histograms(data, shared, round_, level, above)
            if level + 1 < settings.depth:
                sums = materialize(sums, "histograms")
            _grow(forest, best_splits(sums, settings).collect(), round_, level)
            above = _larger_children(sums, forest, round_, level)
            shared.unpersist()
    shared = context.broadcast(forest)
    schema = ", ".join(f"`{c}` {data.schema[c].dataType.simpleString()}" for c in key)
    schema += ", task string, fold int, label double, prediction double, probabilities array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        n_folds = forest.settings.n_folds
        layout = _layout(len(features), len(forest.tasks))
        paths = [Paths(forest, forest.settings.rounds, models=forest.of(task)) for task in forest.tasks]
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, folds, labels = next(_unpacked(iter([batch]), layout))
            for task, path, fold, label in zip(forest.tasks, paths, folds, labels, strict=True):
                rows, starts = _by_fold(fold, label, n_folds)
                walk = Walk(path, bins.take(rows, axis=1))
                p = np.concatenate([forest.predicted(task, walk.part(starts[k], starts[k + 1]), k)
                                    for k in range(n_folds)], axis=1)
                if task.kind == "regression":
                    best, shares = p[0], pa.nulls(len(rows), pa.list_(pa.float64()))
                else:
                    p = np.concatenate([1 - p, p]) if task.kind == "binary" else p
                    best = p.argmax(axis=0).astype(float)
                    ends = np.arange(len(rows) + 1, dtype=np.int32) * len(p)
                    shares = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(p.T).ravel()))
                held = [batch.column(c).take(pa.array(rows)) for c in key]
                yield pa.record_batch([*held, pa.array([task.name] * len(rows), pa.string()),
                                       pa.array(fold[rows].astype(np.int32)), pa.array(label[rows]),
                                       pa.array(best), shares],
                                      names=[*key, "task", "fold", "label", "prediction", "probabilities"])

    return data.mapInArrow(run, schema)


def oof_report(predictions: DataFrame, tasks: Sequence[Task], key: Sequence[str], n_folds: int) -> DataFrame:
    """One row per task and fold: rows the model was trained on and predicted,
    rows predicted exactly once, rows whose probabilities sum to one, and whether
    the out-of-fold error is below that of the training rows' mean or commonest class."""
    rows = materialize(predictions, "oof-predictions")
    once = rows.groupBy("task", "fold", *key).agg(F.count(F.lit(1)).alias("n"))
    once = once.groupBy("task", "fold").agg(F.count_if(F.col("n") == 1).alias("predicted_once"))
    kind = F.create_map(*[x for t in tasks for x in (F.lit(t.name), F.lit(t.kind))])
    regression = kind[F.col("task")] == "regression"
    whole = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    # Training means and commonest classes from counts per task, fold and label.
    counts = rows.groupBy("task", "fold", F.when(~regression, F.col("label")).alias("cls")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("total"))
    held_out = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))
    train = counts.withColumn("out", held_out).filter("out != fold").groupBy("task", "out", "cls").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"))
    train = train.groupBy("task", F.col("out").alias("fold")).agg(
        F.sum("n").alias("rows_trained"), (F.sum("total") / F.sum("n")).alias("mean"),
        F.max_by("cls", F.struct("n", -F.col("cls"))).alias("commonest"))
    error = F.when(regression, F.abs(F.col("prediction") - F.col("label"))).otherwise(
        (F.col("prediction") != F.col("label")).cast("double"))
    plain = F.when(regression, F.abs(F.col("mean") - F.col("label"))).otherwise(
        (F.col("commonest") != F.col("label")).cast("double"))
    out = rows.join(F.broadcast(train), ["task", "fold"]).groupBy("task", "fold", "rows_trained").agg(
        F.count(F.lit(1)).alias("rows_predicted"),
        F.count_if(regression | (F.abs(whole - 1) < 1e-9)).alias("whole_probabilities"),
        (F.avg(error) < F.avg(plain)).alias("below_plain_error"))
    return out.join(once, ["task", "fold"])
