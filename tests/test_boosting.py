"""Out-of-fold training of several tasks against a plain single-machine version."""

import math
import random

import numpy as np

from herdflow.operators.boosting import (Forest, Paths, Settings, Task, Walk, _bundles, _histograms, _larger_children, _layout,
                                          best_splits, feature_columns, oof_report, out_of_fold_tasks)

TASKS = [Task("weight", "regression", "y_w"), Task("grade", "multiclass", "y_g", 3), Task("sick", "binary", "y_s", 2)]
SETTINGS = Settings(n_folds=3, rounds=3, depth=2, max_bin=8, min_child=5, quantile_error=0.0)


def table(spark, n=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        a, b, c = rng.random(), float(rng.randint(0, 5)), rng.gauss(0, 1)
        rows.append((i, rng.randint(0, 60) if i % 9 else None, None if i % 13 == 0 else a, b, float("nan") if i % 17 == 0 else c,
                     None if i % 7 == 0 else 3 * a + b, None if i % 5 == 0 else float(int(b) // 2), float(a + c > 0.7)))
    return spark.createDataFrame(rows, "id long, farm long, a double, b double, c double, y_w double, y_g double, y_s double")


def plain(rows, folds, task, k):
    """Predictions of fold k by loops over all splits, from the same binned rows."""
    train = [r for r in rows if folds[r["id"]] != k]
    test = [r for r in rows if folds[r["id"]] == k]
    classes = range(task.scores)
    n = len(train)
    if task.kind == "regression":
        base = [sum(r["y"] for r in train) / n]
    elif task.kind == "binary":
        share = (sum(r["y"] == 1 for r in train) + 1) / (n + 2)
        base = [math.log(share / (1 - share))]
    else:
        base = [math.log((sum(r["y"] == c for r in train) + 1) / (n + 2)) for c in classes]
    raw = {r["id"]: list(base) for r in rows}

    def shares(r):
        f = raw[r["id"]]
        if task.kind == "regression":
            return f
        if task.kind == "binary":
            return [1 / (1 + math.exp(-f[0]))]
        e = [math.exp(x) for x in f]
        return [x / sum(e) for x in e]

    def grow(part, grads, depth):
        g, h = sum(grads[r["id"]][0] for r in part), sum(grads[r["id"]][1] for r in part)
        leaf = -SETTINGS.learning_rate * g / (h + 1)
        if depth == 0:
            return leaf
        best = (1e-12, None)
        for f in range(3):
            for b in sorted({r["bins"][f] for r in part}):
                left, right = ([r for r in part if (r["bins"][f] <= b) == side] for side in (True, False))
                if min(len(left), len(right)) < SETTINGS.min_child:
                    continue
                sums = [[sum(grads[r["id"]][i] for r in x) for i in (0, 1)] for x in (left, right)]
                gain = sum(a * a / (b2 + 1) for a, b2 in sums) - g * g / (h + 1)
                if gain > best[0] + 1e-12:
                    best = (gain, (f, b, left, right))
        if best[1] is None:
            return leaf
        f, b, left, right = best[1]
        return f, b, grow(left, grads, depth - 1), grow(right, grads, depth - 1)

    def value(tree, r):
        while isinstance(tree, tuple):
            tree = tree[2] if r["bins"][tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(SETTINGS.rounds):
        p = {r["id"]: shares(r) for r in train}
        trees = []
        for c in classes:
            target = {r["id"]: (float(r["y"] == c) if task.kind == "multiclass" else r["y"]) for r in train}
            grads = {i: (p[i][c] - target[i], 1.0 if task.kind == "regression" else p[i][c] * (1 - p[i][c])) for i in p}
            trees.append(grow(train, grads, SETTINGS.depth))
        for r in rows:
            raw[r["id"]] = [x + value(t, r) for x, t in zip(raw[r["id"]], trees)]
    return {r["id"]: shares(r) for r in test}


def test_out_of_fold_predictions_equal_plain_boosting(spark):
    df = table(spark)
    features = feature_columns(df, ["id", "farm", "y_w", "y_g", "y_s"])
    assert features == ["a", "b", "c"]
    found = out_of_fold_tasks(df.repartition(5), key=["id"], tasks=TASKS, features=features, group="farm", settings=SETTINGS,
                              seed=None).collect()
    rows = [r.asDict() for r in df.collect()]
    probs = [i / 8 for i in range(1, 8)]
    edges = [np.unique(q) for q in df.select(*[df[c].cast("double") for c in features])
             .approxQuantile(features, probs, 0.0)]
    for r in rows:
        r["bins"] = [0 if r[c] is None or math.isnan(r[c]) else 1 + int(np.searchsorted(e, r[c])) for c, e in zip(features, edges)]
    for task in TASKS:
        valid = [dict(r, y=r[task.label]) for r in rows if r[task.label] is not None]
        mine = {r.id: r for r in found if r.task == task.name}
        assert sorted(mine) == sorted(r["id"] for r in valid)
        folds = {i: r.fold for i, r in mine.items()}
        farms = {}
        for r in valid:
            farms.setdefault(r["farm"], set()).add(folds[r["id"]])
        assert all(len(f) == 1 for f in farms.values())
        for k in range(3):
            for i, p in plain(valid, folds, task, k).items():
                got = mine[i]
                if task.kind == "regression":
                    assert got.probabilities is None and abs(got.prediction - p[0]) < 1e-9
                else:
                    want = [1 - p[0], p[0]] if task.kind == "binary" else p
                    assert np.allclose(got.probabilities, want, atol=1e-9)
                    assert got.prediction == float(np.argmax(got.probabilities))


def test_report_and_missing_labels(spark):
    df = table(spark)
    pred = out_of_fold_tasks(df, key=["id"], tasks=TASKS, features=["a", "b", "c"], group="farm", settings=SETTINGS)
    report = oof_report(pred, TASKS, ["id"], 3).collect()
    assert len(report) == 9
    for r in report:
        n = sum(x.rows_predicted for x in report if x.task == r.task)
        assert r.rows_trained == n - r.rows_predicted and r.predicted_once == r.rows_predicted == r.whole_probabilities
        assert r.below_plain_error
    none = out_of_fold_tasks(df.filter("id < 0"), key=["id"], tasks=TASKS[1:], features=["a", "b", "c"], group="farm", settings=SETTINGS)
    assert none.collect() == []


def test_no_split_without_enough_rows(spark):
    hist = spark.createDataFrame([(0, 0, 0, 1, -2.0, 4.0, 4.0), (0, 0, 0, 2, 2.0, 6.0, 6.0)],
                                 "model int, node int, feature int, bin int, g double, h double, n double")
    few, enough = (best_splits(hist, Settings(min_child=m)).first() for m in (5, 4))
    assert few.gain == 0 and (few.g, few.h) == (0.0, 10.0)
    assert enough.bin == 1 and abs(enough.gain - (4 / 5 + 4 / 7)) < 1e-12


def test_byte_coded_paths_equal_plain_descent():
    rng = np.random.default_rng(5)
    for depth, n in ((2, 1), (3, 37), (5, 64)):
        forest = Forest(TASKS, Settings(n_folds=2, rounds=2, depth=depth, max_bin=8), [np.arange(7.0)] * 3)
        forest.feature[:] = rng.integers(0, 3, forest.feature.shape)
        forest.bin[:] = rng.integers(0, 10, forest.bin.shape)
        forest.value[:] = rng.normal(size=forest.value.shape)
        forest.base[:] = rng.normal(size=forest.n_models)
        bins = rng.integers(0, 9, (3, n)).astype(np.uint8)

        def leaf(model, round_, levels, row):
            at = 0
            for _ in range(levels):
                at = 2 * at + 1 + int(bins[forest.feature[model, round_, at], row] > forest.bin[model, round_, at])
            return at - (2 ** levels - 1)

        for levels in range(depth):
            walk = Walk(Paths(forest, 1, levels), bins)
            for model in range(forest.n_models):
                assert walk.node(model, 1, levels).tolist() == [leaf(model, 1, levels, i) for i in range(n)]
                raw = [forest.base[model] + forest.value[model, 0, leaf(model, 0, depth, i)] for i in range(n)]
                assert np.allclose(walk.raw(model), raw, atol=1e-12)
        # One comparison for each split, however many models hold it.
        assert len(Walk(Paths(forest, 2), bins).marks) <= 3 * 10


def test_histograms_count_joint_bins():
    assert _bundles([32, 32, 12, 10]) == [[0, 1], [2, 3]] and _bundles([2000, 2]) == [[0], [1]] and _bundles([]) == []


def test_a_pass_sums_only_the_smaller_children(spark):
    """One binary column is read; with ``above`` the sums are those of all rows of both children."""
    rng = np.random.default_rng(7)
    task, settings = Task("grade", "multiclass", "y", 2), Settings(n_folds=2, rounds=1, depth=3, max_bin=8)
    forest = Forest([task], settings, [np.arange(7.0)] * 3)
    bins, fold, label = rng.integers(0, 9, (90, 3)), rng.integers(0, 2, 90), rng.integers(0, 2, 90).astype(float)
    label[::11] = np.nan
    rows = np.zeros(90, _layout(3, 1))
    rows["bins"], rows["fold"][:, 0], rows["label"][:, 0] = bins, fold, label
    data = spark.createDataFrame([(bytearray(r.tobytes()),) for r in rows], "__packed binary").repartition(3)
    above = None
    for level in range(3):
        if level:
            at = slice(2 ** (level - 1) - 1, 2 ** level - 1)
            forest.feature[:, 0, at], forest.bin[:, 0, at] = level, 2
            forest.right[:, 0, at] = rng.random(forest.right[:, 0, at].shape) < 0.5
            above = _larger_children(found, forest, 0, level - 1)  # noqa: F821
        found = _histograms(data, spark.sparkContext.broadcast(forest), 0, level, above)
        got = {(r.model, r.node, r.feature, r.bin): (r.g, r.h, r.n) for r in found.collect()}
        want = {}
        for model, c in ((m, m % 2) for m in range(forest.n_models)):
            for i in np.flatnonzero(~np.isnan(label) & (fold != model // 2)):
                node = 0
                for step in range(1, level + 1):
                    node = 2 * node + int(bins[i, step] > 2)
                for f in range(3):
                    cell = want.setdefault((model, node, f, int(bins[i, f])), np.zeros(3))
                    cell += (0.5 - (label[i] == c), 0.25, 1)
        assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_ranges_of_a_walk():
    rng = np.random.default_rng(8)
    forest = Forest(TASKS, Settings(n_folds=2, rounds=2, depth=3, max_bin=8), [np.arange(7.0)] * 3)
    forest.feature[:], forest.bin[:] = rng.integers(0, 3, forest.feature.shape), rng.integers(0, 10, forest.bin.shape)
    forest.value[:] = rng.normal(size=forest.value.shape)
    walk = Walk(Paths(forest, 2, models=forest.of(TASKS[1])), rng.integers(0, 9, (3, 61)).astype(np.uint8))
    for first, end in ((0, 61), (5, 40), (8, 8), (13, 59)):
        for model in forest.of(TASKS[1]):
            assert walk.part(first, end).raw(model).tolist() == walk.raw(model)[first:end].tolist()
