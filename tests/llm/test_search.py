"""Ranked lexical search, exact top-k search and spelling variants against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from tests.llm.common import awkward_rows, clashing, documents, empty, prose

from herdflow.llm import dual_tree, m_tree, spelling

ITEMS = "item_id long, text string"


# -- ranked lexical search ---------------------------------------------------------

def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text or ""))


def ranked(docs, items, k):
    docs = [(d, Counter(terms_of(t))) for d, t in docs]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    total, size = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for d, c, n in docs:
            m = 100 - 50 + (50 * n * total) // size
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


def rank_rows(df):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


def test_dual_tree_equals_brute_force(spark):
    docs = documents(spark, n=400)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(2)
    items = [(i, prose(rng, rng.choice([1, 6, 30]))) for i in range(40)] + [
        (40, None), (41, ""), (42, "word"), (42, "THE tion"), (42, "the tion"), (None, "x A b"), (43, "absentterm")]
    table = spark.createDataFrame(items, ITEMS)
    want = ranked(texts, items, 7)
    assert rank_rows(dual_tree.rank_documents(clashing(docs), table, k=7)) == want
    # Small blocks, and batches of many nodes.
    assert rank_rows(dual_tree.rank_documents(docs.repartition(5), table, k=7, block_pairs=60)) == want
    assert rank_rows(dual_tree.rank_documents(docs, table)) == ranked(texts, items, 50)


def test_ranking_ties_copies_and_empty_tables(spark):
    copies = [(i, "alpha beta", "en", "a", 10) for i in range(90, 0, -1)] + [(5, "alpha beta", "en", "a", 10)]
    docs = spark.createDataFrame(copies + [(1000, "gamma", "en", "a", 5)], documents(spark, n=1).schema)
    items = spark.createDataFrame([(1, "beta")], ITEMS)
    found = dual_tree.rank_documents(docs, items, k=10).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    assert dual_tree.rank_documents(empty(spark), items).collect() == []
    assert dual_tree.rank_documents(docs, spark.createDataFrame([], ITEMS)).collect() == []


def test_long_texts_go_in_slices(monkeypatch):
    rng = random.Random(4)
    text = prose(rng, 3000)
    whole = dual_tree.term_counts(text)
    monkeypatch.setattr(dual_tree, "SLICE", 50)
    assert dual_tree.term_counts(text) == whole == Counter(t.encode() for t in terms_of(text))


def test_dual_tree_drops_pairs_whole():
    """Items of one vocabulary never meet documents of another."""
    rng = np.random.default_rng(1)
    pairs = [(i, f"{'ab'[i % 2]}{t}".encode()) for i in range(64) for t in [99, *rng.integers(0, 40, 12)]]
    tree = dual_tree.ItemTree(pairs)
    rows = [sorted({tree.vocabulary[f"{'ab'[d % 2]}{t}".encode()] for t in [99, *rng.integers(0, 40, 10)]
                    if f"{'ab'[d % 2]}{t}".encode() in tree.vocabulary}) for d in range(512)]
    starts = np.cumsum([0, *map(len, rows)])
    terms = np.concatenate(rows)
    values = rng.integers(1, 100, len(terms))
    search = dual_tree.Search(tree, np.ones(64, np.int64), 5)
    search.add(dual_tree.DocTree(np.arange(512), starts, terms, values))
    assert search.compared < 0.6 * 512 * 64
    sets = {i: {tree.vocabulary[t] for j, t in pairs if j == i} for i in range(64)}
    for item, (scores, docs) in zip(tree.ids, search.best, strict=True):
        all_scores = [(-sum(v for t, v in zip(terms[a:b], values[a:b]) if t in sets[item]), d)
                      for d, (a, b) in enumerate(zip(starts[:-1], starts[1:]))]
        assert [(-s, d) for s, d in zip(scores, docs)] == sorted(x for x in all_scores if x[0])[:5]


# -- exact top-k search ------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int"


def top(rows, k):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in whole:
        if i is not None and i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i) for i, w in whole if i != q)
        out += [(q, r, i, min(max(-s, 1 - 2 ** 63), 2 ** 63 - 1)) for r, (s, _, i) in enumerate(scores[:k], 1)]
    return sorted(map(str, out))


def top_rows(df):
    return sorted(str((r.query_id, r["rank"], r.vec_id, r.score)) for r in df.collect())


def vectors(n, seed=1, width=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(width)]
        if i % 3 == 1:
            v = [0.5] * width                       # a third of all rows are copies
        elif i % 5 == 2 and rows[-1][1]:
            v = [x + rng.gauss(0, 0.001) for x in rows[-1][1]]
        rows.append((i, v))
    return rows


def test_m_tree_equals_brute_force(spark, monkeypatch):
    rows = vectors(900) + [(None, [0.5] * 6), (None, None), (100, [0.1] * 6), (300, None), (1000, [1.0, None]),
                           (1100, [float("nan")] * 6), (1200, [float("inf")] + [0.0] * 5), (1300, []), (1400, [2.0, 1.0]),
                           (-100, [0.0] * 6), (7, [0.5] * 6), (7, [0.5] * 6)]
    monkeypatch.setattr(m_tree, "CELL_ROWS", 60)
    monkeypatch.setattr(m_tree, "TREE_ROWS", 100)
    monkeypatch.setattr(m_tree, "QUERY_BLOCK", 3)
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    found = m_tree.top_inner_products(clashing(table.withColumnRenamed("label", "doc_id")).withColumnRenamed("w", "v"))
    assert top_rows(found) == top(rows, 10)


def test_m_tree_few_rows_large_components_and_empty_tables(spark):
    rows = [(0, [1e9, -3.5]), (1, [2e9, 1.0]), (2, [1e300, 0.0]), (100, [-1e300, 2.0]), (200, [1e9, -3.5])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    found = {(r.query_id, r.vec_id): r.score for r in m_tree.top_inner_products(table).collect()}
    assert len(found) == 12 and found[0, 200] == found[200, 0] == 2 ** 63 - 1
    assert found[0, 100] == 1 - 2 ** 63
    assert m_tree.top_inner_products(spark.createDataFrame([], VECTORS)).collect() == []
    none = spark.createDataFrame([(1, [1.0], 0), (2, None, 0)], VECTORS)
    assert m_tree.top_inner_products(none).collect() == []


def test_m_tree_spares_distances():
    """In clustered data the stored distances leave most of the tree aside."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1000, (40, 8))
    data = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 15, (4000, 8)))
    tree = m_tree.Tree(data, np.arange(4000), float((data ** 2).sum(axis=1).max()))
    computed = 0
    for q in data[::100]:
        rows, scores, n = tree.search(q, 10, -np.inf)
        computed += n
        want = np.lexsort((np.arange(4000), -(data @ q)))[:10]
        assert tree.order[rows].tolist() == want.tolist() and (scores == data[want] @ q).all()
    assert computed < 0.3 * 4000 * 40


# -- spelling variants -------------------------------------------------------------

def variants(texts, damage, min_length=6, min_count=5, ratio=5):
    counts = Counter()
    for i, text in texts:
        for raw in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(raw)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(a == b[:p] + b[p + 1:] for p in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if apart(v, w))
        form[w] = near[0][1] if near and -near[0][0] >= ratio * n else None
        out[w] = [n, len(near), words[form[w]] if form[w] else None]
    result = []
    for w, facts in out.items():
        root = w
        while form[root]:
            root = form[root]
        result.append((w, form[w], root, *facts))
    return sorted(map(str, result))


def variant_rows(df):
    return sorted(str((r.word, r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect())


def spelled(spark):
    rng = random.Random(6)
    base = ["transport", "tränsport", "station", "stationer", "nationing", "abababab", "aaaaaa", "aaaaaaa"]
    rows = awkward_rows()
    for i in range(150):
        text = []
        for _ in range(60):
            w = rng.choices(base, [50, 2, 40, 3, 10, 6, 4, 2])[0]
            if rng.random() < 0.15:
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1:], w[:p] + rng.choice("abÀÿ") + w[p:], w[:p] + rng.choice("abÉ×") + w[p + 1:]])
            text.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(text), "en", "a", 1))
    long = "x" * 5000
    rows.append((900, " ".join([long] * 6 + [long + "y"] * 40 + ["ж" + long[1:]] * 5), "en", "a", 1))
    return spark.createDataFrame(rows, documents(spark, n=1).schema)


def test_spelling_equals_brute_force(spark):
    docs = spelled(spark)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = variants(texts, 7)
    assert len(want) > 100
    assert variant_rows(spelling.spelling_variants(clashing(docs), damage=7)) == want
    # Crowded cells are cut into parts, and blocks are many.
    assert variant_rows(spelling.spelling_variants(docs, damage=7, cell_words=3)) == want
    assert variant_rows(spelling.spelling_variants(docs)) == variants(texts, 199)


def test_spelling_small_blocks_and_empty_tables(spark, monkeypatch):
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(6, 9))) for _ in range(300)})
    table = spark.createDataFrame([(w, 5 + i % 40) for i, w in enumerate(words)], "word string, n long").coalesce(1)
    cells = [r.asDict() for r in spelling._cells(table, 1000).orderBy("length", "segment", "cell", "i", "j").collect()]
    monkeypatch.setattr(spelling, "BLOCK", 4)
    import pyarrow as pa

    columns = ["length", "segment", "cell", "i", "j", "part", "word", "n"]
    halves = [pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in x]) for x in (cells[:501], cells[501:])]
    found = Counter()
    for batch in spelling._compare(iter(halves)):
        for r in batch.to_pylist():
            found[r["word"]] += r["many"]
    near = {w: sum(1 for v in words if v != w and spelling.tile([w], [v], max(len(w), len(v)), 0)[0, 0]
                   | spelling.tile([w], [v], max(len(w), len(v)), 1)[0, 0]
                   | spelling.tile([w], [v], max(len(w), len(v)), 2)[0, 0]) for w in words}
    assert found == Counter({w: n for w, n in near.items() if n})
    assert spelling.spelling_variants(empty(spark)).collect() == []


def test_chains_of_forms_end_in_one_root(spark):
    numbers = [("banana", 5), ("bananas", 30), ("bananass", 160), ("bananasss", 900), ("bananassss", 5000)]
    rows = [(i, " ".join([w] * n), "en", "a", 1) for i, (w, n) in enumerate(numbers)]
    docs = spark.createDataFrame(rows, documents(spark, n=1).schema)
    found = {r.word: (r.form, r.root) for r in spelling.spelling_variants(docs, damage=10 ** 9 + 7).collect()}
    assert found["banana"] == ("bananas", "bananassss") and found["bananassss"] == (None, "bananassss")
    assert {root for _, root in found.values()} == {"bananassss"}
