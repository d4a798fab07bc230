"""Long repeats, decontamination and SimHash against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from herdflow.llm import components, decontam, rindex, simhash
from tests.llm import common


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark).cache()


def test_index_against_counting():
    rng = random.Random(2)
    for _ in range(25):
        length, letters = rng.choice([5, 9, 20]), rng.choice([b"ab", b"abc\x00", b"abcdefgh"])
        parts = list({bytes(rng.choices(letters, k=rng.randint(0, 60))): 0 for _ in range(rng.randint(1, 20))})
        weights = [rng.choice([1, 1, 1, 2]) for _ in parts]
        n = Counter()
        for p, w in zip(parts, weights):
            for i in range(len(p) - length + 1):
                n[p[i:i + length]] += w
        want = {(j, i) for j, p in enumerate(parts) for i in range(len(p) - length + 1) if n[p[i:i + length]] > 1}
        got = {(int(j), i) for j, a, b in zip(*rindex.repeated_runs(parts, weights, length)) for i in range(a, b + 1)}
        assert got == want


def test_longest_matches():
    parts = [b"abracadabra", b"cadabrax", b"zz"]
    longest, left = rindex.longest_matches(parts)
    text = b"\xff".join(parts) + b"\xff"
    bounds = {i: i + int(left[i]) for i in range(len(text))}
    for i in range(len(text)):
        best = 0
        for j in range(len(text)):
            k = 0
            while j != i and i + k < bounds[i] and j + k < bounds[j] and text[i + k] == text[j + k]:
                k += 1
            best = max(best, k)
        assert longest[i] == best


def stripped(texts, length):
    n = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if n[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        yield len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()


@pytest.mark.parametrize("length, hot", [(200, 20_000), (60, 1)])
def test_repeats(spark, docs, length, hot):
    more = [(700, "ab" * 400, "", "", 0), (701, "ab" * 300 + "c" * 190, "", "", 0), (702, "q" * 200, "", "", 0),
            (703, "z" * 199, "", "", 0), (704, "é" * 100, "", "", 0)]
    table = docs.unionByName(spark.createDataFrame(more, common.SCHEMA))
    rows = table.collect()
    want = sorted((str(r.doc_id), *map(str, x)) for r, x in zip(rows, stripped([(r.text or "").encode() for r in rows], length)))
    got = common.rows(rindex.repeated_spans(table, length=length, hot_segments=hot, chunk=2000),
                      "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == want


def test_repeats_of_empty_table(spark):
    assert rindex.repeated_spans(common.empty(spark)).count() == 0
    assert rindex.repeated_spans(common.clashing(common.documents(spark, 3))).count() == 14


def plain_fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(1)
    for text in ["", " \n", "One", "one TWO", "É é É", *(common.prose(rng, n) for n in (3, 4, 50, 400))]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_simhash_components(spark, docs):
    got = simhash.simhash_components(docs).collect()
    prints = {r.fingerprint for r in got}
    values = np.array(sorted(int(p, 16) for p in prints), np.uint64)
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            parent[root(i)] = root(int(j))
    place = {f"{int(v):016x}": root(i) for i, v in enumerate(values)}
    least = {}
    for r in got:
        if r.doc_id is not None:
            least[place[r.fingerprint]] = min(r.doc_id, least.get(place[r.fingerprint], r.doc_id))
    assert all(r.component_id == least.get(place[r.fingerprint]) for r in got)
    texts = sorted((str(r.doc_id), f"{plain_fingerprint(r.text or ''):016x}") for r in docs.collect())
    assert texts == sorted((str(r.doc_id), r.fingerprint) for r in got)
    kept = simhash.keep_one(common.clashing(docs))
    assert kept.columns == common.clashing(docs).columns
    assert kept.count() == len(set(place.values()))


def test_links_inside_a_large_cell():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 30)).astype(np.uint64)
    fps = np.unique((base[:, None] ^ flips).ravel())
    fps = fps[np.argsort(np.bitwise_count(fps), kind="stable")]
    a, b = map(np.concatenate, zip(*simhash.spanning_links(np.zeros(len(fps), np.int64), fps, tile=64)))
    assert len(a) < 20 * len(fps)
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in zip(a, b):
        label[root(int(x))] = root(int(y))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            assert root(i) == root(int(j))


def test_large_cells_are_dealt(spark):
    """A family that shares two bit blocks: parts of its cell keep every link,
    and no task's cell holds more than two parts."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    family = [rng.getrandbits(30) for _ in range(900)]
    family += [rng.choice(family) ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])))
               for _ in range(900)]
    fps = np.array(sorted(set(family)), np.uint64)
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.RADIUS

    def classes(links):
        root = list(range(len(fps)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x
        for a, b in links:
            root[find(a)] = find(b)
        groups = defaultdict(list)
        for x in range(len(fps)):
            groups[find(x)].append(x)
        return sorted(groups.values())

    want = classes(zip(*np.nonzero(np.triu(near, 1))))
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    for cell_rows in (64, 100_000):
        links = [(at[r.u], at[r.v]) for r in simhash.near_links(table, cell_rows=cell_rows).collect()]
        assert classes(links) == want
    most = simhash._dealt(table, simhash.RADIUS, 64).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max("n")).first()[0]
    assert most < 64 * 3


def test_simhash_of_empty_table(spark):
    assert simhash.simhash_components(common.empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [
        (200, 200), (-5, 3)]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for n in sorted(near):
        if n not in want:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = n
                    todo += near[x]
    got = components.components(spark.createDataFrame(links, "u long, v long"), len(near)).collect()
    assert {r.u: r.v for r in got} == {k: v for k, v in want.items() if k != v}


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (p != t)))
    return min(row)


def test_myers_distance():
    rng = random.Random(6)
    for _ in range(200):
        p = "".join(rng.choices("abc", k=rng.randint(1, 80)))
        t = "".join(rng.choices("abc", k=rng.randint(0, 120)))
        masks = {}
        for i, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << i
        assert decontam.least_distance(masks, len(p), t) == least_distance(p, t)


def test_contaminations(spark, docs):
    rng = random.Random(8)
    items = [(i, common.prose(rng, 25)) for i in range(12)] + [(50, None), (51, " "), (None, "a null key item text"),
                                                              (60, "zq")]
    planted = []
    for i in range(30):
        text = items[i % 12][1]
        letters = list(text.upper() if i % 3 else text.replace(" ", "\n\t"))
        for _ in range(rng.choice([0, 2, 5, 9, 25])):
            k = rng.randrange(len(letters))
            letters[k] = rng.choice(["", "x", letters[k] + "y"])
        planted.append((800 + i, common.prose(rng, 30) + " " + "".join(letters) + " " + common.prose(rng, 20), "en", "a", 1))
    planted.append((900, "at zq end", "en", "a", 1))
    table = docs.unionByName(spark.createDataFrame(planted, common.SCHEMA)).filter("doc_id is null or doc_id > -6")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = defaultdict(list)
    for r in decontam.contaminations(table, bench, block_bytes=700).collect():  # several blocks
        got[r.doc_id].append({m["item"]: m["errors"] for m in r.matches})
    for r in table.collect():
        if r.doc_id is None or r.doc_id < 780 and r.doc_id % 10:
            continue
        text, want = decontam.normalised(r.text or ""), {}
        for key, item in items:
            item = decontam.normalised(item or "")
            if item and (d := least_distance(item, text)) <= int(decontam.ERROR_RATE * len(item)):
                want[key] = d
        assert want in got[r.doc_id]
    found = sum(bool(m) for x in got.values() for m in x)
    assert found > 15
    extra = common.clashing(table)
    clean = decontam.drop_contaminated(extra, bench)
    assert clean.columns == extra.columns and clean.count() == table.count() - found


def test_many_blocks_run_in_waves(spark, monkeypatch):
    """Twenty blocks: one Python worker a task, waves written between."""
    rng = random.Random(12)
    items = [(i, common.prose(rng, 25)) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, common.prose(rng, 20) + " " + (items[i][1] if i < 40 else "") + " " + common.prose(rng, 20))
            for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    size = max(len(t.encode()) for _, t in items)
    monkeypatch.setattr(decontam, "_blocks", lambda *_: iter([sorted(items[i:i + 2]) for i in range(0, 40, 2)]))
    for blocks, held in ((100, 1 << 20), (7, 1), (1, 1 << 20)):
        monkeypatch.setattr(decontam, "WAVE_BLOCKS", blocks)
        monkeypatch.setattr(decontam, "HELD_BYTES", held)
        found = decontam.contaminations(table, bench, block_bytes=size)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
        assert {r.doc_id: [m["item"] for m in r.matches] for r in found.collect()} == {
            i: [i] if i < 40 else [] for i in range(60)}
        clean = decontam.drop_contaminated(table, bench, block_bytes=size)
        assert sorted(r.doc_id for r in clean.collect()) == list(range(40, 60))


def test_contaminations_of_empty_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminations(docs, bench).filter("size(matches) = 0").count() == docs.count()
    assert decontam.contaminations(common.empty(spark), bench).count() == 0
