"""Token counts, the classifier and the language model."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from herdflow.llm import bpe_count, byte_cnn, kneser_ney
from tests.llm import common

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark).cache()


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_counts_equal_the_library():
    rng, library = random.Random(4), tokenizer()
    count = bpe_count.text_counter(*bpe_count.read_ranks(P.path("byte_bpe_50k.json")))
    letters = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　​'sdtmrevl019²½Ⅷaé中🤦́_-<|endoftext|>"
    texts = ["", "a" * 3000, "don't  stop<|endoftext|><|endoftext|> x", common.prose(rng, 300)]
    texts += ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(2000)]
    for t in texts:
        assert count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_token_table(spark, docs):
    library = tokenizer()
    got = common.rows(bpe_count.count_tokens(common.clashing(docs), P.path("byte_bpe_50k.json"), limit=50),
                      "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for r in docs.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((str(r.doc_id), str(len((r.text or "").encode())), str(n), str(n > 50)))
    assert got == sorted(want)
    assert bpe_count.count_tokens(common.empty(spark), P.path("byte_bpe_50k.json")).count() == 0


def test_remembered_counts_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe_count, "REMEMBERED", 10)
    memo = bpe_count.Remembered({})
    assert [memo[str(i)] for i in range(100, 150)] == [3] * 50 and len(memo) <= 10


def test_chunks_cover_everything():
    for n in (0, 1, 1023, 1024, 1025, 1920, 5000):
        data = bytes(i % 251 + 1 for i in range(n))
        chunks = byte_cnn.chunks_of(data)
        back = b"".join(bytes(c[:byte_cnn.STEP]) for c in chunks[:-1]) + bytes(chunks[-1])
        assert back.rstrip(b"\0") == data and chunks.shape[1] == byte_cnn.CHUNK


def test_gradients():
    rng = np.random.default_rng(0)
    net = byte_cnn.ByteCnn({k: v.astype(np.float64) for k, v in byte_cnn.ByteCnn().weights.items()})
    texts = [bytes(rng.integers(97, 120, n).astype(np.uint8)) for n in (30, 1500, 2500)]
    parts, y, share = [byte_cnn.chunks_of(t) for t in texts], np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        p = net.score(texts)
        return -(share * np.log(np.where(y == 1, p, 1 - p))).sum() / share.sum()

    g = net.gradients(parts, y, share)
    for name, w in net.weights.items():
        for at in [np.unravel_index(np.abs(g[name]).argmax(), w.shape)]:
            old, eps = w[at], 1e-4
            w[at] = old + eps
            up = loss()
            w[at] = old - eps
            down = loss()
            w[at] = old
            assert g[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.02, abs=1e-4), name


def test_classifier_learns_and_holds_out(spark, docs):
    rng = random.Random(9)
    rows = [(1000 + i, " ".join(w.upper() + "!!" for w in common.prose(rng, 60).split()) if i % 3 == 0
             else common.prose(rng, 60), "en", "a", 1) for i in range(150)]
    table = docs.unionByName(spark.createDataFrame(rows, common.SCHEMA))
    labels = spark.createDataFrame([(r[0], 0 if r[0] % 3 == 1 else 1, 0) for r in rows] + [(None, 1, 0), (7, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = byte_cnn.score_quality(common.clashing(table), labels).collect()
    assert len(got) == table.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 1000]
    right = sum(r.predicted == (0 if r.doc_id % 3 == 1 else 1) for r in held)
    assert len(held) > 15 and right / len(held) > 0.9


def test_classifier_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in byte_cnn.score_quality(docs, none).collect()} == {0.5}
    assert byte_cnn.score_quality(common.empty(spark), none).count() == 0


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["</s>"]


def test_kneser_ney(spark, docs, monkeypatch):
    monkeypatch.setattr(kneser_ney, "TOKENS_PER_SHARD", 3000)
    got = kneser_ney.score_corpus(common.clashing(docs)).collect()
    rows = docs.collect()
    held = lambda key: zlib.crc32(("null" if key is None else str(key)).encode()) % 10 == 0
    train = [tokens(r.text) for r in rows if not held(r.doc_id)]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t))
    of = Counter(pairs.values())
    d = [0, *kneser_ney.discounts([of[k] for k in (1, 2, 3, 4)])]
    context, heads = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (a, b), k in pairs.items():
        context[a][0] += k
        context[a][min(k, 3)] += 1
        heads[b] += 1
    of = Counter(heads.values())
    e = [0, *kneser_ney.discounts([of[k] for k in (1, 2, 3, 4)])]
    spare = (e[1] * of[1] + e[2] * of[2] + e[3] * sum(x for k, x in of.items() if k > 2)) / len(pairs)

    def p(a, b):
        lower = max(heads[b] - e[min(heads[b], 3)], 0) / len(pairs) + spare / (v + 1)
        if a not in context:
            return lower
        s, k = context[a], pairs[a, b]
        return max(k - d[min(k, 3)], 0) / s[0] + sum(x * y for x, y in zip(d[1:], s[1:])) / s[0] * lower

    assert sum(p("the", w) for w in count) < 1 < sum(p("the", w) for w in count) + 0.05
    want = defaultdict(list)
    for r in rows:
        t = tokens(r.text)
        want[r.doc_id].append((len(t), sum(count[w] > 0 for w in t),
                               sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t),
                               sum(math.log10(p(a, b)) for a, b in zip(["<s>", *t], t))))
    assert len(got) == len(rows)
    for r in got:
        assert r.train_tokens == n and r.held_out == held(r.doc_id)
        assert any(r.n_tokens == x[0] and r.n_known == x[1] and abs(r.base_score - x[2]) < 1e-6
                   and abs(r.score - x[3]) < 1e-6 for x in want[r.doc_id])


def test_kneser_ney_without_training_rows(spark):
    assert kneser_ney.score_corpus(common.empty(spark)).count() == 0
    model = kneser_ney.train(common.empty(spark))
    one = kneser_ney.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (one.n_tokens, one.n_known, one.base_score, one.score) == (3, 0, 0.0, 0.0)


def test_packed_pairs_come_back():
    rng = np.random.default_rng(1)
    u = np.sort(rng.integers(0, 2**63, 500, dtype=np.uint64)).repeat(2)
    v, c = rng.integers(0, 2**48, 1000, dtype=np.uint64), rng.integers(1, 2**31, 1000)
    for a, b in zip(kneser_ney.unpack_pairs(kneser_ney.pack_pairs(u, v, c)), (u, v, c)):
        assert (a == b).all()
