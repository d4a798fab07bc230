"""Interpolated modified Kneser-Ney word bigrams, counted in Spark and kept as
sorted hash arrays that workers memory-map.

Training, over all training documents:

1. One pass finds the number of tokens, which sets the number of shards, and
   the words that make up a 1/``HOT_SHARE`` of all tokens or more (so at most
   ``HOT_SHARE`` words).
2. Tasks count the word pairs of their batches and send every shard one packed
   row per batch: pairs go to the shard of their first word, those of hot first
   words to the shard of the pair. A shard adds them up, writes its pairs
   (sorted hashes, counts) and first words (sorted hashes; total, and followers
   seen once, twice, oftener) and sends on how many first words each second
   word has had, again packed.
3. Shards of second words add those numbers up and write them sorted.

Discounts follow from the counts of counts, which are summed in Spark. Scoring
tasks map the files they need and look their batches' distinct words and pairs
up by binary search, in sorted order. All counts grow with the corpus; nothing
is capped, and no task holds more than a batch or a shard.

Files are written under temporary names and renamed, so a task that runs again
replaces them. The shared folder (``spark.checkpoint.dir``) must be mounted as a
file path, since only files can be mapped.

Words are hashed to 64 bits; as second words of a pair to 48 of them.

Defined results: a null text has the end token only; a null key counts as the
text ``null`` for the hold-out; without any training token every probability
is that of one unknown word; equal rows score alike; an empty table gives an
empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from herdflow.llm.common import key_text
from herdflow.session import scratch_path

HOT_SHARE = 256
TOKENS_PER_SHARD = 2_500_000
BATCH_TOKENS = 2_000_000
HELD_OUT_MOD = 10
BASE_ADD = 0.1

START, END = np.uint64(1), np.uint64(2)  # hashes of the marks; no word is changed by a clash worth naming
LOW48 = np.uint64((1 << 48) - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(32))


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(u * _A + v)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words and the end token."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def token_groups(texts, most: int = BATCH_TOKENS) -> Iterator[list[np.ndarray]]:
    """Token arrays of consecutive texts, about ``most`` tokens at a time."""
    group, size = [], 0
    for text in texts:
        group.append(tokens(text.as_py()))
        size += len(group[-1])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def pairs_of(group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first, second) words of all pairs; every text starts after START."""
    v = np.concatenate(group)
    u = np.empty_like(v)
    u[1:] = v[:-1]
    u[np.cumsum([0, *map(len, group[:-1])])] = START
    return u, v & LOW48


def sum_sorted(keys: tuple[np.ndarray, ...], *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys (sorted by the first, then the next) with summed values."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    first = np.zeros(len(order), bool)
    first[:1] = True
    for k in keys:
        first[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(first)
    sums = [np.add.reduceat(v[order], at) if len(at) else v[order] for v in values]
    return (*(k[at] for k in keys), *sums)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, first bytes first: equal high
    bytes compress well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def _unplanes(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns (numbers, bytes each) of one length as one value."""
    n = len(columns[0][0])
    return n.to_bytes(8, "little") + b"".join(_planes(x, width) for x, width in columns)


def unpack(data: bytes, *widths: int) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    view = memoryview(data)
    for width in widths:
        out.append(_unplanes(view[at:], n, width))
        at += n * width
    return out


def pack_pairs(u: np.ndarray, v: np.ndarray, c: np.ndarray) -> bytes:
    """Pairs sorted by first word, which is written once."""
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    head = pack((u[first], 8), (np.diff(np.append(first, len(u))), 4))
    return len(head).to_bytes(8, "little") + head + pack((v, 6), (c, 4))


def unpack_pairs(data: bytes) -> tuple[np.ndarray, ...]:
    n = int.from_bytes(data[:8], "little")
    u, run = unpack(data[8:8 + n], 8, 4)
    v, c = unpack(data[8 + n:], 6, 4)
    return np.repeat(u, run.astype(np.int64)), v, c


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    for kind, x in arrays.items():
        path = f"{folder}/{name}.{kind}.npy"
        part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(part, "wb") as f:
            np.save(f, x)
        os.replace(part, path)


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more from the
    numbers of counts 1 to 4; each is kept between 0 and its count."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) if n[k - 1] else min(0.5, y) for k in (1, 2, 3)]


@dataclass(frozen=True)
class Model:
    """A trained model: its folder of sorted arrays and a few numbers."""
    folder: str
    shards: int
    train_tokens: int
    train_texts: int
    vocabulary: int  # distinct training tokens, the end among them
    pair_discounts: list[float]
    word_discounts: list[float]
    word_counts: list[int]  # second words that follow 1, 2, 3 or more words; all distinct pairs
    hot: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)

    def array(self, name: str) -> np.ndarray | None:
        path = f"{self.folder}/{name}.npy"
        return np.load(path, mmap_mode="r") if os.path.exists(path) else None


def _shard(x: np.ndarray, shards: int) -> np.ndarray:
    return (mix(x) >> np.uint64(16)) % np.uint64(shards)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(shard[part[0]]), part


def _pair_shard(u: np.ndarray, v: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    return _shard(np.where(np.isin(u, hot), pair_hash(u, v), u), shards)


def _followers(c: np.ndarray) -> list[np.ndarray]:
    return [c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c >= 3).astype(np.int64)]


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count ``docs`` and write the model."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "kneser-ney").removeprefix("file://")
    if "://" in folder:
        raise ValueError("memory-mapped files need a shared folder that is mounted as a file path")
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in token_groups(batch.column(0)):
                word, n = np.unique(np.concatenate(group), return_counts=True)
                often = n >= n.sum() / HOT_SHARE
                w = np.append(word[often], np.uint64(0))  # 0: all tokens
                yield pa.record_batch([pa.array(w.view(np.int64)), pa.array(np.append(n[often], n.sum())),
                                       pa.array(np.append(np.zeros(often.sum(), np.int64), len(group)))],
                                      names=["w", "n", "texts"])

    rows = texts.mapInArrow(frequent, "w long, n long, texts long").groupBy("w").agg(F.sum("n"), F.sum("texts")).collect()
    total, n_texts = next(((n, t) for w, n, t in rows if w == 0), (0, 0))
    often = sorted(w for w, n, _ in rows if w and n * HOT_SHARE >= total)
    hot = np.array(sorted(np.array([*often, 1], np.int64).view(np.uint64)), np.uint64)  # START opens every text
    shards = -(-total // TOKENS_PER_SHARD) or 1
    os.makedirs(folder, exist_ok=True)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in token_groups(batch.column(0)):
                u, v = pairs_of(group)
                u, v, c = sum_sorted((u, v), np.ones(len(u), np.int64))
                out = [(s, pack_pairs(u[part], v[part], c[part]))
                       for s, part in _by_shard(_pair_shard(u, v, hot, shards))]
                yield pa.record_batch([pa.array([s for s, _ in out], pa.int64()),
                                       pa.array([p for _, p in out], pa.binary())], names=["shard", "part"])

    def add_pairs(key, table):
        shard = key[0].as_py()
        columns = [unpack_pairs(p.as_py()) for p in table.column("part")]
        u, v, c = sum_sorted((np.concatenate([x[0] for x in columns]), np.concatenate([x[1] for x in columns])),
                             np.concatenate([x[2] for x in columns]).astype(np.int64))
        p = pair_hash(u, v)
        order = np.argsort(p, kind="stable")
        once = c[order] == 1
        _save(folder, f"pairs{shard}", once=p[order][once], more=p[order][~once],
              count=c[order][~once].astype(np.uint32))
        w, *stats = sum_sorted((u,), *_followers(c))
        is_hot = np.isin(w, hot)
        _save(folder, f"first{shard}", word=w[~is_hot], stats=np.stack(stats, axis=1)[~is_hot].astype(np.int64))
        second, heads = np.unique(v, return_counts=True)
        out = [("second", s, pack((second[part], 6), (heads[part], 5)), 0, 0, 0, 0)
               for s, part in _by_shard(_shard(second, shards))]
        out += [("hot", int(x.view(np.int64)), b"", *map(int, s))
                for x, s in zip(w[is_hot], np.stack(stats, axis=1)[is_hot], strict=True)]
        out.append(("counts", 0, b"", *(int((c == k).sum()) for k in (1, 2, 3, 4))))
        out.append(("words", 0, b"", int((~is_hot).sum()), 0, 0, 0))
        return pa.table(dict(zip(("kind", "key", "part", "a", "b", "c", "d"), map(list, zip(*out, strict=True)),
                                 strict=True)), schema=pa.schema(
            [("kind", pa.string()), ("key", pa.int64()), ("part", pa.binary()),
             *((x, pa.int64()) for x in "abcd")]))

    def add_seconds(key, table):
        shard = key[0].as_py()
        columns = [unpack(p.as_py(), 6, 5) for p in table.column("part")]
        v, heads = sum_sorted((np.concatenate([x[0] for x in columns]),),
                              np.concatenate([x[1] for x in columns]).astype(np.int64))
        _save(folder, f"second{shard}", word=v, heads=heads)
        return pa.table({x: [int(n)] for x, n in zip("abcdef", (
            *((heads == k).sum() for k in (1, 2, 3, 4)), (heads >= 3).sum(), heads.sum()), strict=True)})

    from herdflow.operators.joins import materialize

    packed = texts.mapInArrow(count_pairs, "shard long, part binary")
    first = materialize(packed.groupBy("shard").applyInArrow(
        add_pairs, "kind string, key long, part binary, a long, b long, c long, d long"), "pair-shards")
    numbers = first.filter("kind != 'second'").groupBy("kind", "key").agg(*(F.sum(x).alias(x) for x in "abcd")).collect()
    seconds = first.filter("kind = 'second'").select(F.col("key").alias("shard"), "part")
    words = seconds.groupBy("shard").applyInArrow(add_seconds, ", ".join(f"{x} long" for x in "abcdef")).agg(
        *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "abcdef")).first()
    of = {(r.kind, r.key): (r.a, r.b, r.c, r.d) for r in numbers}
    hot_stats = {k & ((1 << 64) - 1): s for (kind, k), s in of.items() if kind == "hot"}
    # Every word but the last opens a pair: distinct tokens are the first words
    # without START, and the end.
    vocabulary = of.get(("words", 0), (0,))[0] + len(set(hot_stats) - {int(START)}) + (total > 0)
    return Model(folder, shards, total, n_texts, vocabulary, discounts(list(of.get(("counts", 0), (0, 0, 0, 0)))),
                 discounts(list(words[:4])), [words.a, words.b, words.e, words.f], hot_stats)


class Scorer:
    """Looks words and pairs up in the mapped arrays of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.hot = np.array(sorted(model.hot), np.uint64)
        self.hot_stats = np.array([model.hot[int(w)] for w in self.hot], np.int64).reshape(-1, 4)
        self.maps: dict[str, np.ndarray | None] = {}

    def _map(self, name: str) -> np.ndarray | None:
        if name not in self.maps:
            self.maps[name] = self.model.array(name)
        return self.maps[name]

    def _find(self, name: str, kind: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of sorted ``keys`` in a sorted array."""
        array = self._map(f"{name}.{kind}")
        if array is None or not len(array):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(array, keys), len(array) - 1)
        return at, array[at] == keys

    def first_words(self, w: np.ndarray) -> np.ndarray:
        """Stats (total; followers seen once, twice, oftener) of sorted words."""
        out = np.zeros((len(w), 4), np.int64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, w), len(self.hot) - 1)
            is_hot = self.hot[at] == w
            out[is_hot] = self.hot_stats[at[is_hot]]
        for s, part in _by_shard(_shard(w, self.model.shards)):
            at, found = self._find(f"first{s}", "word", w[part])
            if found.any():
                out[part[found]] = self._map(f"first{s}.stats")[at[found]]
        return out

    def heads(self, v: np.ndarray) -> np.ndarray:
        """How many words each of the sorted second words has followed."""
        out = np.zeros(len(v), np.int64)
        for s, part in _by_shard(_shard(v, self.model.shards)):
            at, found = self._find(f"second{s}", "word", v[part])
            if found.any():
                out[part[found]] = self._map(f"second{s}.heads")[at[found]]
        return out

    def pair_counts(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        p, out = pair_hash(u, v), np.zeros(len(u), np.int64)
        shard = _pair_shard(u, v, np.append(self.hot, START), self.model.shards)
        for s, part in _by_shard(shard):
            part = part[np.argsort(p[part], kind="stable")]
            _, found = self._find(f"pairs{s}", "once", p[part])
            out[part[found]] = 1
            at, found = self._find(f"pairs{s}", "more", p[part])
            if found.any():
                out[part[found]] = self._map(f"pairs{s}.count")[at[found]]
        return out

    def score(self, group: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
        """(tokens, known tokens, base score, model score) of each text."""
        m = self.model
        w = np.concatenate(group)
        u, v = pairs_of(group)
        words, word_at = np.unique(np.concatenate([w, [START]]), return_inverse=True)
        word_at = word_at[:-1]
        stats = self.first_words(words)
        count = np.where(words == END, m.train_texts, stats[:, 0])[word_at]
        base = np.log10((count + BASE_ADD) / (m.train_tokens + BASE_ADD * (m.vocabulary + 1)))

        low = np.unique(words & LOW48)
        heads = self.heads(low)
        heads = heads[np.searchsorted(low, v)]
        once, twice, more, all_pairs = m.word_counts
        d = np.array([0.0, *m.word_discounts])
        spare = (d[1] * once + d[2] * twice + d[3] * more) / all_pairs if all_pairs else 1.0
        lower = spare / (m.vocabulary + 1)
        if all_pairs:
            lower = lower + np.maximum(heads - d[np.minimum(heads, 3)], 0) / all_pairs

        # Distinct pairs by their words' places.
        first_at = np.empty_like(word_at)
        first_at[1:] = word_at[:-1]
        first_at[np.cumsum([0, *map(len, group[:-1])])] = np.searchsorted(words, START)
        code, pair_at = np.unique(first_at * len(words) + word_at, return_inverse=True)
        seen = self.pair_counts(words[code // len(words)], words[code % len(words)] & LOW48)[pair_at]
        context = stats[first_at]
        e = np.array([0.0, *m.pair_discounts])
        total = np.maximum(context[:, 0], 1)
        kept = np.maximum(seen - e[np.minimum(seen, 3)], 0) / total
        share = np.where(context[:, 0] > 0, (context[:, 1:] @ e[1:]) / total, 1.0)
        score = np.log10(kept + share * lower)

        cuts = np.cumsum([0, *map(len, group)])
        return [(int(b - a), int((count[a:b] > 0).sum()), float(base[a:b].sum()), float(score[a:b].sum()))
                for a, b in zip(cuts, cuts[1:], strict=False)]


_SCORERS: dict[str, Scorer] = {}


def score_texts(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: tokens, known tokens, base score and score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.folder not in _SCORERS:  # one per worker process
            _SCORERS.clear()
            _SCORERS[model.folder] = Scorer(model)
        scorer = _SCORERS[model.folder]
        for batch in batches:
            rows = [r for group in token_groups(batch.column(1)) for r in scorer.score(group)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(
                columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def is_held_out(id_col: str) -> Column:
    return F.crc32(key_text(id_col).cast("binary")) % HELD_OUT_MOD == 0


def score_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows not held out and score all rows."""
    model = train(docs.filter(~is_held_out(id_col)), text_col)
    scored = score_texts(docs, model, id_col=id_col, text_col=text_col)
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
