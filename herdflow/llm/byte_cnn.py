"""Byte-level convolutional quality classifier in numpy.

A document's bytes are cut into overlapping chunks that cover all of it. In a
chunk, learned filters slide over the embedded bytes (``WIDTH`` bytes, every
``STRIDE``) and each filter's largest response is kept; a small layer combines
the filters of a chunk, its units are max-pooled over all chunks, and a
logistic unit makes one probability of them. Only bytes enter a score.

Fitting uses at most ``TRAIN_ROWS`` labelled documents per label (lowest hash of
the key, never held-out ones), weighted back to the labels' shares; that bound
lets the sample be read on the driver. Scoring reads every byte of every
document, a few chunks at a time, and broadcasts the weights (a few thousand
numbers).

Defined results: null counts as the empty text, which is one chunk of padding;
a key without a label is only scored; a key with several labels learns from
the lowest; without labelled rows every score is 0.5; equal texts score alike
up to the last digits of arithmetic; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdflow.llm.common import key_text

HELD_OUT_MOD = 5
THRESHOLD = 0.3
TRAIN_ROWS = 1_500
CHUNK, STEP = 1024, 896
WIDTH, STRIDE = 8, 4
EMBED, FILTERS, UNITS = 8, 24, 16
STEPS, ROWS_A_STEP, RATE = 800, 32, 0.01
BLOCK = 128  # chunks computed at a time
SEED = 7

WINDOWS = (CHUNK - WIDTH) // STRIDE + 1


def chunks_of(data: bytes) -> np.ndarray:
    """(chunks, CHUNK) bytes, zero-padded; at least one chunk."""
    n = max(1, -(-max(0, len(data) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[:len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class ByteCnn:
    """The network; ``weights`` maps names to arrays."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        if weights is None:
            rng = np.random.default_rng(SEED)
            draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
            weights = {
                "embed": draw(256, EMBED, scale=0.5), "filters": draw(WIDTH * EMBED, FILTERS, scale=0.2),
                "bias": np.zeros(FILTERS, np.float32), "units": draw(FILTERS, UNITS, scale=0.3),
                "unit_bias": np.full(UNITS, 0.1, np.float32), "out": draw(UNITS, scale=0.3),
                "out_bias": np.zeros(1, np.float32)}
        self.weights = weights

    def responses(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, and its window."""
        w, best, at = self.weights, [], []
        for i in range(0, len(chunks), BLOCK):
            block = chunks[i:i + BLOCK]
            embedded = w["embed"][block].reshape(len(block), CHUNK * EMBED)
            windows = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBED, axis=1)[:, ::STRIDE * EMBED]
            z = windows.reshape(-1, WIDTH * EMBED) @ w["filters"]
            z = z.reshape(len(block), WINDOWS, FILTERS)
            where = z.argmax(axis=1)
            at.append(where)
            best.append(np.take_along_axis(z, where[:, None, :], axis=1)[:, 0, :] + w["bias"])
        return np.concatenate(best), np.concatenate(at)

    def logits(self, responses: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One logit per document; ``starts`` has each one's first chunk."""
        w = self.weights
        units = np.maximum(np.maximum(responses, 0) @ w["units"] + w["unit_bias"], 0)
        return np.maximum.reduceat(units, starts, axis=0) @ w["out"] + w["out_bias"][0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        parts = [chunks_of(t) for t in texts]
        starts = np.cumsum([0, *(len(p) for p in parts)])[:-1]
        responses = np.concatenate([self.responses(p)[0] for p in _packs(parts)])
        return 1 / (1 + np.exp(-self.logits(responses, starts).astype(np.float64)))

    def gradients(self, parts: list[np.ndarray], labels: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss over a few documents."""
        w = self.weights
        chunks = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        r, at = self.responses(chunks)
        active = np.maximum(r, 0)
        units = np.maximum(active @ w["units"] + w["unit_bias"], 0)
        pooled = np.maximum.reduceat(units, starts, axis=0)
        p = 1 / (1 + np.exp(-(pooled @ w["out"] + w["out_bias"][0])))
        d = ((p - labels) * share / share.sum()).astype(np.float32)
        g = {"out": pooled.T @ d, "out_bias": np.array([d.sum()], np.float32)}
        # Each pooled unit passes its gradient to the first chunk that reached it.
        hit = units == pooled[owner]
        before = np.cumsum(hit, axis=0) - hit
        first = hit & (before == before[starts][owner])
        d_units = np.where(first & (units > 0), d[owner, None] * w["out"], 0).astype(np.float32)
        g["units"], g["unit_bias"] = active.T @ d_units, d_units.sum(axis=0)
        d_r = np.where(r > 0, d_units @ w["units"].T, 0).astype(np.float32)
        g["bias"] = d_r.sum(axis=0)
        c, f = np.nonzero(d_r)
        seen = chunks[c[:, None], at[c, f][:, None] * STRIDE + np.arange(WIDTH)]
        value = d_r[c, f][:, None]
        g["filters"] = np.zeros_like(w["filters"])
        np.add.at(g["filters"].T, f, w["embed"][seen].reshape(len(c), -1) * value)
        g["embed"] = np.zeros_like(w["embed"])
        np.add.at(g["embed"], seen, (w["filters"].T[f] * value).reshape(len(c), WIDTH, EMBED))
        return g


def _packs(parts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Chunks of consecutive documents, about BLOCK at a time."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p)
        if n >= BLOCK:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def fit(texts: list[bytes], labels: list[int], shares: list[float]) -> ByteCnn:
    """Fit by Adam; ``shares`` weighs each row. Same rows, same weights."""
    net, rng = ByteCnn(), np.random.default_rng(SEED)
    y, share = np.array(labels, np.float32), np.array(shares, np.float32)
    if len(y):
        mean = float(np.clip((y * share).sum() / share.sum(), 0.01, 0.99))
        net.weights["out_bias"][0] = np.log(mean / (1 - mean))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    order = np.zeros(0, np.int64)
    for step in range(1, STEPS + 1 if len(y) else 1):
        if not len(order):
            order = rng.permutation(len(y))
        rows, order = order[:ROWS_A_STEP], order[ROWS_A_STEP:]
        g = net.gradients([chunks_of(texts[k]) for k in rows], y[rows], share[rows])
        rate = RATE * (1 - step / (STEPS + 1))
        for k, (m, v) in moment.items():
            m += 0.1 * (g[k] - m)
            v += 0.001 * (g[k] ** 2 - v)
            net.weights[k] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def is_held_out(id_col: str) -> Column:
    return F.crc32(key_text(id_col).cast("binary")) % HELD_OUT_MOD == 0


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", rows: int = TRAIN_ROWS) -> ByteCnn | None:
    """Fit on at most ``rows`` documents per label; None without any."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~is_held_out(id_col)).groupBy(
        F.col(id_col).alias("__key")).agg(F.min(label_col).cast("int").alias("label"))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for label in sorted(n):
        some = known.filter(F.col("label") == label).orderBy(F.xxhash64("__key"), "__key").limit(rows)
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        return None
    sample = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("text")).join(
        F.broadcast(picked), F.col("__id") == F.col("__key"))  # at most rows per label
    # Repeated keys may give a label more rows than keys: one text per key.
    got = sample.groupBy("__id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).collect()
    got.sort(key=lambda r: str(r["__id"]))
    if not got:
        return None
    here = {label: sum(r["label"] == label for r in got) for label in n}
    return fit([r["text"].encode() for r in got], [r["label"] for r in got], [n[r["label"]] / here[r["label"]] for r in got])


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: held-out flag, score, and predicted label."""
    net = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    weights = docs.sparkSession.sparkContext.broadcast(net.weights if net else None)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteCnn(weights.value) if weights.value is not None else None
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            for i in range(0, batch.num_rows if model else 0, BLOCK):
                texts = [(t.as_py() or "").encode() for t in batch.column(1)[i:i + BLOCK]]
                scores[i:i + BLOCK] = model.score(texts)
            yield pa.record_batch([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    scored = picked.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
