"""Long-repeat removal with run-length (r-) indexes over content shards.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else in
the corpus is removed. One index of the whole corpus fits no machine, so the
corpus is cut by content: a window of ``LENGTH`` bytes belongs to the smallest
hash among its ``ANCHOR``-byte substrings, hence equal windows belong to the
same anchor wherever they stand. Consecutive windows of one anchor form a
segment, which holds each of its windows exactly once.

1. Anchors are counted over all documents; those that occur once (at one place
   of one segment) hold no repeat. The others' segments are kept, and equal segments (same anchor, same
   content hash) become one with a weight, before and after the shuffle.
2. A task gets whole anchors, concatenates their distinct segments and builds
   the Burrows-Wheeler transform of that text (prefix doubling). Only its runs
   matter from here: at the text position of each run's first and last row it
   samples the neighbouring suffix and their common prefix.
3. Streaming over the text, the match with the preceding (following) suffix at
   a position is that of the last sample before it less the distance, which
   gives the longest match of every position with any other. Positions with
   ``LENGTH`` or more, or in a segment of weight two, are marked.
4. Marks go back to every document that holds the segment, and the covered
   bytes are cut out.

Hashes only route and merge: a window's verdict comes from the index over
bytes, except that segments (and texts) count as equal by 128 bits of hash.

An anchor with more than ``HOT_SEGMENTS`` distinct segments does not go to one
task: its windows are keyed one by one by two hashes and counted with partial
aggregation, which splits it evenly and gives the same verdicts.

Defined results: null text counts as empty; texts shorter than ``LENGTH`` lose
nothing; two equal texts of that length or more lose everything; matches never
cross documents; an empty table gives an empty result; the keys are only passed
on, so null or repeated keys are fine.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from herdflow.llm.common import text_or_empty
from herdflow.operators.joins import materialize

LENGTH = 200
ANCHOR = 32
CHUNK = 2 << 20  # bytes of segments indexed at a time, unless one anchor has more
HOT_SEGMENTS = 20_000
SHIFT = 10  # a segment has under 2**SHIFT windows

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()


def segments(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each segment, and
    whether it has its anchor more than once."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(bool)
    words = _words(np.frombuffer(data, np.uint8))
    kmers = len(data) - ANCHOR + 1
    h = words[:kmers] * _MIX[0]
    for i in range(1, ANCHOR // 8):
        h += words[8 * i:8 * i + kmers] * _MIX[i]
    h ^= h >> np.uint64(32)
    h *= _MIX[3]
    h ^= h >> np.uint64(29)
    # Least hash in every window: prefix and suffix minima of blocks as long as it.
    width = length - ANCHOR + 1
    padded = np.full(-(-kmers // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:kmers] = h
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    least = np.minimum(ahead[:n], behind[width - 1:width - 1 + n])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.append(first, n))
    # Runs of one hash longer than a window's substrings (periodic text) are cut.
    pieces = -(-size // width)
    if (pieces > 1).any():
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, size = np.repeat(first, pieces) + nth * width, np.repeat(size, pieces) - nth * width
        size = np.minimum(size, width)
    return least[first].view(np.int64), first, size, _anchor_repeats(h, least, first, size, width)


def _anchor_repeats(h: np.ndarray, least: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Whether a segment has its anchor at more than one place: if not, no two
    of its own windows are equal."""
    out = np.zeros(len(first), bool)
    span = np.arange(width)
    for i in range(0, len(first), 4096):
        a = first[i:i + 4096]
        b = a + size[i:i + 4096] - 1
        value = least[a][:, None]
        leftmost = a + (h[a[:, None] + span] == value).argmax(axis=1)
        rightmost = b + width - 1 - (h[b[:, None] + span[::-1]] == value).argmax(axis=1)
        out[i:i + 4096] = leftmost != rightmost
    return out


def suffix_array(text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse for concatenated segments; ``left`` is the
    number of bytes from each position to its segment's end mark. End marks are
    smaller than any byte and ordered by place."""
    n, step = len(text), 7
    symbols = np.zeros(n + step, np.int64)
    symbols[:n] = np.where(left > 0, text.astype(np.int64) + 1, 0)
    key = np.zeros(n, np.int64)
    for i in range(step):
        key <<= 9
        key |= np.where(left > i, symbols[i:i + n], 0)
    order = np.argsort(key, kind="stable")
    ended = left[order] < step
    head = np.ones(n, bool)
    head[1:] = (key[order][1:] != key[order][:-1]) | ended[1:] | ended[:-1]
    rank = np.empty(n, np.int64)
    slots = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(head, slots, 0))
    while True:
        single = head & np.append(head[1:], True)
        open_slots = np.flatnonzero(~single)
        if not len(open_slots):
            return order, rank
        at = order[open_slots]
        keys = rank[at] * n + rank[at + step]
        by = np.argsort(keys, kind="stable")
        at, keys = at[by], keys[by]
        order[open_slots] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        head[open_slots] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, open_slots, 0))
        step *= 2


def _common(words: np.ndarray, left: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at p and q, inside their segments."""
    most = np.minimum(left[p], left[q])
    out = np.zeros(len(p), np.int64)
    live = np.arange(len(p))
    while len(live):
        off = out[live]
        diff = words[p[live] + off] ^ words[q[live] + off]
        same = diff == 0
        low = diff[~same]
        out[live[~same]] += np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
        live = live[same]
        out[live] += 8
        live = live[out[live] < most[live]]
    return np.minimum(out, most)


def longest_matches(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each position of the concatenated parts (an end mark after each):
    its longest match with any other position, and the bytes left in its part."""
    sizes = np.array([len(p) for p in parts], np.int64)
    text = np.frombuffer(b"\xff".join(parts) + b"\xff" + bytes(16), np.uint8)
    n = int(sizes.sum()) + len(parts)
    ends = np.cumsum(sizes + 1) - 1
    left = np.repeat(ends, sizes + 1) - np.arange(n)
    words = _words(text)
    order, rank = suffix_array(text[:n], left)
    # Runs of the transform; the byte before a part's first is a mark of its own.
    before = np.where(order > 0, text[order - 1], 255)
    opens = np.ones(n + 1, bool)  # slot starts a run
    opens[1:n] = (before[1:] != before[:-1]) | (before[1:] == 255)
    longest = np.zeros(n, np.int64)
    places = np.arange(n)
    for sampled, neighbour in ((opens[:n], -1), (opens[1:], 1)):
        slot = np.flatnonzero(sampled)
        slot = slot[(slot + neighbour >= 0) & (slot + neighbour < n)]
        match = np.zeros(n, np.int64)
        at = order[slot]
        match[at] = _common(words, left, at, order[slot + neighbour])
        # Stream: from sample to sample the match shrinks by one a position.
        last = np.maximum.accumulate(np.where(sampled[rank], places, 0))
        longest = np.maximum(longest, match[last] - (places - last))
    return longest, left


def repeated_runs(parts: list[bytes], weights: list[int], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Arrays (part, first, last): runs of windows that start somewhere else too."""
    longest, left = longest_matches(parts)
    sizes = np.array([len(p) for p in parts], np.int64) + 1
    part = np.repeat(np.arange(len(parts)), sizes)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    marked = (left >= length) & ((longest >= length) | (np.repeat(np.array(weights), sizes) > 1))
    edge = np.diff(np.concatenate([[0], marked.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return part[first], first - start[first], last - start[first]


def _document_segments(with_content: bool, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, rows, places, contents, counts = [], [], [], [], []
            texts = batch.column(0).dictionary_encode()  # equal texts of a batch are cut once
            copies = np.bincount(texts.indices.to_numpy(), minlength=len(texts.dictionary))
            first_row = np.zeros(len(copies), np.int64)
            first_row[texts.indices.to_numpy()[::-1]] = np.arange(batch.num_rows)[::-1]
            for row, text, n in zip(first_row.tolist(), texts.dictionary, copies.tolist(), strict=True):
                data = text.as_py().encode()
                h, first, size, repeats = segments(data, length)
                # An anchor that a segment has more than once counts twice.
                hs.append(h if with_content else np.append(h, h[repeats | (n > 1)]))
                if with_content:
                    rows.append(np.full(len(h), row))
                    counts.append(np.full(len(h), n))
                    places.append(first << SHIFT | size)
                    contents += [xxh3_64_intdigest(data[a:b]) for a, b in
                                 zip(first.tolist(), (first + size + length - 1).tolist(), strict=True)]
            h = pa.array(np.concatenate(hs) if hs else np.zeros(0, np.int64))
            if not with_content:
                yield pa.record_batch([h], names=["h"])
                continue
            row = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            yield pa.record_batch([h, pa.array(np.array(contents, np.uint64).view(np.int64)),
                                   batch.column(1).take(row), batch.column(2).take(row),
                                   pa.array(np.concatenate(places) if places else np.zeros(0, np.int64)),
                                   pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))],
                                  names=["h", "content", "d1", "d2", "place", "n"])
    return run


def _cut_segments(length: int):
    """(text, wanted segments) -> their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_py().encode()
                for x in wanted.as_py():
                    first, size = x["place"] >> SHIFT, x["place"] & ((1 << SHIFT) - 1)
                    for column, value in zip(out, (x["h"], x["content"], x["n"],
                                                   data[first:first + size + length - 1]), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                   pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
                                  names=["h", "content", "n", "part"])
    return run


def _index(length: int, chunk: int):
    """Rows (h, content, n, part) sorted by h -> runs of repeated windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            unique = list({(h, c): (h, c, n, p) for h, c, n, p in rows}.values())
            at, first, last = repeated_runs([r[3] for r in unique], [r[2] for r in unique], length)
            return pa.record_batch([pa.array(np.array([r[0] for r in unique], np.int64)[at]),
                                    pa.array(np.array([r[1] for r in unique], np.int64)[at]),
                                    pa.array(first), pa.array(last)], names=["h", "content", "first", "last"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= chunk and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush(held)
    return run


def _windows(length: int):
    """Rows (h, content, n, part) -> one row per window with its two hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, content, n, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces = [part[i:i + length] for i in range(len(part) - length + 1)]
                a = np.array([xxh3_64_intdigest(p) for p in pieces], np.uint64).view(np.int64)
                b = np.array([xxh3_64_intdigest(p, 1) for p in pieces], np.uint64).view(np.int64)
                k = len(pieces)
                yield pa.record_batch([pa.array(np.full(k, h)), pa.array(np.full(k, content)),
                                       pa.array(np.full(k, n)), pa.array(np.arange(k)), pa.array(a), pa.array(b)],
                                      names=["h", "content", "n", "first", "a", "b"])
    return run


def _strip(length: int):
    """(key, text, runs of windows) -> the result row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode()
                spans: list[list[int]] = []
                for x in runs.as_py() or ():
                    if spans and x["first"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x["last"] + length)
                    else:
                        spans.append([x["first"], x["last"] + length])
                kept, at = sha256(), 0
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                for column, value in zip(out, (len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest(),
                                               [{"first": a, "end": b} for a, b in spans]), strict=True):
                    column.append(value)
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3]),
                                   pa.array(out[4], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
                                  names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    return run


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   chunk: int = CHUNK, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """One row per document: bytes, bytes removed, number of removed spans,
    SHA-256 of what is left, and the spans (byte offsets, end exclusive)."""
    if length < ANCHOR + 8 or length - ANCHOR + 1 >= 1 << SHIFT:
        raise ValueError("length out of range")
    text = text_or_empty(text_col).cast("string")
    digest = F.md5(text.cast("binary"))
    half = lambda a: F.conv(F.substring(digest, a, 15), 16, 10).cast("long")  # noqa: E731  120 bits in all
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), half(1).alias("d1"),
                        half(16).alias("d2"))

    # 1. Segments whose anchor occurs more than once, with their documents.
    counted = keyed.select("text").mapInArrow(_document_segments(False, length), "h long")
    again = counted.groupBy(F.col("h").alias("anchor")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = keyed.select("text", "d1", "d2").mapInArrow(
        _document_segments(True, length), "h long, content long, d1 long, d2 long, place long, n long")
    found = found.join(again, F.col("h") == F.col("anchor"), "left_semi")
    # The sum goes by an expression of the anchor, so it deals the rows of a hot
    # anchor anew, by all of its keys.
    apart = found.withColumn("h", F.col("h").bitwiseXOR(F.lit(0)))
    held = materialize(apart.groupBy("h", "content", "d1", "d2", "place").agg(F.sum("n").alias("n")), "segments")

    # Distinct segments, each with its weight and one document to cut it from.
    distinct = held.groupBy("h", "content").agg(F.sum("n").alias("n"), F.first("d1").alias("d1"),
                                                F.first("d2").alias("d2"), F.first("place").alias("place"))
    wanted = distinct.groupBy(F.col("d1").alias("w1"), F.col("d2").alias("w2")).agg(
        F.collect_list(F.struct("h", "content", "n", "place")).alias("wanted"))
    texts = keyed.select("text", "d1", "d2").dropDuplicates(["d1", "d2"])
    parts = materialize(texts.join(wanted, (F.col("d1") == F.col("w1")) & (F.col("d2") == F.col("w2"))).select(
        "text", "wanted").mapInArrow(_cut_segments(length), "h long, content long, n long, part binary"), "parts")

    # 2. and 3. Indexes over whole anchors; hot ones window by window.
    hot = parts.groupBy(F.col("h").alias("hot")).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > hot_segments)
    cool = parts.join(hot, F.col("h") == F.col("hot"), "left_anti").repartition("h").sortWithinPartitions("h")
    runs = cool.mapInArrow(_index(length, chunk), "h long, content long, first long, last long")
    windows = parts.join(hot, F.col("h") == F.col("hot"), "left_semi").mapInArrow(
        _windows(length), "h long, content long, n long, first long, a long, b long")
    twice = windows.groupBy(F.col("a").alias("wa"), F.col("b").alias("wb")).agg(F.sum("n").alias("all")).filter(
        F.col("all") > 1)
    hot_runs = windows.join(twice, (F.col("a") == F.col("wa")) & (F.col("b") == F.col("wb")), "left_semi").select(
        "h", "content", "first", F.col("first").alias("last"))
    marks = runs.unionByName(hot_runs).select(F.col("h").alias("mh"), F.col("content").alias("mc"), "first", "last")

    # 4. Back to the documents.
    of_text = held.select("h", "content", "d1", "d2", F.shiftright("place", SHIFT).alias("at")).join(
        marks, (F.col("h") == F.col("mh")) & (F.col("content") == F.col("mc")))
    runs_of = of_text.groupBy(F.col("d1").alias("r1"), F.col("d2").alias("r2")).agg(F.sort_array(F.collect_list(
        F.struct((F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last")))).alias("runs"))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    joined = keyed.join(runs_of, (F.col("d1") == F.col("r1")) & (F.col("d2") == F.col("r2")), "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(
        _strip(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<first:long,end:long>>")
