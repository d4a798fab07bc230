"""Token counts by byte-pair merging with a heap and a linked list.

A piece of text starts as a list of single-byte symbols; the adjacent pair of
lowest rank (leftmost on ties) is popped from a heap and merged until no pair
has a rank. Every merge joins two symbols, so the count is the initial symbols
minus the merges: no token identifier is ever looked up or emitted.

The vocabulary file is read once, on the driver, and its ranked pairs (a fixed
table of the file's size) are broadcast. Each task counts its own documents
batch by batch; counts of short pieces are remembered, at most
``REMEMBERED`` at a time, so memory is bounded and a lost task just runs again.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special
strings of the file inside a text are one token each, as the file's library
treats them by default; equal texts have equal counts; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 400_000
SHORT_PIECE = 48

# Fixed pattern of the byte-level vocabularies: contractions, words, numbers,
# other signs, white space.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file:
    printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_ranks(path: str) -> tuple[dict[tuple[bytes, bytes], int], list[str]]:
    """Ranked pairs and special strings of a byte-level BPE ``.json`` file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
                                 "use_regex": True} or spec["normalizer"] is not None:
        raise ValueError("only plain byte-level vocabularies are counted")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("special strings that take in their surroundings are not counted")
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    return {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}, [t["content"] for t in spec["added_tokens"]]


def count_symbols(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Symbols left once every ranked pair of ``piece`` has been merged."""
    n = len(piece)
    symbol: list[bytes | None] = [piece[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbol[i], symbol[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        # Stale entries: the left symbol is gone, or its pair has changed.
        if symbol[i] is None or j >= n or ranks.get((symbol[i], symbol[j])) != rank:
            continue
        symbol[i], symbol[j] = symbol[i] + symbol[j], None
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((symbol[i], symbol[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get((symbol[h], symbol[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return n - merges


class Remembered(dict):
    """Counts by piece; forgets all of them when there are too many."""

    def __init__(self, ranks):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> int:
        n = count_symbols(piece.encode(), self.ranks)
        if len(piece) <= SHORT_PIECE:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


def text_counter(ranks, specials: list[str]):
    """A function from text to its number of tokens."""
    special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
    count = Remembered(ranks).__getitem__

    def tokens(text: str) -> int:
        if special is None:
            return sum(map(count, PIECES.findall(text)))
        parts = special.split(text)
        return len(parts) - 1 + sum(sum(map(count, PIECES.findall(p))) for p in parts)

    return tokens


_COUNTERS: dict[str, object] = {}


def count_tokens(docs: DataFrame, path: str, *, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: UTF-8 bytes, tokens, and whether they exceed ``limit``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))  # a fixed vocabulary file
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _COUNTERS:  # one per worker process: what it remembers serves later tasks
            _COUNTERS.clear()
            _COUNTERS[name] = text_counter(*shared.value)
        tokens = _COUNTERS[name]
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                                   pa.array(map(tokens, texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    counted = picked.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
