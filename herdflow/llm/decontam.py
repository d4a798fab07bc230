"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``m`` normalised characters may differ from a passage by
``k = floor(ERROR_RATE * m)`` edits. Cut into ``k + 1`` pieces, at least one
piece of it must occur unchanged in any such passage, so all pieces are sought
at once (one automaton pass over the text), and the text around every hit is
verified with Myers' bit-parallel edit distance, which finds the least distance
of the whole item to any substring there.

Texts are normalised by lower-casing and by making every run of white space
one space. Whole texts are searched. The items are the stated query set: they
are read in blocks of about ``BLOCK_BYTES`` of text (by hash), each block is
broadcast. A task holds ``HELD_BYTES`` of documents at a time and goes through
the blocks of a wave one after another, with one block's automaton in memory;
after ``WAVE_BLOCKS`` blocks the rows so far are written to the shared folder.
So any number of items is answered exactly by one worker and one automaton a
task; documents never shuffle.

Defined results: a null text is empty and matches nothing; items without any
character match nothing; an item shorter than ``1 / ERROR_RATE`` characters
must occur exactly; items of equal text all match; equal texts match equally;
empty documents or items give no match. Extra columns are passed on as they
are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdflow.operators.joins import materialize

ERROR_RATE = 0.08
BLOCK_BYTES = 8 << 20
WAVE_BLOCKS = 16
HELD_BYTES = 32 << 20


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def least_distance(masks: dict[str, int], m: int, text: str) -> int:
    """Least edit distance of a pattern of ``m`` characters to any substring
    of ``text``; ``masks`` has a bit per place of each character (Myers)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        up = mh | (full & ~(xv | ph))
        down = ph & xv
    return best


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float = ERROR_RATE):
        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            text = normalised(text or "")
            m = len(text)
            if not m:
                continue
            k = int(error_rate * m)
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            at = [m * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(at, at[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((len(self.items), b - 1))
            self.items.append((key, masks, m, k))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, owners)
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[object, int]]:
        """(item key, least distance) of each item found, in block order."""
        if not self.items:
            return []
        text = normalised(text)
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, owners in self.automaton.iter(text):
            for item, last in owners:
                _, _, m, k = self.items[item]
                begin = end - last
                spans.setdefault(item, []).append((max(0, begin - k), begin + m + k))
        found = []
        for item in sorted(spans):
            key, masks, m, k = self.items[item]
            best, reach = m, -1
            low = high = -1
            # Spans of one item that overlap are verified as one.
            for a, b in [*sorted(spans[item]), (len(text) + 2 * m, 0)]:
                if a > reach:
                    if high > low:
                        best = min(best, least_distance(masks, m, text[low:high]))
                        if not best:
                            break
                    low = a
                    high = reach = b
                elif b > reach:
                    high = reach = b
            if best <= k:
                found.append((key, best))
        return found


_MATCHERS: dict[str, Matcher] = {}


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about ``block_bytes``, the most ever on the driver."""
    picked = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter(
        F.col("text").isNotNull())
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    part = F.pmod(F.xxhash64("text"), F.lit(max(1, blocks)))
    for block in range(blocks):
        rows = picked.filter(part == block).collect()
        yield sorted(((r.id, r.text) for r in rows), key=lambda x: (x[0] is None, x))


def _shared(block: list[tuple[object, str]], error_rate: float, context) -> Callable[[], Matcher]:
    """A function that gives the block's matcher inside a task."""
    name, shared = uuid.uuid4().hex, context.broadcast(block)

    def matcher() -> Matcher:
        if name not in _MATCHERS:  # one per worker process
            _MATCHERS.clear()
            _MATCHERS[name] = Matcher(shared.value, error_rate)
        return _MATCHERS[name]
    return matcher


def _waves(items: DataFrame, id_col: str, text_col: str, error_rate: float,
           block_bytes: int) -> Iterator[list[Callable[[], Matcher]]]:
    """The matchers of all blocks, at most ``WAVE_BLOCKS`` at a time."""
    context = items.sparkSession.sparkContext
    blocks = _blocks(items, id_col, text_col, block_bytes)
    while wave := [_shared(block, error_rate, context) for block in islice(blocks, WAVE_BLOCKS)]:
        yield wave


def _search(batches: Iterator[pa.RecordBatch], wave: list[Callable[[], Matcher]], place: int,
            first: bool) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[object, int]]]]]:
    """Each batch with the matches of every row; ``first`` stops a row at the
    first block that matches. Batches are held together where there are several
    blocks, so that a matcher is made once for all of them."""
    limit = HELD_BYTES if len(wave) > 1 else 0
    held: list[pa.RecordBatch] = []

    def found():
        out = [(batch, [[] for _ in range(batch.num_rows)]) for batch in held]
        for get in wave:
            matcher = get()
            for batch, rows in out:
                for text, row in zip(batch.column(place), rows, strict=True):
                    if not (first and row):
                        row += matcher.matches(text.as_py() or "")
        return out

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield from found()
            held, size = [], 0
    yield from found()


def contaminations(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   item_id_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its matches as an array of (item, errors)."""
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_id_col].dataType.simpleString()
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    hits = f"array<struct<item:{item_kind},errors:int>>"
    out = out.select("*", F.array().cast(hits).alias("matches"))
    schema = f"doc_id {kind}, text string, matches {hits}"
    for i, wave in enumerate(_waves(items, item_id_col, item_text_col, error_rate, block_bytes)):
        def run(batches: Iterator[pa.RecordBatch], wave=wave) -> Iterator[pa.RecordBatch]:
            for batch, rows in _search(batches, wave, 1, False):
                found = [before.as_py() + [{"item": i, "errors": e} for i, e in row]
                         for row, before in zip(rows, batch.column(2), strict=True)]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, batch.schema.field(2).type)],
                                      schema=batch.schema)
        out = (materialize(out, "wave") if i else out).mapInArrow(run, schema)
    return out.select("doc_id", F.sort_array("matches").alias("matches"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text", error_rate: float = ERROR_RATE,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    place = docs.columns.index(text_col)
    for i, wave in enumerate(_waves(items, item_id_col, item_text_col, error_rate, block_bytes)):
        def run(batches: Iterator[pa.RecordBatch], wave=wave) -> Iterator[pa.RecordBatch]:
            for batch, rows in _search(batches, wave, place, True):
                yield batch.filter(pa.array([not row for row in rows], pa.bool_()))
        docs = (materialize(docs, "wave") if i else docs).mapInArrow(run, docs.schema)
    return docs
