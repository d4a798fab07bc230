"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point turns one into
the other. That holds exactly if their longest common prefix and suffix together
reach the longer length minus one. Blocks of words are padded code-point matrices
(the words, and the words reversed); a tile compares all pairs of two blocks at
once and reads both lengths off the runs of equal columns.

Which blocks meet: of a pair whose longer word has L code points, cut L into
SEGMENTS stretches. The edit falls into one of them, and everything before and
after it is equal in both words. So a word stands, for L its length and its length
plus one, in one cell per stretch, named by what surrounds the stretch. A pair is
counted only in the stretch where its common prefix ends, thus once. A cell with
more than CELL_WORDS words is cut into parts by hash, and every pair of parts is
a cell of its own, so no task holds more than two parts.

Defined results: null and empty texts have no words; a null ``doc_id`` counts as
the text ``null``; repeated rows count each time; words of one document are
damaged alike; ties for a form go to the smallest word in code-point order; empty
tables give no rows. Words may be of any length. Only the id and text columns are
read, whatever others are called.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdflow.operators.joins import materialize

MIN_LENGTH = 6
MIN_COUNT = 5
FORM_RATIO = 5
DAMAGE = 199
SEGMENTS = 3
CELL_WORDS = 1024
BLOCK = 128              # words of a block at most
TILE_CELLS = 1 << 22     # code points compared by a tile at most
FLUSH = 200_000          # distinct words held before counts are passed on

# Latin-1 bytes of a word: A-Z lowered, a-z and everything from U+00C0; all
# others, and what Latin-1 lacks ("?"), separate.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def damaged_counts(name: str, text: str, damage: int = DAMAGE) -> Iterator[tuple[str, int]]:
    """The distinct runs of a text with their numbers, each run that its crc32
    with the document's name selects without one of its code points."""
    seed = zlib.crc32(f"{name}:".encode())
    for run, n in Counter(text.encode("latin-1", "replace").translate(_WORD_BYTES).split()).items():
        word = run.decode("latin-1")
        h = zlib.crc32(run if run.isascii() else word.encode(), seed)
        if h % damage == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        yield word, n


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE,
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``min_length`` code points and
    ``min_count`` occurrences in all texts."""
    def passed(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                               names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in damaged_counts(name, text.as_py() or "", damage):
                    if len(word) >= min_length:
                        counts[word] += n
                if len(counts) >= FLUSH:
                    yield passed(counts)
                    counts.clear()
        yield passed(counts)

    picked = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")),
                         F.col(f"`{text_col}`").cast("string"))
    counted = picked.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _bounds(length):
    """Ends of the stretches of a word of ``length`` (a column or a number)."""
    if isinstance(length, int):
        return [length * s // SEGMENTS for s in range(SEGMENTS + 1)]
    return [F.floor(length * s / SEGMENTS).cast("int") for s in range(SEGMENTS + 1)]


def _cells(words: DataFrame, cell_words: int) -> DataFrame:
    """Every word once per cell: (length, segment, cell, i, j, part, word, n)."""
    size = F.length("word")
    rows = words.select("word", "n", size.alias("size"), F.explode(F.array(size, size + 1)).alias("length"))
    ends = _bounds(F.col("length"))
    around = [F.struct(F.lit(s).alias("segment"), F.xxhash64(F.substring("word", F.lit(1), ends[s]), F.expr(
        f"right(word, length - cast(floor(length * {s + 1} / {SEGMENTS}) as int))")).alias("cell"))
        for s in range(SEGMENTS)]
    rows = materialize(rows.select("word", "n", "length", F.explode(F.array(*around)).alias("c"))
                       .select("word", "n", "length", "c.segment", "c.cell"), "cells")
    name = ["length", "segment", "cell"]
    crowded = rows.groupBy(*name).count().filter(F.col("count") > cell_words).select(
        *name, F.ceil(F.col("count") / cell_words).cast("int").alias("parts"))
    rows = rows.join(crowded, name, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select(*name, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                       "part", "word", "n")


def _points(words: list[str]) -> np.ndarray:
    """Padded code-point matrix of words."""
    width = max(map(len, words))
    return np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of all pairs of rows; padding counts as equal."""
    width = min(a.shape[1], b.shape[1])
    same = a[:, None, :width] == b[None, :, :width]
    return np.logical_and.accumulate(same, axis=2).sum(axis=2)


def tile(a: list[str], b: list[str], length: int, segment: int) -> np.ndarray:
    """Which pairs of two blocks are one edit apart, with ``length`` as the longer
    word's, the edit in the given stretch."""
    sizes = [np.array([len(w) for w in x]) for x in (a, b)]
    shorter = np.minimum(sizes[0][:, None], sizes[1][None, :])
    longer = np.maximum(sizes[0][:, None], sizes[1][None, :])
    prefix = np.minimum(_common(_points(a), _points(b)), shorter)
    suffix = np.minimum(_common(_points([w[::-1] for w in a]), _points([w[::-1] for w in b])), shorter)
    same = (prefix == longer) & (shorter == longer)
    edit = np.minimum(prefix, length - 1)
    ends = _bounds(length)
    return ((longer == length) & (shorter >= length - 1) & (prefix + suffix >= length - 1) & ~same
            & (edit >= ends[segment]) & (edit < ends[segment + 1]))


class _Near:
    """Per word: how many near words, and the one of the largest n."""

    def __init__(self):
        self.found: dict[str, tuple[int, int, str]] = {}

    def add(self, a: list[str], na: np.ndarray, b: list[str], nb: np.ndarray, length: int, segment: int,
            both: bool) -> None:
        near = tile(a, b, length, segment)
        if not near.any():
            return
        for x, y in zip(*np.nonzero(near), strict=True):
            self._one(a[x], int(nb[y]), b[y])
            if both:
                self._one(b[y], int(na[x]), a[x])

    def _one(self, word: str, n: int, other: str) -> None:
        many, down, best = self.found.get(word, (0, 1, ""))
        best = min((down, best), (-n, other))
        self.found[word] = (many + 1, *best)

    def take(self) -> pa.RecordBatch:
        out = pa.record_batch([pa.array(list(self.found), pa.string()),
                               pa.array([x[0] for x in self.found.values()], pa.int64()),
                               pa.array([-x[1] for x in self.found.values()], pa.int64()),
                               pa.array([x[2] for x in self.found.values()], pa.string())],
                              names=["word", "many", "best_n", "best"])
        self.found.clear()
        return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the cells of a task, whose rows come sorted by cell. Whole
    small cells of one length and stretch share a block; a cell beyond a block,
    or a pair of parts, is compared block by block."""
    near = _Near()

    def blocks(rows: list, size: int) -> list[tuple[list[str], np.ndarray]]:
        return [([r[1] for r in rows[p:p + size]], np.array([r[2] for r in rows[p:p + size]]))
                for p in range(0, len(rows), size)]

    def compared(rows: list, length: int, segment: int, crossed: bool) -> None:
        size = max(1, min(BLOCK, math.isqrt(TILE_CELLS // length)))
        if crossed:
            parts = sorted({r[0] for r in rows})
            sides = [blocks([r for r in rows if r[0] == p], size) for p in parts]
            for a in sides[0]:
                for b in sides[-1] if len(parts) == 2 else []:
                    near.add(*a, *b, length, segment, True)
            return
        cut = blocks(rows, size)
        for x, a in enumerate(cut):
            near.add(*a, *a, length, segment, False)
            for b in cut[x + 1:]:
                near.add(*a, *b, length, segment, True)

    shared: list = []       # rows of whole small cells
    kind = cell = None
    rows: list = []

    def ended() -> None:
        """The cell in ``rows`` is whole."""
        nonlocal shared
        if not rows:
            return
        length, segment = kind
        size = max(1, min(BLOCK, math.isqrt(TILE_CELLS // length)))
        if cell[1] != cell[2] or len(rows) > size:
            compared(rows, length, segment, cell[1] != cell[2])
        elif len(rows) > 1 and cell[2]:
            compared(rows, length, segment, False)  # a part of a crowded cell never shares a block with another
        elif len(rows) > 1:
            if len(shared) + len(rows) > size:
                compared(shared, length, segment, False)
                shared = []
            shared += rows

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(8)]
        for length, segment, name, i, j, part, word, n in zip(*columns, strict=True):
            if kind != (length, segment) or cell != (name, i, j):
                ended()
                if kind != (length, segment) and shared:
                    compared(shared, *kind, False)
                    shared = []
                kind, cell, rows = (length, segment), (name, i, j), []
            rows.append((part, word, n))
        if len(near.found) >= FLUSH:
            yield near.take()
    ended()
    if shared:
        compared(shared, *kind, False)
    yield near.take()


def near_words(words: DataFrame, *, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) of every word that has a near word. ``words``
    has distinct words and their numbers (word, n)."""
    cells = _cells(words, cell_words)
    name = ["length", "segment", "cell", "i", "j"]
    dealt = cells.repartition(*name).sortWithinPartitions(*name)
    found = dealt.mapInArrow(_compare, "word string, many long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("down"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("many").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.best").alias("best"), (-F.col("b.down")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: the chains of forms are followed by
    doubling. A form has FORM_RATIO times the number of its word, so a chain has
    at most log(n) steps and the rounds are few."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        step = now.join(on, F.col("root") == F.col("__at"), "left")
        then = materialize(step.select("word", F.coalesce("__next", "root").alias("root"),
                                       F.col("__next").isNotNull().alias("moved")), "roots")
        if then.filter("moved").isEmpty():
            return then.select("word", "root")
        now = then.select("word", "root")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE,
                      min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = FORM_RATIO,
                      cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts."""
    words = materialize(word_counts(docs, id_col=id_col, text_col=text_col, damage=damage, min_length=min_length,
                                    min_count=min_count), "words")
    near = near_words(words, cell_words=cell_words)
    takes = F.col("best_n") >= ratio * F.col("n")
    formed = materialize(words.join(near, "word", "left").select(
        "word", F.when(takes, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
