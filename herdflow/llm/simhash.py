"""SimHash near-duplicates by exact tiled comparison.

A fingerprint bit is set if it is set in over half of the XXH64 hashes (seed
42) of a text's word shingles, repeats included. Two fingerprints link if at
most ``RADIUS`` bits differ; linked fingerprints form components.

Distinct fingerprints are dealt to cells so that any two that link meet: of
``BLOCKS`` blocks of bits, at least ``BLOCKS - RADIUS`` are equal, so every
choice of that many blocks, with their bits, is a cell key. Cells are counted;
one of more than ``CELL_ROWS`` fingerprints is cut into parts by hash, and every
pair of its parts becomes a cell of its own, so that no cell holds more than
about two parts and a family of any size is dealt over tasks. A task sorts its
rows by (cell, population count), cuts them into tiles of ``TILE`` rows and
compares tiles by exclusive-or and bit counts; tile pairs that share no cell,
or whose population counts differ by more than the radius, are skipped. Of the
links inside a tile pair only a spanning set leaves the task (at most one per
row), so a group of near copies never turns into all of its pairs, and the
components over spanning links are the exact ones. Copies share a fingerprint
and are compared once.

Defined results: a null text counts as empty; a text without a word has
fingerprint 0 and links like any other; a null key is ignored as a component
name unless all keys of the component are null; equal rows share everything;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from herdflow.llm.common import free_name, key_text, text_or_empty
from herdflow.llm.components import components
from herdflow.operators.joins import bounded_broadcast, materialize

SEED = 42
SHINGLE = 3
RADIUS = 3
BLOCKS = 5
TILE = 512
CELL_ROWS = 16_384  # fingerprints compared with each other in one task; larger cells are cut
VOTES = 1 << 16  # shingles whose bits are unpacked at a time


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text as an unsigned number."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), VOTES):
        part = hashes[i:i + VOTES].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the fingerprint as a signed long ``fp``."""
    keep = [c for c in docs.columns if c != text_col]
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or "", shingle) for t in batch.column(len(keep))], np.uint64)
            yield pa.record_batch([*batch.columns[:len(keep)], pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kinds}, fp long")


def cell_keys(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """One bit mask per choice of blocks that two linked fingerprints may share."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(masks, blocks - radius)]


def spanning_links(cells: np.ndarray, fps: np.ndarray, radius: int = RADIUS, tile: int = TILE):
    """Arrays (a, b) of rows whose fingerprints link inside a cell, enough of
    them to connect all that link. Rows must be sorted by (cell, bit count)."""
    counts = np.bitwise_count(fps).astype(np.int16)
    starts = range(0, len(fps), tile)
    for i in starts:
        mine = slice(i, min(i + tile, len(fps)))
        for j in range(i, len(fps), tile):
            other = slice(j, min(j + tile, len(fps)))
            if cells[other.start] > cells[mine.stop - 1]:
                break
            if j > i and cells[mine.start] == cells[other.stop - 1] \
                    and counts[other.start] - counts[mine.stop - 1] > radius:
                break  # one cell: later tiles differ even more
            near = np.bitwise_count(fps[mine, None] ^ fps[None, other]) <= radius
            near &= cells[mine, None] == cells[None, other]
            if i == j:
                near = np.triu(near, 1)
            a, b = np.nonzero(near)
            if not len(a):
                continue
            a, b = a + i, b + j
            nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
            a, b = ends[:len(a)], ends[len(a):]
            label = np.arange(len(nodes))
            while True:
                low = np.minimum(label[a], label[b])
                new = label.copy()
                np.minimum.at(new, a, low)
                np.minimum.at(new, b, low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            moved = np.nonzero(label != np.arange(len(nodes)))[0]
            yield nodes[moved], nodes[label[moved]]


def _link_cells(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the cells of one task, whose rows arrive sorted by cell; held
    at a time: the rows of the cells that one batch completes."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps = rows[1].view(np.uint64)
        order = np.lexsort((np.bitwise_count(fps), rows[0]))
        rows, fps = rows[:, order], fps[order]
        for a, b in spanning_links(rows[0], fps, radius):
            yield pa.record_batch([pa.array(rows[1, a]), pa.array(rows[1, b])], names=["u", "v"])

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        if not rows.shape[1]:
            continue
        held.append(rows)
        last = rows[0, -1]
        if rows[0, 0] == last:
            continue  # one cell goes on
        rows = np.concatenate(held, axis=1)
        done = rows[0] != last
        yield from links(rows[:, done])
        held = [rows[:, ~done]]
    if held:
        yield from links(np.concatenate(held, axis=1))


def _dealt(fps: DataFrame, radius: int, cell_rows: int) -> DataFrame:
    """(cell, fp): every two fingerprints that link share a cell of about
    2 * ``cell_rows`` rows at most.

    Cell names are hashes; should two cells share one, they are compared as one,
    which costs time and links nothing, as every link is a checked distance."""
    masks = [m - (1 << 64) if m >> 63 else m for m in cell_keys(radius)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    cells = fps.select("fp").distinct().select("fp", F.explode(keys).alias("cell"))
    large = cells.groupBy(F.col("cell").alias("__large")).agg(F.count(F.lit(1)).alias("__n")).filter(
        F.col("__n") > cell_rows)
    parts = F.ceil(F.col("__n") / F.lit(cell_rows)).cast("int")
    large, _ = bounded_broadcast(large.select("__large", parts.alias("__parts")))
    mine = F.pmod(F.xxhash64("fp", F.lit("part")), F.col("__parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("__parts") - 1), lambda p: p != F.col("__mine"))
    pairs = F.transform(others, lambda p: F.xxhash64("cell", F.least(p, "__mine"), F.greatest(p, "__mine")))
    return cells.join(large, F.col("cell") == F.col("__large"), "left").withColumn("__mine", mine).select(
        F.explode(F.when(F.col("__parts").isNull(), F.array("cell")).otherwise(pairs)).alias("cell"), "fp")


def near_links(fps: DataFrame, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Spanning links (u, v) between the distinct values of column ``fp``."""
    dealt = _dealt(fps, radius, cell_rows).repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(lambda batches: _link_cells(batches, radius), "u long, v long")


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """(class_fp, root, component_id) of every distinct fingerprint."""
    roots = components(near_links(prints, radius), prints.count())
    least = prints.groupBy(F.col("fp").alias("class_fp")).agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, F.col("class_fp") == F.col("u"), "left").select(
        "class_fp", "least", F.coalesce("v", "class_fp").alias("root"))
    names = rooted.groupBy(F.col("root").alias("__root")).agg(F.min("least").alias("component_id"))
    return rooted.join(names, F.col("root") == F.col("__root")).select("class_fp", "root", "component_id")


def simhash_components(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint and its component's smallest key."""
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    prints = materialize(fingerprints(picked, shingle), "simhash")
    named = prints.join(_classes(prints, radius), F.col("fp") == F.col("class_fp"))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One document of each component (smallest key), with its own columns."""
    row = F.md5(F.concat(key_text(id_col), F.lit("\n"), text_or_empty(text_col)))
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), row.alias("row"), F.col(f"`{text_col}`").alias("text"))
    prints = materialize(fingerprints(picked, shingle), "simhash")
    first = prints.join(_classes(prints, radius), (F.col("fp") == F.col("class_fp"))
                        & F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = first.groupBy("root").agg(F.min("row").alias("__kept_row")).select("__kept_row")
    name = free_name(docs, "__row")
    own = docs.select("*", row.alias(name))
    # Rows equal in key and text are one document.
    return own.join(kept, F.col(name) == F.col("__kept_row"), "left_semi").dropDuplicates([name]).drop(name)
