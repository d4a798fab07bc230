"""Sharding by a hierarchical weighted hash tree.

Shards sit in racks and racks in regions. A key descends region, rack, shard;
at each level it takes the child with the smallest weighted draw. A shard's
draw for a key is ``-ln(u) / weight`` with ``u`` a hash of key and shard path;
a rack's draw is the smallest of its shards' draws and a region's the smallest
of its racks'. The smallest of exponential draws is an exponential draw with
the summed weight, so every level draws by the weight of its subtree, and a
weight that grows only draws keys into the subtree where it grew: adding a
shard moves rows into that shard and nowhere else.

Everything is a column expression; only the rank inside a shard shuffles (by
shard and hash bucket, see ``common.spread_rank``), without the text.

Defined results: a null key is placed by the text ``null``; a null or empty
text has size 1 and checksum 0; repeated rows share a shard and take
consecutive slots; an empty table gives an empty result. Extra columns of any
name are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdflow.llm import mixing
from herdflow.llm.common import RANK_BUCKETS, free_name, key_text, spread_rank, text_or_empty
from herdflow.operators.joins import materialize

SHARDS_PER_RACK = 4
RACKS_PER_REGION = 2


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0

    @property
    def path(self) -> str:
        return f"{self.region}/{self.rack}/{self.shard}"


def even_tree(shards: int) -> list[Leaf]:
    """``shards`` equal shards, filled rack by rack and region by region."""
    return [Leaf(s // (SHARDS_PER_RACK * RACKS_PER_REGION), s // SHARDS_PER_RACK, s) for s in range(shards)]


def _draw(key: Column, leaf: Leaf) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{leaf.path}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / F.lit(float(leaf.weight))


def _nearest(children: Sequence[Column]) -> Column:
    """The child with the smallest (draw, shard) pair."""
    return F.array_min(F.array(*children))


def assign_shards(df: DataFrame, key: Column, trees: dict[str, Sequence[Leaf]]) -> DataFrame:
    """Add one shard column per entry of ``trees`` (column name -> leaves).

    Trees that share leaves share their draws. Weights must be positive."""
    leaves = {leaf for tree in trees.values() for leaf in tree}
    if any(leaf.weight <= 0 for leaf in leaves):
        raise ValueError("weights must be positive")
    order = sorted(leaves, key=lambda x: (x.region, x.rack, x.shard, x.weight))
    names = {leaf: f"__draw{i}" for i, leaf in enumerate(order)}
    own = [F.col(f"`{c}`") for c in df.columns]
    drawn = df.select(*own, *[_draw(key, leaf).alias(n) for leaf, n in names.items()])
    picks = []
    for out, tree in trees.items():
        regions: dict[int, dict[int, list[Leaf]]] = {}
        for leaf in sorted(tree, key=lambda x: (x.region, x.rack, x.shard)):
            regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
        by_region = [
            _nearest([_nearest([F.struct(F.col(names[leaf]).alias("draw"), F.lit(leaf.shard).alias("shard"))
                                for leaf in shards]) for shards in racks.values()])
            for racks in regions.values()]
        picks.append(_nearest(by_region)["shard"].cast("int").alias(out))
    return drawn.select(*own, *picks)


def _slots(docs: DataFrame, shards: int, id_col: str, text_col: str, carried: Sequence[Column]) -> DataFrame:
    """Size, checksum, shard, slot and grown shard of every row, with ``carried``."""
    trees = {"shard": even_tree(shards), "grown_shard": even_tree(shards + 1)}
    text = text_or_empty(text_col)
    digest = F.md5(F.concat(F.lit("slot:"), key_text(id_col)))
    key = F.col(f"`{id_col}`").alias("__key")
    rows = docs.select(key, (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), digest.alias("__digest"), *carried)
    counted = docs.select(key, digest.alias("__digest"))
    return spread_rank(assign_shards(rows, key_text("__key"), trees),
                       assign_shards(counted, key_text("__key"), {"shard": trees["shard"]}),
                       "shard", "__digest", ["__key", "size", "text_crc32"], "slot")


def shard_table(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its shard among ``shards``, its slot there (0, 1,
    ... in hash order), and its shard once one more is added."""
    rows = _slots(docs, shards, id_col, text_col, [])
    return rows.select(F.col("__key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard",
                       "slot", "grown_shard")


def place_in_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their own columns, and their shard and slot (under
    names that start with underscores where those are taken)."""
    rows = _slots(docs, shards, id_col, text_col, [F.struct("*").alias("__doc")])
    return rows.select("__doc.*", F.col("shard").alias(free_name(docs, "shard")),
                       F.col("slot").alias(free_name(docs, "slot")))


def place_in_sequence(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                      source_col: str = "source") -> DataFrame:
    """As ``place_in_shards``, but the slots of a shard follow the mixed sequence
    of all documents by natural shares (``mixing.positions``). Runs a job that
    counts the sources' rows."""
    tree = {"__shard": even_tree(shards)}
    key, text = F.col(f"`{id_col}`").alias("__id"), text_or_empty(text_col)
    # Ranking goes by this digest: the part of the sequence, then the place.
    part = F.expr(f"__position * {RANK_BUCKETS} div __positions")
    digest = F.lower(F.concat(F.lpad(F.hex(part), 3, "0"), F.lpad(F.hex("__position"), 16, "0")))

    def placed(carried, ties=()):
        rows = mixing.positions(docs, [key, *carried], id_col=id_col, source_col=source_col, ties=ties)
        return assign_shards(rows.withColumn("__digest", digest), key_text("__id"), tree)

    ranked = spread_rank(placed([F.struct("*").alias("__doc"), F.xxhash64(text).alias("__text_hash")], ["__text_hash"]),
                         placed([]), "__shard", "__digest", [], "__slot")
    return ranked.select("__doc.*", F.col("__shard").alias(free_name(docs, "shard")),
                         F.col("__slot").alias(free_name(docs, "slot")))


def place_in_order(docs: DataFrame, shards: int = 16, id_col: str = "doc_id") -> DataFrame:
    """As ``place_in_shards``, but the slots of a shard follow the order in which
    ``docs`` is given: that of a written table's files, or of the partitions of any
    other DataFrame. The rows are written once with their place, so counting and
    ranking see the same order."""
    spot = F.monotonically_increasing_id().alias("__spot")
    part = F.regexp_extract("__file", "part-([0-9]+)[^/]*$", 1).try_cast("long").alias("__part")
    key, doc = key_text(id_col).alias("__id"), F.struct("*").alias("__doc")
    try:
        # A file's pieces may be read by several tasks, and files in any order.
        rows = docs.select(doc, key, F.input_file_name().alias("__file"), F.input_file_block_start().alias("__from"), spot)
    except AnalysisException:
        # Spark names no file for a plan over several tables: not a written table.
        rows = docs.select(doc, key, F.lit("").alias("__file"), F.lit(-1).cast("long").alias("__from"), spot)
    rows = assign_shards(rows, F.col("__id"), {"__shard": even_tree(shards)})
    rows = materialize(rows.select("*", part), "in-order")
    # A piece is read by one task from end to end; without files, a piece is a partition.
    rows = rows.withColumn("__task", F.when(F.col("__file") == "", F.shiftright("__spot", 33)).otherwise(F.lit(0)))
    piece = ["__part", "__file", "__from", "__task"]
    pieces = rows.groupBy(*piece).agg(F.min("__spot").alias("__first"), F.count(F.lit(1)).alias("__n"))
    order = Window.orderBy(*piece)                      # one row per piece
    pieces = pieces.select(*[F.col(c).alias(f"_{c}") for c in piece], "__first",
                           F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                                      F.lit(0)).alias("__before"),
                           F.sum("__n").over(Window.partitionBy()).alias("__all"))
    pieces = materialize(pieces, "pieces")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in piece]
    position = F.col("__before") + F.col("__spot") - F.col("__first")
    part_of = F.expr(f"__position * {RANK_BUCKETS} div __all")
    digest = F.lower(F.concat(F.lpad(F.hex(part_of), 3, "0"), F.lpad(F.hex("__position"), 16, "0")))

    def placed(*carried):
        found = rows.select(*carried, "__shard", "__spot", *piece).join(F.broadcast(pieces), same)
        return found.withColumn("__position", position).select(*carried, "__shard", digest.alias("__digest"))

    ranked = spread_rank(placed("__doc"), placed(), "__shard", "__digest", [], "__slot")
    return ranked.select("__doc.*", F.col("__shard").alias(free_name(docs, "shard")),
                         F.col("__slot").alias(free_name(docs, "slot")))
