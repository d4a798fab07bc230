"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are put in hash order and cut into blocks. Of a source with
``b`` blocks among the mix's ``T``, block ``i`` (from 0) is released at slot
``floor(i * T / b)`` and due by slot ``ceil((i + 1) * T / b)``; earliest
deadline first over the released blocks fills the slots 0 to ``T - 1``. The
shares ``b / T`` sum to 1, so every block meets its window, and at any slot
each source is within one block of its share, however long the mix is. The
shares are those of whole blocks: a source's last block may be short of rows.

The block counts are known when the plan is made (one small job). The scheduler
runs there once, slot by slot over a heap of the sources, and keeps only what
each source has done at the start of every ``WINDOW`` slots; the windows are
then scheduled again as rows, by many tasks. Blocks find their slots by a join,
broadcast below ``BROADCAST_SLOTS`` slots. The number of sources is taken to be
small (thousands at most); rows per source are unbounded, and ranking them
spreads a hot source over hash buckets.

With a whole number ``period`` the weights are rounded instead to whole numbers
``k`` of a period of ``K = sum(k)`` slots (``k = max(1, round(w * period))``)
that repeats: one period is scheduled, and each source is within one block of
``k / K``, not of its target.

With ``hot_factor=None`` and no weights the targets are the natural shares
``w = rows / all rows``: every row is in the mix. Otherwise the targets are the
caller's weights, or the natural shares with hot sources held back
(``w ~ min(rows, hot_factor * mean rows per source)``); the mix is then as long
as the scarcest source allows, ``T = min(rows / w)`` rows, of which a source
gives ``w * T``. Rows beyond that are surplus of over-represented sources; they
keep ``in_mix = false`` and null slots. The query and the pipeline use the
natural shares.

Defined results: a null source is a source of its own; a null key orders by
the text ``null``; equal rows are interchangeable; a source without a weight
or with weight 0 is out of the mix; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from herdflow.llm.common import key_text, spread_rank

WINDOW = 1024
BROADCAST_SLOTS = 250_000
BLOCK_ROWS = 8
HOT_FACTOR = 2.0


def source_key(col: str):
    """Source as text; null gets a key that no source name has."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{col}`").cast("string")), F.lit("null"))


def source_plan(rows: DataFrame, weights: dict[str | None, float] | None = None,
                hot_factor: float | None = HOT_FACTOR, period: int | None = None,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per source: rows ``n``, target weight ``w``, rows to ``take``,
    blocks ``k`` (per period, or of the whole mix without one) and index ``s``
    (order of the source key)."""
    counts = rows.groupBy("__source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        all_rows = F.struct(F.collect_list(F.struct("__source", "n")).alias("each"), F.avg("n").alias("mean"))
        one = counts.agg(all_rows.alias("a")).select(F.explode("a.each").alias("e"), F.col("a.mean").alias("mean"))
        want = F.col("e.n").cast("double")
        if hot_factor is not None:
            want = F.least(want, F.lit(hot_factor) * F.col("mean"))
        wanted = one.select(F.col("e.__source").alias("__source"), F.col("e.n").alias("n"), want.alias("want"))
    else:
        wanted_by = F.lit(None).cast("double")
        for name, w in weights.items():
            wanted_by = F.when(F.col("__source") == ("null" if name is None else f"={name}"),
                               F.lit(float(w))).otherwise(wanted_by)
        wanted = counts.withColumn("want", wanted_by).filter(F.col("want") > 0)
    packed = wanted.agg(F.sort_array(F.collect_list(F.struct("__source", "n", "want"))).alias("each"))
    plan = packed.select(F.expr("transform(each, (x, i) -> named_struct('__source', x.__source, 'n', x.n, 's', i, "
                                "'w', x.want / aggregate(each, 0D, (a, y) -> a + y.want)))").alias("each"))
    plan = plan.select("each", F.expr("floor(array_min(transform(each, x -> x.n / x.w)) + 1e-6D)").alias("total"))
    take = F.least(F.col("x.n"), F.floor(F.col("x.w") * F.col("total") + F.lit(1e-6)))
    if weights is None and hot_factor is None:
        take = F.col("x.n")
    blocks = F.ceil(take / block_rows) if period is None else F.greatest(F.lit(1), F.round(F.col("x.w") * period))
    return plan.select(F.explode("each").alias("x"), "total").select(
        F.col("x.__source").alias("__source"), F.col("x.s").alias("s"), F.col("x.n").alias("n"),
        F.col("x.w").alias("w"),
        take.cast("long").alias("take"),
        blocks.cast("long").alias("k"))


def period_schedule(plan: DataFrame) -> DataFrame:
    """Earliest deadline first over one period: (s, j, t) = block ``j`` of
    source ``s`` runs in slot ``t``."""
    one = plan.agg(F.sort_array(F.collect_list(F.struct("s", "k"))).alias("each")).filter(F.size("each") > 0)
    one = one.select(F.expr("transform(each, x -> x.k)").alias("k"),
                     F.expr("aggregate(each, 0L, (a, x) -> a + x.k)").alias("slots"))
    # The fold's state: blocks done per source, and the picks so far. Each step
    # picks the released block due first (ties: the lower source index).
    step = """aggregate(sequence(0L, slots - 1),
      named_struct('done', transform(k, x -> 0L), 'picks', cast(array() as array<int>)),
      (st, t) -> transform(
        array(array_min(transform(k, (ks, s) ->
          if(st.done[s] < ks and (st.done[s] * slots) div ks <= t,
             named_struct('due', ((st.done[s] + 1) * slots + ks - 1) div ks, 's', s), null))).s),
        p -> named_struct('done', transform(st.done, (d, s) -> if(s = p, d + 1, d)),
                          'picks', array_append(st.picks, p)))[0],
      st -> st.picks)"""
    picks = one.select(F.posexplode(F.expr(step)).alias("t", "s"))
    nth = F.row_number().over(Window.partitionBy("s").orderBy("t")) - 1
    return picks.select("s", F.col("t").cast("long").alias("t"), nth.cast("long").alias("j"))


def window_starts(blocks: Sequence[int], window: int = WINDOW) -> list[tuple[int, int, list[int]]]:
    """(first slot, slots, blocks done per source) of every window, by earliest
    deadline first over all slots (ties: the lower source index)."""
    slots, done, starts = sum(blocks), [0] * len(blocks), []
    ready, waiting = [], [(0, s) for s, b in enumerate(blocks) if b]
    for t in range(slots):
        if t % window == 0:
            starts.append((t, min(window, slots - t), list(done)))
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * slots // blocks[s]), s))
        s = heapq.heappop(ready)[1]
        done[s] += 1
        if done[s] < blocks[s]:
            heapq.heappush(waiting, (done[s] * slots // blocks[s], s))
    return starts


def whole_schedule(spark: SparkSession, blocks: Sequence[int], window: int = WINDOW) -> DataFrame:
    """Earliest deadline first over all slots: (s, j, t) = block ``j`` of
    source ``s`` runs in slot ``t``. Each window is one row's fold."""
    starts = spark.createDataFrame(window_starts(blocks, window), "at long, n long, done array<long>")
    rows = starts.repartition(max(1, -(-sum(blocks) // (8 * window)))).withColumns({
        "k": F.from_json(F.lit(str([int(b) for b in blocks])), "array<long>"),
        "slots": F.lit(int(sum(blocks))).cast("long")})
    # As in period_schedule; a pick also keeps its block.
    step = """aggregate(sequence(0L, n - 1),
      named_struct('done', done, 'picks', cast(array() as array<struct<s:int,j:bigint>>)),
      (st, i) -> transform(
        array(array_min(transform(k, (ks, s) ->
          if(st.done[s] < ks and (st.done[s] * slots) div ks <= at + i,
             named_struct('due', ((st.done[s] + 1) * slots + ks - 1) div ks, 's', s), null))).s),
        p -> named_struct('done', transform(st.done, (d, s) -> if(s = p, d + 1, d)),
                          'picks', array_append(st.picks, named_struct('s', p, 'j', st.done[p]))))[0],
      st -> st.picks)"""
    picks = rows.select("at", F.posexplode(F.expr(step)).alias("i", "p"))
    return picks.select(F.col("p.s").alias("s"), (F.col("at") + F.col("i")).alias("t"), F.col("p.j").alias("j"))


def _scheduled(docs: DataFrame, weights, carried: Sequence[Column], *, id_col: str, source_col: str,
               block_rows: int, hot_factor: float | None, period: int | None,
               ties: Sequence[str] = ()) -> DataFrame:
    """Every row's block, window and slot, with ``carried``. ``ties`` names
    columns of ``carried`` that order rows of one key."""
    digest = F.md5(F.concat(F.lit("mix:"), key_text(id_col)))
    rows = docs.select(F.col(f"`{id_col}`").alias("__key"), source_key(source_col).alias("__source"),
                       digest.alias("__digest"), *carried)
    plan = source_plan(rows, weights, hot_factor, period, block_rows)
    if period is None:
        spark = docs.sparkSession
        known = plan.collect()  # one row per source
        plan = spark.createDataFrame(known, plan.schema)
        blocks = [r.k for r in sorted(known, key=lambda r: r.s)]
        slots, times = F.lit(sum(blocks)).cast("long"), whole_schedule(spark, blocks)
        times = F.broadcast(times) if sum(blocks) <= BROADCAST_SLOTS else times
    else:
        slots = plan.agg(F.sum("k").alias("slots")).scalar()
        times = F.broadcast(period_schedule(plan))  # at most period + sources rows
    times = times.select(F.col("s").alias("__s"), F.col("j").alias("__tj"), F.col("t").alias("__t"))
    ranked = spread_rank(rows, rows, "__source", "__digest", ["__key", *ties], "__rank")
    ranked = ranked.join(F.broadcast(plan.withColumnRenamed("__source", "__plan_source")),  # one row per source
                         F.col("__source") == F.col("__plan_source"), "left")
    ranked = ranked.withColumn("in_mix", F.coalesce(F.col("__rank") < F.col("take"), F.lit(False)))
    ranked = ranked.withColumn("block", F.when(F.col("in_mix"), F.expr(f"__rank div {int(block_rows)}")))
    ranked = ranked.withColumn("place", F.when(F.col("in_mix"), F.expr(f"__rank % {int(block_rows)}")))
    ranked = ranked.select("*", slots.alias("slots"))
    # Without a period every block number is below k, and __p is 0.
    ranked = ranked.withColumn("__j", F.expr("block % k")).withColumn("__p", F.expr("block div k"))
    timed = ranked.join(times, (F.col("s") == F.col("__s")) & (F.col("__j") == F.col("__tj")), "left")
    return timed.withColumns({"release": F.expr("__p * slots + (__j * slots) div k"),
                              "deadline": F.expr("__p * slots + ((__j + 1) * slots + k - 1) div k"),
                              "slot": F.expr("__p * slots + __t")})


def mix_schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, *, id_col: str = "doc_id",
                 source_col: str = "source", block_rows: int = BLOCK_ROWS, hot_factor: float | None = HOT_FACTOR,
                 period: int | None = None) -> DataFrame:
    """One row per document: source, its block there, the block's release,
    deadline and slot, the row's place in the block, and ``in_mix``. Ordering
    by (slot, place) is the mixed sequence. Runs one job that counts the sources'
    rows, unless a ``period`` is given."""
    rows = _scheduled(docs, weights, [F.col(f"`{source_col}`").alias("source")], id_col=id_col, source_col=source_col,
                      block_rows=block_rows, hot_factor=hot_factor, period=period)
    return rows.select(F.col("__key").alias("doc_id"), "source", "in_mix", F.col("w").alias("target_weight"), "block",
                       "release", "deadline", "slot", "place")


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, *, id_col: str = "doc_id",
          source_col: str = "source", block_rows: int = BLOCK_ROWS, hot_factor: float | None = HOT_FACTOR,
          period: int | None = None) -> DataFrame:
    """The documents of the mix with their own columns, in mixed sequence.
    Runs the same job as ``mix_schedule``."""
    rows = _scheduled(docs, weights, [F.struct("*").alias("__doc")], id_col=id_col, source_col=source_col,
                      block_rows=block_rows, hot_factor=hot_factor, period=period)
    return rows.filter("in_mix").orderBy("slot", "place").select("__doc.*")


SEQUENCE = "herdflow.sequence"


def in_sequence(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the note, in the metadata of its key column, that its rows stand
    in mixed sequence. Parquet files keep the note."""
    return docs.withMetadata(id_col, {**docs.schema[id_col].metadata, SEQUENCE: "mixed"})


def is_in_sequence(docs: DataFrame, id_col: str = "doc_id") -> bool:
    return docs.schema[id_col].metadata.get(SEQUENCE) == "mixed"


def positions(docs: DataFrame, carried: Sequence[Column], *, id_col: str = "doc_id", source_col: str = "source",
              block_rows: int = BLOCK_ROWS, ties: Sequence[str] = ()) -> DataFrame:
    """``carried`` of every row, with its ``__position`` in the mixed sequence by
    natural shares (slots times ``block_rows``, plus the place; gaps after short
    blocks) and the bound ``__positions``. Runs the same job as ``mix_schedule``."""
    rows = _scheduled(docs, None, carried, id_col=id_col, source_col=source_col, block_rows=block_rows,
                      hot_factor=None, period=None, ties=ties)
    return rows.withColumns({"__position": F.col("slot") * block_rows + F.col("place"),
                             "__positions": F.col("slots") * block_rows}).select(
        *docs.select(*carried).columns, "__position", "__positions")
