"""Quality rules: counted features plus a hashed n-gram log-likelihood ratio.

A document's n-grams are all character trigrams of all its words (the whole
word if it is shorter). Each is hashed to one of ``BUCKETS`` buckets, and the
ratio of a document is the mean of ``ln(p_target / p_raw)`` over its n-grams'
buckets. ``p_raw`` is the multinomial of all documents, ``p_target`` that of
trusted ones: rows labelled good and not toxic, of which at most
``TRUSTED_ROWS`` (lowest hash of the key) are used, so that their keys may be
broadcast. The target is smoothed towards the raw multinomial, so a small
trusted sample moves no ratio far. A document is kept if it passes the counted
rules and its mean ratio is at least ``threshold``. Counts are whole numbers and
sums run in word order, so verdicts do not depend on partitions.

All column expressions. Words are counted first (partially aggregated, so a
frequent word is one row per task) and cut into n-grams once per distinct word;
the ``BUCKETS`` ratios are read once and enter the plan as a constant array.
Words over ``PIECE`` code points are cut into overlapping pieces, so that their
trigrams take linear time.

Defined results: a null text has no words, all counts 0, base_failed true; a
null key is never trusted; a document with no n-gram has ratio 0; without any
trusted row every ratio is 0, so that the counted rules alone decide; repeated
rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdflow.llm.common import text_or_empty, words

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 1.0
PRIOR = 4096.0  # n-grams of the raw multinomial that the target is taken to hold besides its own
TRUSTED_ROWS = 20_000
THRESHOLD = -0.47
MIN_WORDS = 50
NGRAM = 3
PIECE = 64  # code points; a trigram is found from the start of its piece
SYMBOLS = "#*$%&|<>"


def _bucket(gram: Column) -> Column:
    """Hash bucket of an n-gram, from 0 to BUCKETS - 1."""
    return F.shiftrightunsigned(F.xxhash64(gram), 64 - BUCKET_BITS).cast("int")


def _pieces(w: Column) -> Column:
    """The words, those over ``PIECE`` code points as pieces that overlap by two
    (what is left below a trigram is covered by the piece before)."""
    cut = F.lit(f"(?s)(?=(.{{1,{PIECE + NGRAM - 1}}})).{{1,{PIECE}}}")
    long = F.exists(w, lambda x: F.length(x) > PIECE)
    return F.when(long, F.flatten(F.transform(w, lambda x: F.when(F.length(x) <= PIECE, F.array(x)).otherwise(
        F.filter(F.regexp_extract_all(x, cut, F.lit(1)), lambda y: F.length(y) >= NGRAM))))).otherwise(w)


def _starts(piece: Column) -> Column:
    """Where the n-grams of a piece start, from 1."""
    return F.sequence(F.lit(1), F.greatest(F.length(piece) - (NGRAM - 1), F.lit(1)))


def trusted_keys(labels: DataFrame, rows: int = TRUSTED_ROWS, id_col: str = "doc_id") -> DataFrame:
    """Keys of at most ``rows`` rows labelled good and not toxic, by lowest hash."""
    good = labels.filter((F.col("quality") == 1) & F.coalesce(F.col("toxic") == 0, F.lit(True))
                         & F.col(f"`{id_col}`").isNotNull())
    key = F.col(f"`{id_col}`")
    return good.select(key.alias("__trusted")).distinct().orderBy(F.xxhash64("__trusted"), "__trusted").limit(rows)


def bucket_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> list[float]:
    """``ln(p_target / p_raw)`` of every bucket, from all documents.

    ``trusted`` must have a bounded number of rows: it is broadcast."""
    w = words(text_or_empty(text_col))
    flagged = docs.select(F.col(f"`{id_col}`").alias("__id"), w.alias("__w")).join(
        F.broadcast(trusted), F.col("__id") == F.col("__trusted"), "left")
    cut = flagged.select(F.col("__trusted").isNotNull().cast("int").alias("t"),
                         _pieces(F.col("__w")).alias("__pieces"))
    each = cut.select("t", F.explode("__pieces").alias("w")).groupBy("w").agg(
        F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    grams = each.select("raw", "target", F.explode(F.transform(
        _starts(F.col("w")), lambda i: _bucket(F.substring(F.col("w"), i, NGRAM)))).alias("b"))
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for b, n, t in grams.groupBy("b").agg(F.sum("raw"), F.sum("target")).collect():
        raw[b], target[b] = n, t
    all_raw, all_target = sum(raw), sum(target)
    if not all_target:
        return [0.0] * BUCKETS
    p_raw = [(n + SMOOTHING) / (all_raw + SMOOTHING * BUCKETS) for n in raw]
    return [math.log((t / p + PRIOR) / (all_target + PRIOR)) for t, p in zip(target, p_raw, strict=True)]


def _count_symbols(text: Column) -> Column:
    """Number of symbols: the bytes that go as each (one byte) is taken out."""
    left = text
    for symbol in SYMBOLS:
        left = F.replace(left, F.lit(symbol), F.lit(""))
    return (F.octet_length(text) - F.octet_length(left)).cast("long")


def rule_columns(docs: DataFrame, ratios: list[float], *, text_col: str = "text",
                 threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the counted features, the ratio and the verdict added."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    text = text_or_empty(text_col)
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))

    a = docs.select(*own, words(text).alias("__w"), lines.alias("__lines"),
                    _count_symbols(text).alias("__symbols"))
    last = F.size("__w") - 2
    windows = F.when(last > 0, F.transform(F.slice("__w", 1, last), lambda w, i: F.xxhash64(
        w, F.get("__w", i + 1), F.get("__w", i + 2)))).otherwise(F.array().cast("array<long>"))
    b = a.select(*own, "__w", "__symbols", windows.alias("__windows"),
                 (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__dup"))
    # Windows with their places, in window order, where any window repeats.
    repeated = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.when(repeated, F.sort_array(F.transform("__windows", lambda h, i: F.struct(
        h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:long,i:int>>"))
    c = b.select(*own, "__w", "__symbols", "__dup", placed.alias("__placed"))
    twice = F.filter("__placed", lambda x, k: (F.get(F.col("__placed"), k - 1)["h"] == x["h"])
                     | (F.get(F.col("__placed"), k + 1)["h"] == x["h"]))
    d = c.select(*own, "__w", "__symbols", "__dup", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("__at"))
    # Each repeated window covers three words, fewer where the next one starts sooner.
    covered = F.when(F.size("__at") > 0, F.aggregate(
        "__at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("end")),
        lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n"), (i + 3).alias("end")),
        lambda s: s["n"])).otherwise(F.lit(0).cast("long"))
    w, pieces = F.col("__w"), F.col("__pieces")
    total = F.aggregate(pieces, F.lit(0.0), lambda s, x: s + F.aggregate(
        _starts(x), F.lit(0.0), lambda p, i: p + F.get(table, _bucket(F.substring(x, i, NGRAM)))))
    grams = F.aggregate(pieces, F.lit(0).cast("long"), lambda n, x: n + F.greatest(
        F.length(x) - (NGRAM - 1), F.lit(1)))
    ratio = F.when(F.size(w) > 0, total / grams).otherwise(F.lit(0.0))
    d = d.select("*", _pieces(w).alias("__pieces"))
    e = d.select(*own, F.size("__w").cast("long").alias("n_words"),
                 F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
                 F.col("__symbols").alias("n_symbols"), F.col("__dup").alias("n_dup_lines"),
                 covered.alias("n_repeat_words"), ratio.alias("ratio"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    f = e.select("*", failed.alias("base_failed"))
    return f.select("*", (~F.col("base_failed") & (F.col("ratio") >= F.lit(threshold))).alias("kept"))


def quality_table(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document with its features, ratio and verdict."""
    ratios = bucket_ratios(docs, trusted_keys(labels))
    return rule_columns(docs.select("doc_id", "text"), ratios, **options).drop("text")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents kept, with their own columns only."""
    ratios = bucket_ratios(docs, trusted_keys(labels))
    judged = rule_columns(docs.select(F.struct("*").alias("__doc"), "text"), ratios, **options)
    # A filter would be pushed below the word arrays and split every text again
    # for each use of them; a generator of one row or none stays in its place.
    return judged.select(F.inline(F.when(F.col("kept"), F.array("__doc"))))
