"""Secret scans: three fixed patterns plus character Markov models.

The patterns find assignments, access keys and long hexadecimal runs. Besides,
every run of key characters, less the pattern spans in it, is cut into the parts
beside those spans, and each part of at least ``MIN_RUN`` characters is scored
by two first-order character models, one of random strings and one of ordinary
identifiers: the mean over its character pairs of
``ln(p_random(b | a) / p_ordinary(b | a))`` must reach ``THRESHOLD``.

The models come from labelled samples taken from the documents of at most
``SAMPLE_ROWS`` keys (lowest hash), the bound of the sample: ordinary ones are
the documents' shorter words (``SHORT_WORD`` to ``MIN_RUN - 1`` key
characters), neighbouring ones joined by ``/``, ``_`` or ``-`` as in paths and long
identifiers or by capitals as in code, plain numbers, and repeated signs as in ruled lines, random ones are digests of their keys written in base 64 and in
lower- and upper-case hexadecimal. Only pair counts leave the cluster (at most
``len(ALPHABET) ** 2`` per model).

All column expressions. A match's place follows from the pieces between
matches: the text split at a pattern and the pattern's matches alternate, so
their lengths add up to every start and end (in code points, end exclusive).
No shuffle of texts: each document is scanned where it is read.

Defined results: a null or empty text has no spans (``base_sha256`` of the
empty text); equal texts have equal spans; an empty table gives an empty
result; with no sample both models are uniform and no run is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdflow.llm.common import text_or_empty
from herdflow.operators.rows import once

# Fixed patterns of the contract.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGN_VALUE = 6

KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_RUN = 16
SHORT_WORD = 4
SAMPLE_ROWS = 5_000
SMOOTHING = 0.5
BACK_OFF = 8.0
JOINTS = "/_-"
RULES = "=-_/+"
THRESHOLD = 0.8

_SPANS = "array<struct<start:int,kind:int,end:int>>"
_PARTS = "array<struct<start:int,kind:int,end:int,text:string>>"


def _span(start: Column, kind: Column, end: Column, *text: Column) -> Column:
    """(start, kind, end), and the text where it is carried along."""
    return F.struct(start.alias("start"), kind.alias("kind"), end.alias("end"), *[t.alias("text") for t in text])


# Elements that a fold appends to one array; an append copies the array.
FOLD_BLOCK = 1024


def _fold(items: Column, state: dict[str, Column], kind: str, step) -> Column:
    """A left fold whose state holds ``state`` and ``found``, an array of type
    ``kind`` that ``step(state, item)`` appends to. Items are folded in blocks, so
    that an append never copies more than a block's finds."""
    names = list(state)
    whole = lambda s, found: F.struct(*[s[n].alias(n) for n in names], found.alias("found"))
    none = F.array().cast(kind)

    def folded(held):
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(held) / FOLD_BLOCK).cast("int")),
                             lambda b: F.slice(held, b * FOLD_BLOCK + 1, FOLD_BLOCK))
        return F.aggregate(blocks, whole(state, none), lambda s, block: F.aggregate(
            block, whole(s, none), step, lambda e: whole(e, F.concat(s["found"], e["found"]))))

    # The array is bound to a name, else every block would work it out again.
    return F.transform(F.array(items), folded)[0]


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Places of the leftmost non-overlapping matches whose ``group`` has at
    least ``least`` code points: array of (start, kind, end)."""
    pieces = F.split(text, pattern, -1)
    parts = F.arrays_zip(
        F.transform(F.slice(pieces, 1, F.size(pieces) - 1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("own"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length).alias("value"))
    parts = parts.cast("array<struct<gap:int,own:int,value:int>>")

    def step(s, x):
        begin = s["at"] + x["gap"]
        end = begin + x["own"]
        span = _span(begin, F.lit(kind), end)
        return F.struct(end.alias("at"), F.when(x["value"] >= least, F.array_append(s["found"], span))
                        .otherwise(s["found"]).alias("found"))

    return F.when(F.regexp_like(text, F.lit(pattern)), _fold(parts, {"at": F.lit(0)}, _SPANS, step)["found"]).otherwise(
        F.array().cast(_SPANS))


def _pair_counts(strings: DataFrame) -> list[int]:
    """Counts of every character pair of strings of key characters: two-character
    strings are counted, and only the counted ones get their place in the table."""
    chars = F.split("s", "")
    pairs = F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, b))
    counted = strings.select(F.explode(pairs).alias("p")).groupBy("p").count()
    counts, k = [0] * len(ALPHABET) ** 2, len(ALPHABET)
    for pair, n in counted.filter(F.length("p") == 2).collect():
        counts[ALPHABET.index(pair[0]) * k + ALPHABET.index(pair[1])] = n
    return counts


def _conditional(counts: list[int]) -> list[float]:
    """p(b | a) of every pair, smoothed towards p(b)."""
    k, out = len(ALPHABET), []
    seen = [sum(counts[b::k]) for b in range(k)]
    alone = [(n + SMOOTHING) / (sum(seen) + SMOOTHING * k) for n in seen]
    for a in range(k):
        row = counts[a * k:(a + 1) * k]
        total = sum(row) + BACK_OFF
        out += [(n + BACK_OFF * p) / total for n, p in zip(row, alone, strict=True)]
    return out


def markov_ratios(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rows: int = SAMPLE_ROWS) -> list[float]:
    """``ln(p_random / p_ordinary)`` of every character pair, from the
    labelled samples of at most ``rows`` documents."""
    ids = docs.select(F.col(f"`{id_col}`").alias("__id")).filter(F.col("__id").isNotNull()).distinct()
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    keys = F.sha2(F.concat(F.lit("sample:"), F.col("__id").cast("string")), 512)
    digests = ids.select(F.explode(F.array(
        F.regexp_replace(F.base64(F.unhex(keys)), "[^A-Za-z0-9+/=]", ""), F.lower(keys), F.upper(keys))).alias("s"))
    texts = docs.select(F.col(f"`{id_col}`").alias("__doc"), text_or_empty(text_col).alias("__t")).join(
        F.broadcast(ids), F.col("__doc") == F.col("__id"), "left_semi")  # at most ``rows`` keys
    texts = texts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = F.regexp_extract_all("__t", F.lit("[A-Za-z0-9+/_=-]+"), F.lit(0))
    short = texts.select(F.filter(runs, lambda s: F.length(s).between(SHORT_WORD, MIN_RUN - 1)).alias("w"))
    # In turn with a joint, in camel case, and with a capital first; the last one's is null.
    ways = len(JOINTS) + 2
    joint = lambda i: F.substring(F.lit(JOINTS), i % ways + 1, F.lit(1))
    large = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))
    joined = F.transform("w", lambda s, i: F.when(i % ways < len(JOINTS), F.concat(s, joint(i), F.get("w", i + 1))).otherwise(
        F.concat(F.when(i % ways == len(JOINTS), s).otherwise(large(s)), large(F.get("w", i + 1)))))
    words = short.select(F.explode(F.concat("w", F.filter(joined, lambda s: s.isNotNull()))).alias("s"))
    numbers = ids.select(F.regexp_replace(F.xxhash64("__id").cast("string"), "-", "").alias("s"))
    rules = ids.select(F.repeat(F.substring(F.lit(RULES), F.pmod(F.xxhash64("__id"), F.lit(len(RULES))).cast("int") + 1,
                                            F.lit(1)), F.lit(SHORT_WORD)).alias("s"))
    ordinary = words.unionByName(numbers).unionByName(rules)
    random_p, ordinary_p = _conditional(_pair_counts(digests)), _conditional(_pair_counts(ordinary))
    return [math.log(r / o) for r, o in zip(random_p, ordinary_p, strict=True)]


def _beside(runs: Column, base: Column) -> Column:
    """The parts of the runs that no base span covers, ``MIN_RUN`` characters
    long at least, with their text: one pass over runs (which carry theirs) and
    base spans in the order of their starts. ``at`` and ``end`` bound what is left
    of the run at hand, ``over`` is how far base spans have come."""
    def step(s, x):
        run, cut = x["kind"] == 3, F.least(x["start"], s["end"])
        part = _span(s["at"], F.lit(3), cut, F.substring(s["text"], s["at"] - s["begin"] + 1, cut - s["at"]))
        found = F.when(cut - s["at"] >= MIN_RUN, F.array_append(s["found"], part)).otherwise(s["found"])
        now = {"at": F.when(run, F.greatest(x["start"], s["over"])).otherwise(F.greatest(s["at"], x["end"])),
               "over": F.when(run, s["over"]).otherwise(F.greatest(s["over"], x["end"]))}
        now |= {name: F.when(run, x[of]).otherwise(s[name]) for name, of in (("begin", "start"), ("end", "end"), ("text", "text"))}
        return F.struct(*[now[n].alias(n) for n in nothing], found.alias("found"))

    plain = F.transform(base, lambda x: _span(x["start"], x["kind"], x["end"], F.lit(None).cast("string")))
    far = F.lit(2 ** 31 - 1)  # a last span beyond any text closes the last run
    last = F.array(_span(far, F.lit(0), far, F.lit(None).cast("string")))
    nothing = {"at": F.lit(0), "over": F.lit(0), "begin": F.lit(0), "end": F.lit(0), "text": F.lit("")}
    events = F.concat(F.sort_array(F.concat(runs.cast(_PARTS), plain.cast(_PARTS))), last.cast(_PARTS))
    return _fold(events, nothing, _PARTS, step)["found"]


def _mean_ratio(run: Column, table: Column) -> Column:
    """Mean of the table's values over the character pairs of a run of key characters."""
    place = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))
    step = lambda s, c: F.struct(place(c).alias("before"), (s["sum"] + F.when(s["before"] >= 0, F.get(
        table, s["before"] * len(ALPHABET) + place(c))).otherwise(F.lit(0.0))).alias("sum"))
    return F.aggregate(F.split(run, ""), start, step, lambda s: s["sum"]) / (F.length(run) - 1)


def scan(docs: DataFrame, ratios: list[float], *, text_col: str = "text", out: str = "secret_spans",
         threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with an array of (start, kind, end) added, sorted; ``kind``
    indexes ``KINDS``."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    text = text_or_empty(text_col)
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    runs = f"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
    # Columns that later ones use several times are generated, not inlined.
    found = docs.select(*own, text.alias("__text"))
    found = once(found, F.concat(_spans(text, ASSIGN, 0, 2, ASSIGN_VALUE), _spans(text, ACCESS, 1), _spans(text, HEX, 2)), "__base")
    said = F.arrays_zip(_spans(text, runs, 3).alias("r"), F.regexp_extract_all(text, F.lit(runs), F.lit(0)).alias("t"))
    found = once(found, F.transform(said, lambda x: _span(x["r"]["start"], F.lit(3), x["r"]["end"], x["t"])), "__runs")
    found = once(found, _beside(F.col("__runs"), F.col("__base")), "__free")
    kept = found.select(*own, "__base", F.transform(F.filter("__free", lambda p: _mean_ratio(p["text"], table) >= F.lit(threshold)),
                                                    lambda p: _span(p["start"], p["kind"], p["end"])).alias("__added"))
    return kept.select(*own, F.sort_array(F.concat("__base", "__added")).alias(out))


def secret_table(docs: DataFrame) -> DataFrame:
    """One row per document: counts per fixed pattern, the digest of the fixed
    patterns' spans, and all spans as text."""
    scanned = scan(docs.select("doc_id", "text"), markov_ratios(docs)).drop("text")
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda x: x["kind"] < 3)
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                          F.sha2(said(base), 256).alias("base_sha256"), said(F.col("secret_spans")).alias("spans"),
                          count(3).alias("n_markov"))
