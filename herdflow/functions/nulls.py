"""Missing-value model: tokens -> NULL on the way in, NULL -> token on the way out.

Inside the engine a missing value is always SQL ``NULL``. The raw files spell
"missing" several ways; these column expressions normalise them. All of them
are Catalyst expressions (no Python UDF), so they stay inside whole-stage
codegen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from herdflow.functions._col import as_col

# ---------------------------------------------------------------------------
# These must equal the reference's spelling of "missing".
# General input tokens (also used by the lineage and offspring producers):
MISSING_TOKENS = ("", "-99", "-99.0", "MISSING")
# Wider token set of the carcass / slaughter-history loader (no "MISSING"):
CARCASS_MISSING_TOKENS = ("", "nan", "NaN", "None", "NONE", "-99", "-99.0")
# Known-bad lineage identifiers that count as missing:
UNKNOWN_LINEAGE_CODES = (
    "kluWj1LiM8I6nYWfDenO7q4tJySB2AVV8z9cMqweuXA=",
    "gQagjD++POKUI4kyvXKUoA==",
    "2XwK0r9Ij2yaHcePqO7Bwg==",
)
# Output spellings.
MISSING_TEXT = "MISSING"
MISSING_NUMBER = -99
MISSING_WEATHER = -99.0
# ---------------------------------------------------------------------------


WHITESPACE = " \t\n\r\x0b\x0c"


def ws_trim(c) -> Column:
    """Strip all leading/trailing ASCII whitespace (plain ``trim`` only strips
    spaces); a character-set trim, no regex."""
    return F.trim(as_col(c).cast("string"), F.lit(WHITESPACE))


def null_tokens(c, tokens: Iterable[str] = MISSING_TOKENS) -> Column:
    """B1: trim, then any missing token -> NULL; other text is kept trimmed."""
    t = ws_trim(c)
    return F.when(t.isin(*list(tokens)), F.lit(None).cast("string")).otherwise(t)


def clean_identifier(c, tokens: Iterable[str] = MISSING_TOKENS,
                     bad_codes: Iterable[str] = UNKNOWN_LINEAGE_CODES) -> Column:
    """B2: identifier cleaning; tokens and known-bad codes -> NULL."""
    return null_tokens(c, tuple(tokens) + tuple(bad_codes))


def to_number(c, tokens: Iterable[str] = MISSING_TOKENS, dtype: str = "double") -> Column:
    """Token-aware text -> number; unparsable text -> NULL (no ANSI error)."""
    return null_tokens(c, tokens).try_cast(dtype)


def sentinel_to_null(c, sentinel: float = -99) -> Column:
    """Numeric sentinel -> NULL (numeric columns only)."""
    col = as_col(c)
    return F.when(col == F.lit(sentinel), F.lit(None)).otherwise(col)


def obs_to_float(c) -> Column:
    """Observation text -> double; ``""``, ``-99``, ``-99.0`` and bad text -> NULL."""
    v = ws_trim(c).try_cast("double")
    return F.when(v == F.lit(-99.0), F.lit(None).cast("double")).otherwise(v)


def number_or_sentinel(c, sentinel: float = MISSING_NUMBER) -> Column:
    """bad/missing number -> sentinel (sink side)."""
    return F.coalesce(ws_trim(c).try_cast("double"), F.lit(float(sentinel)))


def round_or_sentinel(c, digits: int = 1, sentinel: float = MISSING_WEATHER) -> Column:
    """Half-even round to ``digits`` or the weather sentinel."""
    return F.coalesce(F.bround(as_col(c).cast("double"), digits), F.lit(float(sentinel)))


def missing_out(c, token: str = MISSING_TEXT) -> Column:
    """NULL -> output token, value cast to string."""
    return F.coalesce(as_col(c).cast("string"), F.lit(token))


def zero_to_sentinel(c, sentinel: int = MISSING_NUMBER) -> Column:
    """B32 (counts): a zero count is written as the sentinel."""
    col = as_col(c)
    return F.when(col == 0, F.lit(sentinel)).otherwise(col)


def null_to_zero(c) -> Column:
    """NULL -> 0."""
    return F.coalesce(as_col(c), F.lit(0))


def text_or_empty(c) -> Column:
    """NULL -> '', stripped text."""
    return F.coalesce(ws_trim(c), F.lit(""))
