"""Scalar sequence and metadata functions as Spark Column expressions.

All of them compile to built-in Catalyst expressions, so they stay inside
whole-stage codegen and never cross into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference for equal results) -------------
# Serotype patterns, tried in this order on the lowercased text; group 1 is
# the serotype number.
SEROTYPE_PATTERNS = [
    r"dengue virus type\s*([1-4])",
    r"dengue virus\s*([1-4])",
    r"type[-\s]*([1-4])",
    r"serotype[-\s]*([1-4])",
    r"denv[-\s]*([1-4])",
    r"den[-\s]*([1-4])",
]
SEROTYPE_PREFIX = "DENV-"
# Characters accepted by the sequence validator, and the ambiguity codes.
VALID_BASES = "ATCGNMRWSYKVHDB"
AMBIGUOUS_BASES = "NMRWSYKVHDB"
COMPLETE_MARKER = "complete genome"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def infer_serotype(*texts, strict: bool = False) -> Column:
    """First pattern (in list order) that matches the joined lowercased text.

    ``texts`` are joined with single spaces, skipping null/empty parts. With
    ``strict=True`` a word boundary is required before ``type`` so that
    "genotype 1" no longer reads as serotype 1.
    """
    parts = [F.when(_c(t) != "", _c(t)) for t in texts]
    text = F.lower(F.concat_ws(" ", *parts))
    pats = list(SEROTYPE_PATTERNS)
    if strict:
        pats[2] = r"\btype[-\s]*([1-4])"
    hits = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in pats]
    num = F.coalesce(*hits)
    return F.when(num.isNotNull(), F.concat(F.lit(SEROTYPE_PREFIX), num))


def year_from_date(date_col, mode: str = "last4") -> Column:
    """Year text from a collection date. ``last4`` = last four characters
    (what the original acquisition does, so "2010-03" gives "0-03");
    ``regex`` = first run of four digits."""
    d = _c(date_col)
    if mode == "last4":
        return F.when(d.isNotNull(), F.substring(d, -4, 4))
    if mode == "regex":
        return F.nullif(F.regexp_extract(d, r"(\d{4})", 1), F.lit(""))
    raise ValueError(f"unknown year mode {mode!r}")


def is_complete(description) -> Column:
    return F.coalesce(F.lower(_c(description)).contains(COMPLETE_MARKER), F.lit(False))


def gc_content(seq) -> Column:
    """(G+C)/length after uppercasing; null or empty -> 0.0.

    The denominator counts every character, ambiguous bases included.
    """
    u = F.upper(_c(seq))
    n = F.length(u)
    gc = n - F.length(F.translate(u, "GC", ""))
    return F.when(n > 0, gc.cast("double") / n.cast("double")).otherwise(F.lit(0.0))


def strip_non_acgt(seq) -> Column:
    """Uppercase and delete every character that is not A, C, G or T."""
    return F.regexp_replace(F.upper(_c(seq)), "[^ACGT]", "")


def clean_sequence(seq) -> Column:
    """Remove all whitespace and uppercase (the validator's cleaning)."""
    return F.upper(F.regexp_replace(_c(seq), r"\s+", ""))


def invalid_chars(clean) -> Column:
    """Sorted distinct characters outside the accepted alphabet, as one string."""
    rest = F.regexp_replace(_c(clean), f"[{VALID_BASES}]", "")
    chars = F.array_sort(F.array_distinct(F.split(rest, "")))
    return F.array_join(F.filter(chars, lambda x: x != ""), "")


def ambiguous_count(clean) -> Column:
    c = _c(clean)
    return (F.length(c) - F.length(F.translate(c, AMBIGUOUS_BASES, ""))).cast("long")


def preview(seq, n: int = 200) -> Column:
    """First ``n`` characters, plus ``...`` when the sequence is longer."""
    s = _c(seq)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def to_numeric(c) -> Column:
    """Coerce to double: booleans -> 0/1, unparsable or null -> 0.0."""
    return F.coalesce(_c(c).try_cast("double"), F.lit(0.0))
