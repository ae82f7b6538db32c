"""Column-level functions (JVM expressions only, no Python UDFs)."""

from seqlake.functions.sequence import (  # noqa: F401
    ambiguous_count,
    clean_sequence,
    gc_content,
    infer_serotype,
    invalid_chars,
    is_complete,
    preview,
    strip_non_acgt,
    to_numeric,
    year_from_date,
    SEROTYPE_PATTERNS,
    VALID_BASES,
    AMBIGUOUS_BASES,
)
