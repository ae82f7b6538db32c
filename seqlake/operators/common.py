"""Small shared helpers: bounded broadcast and the replayable hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_ROWS = 100_000


def bounded_broadcast(small: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``small`` only after checking it holds at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows of an (already aggregated)
    frame; beyond the bound the frame is returned as is and Spark shuffles.
    """
    n = small.limit(max_rows + 1).count()
    return F.broadcast(small) if n <= max_rows else small


def hash_key(*cols, seed: int | str = 42) -> Column:
    """Replayable pseudo-random order key: md5 of ``seed|c1|c2...`` (hex text).

    DuckDB computes the same string with ``md5(concat(...))``.
    """
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_key_sql(*cols, seed: int | str = 42) -> str:
    """DuckDB text of :func:`hash_key`."""
    parts = [f"'{seed}'"] + [f"coalesce(cast({c} as varchar), '')" for c in cols]
    return "md5(concat_ws('|', " + ", ".join(parts) + "))"
