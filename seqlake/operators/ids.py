"""Dense row numbering without a single-partition window.

``row_number()`` over a global order puts every row in one task. Here rows are
range-partitioned and sorted inside partitions, each row's position inside its
partition comes from ``monotonically_increasing_id`` (partition id in the top
bits), and partition offsets come from a per-partition count table whose size
is bounded by the number of partitions. Counts and rows must come from one and the
same layout, so the tagged rows are written to the shared folder first: a range
shuffle evaluated twice may draw other bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.session import materialize

_LOW = (1 << 33) - 1


def dense_index(df: DataFrame, order_by=None, col: str = "_idx", start: int = 1,
                num_partitions: int | None = None) -> DataFrame:
    """Add a dense, gap-free index in ``order_by`` order (or file order when None)."""
    if order_by is not None:
        keys = [order_by] if isinstance(order_by, str) else list(order_by)
        if num_partitions:
            df = df.repartitionByRange(num_partitions, *keys)
        else:
            df = df.repartitionByRange(*keys)
        df = df.sortWithinPartitions(*keys)
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    tagged = (tagged.withColumn("_pid", F.shiftright("_mid", 33))
                    .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(_LOW))))
    tagged = materialize(tagged, "index")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    # one row per partition: the broadcast is bounded by the partition count
    out = tagged.join(F.broadcast(offsets), "_pid", "inner")
    out = out.withColumn(col, F.col("_off") + F.col("_pos") + F.lit(start))
    return out.drop("_mid", "_pid", "_pos", "_off")


def with_sample_ids(df: DataFrame, id_col: str = "sample_id", order_by=None,
                    fmt: str = "SAMPLE_%04d", start: int = 1) -> DataFrame:
    """Generate ``SAMPLE_0001``... (``fmt=None`` keeps the bare integer)."""
    out = dense_index(df, order_by=order_by, col="_idx", start=start)
    idc = F.format_string(fmt, F.col("_idx")) if fmt else F.col("_idx")
    return out.withColumn(id_col, idc).drop("_idx")


def prefix_sum(df: DataFrame, order_by: str, value_col: str, out_col: str = "_cum",
               inclusive: bool = True) -> DataFrame:
    """Running total of ``value_col`` in ``order_by`` order, over all rows.

    Range-partitioned so each task sums one contiguous slice; slice offsets
    come from a per-partition total table (bounded by the partition count).
    Rows with equal keys get the running total in arbitrary tie order; callers
    that need tie groups aggregate by the key first.
    """
    r = materialize(df.repartitionByRange(order_by).withColumn("_pid", F.spark_partition_id()), "prefix")
    tot = r.groupBy("_pid").agg(F.sum(value_col).alias("_t"))
    off = tot.select("_pid", F.coalesce(F.sum("_t").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_pid").orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
    local = r.withColumn("_loc", F.sum(value_col).over(w))
    out = local.join(F.broadcast(off), "_pid", "inner")
    cum = F.col("_off") + F.col("_loc")
    if not inclusive:
        cum = cum - F.col(value_col)
    return out.withColumn(out_col, cum).drop("_pid", "_off", "_loc")
