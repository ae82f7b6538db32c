"""Hilbert-curve sharding of documents (DataFrame functions only).

Language, source and size are quantised to ``BITS`` bits each, the cell of each
row becomes its index on the 3-d Hilbert curve, and the curve order is cut into
runs of equal row counts. Rows that are near in all three dimensions share a
shard, so a reader's min/max statistics prune files for filters on any of them.

* language and source: rank by code point (null first), spread over the axis.
  Their level tables have one row per distinct value.
* size: twice the base-2 logarithm of the UTF-8 size, from a fixed list of bounds.

The global rank needs no global sort: row counts per (curve index, slice) give
offsets, where a slice is ``2**SLICE_BITS`` hash ranges of the document id, so a
cell with a third of all rows is still split over many tasks.

Edge cases: null text counts as empty (size 1, crc 0), null ids, languages and
sources sort first, equal rows each get their own slot, an empty table gives an
empty result, extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.session import materialize

BITS = 5
SLICE_BITS = 10
SIZE_BOUNDS = [int(2 ** (k / 2)) for k in range(8, 8 + 2 ** BITS - 1)]


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of points with ``bits``-bit coordinates (Skilling's transform).

    The fold runs over the bit planes from the top; each step reflects or
    exchanges the low bits of the first axis, then a Gray code gives the index.
    """
    names = [f"x{i}" for i in range(len(axes))]

    def undo(acc, q):
        p = q - 1
        x = [acc[n] for n in names]
        first = x[0]
        out = [None] * len(x)
        for i in range(len(x)):
            on = x[i].bitwiseAND(q) != 0
            swap = first.bitwiseXOR(x[i]).bitwiseAND(p) if i else F.lit(0)
            out[i] = F.when(on, x[i]).otherwise(x[i].bitwiseXOR(swap)) if i else None
            first = F.when(on, first.bitwiseXOR(p)).otherwise(first.bitwiseXOR(swap) if i else first)
        out[0] = first
        return F.struct(*[c.alias(n) for c, n in zip(out, names)])

    planes = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    start = F.struct(*[a.cast("int").alias(n) for a, n in zip(axes, names)])

    def gray(acc):
        x = [acc[n] for n in names]
        for i in range(1, len(x)):
            x[i] = x[i].bitwiseXOR(x[i - 1])
        flip = F.lit(0)
        for b in range(bits - 1, 0, -1):
            flip = flip.bitwiseXOR(F.when(x[-1].bitwiseAND(1 << b) != 0, (1 << b) - 1).otherwise(0))
        code = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for v in x:
                bit = F.shiftright(v.bitwiseXOR(flip), b).bitwiseAND(1)
                code = code * 2 + bit
        return code

    return F.aggregate(planes, start, undo, gray)


def _levels(rows: DataFrame, col: str, bits: int) -> DataFrame:
    """Quantised code point rank of each distinct value (one row per value)."""
    every = Window.partitionBy(F.lit(0))
    d = rows.groupBy(F.col(col).alias(f"_{col}")).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(every.orderBy(F.col(f"_{col}").cast("binary").asc_nulls_first())) - 1
    q = F.floor(rank * F.lit(1 << bits) / F.greatest(F.count(F.lit(1)).over(every), F.lit(1 << bits)))
    return d.select(f"_{col}", q.cast("int").alias(f"_q_{col}"))


def curve_rank(docs: DataFrame, bits: int = BITS, whole: bool = False) -> tuple[DataFrame, int]:
    """Rows with ``doc_id, size, text_crc32, lang, source, curve, rank`` (dense from 0), and their number.

    ``whole`` also carries each row of ``docs`` itself, as ``_row``.
    """
    row = ["_row"] if whole else []
    docs = docs.withColumn("_row", F.struct(*docs.columns)) if whole else docs
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), *row)
    rows = materialize(rows, "hilbert-rows")
    for c in ("lang", "source"):
        rows = rows.join(_levels(rows, c, bits), F.col(c).eqNullSafe(F.col(f"_{c}")), "left").drop(f"_{c}")
    length = F.size(F.filter(F.array(*[F.lit(b) for b in SIZE_BOUNDS]), lambda b: b <= F.col("size")))
    slot = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - SLICE_BITS)
    rows = rows.select("doc_id", "size", "text_crc32", "lang", "source",
                       hilbert_index([F.col("_q_lang"), F.col("_q_source"), length], bits).alias("curve"),
                       slot.alias("_slice"), *row)
    rows = materialize(rows, "hilbert-curve")
    counts = rows.groupBy("curve", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    # per curve index at most 2**SLICE_BITS rows; over curve indexes at most 2**(3 * bits) rows
    before = Window.partitionBy("curve").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("_in", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    along = Window.partitionBy(F.lit(0)).orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = (counts.groupBy("curve").agg(F.sum("_n").alias("_c"))
             .withColumn("_at", F.coalesce(F.sum("_c").over(along), F.lit(0))).select("curve", "_at"))
    offsets = within.join(cells, "curve").select("curve", "_slice", (F.col("_at") + F.col("_in")).alias("_off"))
    inside = Window.partitionBy("curve", "_slice").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("_rn", F.row_number().over(inside)).join(offsets, ["curve", "_slice"])
    n = rows.count()
    return ranked.withColumn("rank", F.col("_off") + F.col("_rn") - 1).drop("_off", "_rn", "_slice"), n


def shard(docs: DataFrame, shards: int = 16, bits: int = BITS, whole: bool = False) -> DataFrame:
    """Cut the curve order into ``shards`` runs whose row counts are at most one apart.

    Row ``r`` of ``n`` goes to shard ``floor(r * shards / n)``; its slot counts from the run's first row.
    """
    ranked, n = curve_rank(docs, bits, whole)
    s = F.expr(f"cast(rank * {int(shards)} div {max(n, 1)} as int)")
    start = F.expr(f"(cast(shard as bigint) * {max(n, 1)} + {int(shards) - 1}) div {int(shards)}")
    return ranked.withColumn("shard", s).withColumn("slot", F.col("rank") - start)


def write_shards(docs: DataFrame, path: str, shards: int = 16, bits: int = BITS) -> None:
    """Write the documents with their shard as one directory per shard, rows in curve order."""
    rows = shard(docs, shards, bits, whole=True).select("_row.*", "shard", "slot", "curve")
    rows = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.mode("overwrite").partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and the curve index."""
    return shard(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")
