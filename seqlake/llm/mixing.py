"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source is a flow. Its documents, shuffled by a seeded hash, are served one
after another (up to ``MAX_EPOCHS`` passes); a document's virtual finish time is
the source's words served so far, this document included, over the source's
target. Ordering all sources' documents by that time interleaves them in
proportion to their targets; the mix is the head of this global order that fits
the total budget (all words of the input).

Scale: a source may hold a third of all rows, so running totals go through
``2**HASH_BITS`` hash slices per source (a slice total per source and slice, then
a window inside one slice), and the budget cut is found in the histogram of
finish times, refined once inside the cell that holds the cut. No window sees a
whole source and no row is ranked globally unless the caller asks for the order.

Edge cases: null or blank texts have size 0 and are never taken; a null source is a
source of its own, ordered last; equal rows count each; an empty table gives an
empty result; extra columns pass through ``mix``, and columns named like the
ones added here are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.session import materialize

MAX_EPOCHS = 3
KEY_BITS = 60
HASH_BITS = 12
CELLS = 4096
SPACES = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in ``text`` (null: 0)."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, "[ \\t-\\r]+"))).cast("long")


def targets(sized: DataFrame, weights: Column | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: ``source, source_size, weight, target``.

    Default weights are 1, 2, 3, 1, ... by code point order (null last). Targets
    share the total by weight, none above ``max_epochs`` times its source; the
    excess is reshared by weight. With the capped sources in front (ascending
    cap per weight) the common level is (total - caps so far) / (weights left),
    so the resharing ends in one pass. The table has one row per source.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").cast("binary").asc_nulls_last()))
    s = s.withColumn("weight", weights.cast("double") if weights is not None
                     else (F.pmod(rank - 1, F.lit(3)) + 1).cast("double"))
    cap = (F.col("source_size") * max_epochs).cast("double")
    ahead = every.orderBy("_ratio", F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("weight"))
          .withColumn("_total", F.sum("source_size").over(every).cast("double"))
          .withColumn("_weights", F.sum("weight").over(every))
          .withColumn("_caps_ahead", F.coalesce(F.sum("_cap").over(ahead), F.lit(0.0)))
          .withColumn("_weights_ahead", F.coalesce(F.sum("weight").over(ahead), F.lit(0.0))))
    level = (F.col("_total") - F.col("_caps_ahead")) / (F.col("_weights") - F.col("_weights_ahead"))
    s = s.withColumn("_level", level)
    # a source is capped while its cap per weight is under the level left for those not yet capped
    s = s.withColumn("_open", F.max(F.when(F.col("_ratio") >= F.col("_level"), F.col("_level"))).over(every))
    share = F.least(F.col("_cap"), F.coalesce(F.col("_open"), F.col("_ratio")) * F.col("weight"))
    return s.select("source", "source_size", "weight", share.alias("target"))


def finish_times(sized: DataFrame, per_source: DataFrame) -> DataFrame:
    """Add ``source_size, target`` and ``_cum``: words of the source served up to this row, itself included.

    ``sized`` has ``source, size`` and ``_h``, the shuffle key. The join is on the
    source (null safe) against one row per source.
    """
    slot = F.shiftright(F.col("_h"), KEY_BITS - HASH_BITS)
    s = sized.withColumn("_slice", slot)
    sums = s.groupBy("source", "_slice").agg(F.sum("size").alias("_n"))
    # at most 2**HASH_BITS rows per source
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sums.select(F.col("source").alias("_s"), F.col("_slice").alias("_k"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    per = per_source.select(F.col("source").alias("_p"), "source_size", "target")
    offsets = offsets.join(per, F.col("_s").eqNullSafe(F.col("_p"))).drop("_p")
    inside = Window.partitionBy("source", "_slice").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_cum", F.sum("size").over(inside))
    s = s.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_k")))
    return s.withColumn("_cum", F.col("_cum") + F.col("_off")).drop("_s", "_k", "_off", "_slice")


def _finish(epoch) -> Column:
    return F.try_divide((F.lit(epoch) - 1) * F.col("source_size") + F.col("_cum"), F.col("target"))


def budget_cut(timed: DataFrame, max_epochs: int = MAX_EPOCHS) -> float:
    """The last finish time that the total budget reaches (-1 for an empty mix).

    Passes of every row are counted into ``CELLS`` equal cells of finish time; the
    cell holding the cut is counted again in as many cells, and only the rows of
    that small cell are ordered exactly.
    """
    live = timed.filter((F.col("size") > 0) & (F.col("target") > 0))
    copies = live.select("size", F.explode(F.array(*[F.struct(_finish(e).alias("v")) for e in range(1, max_epochs + 1)]))
                         .alias("c")).select("size", F.col("c.v").alias("v"))
    top = copies.agg(F.max("v").alias("m"), (F.sum("size") / max_epochs).alias("t")).first()
    if top.m is None:
        return -1.0
    budget, low, width, spent = round(top.t), 0.0, top.m, 0
    for _ in range(2):
        cell = F.least(F.floor((F.col("v") - low) / F.lit(width) * CELLS), F.lit(CELLS - 1))
        counts = copies.filter((F.col("v") >= low) & (cell >= 0)).groupBy(cell.alias("c")).agg(
            F.sum("size").alias("n"), F.max("v").alias("hi"), F.min("v").alias("lo"))
        counts = counts.withColumn("run", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("c")))
        hit = counts.filter(F.col("run") + F.lit(spent) > budget).orderBy("c").first()  # at most CELLS rows
        if hit is None:
            return float(copies.agg(F.max("v")).first()[0])
        spent += hit.run - hit.n
        low, width = hit.lo, (hit.hi - hit.lo) * (1 + 1e-12)
        copies = copies.filter((F.col("v") >= hit.lo) & (F.col("v") <= hit.hi))
        if not width:
            break
    running = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("v")) + F.lit(spent)
    tail = copies.groupBy("v").agg(F.sum("size").alias("n")).withColumn("run", running)
    # the copy that straddles the budget is taken if half of it fits
    last = tail.filter(F.col("run") - F.col("n") / 2 <= budget).agg(F.max("v")).first()[0]
    return float(last) if last is not None else math.nextafter(low, -math.inf)


def taken_passes(cut: float, max_epochs: int = MAX_EPOCHS) -> Column:
    """How many passes of the row end by the cut."""
    n = F.lit(0)
    for e in range(1, max_epochs + 1):
        n = n + F.when((F.col("size") > 0) & (F.col("target") > 0) & (_finish(e) <= F.lit(cut)), 1).otherwise(0)
    return n


def shuffle_key(seed: int = 42) -> Column:
    """Seeded ``KEY_BITS``-bit shuffle key: md5 of seed, source, document id and text; equal rows share it."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), part("source"), part("doc_id"), F.md5(part("text"))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def schedule(docs: DataFrame, seed: int = 42) -> tuple[DataFrame, float]:
    """``(doc_id, source, size, source_size, target, _h, _cum; cut)``, without the texts."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key(seed).alias("_h"))
    sized = materialize(sized, "mix-sizes")
    timed = materialize(finish_times(sized, targets(sized)), "mix-times")
    return timed, budget_cut(timed)


def mix(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, input columns kept.

    The texts move once, to meet their key's number of passes; equal rows share theirs.
    """
    timed, cut = schedule(docs, seed)
    passes = timed.groupBy("_h").agg(F.sum(taken_passes(cut)).alias("_passes"), F.count(F.lit(1)).alias("_rows")).filter("_passes > 0")
    every = [F.col(f"`{c}`") for c in docs.columns]
    other = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.lit(0).alias("_")))
    # wholly equal rows merge before they move; rows of one id, source and text may still differ in other columns
    each = docs.select(shuffle_key(seed).alias("_h"), F.xxhash64(other).alias("_x"), F.struct(*every).alias("_r"))
    each = each.groupBy("_h", "_x").agg(F.first("_r").alias("_r"), F.count(F.lit(1)).alias("_n")).join(passes, "_h")
    ahead = Window.partitionBy("_h").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    left = F.pmod(F.col("_passes"), F.col("_rows")) - F.coalesce(F.sum("_n").over(ahead), F.lit(0))
    own = F.floor(F.col("_passes") / F.col("_rows")) * F.col("_n") + F.least(F.greatest(left, F.lit(0)), F.col("_n"))
    each = each.withColumn("_own", own).filter("_own > 0").withColumn("_pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_own"))))
    return each.select("_r.*")


def mix_report(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken`` and the source."""
    timed, cut = schedule(docs, seed)
    return timed.select("doc_id", "size", "source_size", "target",
                        (taken_passes(cut) * F.col("size")).cast("long").alias("taken"), "source")
