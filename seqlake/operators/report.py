"""Report over an inference output: totals, flag counts, serotype counts and score histograms by flag.

One scan with grouping sets makes every section; only the histogram ranges are
found first, in one aggregate. The report has one row per serotype, flag value and
filled bin, whatever the number of predictions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: section of the flag, the flag, the score split by it
FLAGS = (("novel_genotype", "is_novel_genotype", "anomaly_score"),
         ("potential_new_serotype", "is_potential_new_serotype", "reconstruction_error"))
SCHEMA = "section string, key string, flag boolean, bin int, lo double, hi double, count long"


def prediction_report(df: DataFrame, bins: int = 30, serotype_col: str = "predicted_serotype") -> DataFrame:
    """``section, key, flag, bin, lo, hi, count`` of rows in the inference output's columns.

    Sections: ``total``; ``serotype`` (key = serotype, null for rows without); each flag's section; and its
    score's name, equal-width bins from least to largest score per flag value (a bin = floor((x - min) / width), the
    maximum in the last). Columns that are missing, or hold nothing because a task was not run, give null groups.
    """
    have = set(df.columns)
    flag = lambda c: F.col(c).cast("boolean") if c in have else F.lit(None).cast("boolean")
    score = lambda c: F.col(c).cast("double") if c in have else F.lit(None).cast("double")
    base = df.select((F.col(serotype_col).cast("string") if serotype_col in have else F.lit(None).cast("string")).alias("key"),
                     *[e for i, (_, f, s) in enumerate(FLAGS) for e in (flag(f).alias(f"f{i}"), score(s).alias(f"s{i}"))])
    ends = base.agg(*[e for i in range(len(FLAGS)) for e in (F.min(f"s{i}").alias(f"lo{i}"), F.max(f"s{i}").alias(f"hi{i}"))]).first()
    widths = [((ends[f"hi{i}"] - ends[f"lo{i}"]) / bins if ends[f"lo{i}"] is not None else 0.0) for i in range(len(FLAGS))]

    def cell(i: int):
        if ends[f"lo{i}"] is None:
            return F.lit(None).cast("int")
        if not widths[i]:
            return F.when(F.col(f"s{i}").isNotNull(), F.lit(0))
        return F.least(F.floor((F.col(f"s{i}") - F.lit(ends[f"lo{i}"])) / F.lit(widths[i])).cast("int"), F.lit(bins - 1))

    cells = base.select("key", *[e for i in range(len(FLAGS)) for e in (F.col(f"f{i}"), cell(i).alias(f"b{i}"))])
    names = ["key", *[n for i in range(len(FLAGS)) for n in (f"f{i}", f"b{i}")]]
    sets = [[], ["key"], *[[f"f{i}"] for i in range(len(FLAGS))], *[[f"f{i}", f"b{i}"] for i in range(len(FLAGS))]]
    grouped = cells.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    counts = grouped.agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("count"))

    def gid(used: list[str]) -> int:
        return sum(1 << (len(names) - 1 - i) for i, n in enumerate(names) if n not in used)

    def section(used: list[str], name: str, key, flag_col, bin_col, lo, hi) -> DataFrame:
        return counts.where(F.col("gid") == gid(used)).select(
            F.lit(name).alias("section"), key.cast("string").alias("key"), flag_col.cast("boolean").alias("flag"),
            bin_col.cast("int").alias("bin"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), "count")

    none = F.lit(None)
    parts = [section([], "total", none, none, none, none, none), section(["key"], "serotype", F.col("key"), none, none, none, none)]
    for i, (name, _, s) in enumerate(FLAGS):
        parts.append(section([f"f{i}"], name, none, F.col(f"f{i}"), none, none, none))
        lo = F.lit(ends[f"lo{i}"]).cast("double") + F.col(f"b{i}") * F.lit(widths[i])
        parts.append(section([f"f{i}", f"b{i}"], s, none, F.col(f"f{i}"), F.col(f"b{i}"), lo, lo + F.lit(widths[i])).where("bin is not null"))
    return reduce(DataFrame.unionByName, parts)
