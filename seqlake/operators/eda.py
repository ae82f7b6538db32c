"""Exploratory aggregations behind the dashboard pages.

Each one is a single aggregate pass (plus, for binned/fenced statistics, one
bounded action for the bounds); wide results are reshaped from the one-row
aggregate with ``explode(array(struct...))`` rather than by scanning again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.operators.quantiles import quantiles

_FLOATS = (T.FloatType, T.DoubleType)


def _missing(df: DataFrame, c: str):
    col = F.col(c)
    if isinstance(df.schema[c].dataType, _FLOATS):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def missing_by_column(df: DataFrame) -> DataFrame:
    """column, missing_count, missing_pct (2 places); only > 0, most first."""
    n = F.count(F.lit(1))
    one = df.agg(n.alias("_n"), *[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"))
                               for i, c in enumerate(df.columns)])).alias("r")
    out = one.select("_n", rows).select("r.column", "r.missing_count", "_n")
    out = out.where(F.col("missing_count") > 0)
    return out.select("column", "missing_count",
                      F.round(F.col("missing_count") / F.col("_n") * 100.0, 2).alias("missing_pct"))


def total_missing(df: DataFrame):
    return sum((F.count_if(_missing(df, c)) for c in df.columns), F.lit(0))


def dataset_summary(df: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """rows, columns, missing cells, duplicated ids (null counts as one value)."""
    n = F.count(F.lit(1))
    distinct_ids = F.count_distinct(id_col) + F.max(F.col(id_col).isNull().cast("int"))
    return df.agg(n.alias("total_samples"), F.lit(len(df.columns)).alias("total_features"),
                  total_missing(df).alias("missing_values"),
                  (n - distinct_ids).alias("duplicate_samples"))


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Counts per non-null value, most frequent first (ties by value)."""
    out = (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
             .orderBy(F.col("count").desc(), F.col(col)))
    return out.limit(top) if top else out


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long-form crosstab, rows with either value null dropped, zeros filled.

    Each level of ``a`` carries the level list of ``b`` and explodes it; the
    zero-filled grid is the result itself, at any number of levels.
    """
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    counts = d.groupBy(a, b).agg(F.count(F.lit(1)).alias("count"))
    levels = counts.agg(F.collect_set(b).alias("l")).scalar()
    grid = counts.select(a).distinct().withColumn("_levels", levels).select(a, F.explode("_levels").alias(b))
    return grid.join(counts, [a, b], "left").select(a, b, F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def group_stats(df: DataFrame, by: str, col: str) -> DataFrame:
    """mean, sample std, count of ``col`` per group, highest mean first."""
    x = F.col(col).cast("double")
    return (df.where(F.col(by).isNotNull()).groupBy(by)
              .agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count(x).alias("count"))
              .orderBy(F.col("mean").desc(), F.col(by)))


def _quartiles(df: DataFrame, cols: list[str], mode: str, accuracy: int = 100_000) -> list[list[float] | None]:
    """25, 50 and 75 % per column: exact and interpolated in bounded memory, or one sketch pass (``approx``)."""
    if mode == "exact":
        return quantiles(df, cols, [0.25, 0.5, 0.75])
    if mode == "approx":
        probs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        return list(df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(f"q{i}") for i, c in enumerate(cols)]).first())
    raise ValueError(mode)


def describe(df: DataFrame, cols: list[str], mode: str = "exact") -> DataFrame:
    """count, mean, sample std, min, 25/50/75%, max per column.

    ``exact`` quartiles are interpolated linearly like the original's and found
    first, in a few passes of bounded memory; they enter the one-row aggregate as literals.
    """
    quartiles = _quartiles(df, cols, mode)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    one = df.agg(*aggs)
    lit = lambda v: F.lit(None if v is None else float(v)).cast("double")
    rows = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"a{i}").alias("mean"),
        F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"),
        *[lit(q[j] if q else None).alias(name) for j, name in enumerate(("p25", "p50", "p75"))], F.col(f"hi{i}").alias("max"))
        for i, (c, q) in enumerate(zip(cols, quartiles))])).alias("r")
    return one.select(rows).select("r.*")


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins from min to max: bin, lo, hi, count (empty bins kept).

    bin = floor((x - min) / width), the maximum goes to the last bin.
    """
    x = F.col(col).cast("double")
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, count long")
    width = (hi - lo) / bins
    b = F.lit(0) if width == 0 else F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    edges = edges.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                         (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"))
    return edges.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def box_stats(df: DataFrame, col: str, mode: str = "exact") -> DataFrame:
    """q1, median, q3, IQR, 1.5-IQR fences and the count outside them
    (``mode`` as in :func:`describe`)."""
    x = F.col(col).cast("double")
    q = _quartiles(df, [col], mode)[0]
    if q is None:
        return df.sparkSession.createDataFrame([], "q1 double, median double, q3 double, iqr double, "
                                                   "lower_fence double, upper_fence double, n_outliers long")
    q1, med, q3 = q
    iqr = q3 - q1
    lf, uf = q1 - 1.5 * iqr, q3 + 1.5 * iqr
    return df.agg(F.lit(q1).alias("q1"), F.lit(med).alias("median"), F.lit(q3).alias("q3"),
                  F.lit(iqr).alias("iqr"), F.lit(lf).alias("lower_fence"), F.lit(uf).alias("upper_fence"),
                  F.count_if((x < F.lit(lf)) | (x > F.lit(uf))).alias("n_outliers"))


def column_means(df: DataFrame, cols: list[str], top: int | None = None) -> DataFrame:
    """feature, mean over rows (e.g. mean k-mer frequency); highest first."""
    one = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"))
                               for i, c in enumerate(cols)])).alias("r")
    out = one.select(rows).select("r.*").orderBy(F.col("mean").desc(), "feature")
    return out.limit(top) if top else out


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair (long form, both orders, diagonal 1).

    Pairwise complete: a row counts for every pair of columns that it has. All
    pairs are aggregates of one scan; the result has one row per pair of columns.
    """
    x = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if not pairs:
        return df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "col_a string, col_b string, corr double")
    one = x.agg(*[F.corr(f"c{i}", f"c{j}").alias(f"r{i}_{j}") for i, j in pairs])
    out = [(a, b, F.lit(1.0) if i == j else F.col(f"r{min(i, j)}_{max(i, j)}"))
           for i, a in enumerate(cols) for j, b in enumerate(cols)]
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), v.alias("corr")) for a, b, v in out]))
    return one.select(cells.alias("r")).select("r.*")


def key_findings(df: DataFrame) -> DataFrame:
    """Distinct serotypes/genotypes, modal serotype, mean density, mean GC."""
    modal = (df.where(F.col("serotype").isNotNull()).groupBy("serotype").agg(F.count(F.lit(1)).alias("n"))
               .agg(F.min_by("serotype", F.struct(-F.col("n"), F.col("serotype"))).alias("m")).scalar())
    return df.agg(F.count_distinct("serotype").alias("n_serotypes"),
                  F.count_distinct("genotype").alias("n_genotypes"),
                  F.avg("mutation_density").alias("mean_mutation_density"),
                  F.avg("gc_content").alias("mean_gc_content")).select("*", modal.alias("modal_serotype"))
