"""Replayable splits and samples (E1-E5), skew-safe.

Every random choice is an md5 order on ``seed|id`` so another engine can
replay it. Ranking inside a class never sends a whole class to one task: rows
are bucketed by the first 16 bits of the hash, a small (class, bucket)
histogram gives each bucket's offset, and only rows of one (class, bucket)
pair meet in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.operators.common import hash_key

BUCKET_HEX = 4  # 16-bit buckets: a class of n rows puts about n/65536 in a task


def hash_rank(df: DataFrame, by: str | None, id_col: str, seed=42, col: str = "_rank",
              hex_digits: int = BUCKET_HEX) -> DataFrame:
    """1-based rank of each row inside its ``by`` class in md5(seed|id) order."""
    g = F.col(by) if by else F.lit(0)
    h = df.withColumn("_g", g).withColumn("_h", hash_key(id_col, seed=seed))
    h = h.withColumn("_b", F.substring("_h", 1, hex_digits))
    hist = h.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = hist.select(F.col("_g").alias("_og"), F.col("_b").alias("_ob"),
                       F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    j = h.join(offs, F.col("_g").eqNullSafe(F.col("_og")) & (F.col("_b") == F.col("_ob")), "inner").drop("_og", "_ob")
    wr = Window.partitionBy("_g", "_b").orderBy("_h", F.col(id_col).cast("string"))
    out = j.withColumn(col, F.col("_off") + F.row_number().over(wr))
    return out.drop("_g", "_h", "_b", "_off")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("_class_n"))


def stratified_split(df: DataFrame, label: str, id_col: str = "sample_id",
                     test_size: float = 0.2, seed=42, col: str = "is_test") -> DataFrame:
    """Per class, the round(test_size * n_class) rows first in hash order are test.

    Falls back to a plain split over all rows when any class has < 2 rows.
    """
    counts = class_counts(df, label)
    tiny = counts.where(F.col("_class_n") < 2).limit(1).count() > 0
    if tiny:
        n = df.count()
        r = hash_rank(df, None, id_col, seed)
        return r.withColumn(col, F.col("_rank") <= F.lit(round(test_size * n))).drop("_rank")
    counts = counts.withColumnRenamed(label, "_class")
    r = hash_rank(df, label, id_col, seed)
    r = r.join(counts, F.col(label).eqNullSafe(F.col("_class")), "inner").drop("_class")
    quota = F.round(F.col("_class_n") * F.lit(test_size))
    return r.withColumn(col, F.col("_rank") <= quota).drop("_rank", "_class_n")


def fold_ids(df: DataFrame, label: str | None, id_col: str = "sample_id", k: int = 5,
             seed=42, col: str = "fold") -> DataFrame:
    """Stratified fold id = (rank in class - 1) mod k; plain k-fold (rank over
    all rows) if ``label`` is None or any class has fewer than k rows."""
    if label is not None:
        small = class_counts(df, label).where(F.col("_class_n") < k).limit(1).count() > 0
        label = None if small else label
    r = hash_rank(df, label, id_col, seed)
    return r.withColumn(col, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def hash_sample(df: DataFrame, n: int, id_col: str = "sample_id", seed=42) -> DataFrame:
    """The ``n`` rows first in md5 order (a bounded top-k, E5)."""
    return (df.withColumn("_h", hash_key(id_col, seed=seed))
              .orderBy("_h", F.col(id_col).cast("string")).limit(n).drop("_h"))


def hash_head(df: DataFrame, n: int, id_col: str = "sample_id", seed=42) -> DataFrame:
    """Like :func:`hash_sample` for any ``n``: ranks with bounded tasks, no global sort."""
    return hash_rank(df, None, id_col, seed).where(F.col("_rank") <= n).drop("_rank")


def _names(df: DataFrame, column: str, limit: int = 3) -> list:
    """The first ``limit`` distinct non-null values by name (a bounded top-k)."""
    rows = (df.where(F.col(column).isNotNull()).select(column).distinct()
              .orderBy(column).limit(limit).collect())
    return [r[0] for r in rows]


def _rest(df: DataFrame, column: str, train_values) -> DataFrame:
    """Rows with a non-null value outside ``train_values`` (no value list needed)."""
    from seqlake.operators.relational import filter_membership

    return filter_membership(df.where(F.col(column).isNotNull()), column, train_values, negate=True)


def _holdout(train: DataFrame, n_novel: int, novel: DataFrame, id_col: str, seed, truth_col: str):
    """Known test rows taken out of ``train``: min(n_novel, n_train // 4) rows first in hash order."""
    from seqlake.operators.relational import union_with_truth

    n = min(n_novel, train.count() // 4)
    ranked = hash_rank(train, None, id_col, seed)
    known = ranked.where(F.col("_rank") <= n).drop("_rank")
    return ranked.where(F.col("_rank") > n).drop("_rank"), union_with_truth(known, novel, truth_col)


def novelty_split(df: DataFrame, train_values=None, test_values=None, column: str = "genotype",
                  id_col: str = "sample_id", seed=42, truth_col: str = "y_true", known_from: str = "rest"):
    """Return ``(train, test)``; test carries 0 (known) / 1 (novel) truth.

    Known test rows are rows whose value is in neither list (nulls included),
    as many as there are novel rows, first in hash order. Without a test list
    every non-train row is novel. Defaults: first value by name vs the rest.
    ``known_from='train_holdout'`` takes the known test rows out of the training rows instead.
    """
    from seqlake.operators.relational import filter_membership, union_with_truth

    if known_from not in ("rest", "train_holdout"):
        raise ValueError(f"unknown known_from {known_from!r}")
    default = train_values is None
    if default:
        names = _names(df, column, 2)
        if len(names) < 2:
            raise ValueError(f"need at least two {column} values")
        train_values = names[:1]
    train = filter_membership(df, column, train_values)
    if default:  # every other named value is novel; known rows are the unnamed ones
        novel = _rest(df, column, train_values)
        n_novel = novel.count()
        if known_from == "train_holdout":
            return _holdout(train, n_novel, novel, id_col, seed, truth_col)
        known = hash_head(df.where(F.col(column).isNull()), n_novel, id_col, seed)
        return train, union_with_truth(known, novel, truth_col)
    if test_values:
        novel = filter_membership(df, column, test_values)
        if known_from == "train_holdout":
            return _holdout(train, novel.count(), novel, id_col, seed, truth_col)
        rest = filter_membership(filter_membership(df, column, train_values, negate=True),
                                 column, test_values, negate=True)
        n_novel = novel.count()
        known = hash_head(rest, n_novel, id_col, seed)
        return train, union_with_truth(known, novel, truth_col)
    test = filter_membership(df, column, train_values, negate=True).withColumn(truth_col, F.lit(1))
    return train, test


def open_set_split(df: DataFrame, train_values=None, test_values=None, column: str = "serotype",
                   id_col: str = "sample_id", seed=42, truth_col: str = "y_true", known_from: str = "train"):
    """Return ``(train, test)``; known test rows are min(n_novel, n_train // 4)
    train rows first in hash order. Defaults: first two values by name vs rest.
    With ``known_from='train_holdout'`` these rows leave the training rows."""
    from seqlake.operators.relational import filter_membership, union_with_truth

    default = train_values is None
    if default:
        names = _names(df, column, 3)
        if len(names) < 2:
            raise ValueError(f"need at least two {column} values")
        train_values = names[:2]
    train = filter_membership(df, column, train_values)
    if (default and len(names) >= 3) or (not default and test_values):
        novel = _rest(df, column, train_values) if default else filter_membership(df, column, test_values)
        if known_from == "train_holdout":
            return _holdout(train, novel.count(), novel, id_col, seed, truth_col)
        n = min(novel.count(), train.count() // 4)
        known = hash_head(train, n, id_col, seed)
        return train, union_with_truth(known, novel, truth_col)
    test = filter_membership(df, column, train_values, negate=True).withColumn(truth_col, F.lit(1))
    return train, test
