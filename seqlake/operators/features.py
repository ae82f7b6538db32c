"""Feature grouping, column kinds, encoding, alignment and scaling.

Fitted state (levels, kinds, means, stds, feature order) is small: at most one
entry per feature column or per category level. It is computed by one
aggregate pass and kept as a plain Python structure / one-row-per-feature
table, then applied as literal column expressions (no join, no UDF).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.functions.sequence import to_numeric

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)
# fixed values: names that the rules look for, and columns that no detector uses
META_FEATURES = ["year", "country", "region", "host", "genome_length"]
PROTEIN_MARKERS = ["protein", "e_", "ns1", "ns3", "ns5"]
DETECTOR_EXCLUDE = ["sample_id", "description", "serotype", "genotype", "country", "year",
                    "host", "is_complete"]
LABEL_LEAK = ("_label",)


# --- D1 ---------------------------------------------------------------------

# group, how a name matches, word; a group holds a name that meets any of its rules
GROUP_RULES = [("X_seq", "starts", "kmer_"), ("X_seq", "is", "gc_content"), ("X_mut", "holds", "mut"), ("X_mut", "holds", "length_diff"),
               *[("X_prot", "holds", w) for w in PROTEIN_MARKERS], *[("X_meta", "is", w) for w in META_FEATURES]]
STRICT_RULES = [*[r for r in GROUP_RULES if r[0] != "X_prot"], ("X_prot", "holds", "protein"),
                *[("X_prot", "starts", f"{g}_") for g in ("E", "NS1", "NS2A", "NS2B", "NS3", "NS4A", "NS4B", "NS5")]]
DETECTOR_RULES = [("X", "starts", "kmer_"), ("X", "is", "gc_content"), ("X", "holds", "mut")]
_MATCH = {"starts": lambda name, word: name.startswith(word), "is": lambda name, word: name == word,
          "holds": lambda name, word: word in name.lower()}


def _matching(columns: list[str], rules: list[tuple[str, str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {group: [] for group, _, _ in rules}
    for c in columns:
        for group in {g for g, how, word in rules if _MATCH[how](c, word)}:
            out[group].append(c)
    return out


def group_features(columns: list[str], strict_names: bool = False) -> dict[str, list[str]]:
    """Name-rule groups (may overlap): X_seq, X_mut, X_prot, X_meta.

    The loose word ``e_`` also takes ``sample_id`` or ``genome_length`` for protein features; with
    ``strict_names`` these need the word "protein" or the prefix of a gene (``E_``, ``NS1_`` ...).
    """
    return _matching(columns, STRICT_RULES if strict_names else GROUP_RULES)


def features_for_task(feature_names: list[str], groups: dict[str, list[str]],
                      task: str = "all") -> list[str]:
    """``novelty``: names containing any X_seq/X_mut name; other tasks: all."""
    if task != "novelty":
        return list(feature_names)
    wanted = [*groups.get("X_seq", []), *groups.get("X_mut", [])]
    return [f for f in feature_names if any(w in f for w in wanted)]


def novelty_feature_columns(columns: list[str]) -> list[str]:
    """Detector auto-detect: k-mers, GC content and names of mutation features."""
    return [c for c in _matching(columns, DETECTOR_RULES)["X"] if c not in DETECTOR_EXCLUDE]


def open_set_feature_columns(columns: list[str], allow_label_features: bool = False) -> list[str]:
    cols = [c for c in columns if c not in DETECTOR_EXCLUDE]
    if not allow_label_features:
        cols = [c for c in cols if not c.endswith(LABEL_LEAK) and c != "known_genotype"]
    return cols


# --- B12 / B13 ----------------------------------------------------------------

def align_features(df: DataFrame, expected: list[str], keep: list[str] | None = None,
                   fill: float = 0.0) -> DataFrame:
    """Exactly ``expected`` columns in order: missing -> ``fill``, extras dropped."""
    keep = [c for c in (keep or []) if c in df.columns]
    have = set(df.columns)
    cols = [F.col(c) if c in have else F.lit(fill).cast("double").alias(c) for c in expected]
    return df.select(*[F.col(c) for c in keep], *cols)


def alignment_report(columns: list[str], expected: list[str]) -> dict[str, list[str]]:
    have = set(columns)
    exp = set(expected)
    return {"missing": [c for c in expected if c not in have],
            "extra": [c for c in columns if c not in exp]}


def alignment_frame(df: DataFrame, expected: list[str], keep: list[str] | None = None) -> DataFrame:
    """``feature, status, n_values``: each expected or extra column (``missing``, ``extra``, ``present``) with its non-null values."""
    found = alignment_report([c for c in df.columns if c not in (keep or [])], expected)
    status = {**{c: "present" for c in expected}, **{c: "missing" for c in found["missing"]}, **{c: "extra" for c in found["extra"]}}
    count = lambda c: F.lit(0).cast("long") if status[c] == "missing" else F.count(F.col(c))
    one = df.agg(*[count(c).alias(f"n{i}") for i, c in enumerate(status)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(s).alias("status"), F.col(f"n{i}").alias("n_values"))
                               for i, (c, s) in enumerate(status.items())])).alias("r")
    return one.select(rows).select("r.*")


def coerce_numeric(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Each column as double: booleans -> 0/1, unparsable or null -> 0."""
    keep = [c for c in (keep or []) if c in df.columns]
    return df.select(*keep, *[to_numeric(F.col(c)).alias(c) for c in columns])


# --- D3 -----------------------------------------------------------------------

def _distinct_profile(df: DataFrame, columns: list[str], exact_below: int, max_levels: int):
    """Row count, approximate distinct counts of every column (one pass), then
    exact sorted level sets for columns the sketch puts below ``exact_below``
    (second pass; each set is bounded by that cut, so memory stays bounded)."""
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.approx_count_distinct(F.col(c), 0.05).alias(f"a{i}") for i, c in enumerate(columns)]).first()
    approx = {c: row[f"a{i}"] for i, c in enumerate(columns)}
    small = [c for c in columns if approx[c] < exact_below]
    levels = {}
    if small:
        r2 = df.agg(*[F.array_sort(F.collect_set(F.col(c))).alias(f"e{i}") for i, c in enumerate(small)]).first()
        levels = {c: list(r2[f"e{i}"]) for i, c in enumerate(small)}
    return row["_n"], approx, levels


def column_kinds(df: DataFrame, columns: list[str], max_levels: int = 20,
                 share: float = 0.1) -> dict[str, str]:
    """Numeric columns with fewer than 20 distinct values *and* fewer than 10%
    of the row count are categorical; other numerics numeric; the rest
    categorical. Two aggregate passes in all (see ``_distinct_profile``).
    """
    kinds, _ = _kinds_and_levels(df, columns, max_levels, share, level_bound=0)
    return kinds


def _kinds_and_levels(df: DataFrame, columns: list[str], max_levels: int = 20, share: float = 0.1,
                      level_bound: int = 1000):
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in columns if isinstance(types[c], NUMERIC_TYPES)]
    others = [c for c in columns if c not in numeric]
    probe = numeric + (others if level_bound else [])
    n, approx, levels = _distinct_profile(df, probe, max(2 * max_levels, level_bound), level_bound)
    kinds = {c: "categorical" for c in others}
    for c in numeric:
        nu = len(levels[c]) if c in levels else 2 * max_levels
        kinds[c] = "categorical" if (nu < max_levels and nu < n * share) else "numeric"
    return kinds, levels


# --- D4 / D5 ------------------------------------------------------------------

def _level_text(v) -> str:
    if isinstance(v, bool):
        return "True" if v else "False"
    return str(v)


def category_levels(df: DataFrame, columns: list[str], max_levels: int = 1000) -> dict[str, list]:
    """Sorted distinct non-null levels of the columns narrow enough for a table column each.

    A column of more than ``max_levels`` levels is left out, as it is in ``one_hot``; ``seqlake.operators.sparse``
    encodes any number of levels.
    """
    out = {}
    for c in columns:
        rows = (df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c)
                  .limit(max_levels + 1).collect())
        if len(rows) <= max_levels:
            out[c] = [r[0] for r in rows]
    return out


def one_hot(df: DataFrame, levels: dict[str, list], drop_first: bool = True,
            keep_source: bool = False) -> DataFrame:
    """``col_level`` 0/1 columns for the given (trained) levels; null -> all 0.

    With ``drop_first`` the first sorted level gets no column. Levels are
    taken from ``levels`` (fit on training data), so unseen values give zeros.
    """
    enc = []
    for c, lv in levels.items():
        for v in (lv[1:] if drop_first else lv):
            enc.append(F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
                       .alias(f"{c}_{_level_text(v)}"))
    base = [F.col(c) for c in df.columns if keep_source or c not in levels]
    return df.select(*base, *enc)


def label_encode(df: DataFrame, column: str, levels: list | None = None,
                 out_col: str | None = None, handle_invalid: str = "error") -> DataFrame:
    """Sorted levels of the string cast -> 0..n-1 (nulls read as 'unknown')."""
    from pyspark.ml.feature import StringIndexer

    src = F.coalesce(F.col(column).cast("string"), F.lit("unknown"))
    tmp = df.withColumn("_lbl_src", src)
    out_col = out_col or column
    if levels is None:
        model = StringIndexer(inputCol="_lbl_src", outputCol="_lbl_idx",
                              stringOrderType="alphabetAsc", handleInvalid=handle_invalid).fit(tmp)
    else:
        from pyspark.ml.feature import StringIndexerModel
        model = StringIndexerModel.from_labels(sorted(str(v) for v in levels), inputCol="_lbl_src",
                                               outputCol="_lbl_idx", handleInvalid=handle_invalid)
    res = model.transform(tmp).withColumn("_lbl_idx", F.col("_lbl_idx").cast("int"))
    return res.drop(column).withColumnRenamed("_lbl_idx", out_col).drop("_lbl_src") \
        if out_col == column else res.withColumnRenamed("_lbl_idx", out_col).drop("_lbl_src")


# --- D7 -----------------------------------------------------------------------

@dataclass
class ScalerModel:
    """Per-feature mean and population std; zero std divides by 1."""
    features: list[str]
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        keep = [c for c in (keep or []) if c in df.columns and c not in self.features]
        have = set(df.columns)
        cols = []
        for c in self.features:
            x = F.col(c).cast("double") if c in have else F.lit(0.0)
            s = self.std[c] if self.std[c] else 1.0
            cols.append(((x - F.lit(self.mean[c])) / F.lit(s)).alias(c))
        return df.select(*keep, *cols)

    def exprs(self, inputs: dict | None = None) -> list:
        """Scaled column expressions; ``inputs`` maps a feature to its source
        expression (default: the column of that name)."""
        out = []
        for c in self.features:
            x = (inputs or {}).get(c, F.col(c)).cast("double")
            s = self.std[c] if self.std[c] else 1.0
            out.append((x - F.lit(self.mean[c])) / F.lit(s))
        return out

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "mean": self.mean, "std": self.std})

    @staticmethod
    def from_json(s: str) -> "ScalerModel":
        d = json.loads(s)
        return ScalerModel(d["features"], d["mean"], d["std"])

    def params_frame(self, spark) -> DataFrame:
        rows = [(i, c, float(self.mean[c]), float(self.std[c])) for i, c in enumerate(self.features)]
        return spark.createDataFrame(rows, "pos int, feature string, mean double, std double")


def fit_scaler(df: DataFrame, features: list[str]) -> ScalerModel:
    """One aggregate pass: avg and stddev_pop of every feature."""
    aggs = []
    for i, c in enumerate(features):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    mean = {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(features)}
    std = {c: float(row[f"s{i}"] or 0.0) for i, c in enumerate(features)}
    return ScalerModel(list(features), mean, std)


def scale_features(train: DataFrame, features: list[str], test: DataFrame | None = None,
                   model: ScalerModel | None = None, keep: list[str] | None = None):
    """Fit on ``train`` (unless ``model`` is given) and transform train (and test)."""
    model = model or fit_scaler(train, features)
    tr = model.transform(train, keep)
    if test is None:
        return tr, model
    return tr, model.transform(test, keep), model


# --- D6 -----------------------------------------------------------------------

@dataclass
class FeatureSchema:
    """Frozen feature schema: order, kinds, one-hot levels, source columns.

    ``wide`` columns have too many levels for a table column each; a ``SparseEncoder`` over ``numeric`` and
    ``categorical`` holds all features of such a table.
    """
    names: list[str]
    numeric: list[str]
    levels: dict[str, list]
    wide: list[str] = field(default_factory=list)
    encoder: object = field(default=None, compare=False)  # the ``SparseEncoder`` of a table with wide columns, once fitted

    @property
    def categorical(self) -> list[str]:
        return [*self.levels, *self.wide]

    def frame(self, spark) -> DataFrame:
        rows = []
        for i, n in enumerate(self.names):
            src, lvl, kind = n, None, "numeric"
            for c, lv in self.levels.items():
                for v in lv:
                    if n == f"{c}_{_level_text(v)}":
                        src, lvl, kind = c, _level_text(v), "onehot"
            rows.append((i, n, kind, src, lvl))
        return spark.createDataFrame(rows, "pos int, name string, kind string, source_col string, level string")

    def exprs(self, columns: list[str]) -> dict:
        """name -> expression over the raw columns (one-hot, coerce, 0 if absent)."""
        have = set(columns)
        out = {}
        for n in self.names:
            out[n] = to_numeric(F.col(n)) if n in have and n in self.numeric else F.lit(0.0)
        for c, lv in self.levels.items():
            for v in lv[1:]:
                name = f"{c}_{_level_text(v)}"
                if c in have:
                    out[name] = F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0))
        return out

    def to_json(self) -> str:
        return json.dumps({"names": self.names, "numeric": self.numeric,
                           "levels": {k: [_level_text(v) if isinstance(v, bool) else v for v in lv]
                                      for k, lv in self.levels.items()}, "wide": self.wide})

    @staticmethod
    def from_json(s: str) -> "FeatureSchema":
        d = json.loads(s)
        return FeatureSchema(d["names"], d["numeric"], d["levels"], d.get("wide", []))


def fit_feature_schema(df: DataFrame, target: str = "serotype",
                       exclude: list[str] | None = None,
                       allow_label_features: bool = False, max_levels: int = 1000) -> FeatureSchema:
    """Decide kinds once (frozen), collect the levels of narrow columns, list the wide ones, fix the column order."""
    exclude = list(exclude if exclude is not None else ["sample_id", "description"]) + [target]
    cols = [c for c in df.columns if c not in exclude]
    if not allow_label_features:
        cols = [c for c in cols if not c.endswith(LABEL_LEAK) and c != "known_genotype"]
    kinds, found = _kinds_and_levels(df, cols, level_bound=max_levels)
    cats = [c for c in cols if kinds[c] == "categorical"]
    numeric = [c for c in cols if kinds[c] == "numeric"]
    levels = {c: found[c] for c in cats if c in found and len(found[c]) <= max_levels}
    names = list(numeric)
    for c in levels:
        names += [f"{c}_{_level_text(v)}" for v in levels[c][1:]]
    return FeatureSchema(names, numeric, levels, [c for c in cats if c not in levels])


def prepare_features(df: DataFrame, schema: FeatureSchema, keep: list[str] | None = None) -> DataFrame:
    """Apply a frozen schema: encode, null -> 0, coerce, align to the exact order."""
    enc = one_hot(df, schema.levels, drop_first=True)
    num = [to_numeric(F.col(c)).alias(c) if c in enc.columns else F.lit(0.0).alias(c)
           for c in schema.names]
    keep = [c for c in (keep or []) if c in df.columns]
    return enc.select(*keep, *num)
