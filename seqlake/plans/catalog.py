"""Registry of named queries (Spark side) and their DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole test tables. Plain divisions of integers are bit-identical in both
engines and are left as they are; doubles produced by order-dependent
aggregation (sums, means, deviations) are rounded to 6 places explicitly, in
the Spark code and in the SQL alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake.functions import sequence as sf
from seqlake.operators import features, kmers, relational, splits, tables
from seqlake.operators.common import hash_key_sql
from seqlake.operators.ids import with_sample_ids
from seqlake.plans import derived
from seqlake.plans.oracle_views import LEVELS, gc_sql, oracle, strip_long_sql
from seqlake.session import input_key
from seqlake.sources.fixtures import read_table, samples, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = oracle(sql)
        return fn
    return deco


# ---------------------------------------------------------------- flagship --

def _profile(cleaned: DataFrame, top: int = 20) -> DataFrame:
    """Mean strip-mode 3-mer frequency per serotype (absent k-mer = 0), top ``top``."""
    per = kmers.kmer_counts(cleaned, k=3, mode="strip", keep=["serotype"])
    n = cleaned.groupBy("serotype").agg(F.count(F.lit(1)).alias("n_samples"))
    agg = per.groupBy("serotype", "kmer").agg(F.sum("freq").alias("_s"))
    mean = agg.join(n, "serotype").select(
        "serotype", "kmer", "n_samples", (F.col("_s") / F.col("n_samples")).alias("mean_freq"))
    w = Window.partitionBy("serotype").orderBy(F.round("mean_freq", 9).desc(), "kmer")
    out = mean.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return out.withColumn("mean_freq", F.round("mean_freq", 6))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    c = relational.filter_outliers(relational.filter_missing_labels(s, "serotype"), "genome_length")
    return _profile(c)


register("kmer_profile_by_serotype", """
, c as (select * from samples where serotype is not null),
  t as (select * from c where genome_length >= (select quantile_cont(genome_length, 0.01) from c)
                          and genome_length <= (select quantile_cont(genome_length, 0.99) from c)),
  n as (select serotype, count(*) as n_samples from t group by serotype),
  k as (""" + strip_long_sql("t") + """),
  m as (select t.serotype, k.kmer, n.n_samples, sum(k.freq) / n.n_samples as mean_freq
        from k join t using (sample_id) join n on n.serotype = t.serotype
        group by t.serotype, k.kmer, n.n_samples),
  r as (select *, row_number() over (partition by serotype order by round(mean_freq, 9) desc, kmer) as rank from m)
select serotype, kmer, n_samples, round(mean_freq, 6) as mean_freq, rank from r where rank <= 20
""")(flagship)


# ------------------------------------------------------- B: scalar features --

def _serotype_sql(*texts: str) -> str:
    parts = ", ".join(f"nullif({t}, '')" for t in texts)
    t = f"lower(concat_ws(' ', {parts}))"
    hits = ", ".join(f"nullif(regexp_extract({t}, '{p}', 1), '')" for p in sf.SEROTYPE_PATTERNS)
    return f"case when coalesce({hits}) is not null then concat('DENV-', coalesce({hits})) end"


@register("serotype_from_text", f"""
select sample_id, description, genotype, {_serotype_sql('description', 'genotype')} as inferred_serotype
from samples""")
def q_serotype_from_text(spark, sf_dir):
    """B1: first of six patterns over description + genotype text."""
    s = samples(spark, sf_dir)
    return s.select("sample_id", "description", "genotype",
                    sf.infer_serotype("description", "genotype").alias("inferred_serotype"))


@register("sample_metadata", """
select sample_id, collection_date, right(collection_date, 4) as year,
       coalesce(contains(lower(description), 'complete genome'), false) as is_complete, genome_length
from samples""")
def q_sample_metadata(spark, sf_dir):
    """B2: year = last 4 characters of the date; is_complete; genome_length."""
    s = samples(spark, sf_dir)
    return s.select("sample_id", "collection_date", sf.year_from_date("collection_date").alias("year"),
                    sf.is_complete("description").alias("is_complete"), "genome_length")


@register("gc_content", f"""
select sample_id, genome_length, {gc_sql('sequence')} as gc_content from samples""")
def q_gc_content(spark, sf_dir):
    """(G+C)/length, ambiguous bases in the denominator, empty -> 0."""
    s = samples(spark, sf_dir)
    return s.select("sample_id", "genome_length", sf.gc_content("sequence").alias("gc_content"))


@register("kmer_counts_skip_n", """
select sample_id, kmer, count(*)::bigint as kmer_count, max(total)::bigint as total,
       count(*)::double / max(total) as freq
from (select sample_id, w as kmer, count(*) over (partition by sample_id) as total
      from (select sample_id, substring(sequence, i, 3) as w
            from (select sample_id, sequence, unnest(range(1, length(sequence) - 1)) as i from samples) a) b
      where not contains(w, 'N')) c
group by sample_id, kmer""")
def q_kmer_counts_skip_n(spark, sf_dir):
    """Raw windows, case kept, windows containing N dropped."""
    return kmers.kmer_counts(samples(spark, sf_dir), k=3, mode="skip_n")


@register("kmer_counts_strip", strip_long_sql("samples"))
def q_kmer_counts_strip(spark, sf_dir):
    """Uppercase, delete non-ACGT first, then count windows."""
    return kmers.kmer_counts(samples(spark, sf_dir), k=3, mode="strip")


@register("sequence_features_wide", """
select s.*, r.genome_length from seqfeat s join (select sample_id, length(sequence) as genome_length from raw) r
using (sample_id)""")
def q_sequence_features_wide(spark, sf_dir):
    """Id, gc, all 64 ACGT 3-mer frequencies (0-filled), genome_length."""
    return kmers.extract_features(derived.raw_sequences(spark, sf_dir), k=3)


@register("kmer_sparse_vectors", """
, w as (select sample_id, substring(sequence, i, 8) as kmer from (select sample_id, sequence, unnest(range(1, length(sequence) - 6)) as i from samples) a),
  c as (select sample_id, kmer, count(*) as n, sum(count(*)) over (partition by sample_id) as total from w where not contains(kmer, 'N') group by sample_id, kmer),
  d as (select kmer, row_number() over (order by kmer) - 1 as slot from (select distinct kmer from c) x)
select s.sample_id, count(d.slot) as n_kmers, min(d.slot)::int as first_slot, max(d.slot)::int as last_slot,
       round(coalesce(sum(n::double / total * slot), 0), 1) as weighted
from samples s left join (select sample_id, n, total, slot from c join d using (kmer)) d on d.sample_id = s.sample_id group by s.sample_id""")
def q_kmer_sparse_vectors(spark, sf_dir):
    """B4 + B6: sparse 8-mer vectors over the observed alphabet; per sample the filled slots and their weighted sum."""
    p, _ = kmers.sequence_parts(samples(spark, sf_dir), k=8, mode="skip_n")
    share = F.aggregate(F.zip_with("_active", "_values", lambda s, f: s * f), F.lit(0.0), lambda a, x: a + x)
    return p.select("sample_id", F.size("_active").cast("long").alias("n_kmers"), F.array_min("_active").alias("first_slot"),
                    F.array_max("_active").alias("last_slot"), F.round(share, 1).alias("weighted"))


@register("mutation_profile", "select * from mutation")
def q_mutation_profile(spark, sf_dir):
    """length_diff and mutation_density against a 10,700-base reference."""
    return derived.mutation_profile(spark, sf_dir)


@register("label_table", "select * from labels")
def q_label_table(spark, sf_dir):
    """Serotype, genotype and known_genotype = genotype is not null."""
    return derived.label_table(spark, sf_dir)


@register("mutation_defaults", """
select sample_id, 0.0::double as mutation_density, 0::bigint as total_mutations,
       (length(sequence) - 10700)::bigint as length_diff
from raw""")
def q_mutation_defaults(spark, sf_dir):
    """Default mutation columns added at inference when absent."""
    f = kmers.extract_features(derived.raw_sequences(spark, sf_dir), k=3)
    return tables.add_mutation_defaults(f, reference_length=tables.REFERENCE_LENGTH).select(
        "sample_id", "mutation_density", "total_mutations", "length_diff")


@register("generated_sample_ids", """
select doc_id, printf('SAMPLE_%04d', row_number() over (order by doc_id)) as sample_id from documents""")
def q_generated_sample_ids(spark, sf_dir):
    """Dense SAMPLE_%04d ids in doc_id order without a one-task window."""
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    return with_sample_ids(d, order_by="doc_id").select("doc_id", "sample_id")


EXPECTED_DEMO = ["gc_content", "kmer_AAA", "kmer_ACG", "kmer_NNN", "genome_length", "total_mutations"]


@register("aligned_features", """
select sample_id, gc_content, kmer_AAA, kmer_ACG, 0.0::double as kmer_NNN,
       genome_length, 0.0::double as total_mutations
from seqfeat join (select sample_id, length(sequence) as genome_length from raw) using (sample_id)""")
def q_aligned_features(spark, sf_dir):
    """Align to an expected schema (missing -> 0, extras dropped, order kept)."""
    return kmers.extract_features(derived.raw_sequences(spark, sf_dir), k=3, expected=EXPECTED_DEMO)


@register("numeric_coercion", """
select sample_id, coalesce(try_cast(year as double), 0.0) as year,
       coalesce(try_cast(is_complete as double), 0.0) as is_complete,
       coalesce(try_cast(country as double), 0.0) as country,
       coalesce(try_cast(genome_length as double), 0.0) as genome_length
from metadata""")
def q_numeric_coercion(spark, sf_dir):
    """Coerce to numbers; booleans -> 0/1, unparsable/null -> 0."""
    m = derived.metadata(spark, sf_dir)
    return features.coerce_numeric(m, ["year", "is_complete", "country", "genome_length"],
                                   keep=["sample_id"])


@register("sequence_validation", """
select sample_id, length(c) as length, array_to_string(list_sort(list_distinct(
         list_filter(string_split(regexp_replace(c, '[ATCGNMRWSYKVHDB]', '', 'g'), ''), lambda x: x <> ''))), '') as invalid_chars,
       length(c) < 100 as too_short,
       (length(c) - length(translate(c, 'NMRWSYKVHDB', '')))::bigint as ambiguous_count,
       """ + gc_sql("c") + """ as gc_content
from (select cast(doc_id as varchar) as sample_id,
             upper(replace(regexp_replace(text, '\\s+', '', 'g'), 'ß', 'SS')) as c  -- full upper case of ß
      from documents) v""")
def q_sequence_validation(spark, sf_dir):
    """Validation report of the whole pasted text."""
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    c = sf.clean_sequence("text")
    v = d.select(F.col("doc_id").cast("string").alias("sample_id"), c.alias("c"))
    return v.select("sample_id", F.length("c").alias("length"), sf.invalid_chars("c").alias("invalid_chars"),
                    (F.length("c") < 100).alias("too_short"), sf.ambiguous_count("c").alias("ambiguous_count"),
                    sf.gc_content("c").alias("gc_content"))


@register("sequence_preview", f"""
select sample_id, length(sequence) as length,
       case when length(sequence) > 50 then concat(substring(sequence, 1, 50), '...') else sequence end as preview,
       {gc_sql('sequence')} as gc_content
from samples""")
def q_sequence_preview(spark, sf_dir):
    """Id, length, first 50 characters + '...', GC."""
    s = samples(spark, sf_dir)
    return s.select("sample_id", F.length("sequence").alias("length"),
                    sf.preview("sequence", 50).alias("preview"), sf.gc_content("sequence").alias("gc_content"))


# ------------------------------------------------------------- A: sources --

@register("sequence_qc", "select sample_id, length(sequence) as genome_length from raw")
def q_sequence_qc(spark, sf_dir):
    """A4: keep sequences of at least min_length (100 on the test texts)."""
    return derived.raw_sequences(spark, sf_dir).select("sample_id", F.length("sequence").alias("genome_length"))


@register("sequence_qc_report", """
select count(*) filter (where sequence is not null and length(sequence) >= 100) as kept,
       count(*) filter (where not coalesce(sequence is not null and length(sequence) >= 100, false)) as skipped
from samples""")
def q_sequence_qc_report(spark, sf_dir):
    """A4: kept / skipped counts."""
    return tables.qc_report(samples(spark, sf_dir), derived.MIN_LENGTH)


@register("text_line_ingest", """
select doc_id, line_no,
       case when contains(line, ',') then trim(split_part(line, ',', 1), ' \t\n\r') else printf('SAMPLE_%04d', line_no) end as sample_id,
       seq as sequence, length(seq) as length
from (select doc_id, line_no, line,
             upper(replace(regexp_replace(case when contains(line, ',') then substring(line, strpos(line, ',') + 1) else line end,
                                  '\\s+', '', 'g'), 'ß', 'SS')) as seq
      from (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as line_no
            from (select doc_id, list_filter(list_transform(string_split(text, '\n'),
                                                            lambda x: trim(x, ' \t\n\r')), lambda x: x <> '') as ls
                  from documents) a) b) c
where length(seq) > 0""")
def q_text_line_ingest(spark, sf_dir):
    """A5: each document read as a pasted multi-line input."""
    from seqlake.sources.text import parse_sequence_lines

    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return parse_sequence_lines(d, text_col="text", group_col="doc_id")


# ---------------------------------------------------- C: joins and filters --

def _merged_cols():
    return (["sample_id", "description", "serotype", "genotype", "country", "year", "host", "genome_length",
             "is_complete", "gc_content"] + [f"kmer_{lv}" for lv in LEVELS]
            + ["length_diff", "mutation_density", "serotype_label", "genotype_label", "known_genotype"])


@register("merged_tables", "select * from merged")
def q_merged_tables(spark, sf_dir):
    """Metadata left-joined with features, mutation profile and labels."""
    return derived.merged(spark, sf_dir)


@register("label_filter", "select sample_id, serotype, serotype_label from labelled")
def q_label_filter(spark, sf_dir):
    """Rows with a null label removed."""
    m = relational.filter_missing_labels(derived.merged(spark, sf_dir), "serotype")
    return m.select("sample_id", "serotype", "serotype_label")


@register("outlier_trim", "select sample_id, genome_length from cleaned")
def q_outlier_trim(spark, sf_dir):
    """Keep q01 <= genome_length <= q99 (linear quantiles, inclusive)."""
    return derived.cleaned(spark, sf_dir).select("sample_id", "genome_length")


@register("min_class_filter", """
, g as (select *, concat(serotype, '/', genotype) as cls from cleaned where genotype is not null)
select sample_id, cls from g where cls in (select cls from g group by cls having count(*) >= 7)""")
def q_min_class_filter(spark, sf_dir):
    """C4: keep classes with >= max(2, ceil(5 / (1 - 0.2))) = 7 rows."""
    c = derived.cleaned(spark, sf_dir).where(F.col("genotype").isNotNull())
    c = c.withColumn("cls", F.concat_ws("/", "serotype", "genotype"))
    return relational.filter_min_class(c, "cls").select("sample_id", "cls")


@register("membership_filter", """
select sample_id, genotype from metadata where not coalesce(genotype in ('src0', 'src1', 'src2'), false)""")
def q_membership_filter(spark, sf_dir):
    """NOT IN that keeps nulls (the pandas ~isin rule)."""
    m = derived.metadata(spark, sf_dir)
    return relational.filter_membership(m, "genotype", ["src0", "src1", "src2"], negate=True) \
        .select("sample_id", "genotype")


@register("year_numeric_filter", """
select cast(try_cast(year as double) as bigint) as year, count(*) as n_samples
from metadata where try_cast(year as double) is not null group by 1""")
def q_year_numeric_filter(spark, sf_dir):
    """C6 + I13: rows whose year parses as a number, counted per year."""
    m = relational.numeric_filter(derived.metadata(spark, sf_dir), "year")
    return (m.groupBy(F.col("year").try_cast("double").cast("long").alias("year"))
             .agg(F.count(F.lit(1)).alias("n_samples")))


# ----------------------------------------- F9-F11, C7, C8, G: detectors ---

from seqlake.operators import metrics  # noqa: E402
from seqlake.operators.models.centroid import fit_centroid  # noqa: E402
from seqlake.operators.models.threshold import flag  # noqa: E402
from seqlake.sources.fixtures import EMBEDDINGS_SQL, embedding_rows  # noqa: E402

_DIST_SQL = {
    "euclidean": "sqrt(list_sum(list_transform(range(1, len(e.features) + 1), lambda i: (e.features[i] - c.cen[i]) * (e.features[i] - c.cen[i]))))",
    "manhattan": "list_sum(list_transform(range(1, len(e.features) + 1), lambda i: abs(e.features[i] - c.cen[i])))",
    "cosine": ("greatest(least(1.0 - (list_sum(list_transform(range(1, len(e.features) + 1), lambda i: e.features[i] * c.cen[i]))"
               " / (sqrt(list_sum(list_transform(e.features, lambda x: x * x))) * sqrt(list_sum(list_transform(c.cen, lambda x: x * x))))), 2.0), 0.0)"),
}


def _det_ctes(method: str) -> str:
    return f"""
, emb as ({EMBEDDINGS_SQL}),
  cpos as (select p, avg(v) as m from (select unnest(features) as v, generate_subscripts(features, 1) as p
                                       from emb where is_train) a group by p),
  c as (select list(m order by p) as cen from cpos),
  sc as (select e.vec_id, e.label, e.is_train, e.y_true, {_DIST_SQL[method]} as score from emb e, c),
  th as (select quantile_cont(score, 0.95) as threshold from sc where is_train),
  fl as (select sc.*, th.threshold, sc.score > th.threshold as is_novel from sc, th where not is_train)
"""


def _detector(spark, sf_dir, method="euclidean"):
    e = embedding_rows(spark, sf_dir)
    det = fit_centroid(e.where("is_train"), "features", method)
    scored = det.score(e, "features")
    return det, scored


def _make_scores(method):
    def q(spark, sf_dir):
        _, scored = _detector(spark, sf_dir, method)
        return scored.select("vec_id", "label", "is_train", "y_true", F.round("score", 6).alias("score"))
    q.__doc__ = f"F9: {method} distance of every embedding to the training centroid."
    return q


for _m, _name in (("euclidean", "centroid_scores"), ("cosine", "centroid_scores_cosine"),
                  ("manhattan", "centroid_scores_manhattan")):
    register(_name, _det_ctes(_m) + "select vec_id, label, is_train, y_true, round(score, 6) as score from sc")(
        _make_scores(_m))


@register("novelty_threshold", _det_ctes("euclidean") + """
select round(threshold, 6) as threshold, (select count(*) from sc where is_train) as n_train from th""")
def q_novelty_threshold(spark, sf_dir):
    """95th percentile (linear) of the training scores."""
    det, scored = _detector(spark, sf_dir)
    n = scored.where("is_train").agg(F.count(F.lit(1)).alias("n_train"))
    return n.select(F.round(F.lit(det.threshold), 6).alias("threshold"), "n_train")


def _flags(spark, sf_dir):
    det, scored = _detector(spark, sf_dir)
    test = scored.where(~F.col("is_train"))
    return det, flag(test, "score", det.threshold).withColumn("threshold", F.lit(det.threshold))


@register("novelty_flags", _det_ctes("euclidean") + """
select vec_id, label, y_true, round(score, 6) as score, is_novel from fl""")
def q_novelty_flags(spark, sf_dir):
    """F11 + C8: held-out known rows (truth 0) and novel rows (truth 1), flagged
    when score > threshold (strict)."""
    _, f = _flags(spark, sf_dir)
    return f.select("vec_id", "label", "y_true", F.round("score", 6).alias("score"), "is_novel")


@register("alert_list", _det_ctes("euclidean") + """
select vec_id, round(score, 6) as score from fl where is_novel order by score desc, vec_id limit 10""")
def q_alert_list(spark, sf_dir):
    """Flagged rows, highest score first, first 10."""
    from seqlake.operators.relational import alert_list
    _, f = _flags(spark, sf_dir)
    return alert_list(f, "is_novel", "score", "vec_id", 10).select("vec_id", F.round("score", 6).alias("score"))


_BIN_SQL = """
  bc as (select count(*) filter (where y_true = 1 and is_novel) as tp, count(*) filter (where y_true <> 1 and is_novel) as fp,
                count(*) filter (where y_true = 1 and not is_novel) as fn, count(*) filter (where y_true <> 1 and not is_novel) as tn from fl),
  bm as (select (tp + tn)::double / nullif(tp + tn + fp + fn, 0) as accuracy,
                coalesce(tp::double / nullif(tp + fp, 0), 0.0) as precision,
                coalesce(tp::double / nullif(tp + fn, 0), 0.0) as recall from bc),
  bm2 as (select coalesce(accuracy, 0.0) as accuracy, precision, recall,
                 case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from bm),
  ranks as (select y_true, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r from fl),
  auc as (select case when sum(y_true) > 0 and sum(1 - y_true) > 0 then
                   (sum(case when y_true = 1 then r else 0 end) - sum(y_true) * (sum(y_true) + 1) / 2.0)
                   / (sum(y_true) * sum(1 - y_true)) else 0.0 end as roc_auc from ranks)
"""


@register("detector_binary_metrics", _det_ctes("euclidean") + "," + _BIN_SQL + """
select round(accuracy, 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall,
       round(f1, 6) as f1 from bm2""")
def q_detector_binary_metrics(spark, sf_dir):
    """Accuracy, precision, recall, F1 of the flags (0 on empty denominators)."""
    _, f = _flags(spark, sf_dir)
    m = metrics.binary_metrics(f.withColumn("y_pred", F.col("is_novel").cast("int")), "y_true", "y_pred")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@register("detector_roc_auc", _det_ctes("euclidean") + "," + _BIN_SQL + """
select round(roc_auc, 6) as roc_auc from auc""")
def q_detector_roc_auc(spark, sf_dir):
    """Exact ROC-AUC of the scores, ties sharing rank."""
    _, f = _flags(spark, sf_dir)
    return metrics.roc_auc(f, "y_true", "score").select(F.round("roc_auc", 6).alias("roc_auc"))


@register("detector_evaluation", _det_ctes("euclidean") + "," + _BIN_SQL + """
select round(accuracy, 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall,
       round(f1, 6) as f1, round(roc_auc, 6) as roc_auc, round((select threshold from th), 6) as threshold
from bm2, auc""")
def q_detector_evaluation(spark, sf_dir):
    """The bundled detector evaluation row."""
    det, f = _flags(spark, sf_dir)
    m = metrics.detector_evaluation(f.withColumn("y_pred", F.col("is_novel").cast("int")), det.threshold)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@register("prediction_summary", _det_ctes("euclidean") + """
select count(*) as total, count(*) filter (where is_novel) as n_flagged,
       count(distinct label) filter (where is_novel) as n_flagged_labels,
       count(*) filter (where is_novel and y_true = 0) as known_flagged,
       count(*) filter (where is_novel and y_true = 1) as novel_flagged,
       round(avg(score), 6) as mean_score
from fl""")
def q_prediction_summary(spark, sf_dir):
    """Totals, flagged counts, known-vs-flagged pairs of the scored rows."""
    _, f = _flags(spark, sf_dir)
    return f.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_novel").alias("n_flagged"),
                 F.count_distinct(F.when(F.col("is_novel"), F.col("label"))).alias("n_flagged_labels"),
                 F.count_if(F.col("is_novel") & (F.col("y_true") == 0)).alias("known_flagged"),
                 F.count_if(F.col("is_novel") & (F.col("y_true") == 1)).alias("novel_flagged"),
                 F.round(F.avg("score"), 6).alias("mean_score"))


_PREDICTED_SQL = _det_ctes("euclidean") + f"""
, m_sc as (select e.vec_id, e.is_train, {_DIST_SQL['manhattan']} as err from emb e, c),
  m_th as (select quantile_cont(err, 0.95) as t from m_sc where is_train),
  pred as (select 'V' || fl.vec_id as sample_id, 'DENV-' || (label % 4 + 1) as predicted_serotype, is_novel as is_novel_genotype,
                  score as anomaly_score, err > m_th.t as is_potential_new_serotype, err as reconstruction_error
           from fl join m_sc using (vec_id), m_th)
"""


def _predictions(spark, sf_dir):
    """Rows in the columns of the inference output, scored by two centroid detectors."""
    e = embedding_rows(spark, sf_dir)
    near = fit_centroid(e.where("is_train"), "features", "euclidean")
    far = fit_centroid(e.where("is_train"), "features", "manhattan")
    s = far.score(near.score(e.where(~F.col("is_train")), "features", "anomaly_score"), "features", "reconstruction_error")
    return s.select(F.concat(F.lit("V"), "vec_id").alias("sample_id"),
                    F.concat(F.lit("DENV-"), (F.col("label") % 4 + 1).cast("string")).alias("predicted_serotype"),
                    (F.col("anomaly_score") > near.threshold).alias("is_novel_genotype"), "anomaly_score",
                    F.lit(near.threshold).alias("novelty_threshold"),
                    (F.col("reconstruction_error") > far.threshold).alias("is_potential_new_serotype"), "reconstruction_error",
                    F.lit(far.threshold).alias("open_set_threshold"))


def _flag_hist_sql(flag: str, score: str) -> str:
    return f"""
select '{score}' as section, null as key, {flag} as flag, bin, round(lo + bin * w, 6) as lo, round(lo + bin * w + w, 6) as hi, count(*) as count
from (select {flag}, lo, w, case when w = 0 then 0 else least(floor(({score} - lo) / w)::int, 29) end as bin
      from pred, (select min({score}) as lo, (max({score}) - min({score})) / 30 as w from pred) e) h
group by {flag}, bin, lo, w"""


@register("prediction_report", _PREDICTED_SQL + """
select 'total' as section, null as key, null::boolean as flag, null::int as bin, null::double as lo, null::double as hi, count(*) as count from pred
union all select 'serotype', predicted_serotype, null, null, null, null, count(*) from pred group by 2
union all select 'novel_genotype', null, is_novel_genotype, null, null, null, count(*) from pred group by 3
union all select 'potential_new_serotype', null, is_potential_new_serotype, null, null, null, count(*) from pred group by 3
union all """ + _flag_hist_sql("is_novel_genotype", "anomaly_score") + " union all " + _flag_hist_sql(
    "is_potential_new_serotype", "reconstruction_error"))
def q_prediction_report(spark, sf_dir):
    """I15 + I6: totals, serotypes, both flags and 30-bin score histograms by flag, from one scan of the inference columns."""
    from seqlake.operators.report import prediction_report

    r = prediction_report(_predictions(spark, sf_dir))
    return r.select("section", "key", "flag", "bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "count")


@register("open_set_alerts", _PREDICTED_SQL + """
select sample_id, round(reconstruction_error, 6) as reconstruction_error from pred where is_potential_new_serotype
order by pred.reconstruction_error desc, sample_id limit 10""")
def q_open_set_alerts(spark, sf_dir):
    """Rows flagged as potential new serotypes, largest reconstruction error first, first 10."""
    from seqlake.operators.relational import alert_list

    a = alert_list(_predictions(spark, sf_dir), "is_potential_new_serotype", "reconstruction_error", "sample_id", 10)
    return a.select("sample_id", F.round("reconstruction_error", 6).alias("reconstruction_error"))


@register("svm_gamma", _det_ctes("euclidean") + """
select round(1.0 / (64 * var_pop(v)), 9) as gamma from (select unnest(features) as v from emb where is_train) a""")
def q_svm_gamma(spark, sf_dir):
    """gamma 'scale' = 1 / (entries per row x population variance of all entries) of the training rows."""
    from seqlake.operators.models.ocsvm import scale_gamma

    train = embedding_rows(spark, sf_dir).where("is_train")
    return train.select("vec_id").agg(F.count(F.lit(1)).alias("n")).select(F.round(F.lit(scale_gamma(train, "features")[0]), 9).alias("gamma"))


# ------------------------------------- G1-G4: multiclass on the text rule --

_PRED_SQL = f"""
, pr as (select serotype as y_true, coalesce({_serotype_sql('description', 'genotype')}, 'unknown') as y_pred
         from samples where serotype is not null)
"""


def _text_predictions(spark, sf_dir):
    s = samples(spark, sf_dir).where(F.col("serotype").isNotNull())
    return s.select(F.col("serotype").alias("y_true"),
                    F.coalesce(sf.infer_serotype("description", "genotype"), F.lit("unknown")).alias("y_pred"))


@register("confusion_matrix", _PRED_SQL + """
, lab as (select y_true as label from pr union select y_pred from pr)
select a.label as y_true, b.label as y_pred, count(pr.y_true)::bigint as n
from lab a, lab b left join pr on pr.y_true = a.label and pr.y_pred = b.label
group by a.label, b.label""")
def q_confusion_matrix(spark, sf_dir):
    """Confusion counts over the label x label grid (zeros kept)."""
    return metrics.confusion_matrix(_text_predictions(spark, sf_dir))


_REPORT_SQL = _PRED_SQL + """
, lab as (select y_true as label from pr union select y_pred from pr),
  rep as (select l.label,
            coalesce(count(*) filter (where pr.y_true = l.label and pr.y_pred = l.label)::double
                     / nullif(count(*) filter (where pr.y_pred = l.label), 0), 0.0) as precision,
            coalesce(count(*) filter (where pr.y_true = l.label and pr.y_pred = l.label)::double
                     / nullif(count(*) filter (where pr.y_true = l.label), 0), 0.0) as recall,
            count(*) filter (where pr.y_true = l.label) as support
          from lab l, pr group by l.label),
  rep2 as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from rep)
"""


@register("per_class_report", _REPORT_SQL + """
select label, round(precision, 6) as precision, round(recall, 6) as recall, support, round(f1, 6) as f1 from rep2""")
def q_per_class_report(spark, sf_dir):
    """Per-class precision / recall / F1 / support."""
    r = metrics.per_class_report(_text_predictions(spark, sf_dir))
    return r.select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
                    "support", F.round("f1", 6).alias("f1"))


@register("classification_metrics", _REPORT_SQL + """
select (select count(*) from pr) as n,
       round((select avg((y_true = y_pred)::int) from pr), 6) as accuracy,
       round(avg(f1), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1,
       round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall
from rep2""")
def q_classification_metrics(spark, sf_dir):
    """Accuracy, macro and weighted F1 over the union of labels."""
    m = metrics.classification_summary(_text_predictions(spark, sf_dir))
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns if c != "n"])


# ------------------------------------------------------ I: exploration ---

from seqlake.operators import eda, interpret  # noqa: E402

NUM_COLS = ["gc_content", "genome_length", "length_diff", "mutation_density"]
META_COLS = ["sample_id", "description", "serotype", "genotype", "country", "year", "host",
             "genome_length", "is_complete"]
MERGED_COLS = (META_COLS + ["gc_content"] + [f"kmer_{lv}" for lv in LEVELS]
               + ["length_diff", "mutation_density", "serotype_label", "genotype_label", "known_genotype"])


@register("table_counts", """
select (select count(*) from metadata) as n_metadata, (select count(*) from seqfeat) as n_sequence_features,
       (select count(*) from mutation) as n_mutation_profiles, (select count(*) from labels) as n_labels,
       (select count(*) from cleaned) as n_cleaned, """ + str(len(MERGED_COLS)) + """ as n_columns,
       (select count(*) filter (where is_complete) from cleaned) as n_complete""")
def q_table_counts(spark, sf_dir):
    """Row counts of each table, cleaned rows, columns, complete samples."""
    c = derived.cleaned(spark, sf_dir)
    cnt = lambda d: d.agg(F.count(F.lit(1))).scalar()
    return c.agg(F.count(F.lit(1)).alias("n_cleaned"), F.count_if("is_complete").alias("n_complete")).select(
        cnt(derived.metadata(spark, sf_dir)).alias("n_metadata"),
        cnt(derived.sequence_features(spark, sf_dir)).alias("n_sequence_features"),
        cnt(derived.mutation_profile(spark, sf_dir)).alias("n_mutation_profiles"),
        cnt(derived.label_table(spark, sf_dir)).alias("n_labels"),
        "n_cleaned", F.lit(len(c.columns)).alias("n_columns"), "n_complete")


@register("missing_by_column", """
, mc as (""" + " union all ".join(
    f"select '{c}' as \"column\", count(*) filter (where {c} is null) as missing_count, count(*) as n from metadata"
    for c in META_COLS) + """)
select "column", missing_count, round(missing_count * 100.0 / n, 2) as missing_pct from mc where missing_count > 0""")
def q_missing_by_column(spark, sf_dir):
    """Missing count and percent per metadata column (only > 0)."""
    return eda.missing_by_column(derived.metadata(spark, sf_dir)).orderBy(F.col("missing_count").desc())


@register("dataset_summary", f"""
select count(*) as total_samples, {len(MERGED_COLS)} as total_features,
       ({' + '.join(f'count(*) filter (where {c} is null)' for c in MERGED_COLS)}) as missing_values,
       count(*) - count(distinct sample_id) - max((sample_id is null)::int) as duplicate_samples
from cleaned""")
def q_dataset_summary(spark, sf_dir):
    """Rows, columns, missing cells, duplicated ids of the cleaned table."""
    return eda.dataset_summary(derived.cleaned(spark, sf_dir))


@register("quality_deltas", f"""
, b as (select count(*) as n, ({' + '.join(f'count(*) filter (where {c} is null)' for c in MERGED_COLS)}) as m from merged),
  a as (select count(*) as n, ({' + '.join(f'count(*) filter (where {c} is null)' for c in MERGED_COLS)}) as m from cleaned)
select b.n as rows_before, a.n as rows_after, b.n - a.n as rows_removed,
       round(b.m * 100.0 / (b.n * {len(MERGED_COLS)}), 4) as missing_pct_before,
       round(a.m * 100.0 / (a.n * {len(MERGED_COLS)}), 4) as missing_pct_after,
       {len(MERGED_COLS)} as features_before, {len(MERGED_COLS)} as features_after
from a, b""")
def q_quality_deltas(spark, sf_dir):
    """I4: raw (merged) vs cleaned: rows removed, missing percent, feature counts."""
    raw, cl = derived.merged(spark, sf_dir), derived.cleaned(spark, sf_dir)
    before = raw.agg(F.struct(F.count(F.lit(1)).alias("n"), eda.total_missing(raw).alias("m")).alias("s")).scalar()
    nb, mb = before.getField("n"), before.getField("m")
    a = cl.agg(F.count(F.lit(1)).alias("n"), eda.total_missing(cl).alias("m"))
    return a.select(nb.alias("rows_before"), F.col("n").alias("rows_after"), (nb - F.col("n")).alias("rows_removed"),
                    F.round(mb * 100.0 / (nb * len(raw.columns)), 4).alias("missing_pct_before"),
                    F.round(F.col("m") * 100.0 / (F.col("n") * len(cl.columns)), 4).alias("missing_pct_after"),
                    F.lit(len(raw.columns)).alias("features_before"), F.lit(len(cl.columns)).alias("features_after"))


@register("describe_numeric", " union all ".join(f"""
select '{c}' as column, count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
       min({c})::double as min, round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50,
       round(quantile_cont({c}, 0.75), 6) as p75, max({c})::double as max from cleaned""" for c in NUM_COLS).replace(
    "select '", ", dd as (select '", 1) + ") select * from dd")
def q_describe_numeric(spark, sf_dir):
    """Count, mean, sample std, min, exact quartiles, max."""
    d = eda.describe(derived.cleaned(spark, sf_dir), NUM_COLS)
    return d.select("column", "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min",
                    *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")], "max")


def _hist_sql(col: str, bins: int = 50) -> str:
    return f"""
, mm as (select min({col})::double as lo, max({col})::double as hi from cleaned),
  w as (select lo, hi, (hi - lo) / {bins} as width from mm),
  hb as (select case when w.width = 0 then 0 else least(floor(({col} - w.lo) / w.width)::int, {bins - 1}) end as bin
         from cleaned, w where {col} is not null),
  hc as (select bin, count(*) as count from hb group by bin),
  e as (select range::int as bin from range({bins}))
select e.bin, round(w.lo + e.bin * w.width, 6) as lo, round(w.lo + (e.bin + 1) * w.width, 6) as hi,
       coalesce(hc.count, 0)::bigint as count
from e cross join w left join hc on hc.bin = e.bin"""


def _hist(col):
    def q(spark, sf_dir):
        h = eda.histogram(derived.cleaned(spark, sf_dir), col, 50)
        return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "count")
    q.__doc__ = f"I6: 50 equal-width bins of {col} (empty bins kept)."
    return q


register("length_histogram", _hist_sql("genome_length"))(_hist("genome_length"))
register("gc_histogram", _hist_sql("gc_content"))(_hist("gc_content"))
register("density_histogram", _hist_sql("mutation_density"))(_hist("mutation_density"))


def _vc(col, top):
    def q(spark, sf_dir):
        return eda.value_counts(derived.cleaned(spark, sf_dir), col, top)
    q.__doc__ = f"I7: value counts of {col}" + (f", top {top}" if top else "")
    return q


for _col, _top in (("serotype", 10), ("genotype", 20), ("country", None)):
    register(f"{_col}_counts", f"""
select {_col}, count(*) as count from cleaned where {_col} is not null group by {_col}
order by count desc, {_col} {'limit ' + str(_top) if _top else ''}""")(_vc(_col, _top))


def _crosstab_sql(a, b, where="true"):
    return f"""
, d as (select {a}, {b} from cleaned where {a} is not null and {b} is not null and {where}),
  a as (select distinct {a} from d), b as (select distinct {b} from d),
  c as (select {a}, {b}, count(*) as count from d group by all)
select a.{a}, b.{b}, coalesce(c.count, 0)::bigint as count
from a cross join b left join c on c.{a} = a.{a} and c.{b} = b.{b}"""


@register("crosstab_serotype_genotype", _crosstab_sql("serotype", "genotype"))
def q_crosstab(spark, sf_dir):
    """I8: serotype x genotype counts, zero-filled, either null dropped."""
    return eda.crosstab(derived.cleaned(spark, sf_dir), "serotype", "genotype")


@register("crosstab_country_serotype", _crosstab_sql("country", "serotype"))
def q_crosstab_country(spark, sf_dir):
    """I8: country x serotype counts."""
    return eda.crosstab(derived.cleaned(spark, sf_dir), "country", "serotype")


@register("crosstab_year_serotype", _crosstab_sql("year", "serotype", "try_cast(year as double) is not null"))
def q_crosstab_year(spark, sf_dir):
    """I8: year x serotype counts, numeric years only."""
    return eda.crosstab(relational.numeric_filter(derived.cleaned(spark, sf_dir), "year"), "year", "serotype")


@register("density_by_serotype", """
select serotype, round(avg(mutation_density), 6) as mean, round(stddev_samp(mutation_density), 6) as std,
       count(mutation_density) as count
from cleaned where serotype is not null group by serotype""")
def q_density_by_serotype(spark, sf_dir):
    """Mean / sample std / count of mutation density per serotype."""
    g = eda.group_stats(derived.cleaned(spark, sf_dir), "serotype", "mutation_density")
    return g.select("serotype", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "count")


@register("length_diff_box", """
, q as (select quantile_cont(length_diff, 0.25) as q1, quantile_cont(length_diff, 0.5) as median,
               quantile_cont(length_diff, 0.75) as q3 from cleaned)
select round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, round(q3 - q1, 6) as iqr,
       round(q1 - 1.5 * (q3 - q1), 6) as lower_fence, round(q3 + 1.5 * (q3 - q1), 6) as upper_fence,
       (select count(*) from cleaned where length_diff < q1 - 1.5 * (q3 - q1) or length_diff > q3 + 1.5 * (q3 - q1)) as n_outliers
from q""")
def q_length_diff_box(spark, sf_dir):
    """Box statistics of length_diff with 1.5-IQR fences."""
    b = eda.box_stats(derived.cleaned(spark, sf_dir), "length_diff")
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns if c != "n_outliers"], "n_outliers")


@register("top_kmers", """
, m as (""" + " union all ".join(f"select 'kmer_{lv}' as feature, avg(kmer_{lv}) as mean from cleaned" for lv in LEVELS) + """)
select feature, round(mean, 6) as mean from m order by round(mean, 9) desc, feature limit 20""")
def q_top_kmers(spark, sf_dir):
    """Mean frequency per k-mer over the cleaned samples, top 20."""
    m = eda.column_means(derived.cleaned(spark, sf_dir), [f"kmer_{lv}" for lv in LEVELS])
    return m.orderBy(F.round("mean", 9).desc(), "feature").limit(20).select("feature", F.round("mean", 6).alias("mean"))


_CORR_COLS = [f"kmer_{lv}" for lv in LEVELS[:20]]


@register("kmer_correlation", """
, p as (""" + " union all ".join(
    f"select '{a}' as col_a, '{b}' as col_b, corr({a}, {b}) as corr from cleaned"
    for a in _CORR_COLS for b in _CORR_COLS if a != b) + """)
select col_a, col_b, round(corr, 6) as corr from p
union all select c, c, 1.0 from (values """ + ", ".join(f"('{c}')" for c in _CORR_COLS) + """) t(c)""")
def q_kmer_correlation(spark, sf_dir):
    """Pearson correlation matrix of the first 20 k-mer columns."""
    c = eda.correlation_matrix(derived.cleaned(spark, sf_dir), _CORR_COLS)
    return c.select("col_a", "col_b", F.round("corr", 6).alias("corr"))


@register("samples_per_year", """
select year, count(*) as n_samples from cleaned where year is not null group by year""")
def q_samples_per_year(spark, sf_dir):
    """Samples per collection year."""
    return (derived.cleaned(spark, sf_dir).where(F.col("year").isNotNull())
            .groupBy("year").agg(F.count(F.lit(1)).alias("n_samples")).orderBy("year"))


@register("key_findings", """
select count(distinct serotype) as n_serotypes, count(distinct genotype) as n_genotypes,
       round(avg(mutation_density), 6) as mean_mutation_density, round(avg(gc_content), 6) as mean_gc_content,
       (select serotype from cleaned where serotype is not null group by serotype order by count(*) desc, serotype limit 1) as modal_serotype
from cleaned""")
def q_key_findings(spark, sf_dir):
    """Distinct label counts, modal serotype, mean density and GC."""
    k = eda.key_findings(derived.cleaned(spark, sf_dir))
    return k.select("n_serotypes", "n_genotypes", F.round("mean_mutation_density", 6).alias("mean_mutation_density"),
                    F.round("mean_gc_content", 6).alias("mean_gc_content"), "modal_serotype")


# ------------------------------------------------- E: splits and samples ---

_HK = hash_key_sql("sample_id")


@register("stratified_split", f"""
, r as (select sample_id, serotype, row_number() over (partition by serotype order by {_HK}, sample_id) as rn,
               count(*) over (partition by serotype) as cn from cleaned)
select sample_id, serotype, rn <= round(cn * 0.2) as is_test from r""")
def q_stratified_split(spark, sf_dir):
    """Per serotype, round(0.2 n) rows first in md5 order are test."""
    c = derived.cleaned(spark, sf_dir).select("sample_id", "serotype")
    return splits.stratified_split(c, "serotype", "sample_id", 0.2, seed=42)


@register("cv_folds", f"""
select sample_id, serotype, ((row_number() over (partition by serotype order by {_HK}, sample_id) - 1) % 5)::int as fold
from cleaned""")
def q_cv_folds(spark, sf_dir):
    """Stratified 5-fold assignment in md5 order."""
    c = derived.cleaned(spark, sf_dir).select("sample_id", "serotype")
    return splits.fold_ids(c, "serotype", "sample_id", 5, seed=42)


@register("novelty_split", f"""
, tr as (select sample_id, genotype from cleaned where genotype = (select min(genotype) from cleaned)),
  nv as (select sample_id, genotype from cleaned where genotype is not null and genotype <> (select min(genotype) from cleaned)),
  kn as (select sample_id, genotype from cleaned where genotype is null
         order by {_HK}, sample_id limit (select count(*) from nv))
select sample_id, genotype, 'train' as role, null::int as y_true from tr
union all select sample_id, genotype, 'test', 0 from kn
union all select sample_id, genotype, 'test', 1 from nv""")
def q_novelty_split(spark, sf_dir):
    """E3 + C8: first genotype by name vs the rest; known test rows are rows in
    neither list (null genotype), as many as the novel rows, in md5 order."""
    c = derived.cleaned(spark, sf_dir).select("sample_id", "genotype")
    train, test = splits.novelty_split(c, column="genotype")
    return (train.select("sample_id", "genotype", F.lit("train").alias("role"), F.lit(None).cast("int").alias("y_true"))
            .unionByName(test.select("sample_id", "genotype", F.lit("test").alias("role"), "y_true")))


@register("open_set_split", f"""
, names as (select distinct serotype from cleaned where serotype is not null order by serotype limit 2),
  tr as (select sample_id, serotype from cleaned where serotype in (select serotype from names)),
  nv as (select sample_id, serotype from cleaned where serotype is not null and serotype not in (select serotype from names)),
  kn as (select sample_id, serotype from tr order by {_HK}, sample_id
         limit least((select count(*) from nv), (select count(*) from tr) // 4))
select sample_id, serotype, 'train' as role, null::int as y_true from tr
union all select sample_id, serotype, 'test', 0 from kn
union all select sample_id, serotype, 'test', 1 from nv""")
def q_open_set_split(spark, sf_dir):
    """E4 + C8: first two serotypes by name vs the rest; known test rows are
    min(n_novel, n_train // 4) training rows in md5 order."""
    c = derived.cleaned(spark, sf_dir).select("sample_id", "serotype")
    train, test = splits.open_set_split(c, column="serotype")
    return (train.select("sample_id", "serotype", F.lit("train").alias("role"), F.lit(None).cast("int").alias("y_true"))
            .unionByName(test.select("sample_id", "serotype", F.lit("test").alias("role"), "y_true")))


@register("hash_sample", f"""
select sample_id, serotype from cleaned order by {_HK}, sample_id limit 100""")
def q_hash_sample(spark, sf_dir):
    """E5: a replayable bounded sample of 100 rows (top-k by md5 order)."""
    c = derived.cleaned(spark, sf_dir).select("sample_id", "serotype")
    return splits.hash_sample(c, 100, "sample_id", seed=42)


# ------------------------------------------- D: features and encoding ---

_NOV_COLS = ["gc_content"] + [f"kmer_{lv}" for lv in LEVELS] + ["mutation_density"]


@register("novelty_feature_columns", "select sample_id, " + ", ".join(_NOV_COLS) + " from cleaned")
def q_novelty_feature_columns(spark, sf_dir):
    """Detector feature auto-detection (k-mers, GC, names containing 'mut')."""
    c = derived.cleaned(spark, sf_dir)
    return c.select("sample_id", *features.novelty_feature_columns(c.columns))


_KIND_NUMERIC = ["genome_length", "gc_content"] + [f"kmer_{lv}" for lv in LEVELS] + ["length_diff", "mutation_density"]
_KIND_OTHER = ["genotype", "country", "year", "host", "is_complete", "serotype_label", "genotype_label", "known_genotype"]


@register("column_kinds", """
, k as (""" + " union all ".join(
    f"select '{c}' as \"column\", case when count(distinct {c}) < 20 and count(distinct {c}) < count(*) * 0.1 "
    f"then 'categorical' else 'numeric' end as kind from cleaned" for c in _KIND_NUMERIC) + " union all " + " union all ".join(
    f"select '{c}', 'categorical'" for c in _KIND_OTHER) + """)
select "column", kind from k""")
def q_column_kinds(spark, sf_dir):
    """D3: numeric with < 20 distinct and < 10% of rows -> categorical."""
    c = derived.cleaned(spark, sf_dir)
    cols = [x for x in c.columns if x not in ("sample_id", "description", "serotype")]
    kinds = features.column_kinds(c, cols)
    return spark.createDataFrame([(k, v) for k, v in kinds.items()], "column string, kind string")


@register("feature_meaning", """
, k as (""" + " union all ".join(f"select '{c}' as feature" for c in _KIND_NUMERIC + _KIND_OTHER) + """)
select feature, case when contains(lower(feature), 'gc_content') then 'GC Content - Overall nucleotide composition'
                     when contains(lower(feature), 'mutation_density') then 'Mutation Density - Rate of genetic variation'
                     when contains(lower(feature), 'kmer_') then 'k-mer frequencies - Sequence patterns'
                     when contains(lower(feature), 'kmer') then 'k-mer pattern'
                     when contains(lower(feature), 'mutation') then 'Mutation profile'
                     when contains(lower(feature), 'gc') then 'GC content'
                     else 'Other feature' end as biological_interpretation
from k""")
def q_feature_meaning(spark, sf_dir):
    """H4: feature -> meaning for every candidate feature of the cleaned table."""
    c = derived.cleaned(spark, sf_dir)
    cols = [x for x in c.columns if x not in ("sample_id", "description", "serotype")]
    names = spark.createDataFrame([(x,) for x in cols], "feature string")
    return interpret.map_features(names, "feature")


@register("one_hot_encoding", """
select sample_id, """ + ", ".join(
    f"coalesce((country = 'country_{i}')::int, 0) as \"country_country_{i}\"" for i in range(1, 6)) + """,
       coalesce((host = 'Homo sapiens')::int, 0) as "host_Homo sapiens"
from cleaned""")
def q_one_hot_encoding(spark, sf_dir):
    """Sorted levels, first level dropped, null -> all zeros."""
    c = derived.cleaned(spark, sf_dir).select("sample_id", "country", "host")
    lv = features.category_levels(c, ["country", "host"])
    return features.one_hot(c, lv, drop_first=True)


@register("label_encoding", """
select sample_id, serotype, (dense_rank() over (order by coalesce(serotype, 'unknown')) - 1)::int as serotype_idx
from metadata""")
def q_label_encoding(spark, sf_dir):
    """Sorted levels of the string cast -> 0..n-1 (null read as 'unknown')."""
    m = derived.metadata(spark, sf_dir).select("sample_id", "serotype")
    return features.label_encode(m, "serotype", out_col="serotype_idx")


_SCALE_COLS = ["gc_content", "kmer_AAA", "kmer_CGT", "length_diff", "mutation_density"]


@register("scaled_features", f"""
, r as (select *, row_number() over (partition by serotype order by {_HK}, sample_id) as rn,
               count(*) over (partition by serotype) as cn from cleaned),
  tr as (select * from r where not (rn <= round(cn * 0.2))),
  st as (select """ + ", ".join(f"avg({c}::double) as m_{c}, stddev_pop({c}::double) as s_{c}" for c in _SCALE_COLS) + """ from tr)
select sample_id, """ + ", ".join(
    f"round(({c} - m_{c}) / case when s_{c} = 0 then 1 else s_{c} end, 6) as {c}" for c in _SCALE_COLS) + """
from cleaned, st""")
def q_scaled_features(spark, sf_dir):
    """Standardise with the train split's mean and population std (0 -> 1)."""
    c = derived.cleaned(spark, sf_dir)
    sp = splits.stratified_split(c.select("sample_id", "serotype", *_SCALE_COLS), "serotype")
    model = features.fit_scaler(sp.where(~F.col("is_test")), _SCALE_COLS)
    out = model.transform(c, keep=["sample_id"])
    return out.select("sample_id", *[F.round(x, 6).alias(x) for x in _SCALE_COLS])


@register("class_weights", """
, n as (select serotype, count(*) as c from cleaned group by serotype)
select serotype, c as n_samples, round((select sum(c) from n)::double / ((select count(*) from n) * c), 9) as weight from n""")
def q_class_weights(spark, sf_dir):
    """balanced class weights n / (k x n_class) of the cleaned samples."""
    from seqlake.operators.models.classify import class_weights

    w = class_weights(derived.cleaned(spark, sf_dir).select("serotype"), "serotype")
    return w.groupBy("serotype").agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.max("weight"), 9).alias("weight"))


@register("null_id_counts", """
select 'metadata' as table_name, count(*) as n_rows, count(*) filter (where sample_id::bigint % 13 = 0) as n_null_ids from metadata
union all select 'mutation_profile', count(*), count(*) filter (where sample_id::bigint % 13 = 0) from mutation""")
def q_null_id_counts(spark, sf_dir):
    """Rows per table whose id is null and which the merge therefore drops (every 13th id blanked)."""
    blank = lambda d: d.withColumn("sample_id", F.when(F.col("sample_id").cast("long") % 13 != 0, F.col("sample_id")))
    return relational.null_id_counts({"metadata": blank(derived.metadata(spark, sf_dir)),
                                      "mutation_profile": blank(derived.mutation_profile(spark, sf_dir)), "labels": None})


@register("alignment_report", """
select unnest(['gc_content', 'kmer_AAA', 'kmer_ACG', 'kmer_NNN', 'genome_length', 'total_mutations', 'length_diff', 'mutation_density']) as feature,
       unnest(['present', 'missing', 'missing', 'missing', 'missing', 'missing', 'extra', 'extra']) as status,
       unnest([(select count(*) from raw), 0, 0, 0, 0, 0, (select count(*) from raw), (select count(*) from raw)])::bigint as n_values""")
def q_alignment_report(spark, sf_dir):
    """Expected columns that are present or missing and extra ones, with their non-null values."""
    m = derived.mutation_profile(spark, sf_dir)
    gc = derived.raw_sequences(spark, sf_dir).select("sample_id", sf.gc_content("sequence").alias("gc_content"))
    return features.alignment_frame(m.join(gc, "sample_id"), EXPECTED_DEMO, keep=["sample_id"])


@register("feature_meaning_means", """
, m as (""" + " union all ".join(f"select '{c}' as feature, avg({c}) as mean from cleaned" for c in _KIND_NUMERIC) + """)
select feature, round(mean, 6) as mean,
       case when contains(lower(feature), 'gc_content') then 'GC Content - Overall nucleotide composition'
            when contains(lower(feature), 'mutation_density') then 'Mutation Density - Rate of genetic variation'
            when contains(lower(feature), 'kmer_') then 'k-mer frequencies - Sequence patterns'
            else 'Other feature' end as biological_interpretation from m""")
def q_feature_meaning_means(spark, sf_dir):
    """H4: mean of every numeric feature of the cleaned samples with its meaning."""
    m = eda.column_means(derived.cleaned(spark, sf_dir), _KIND_NUMERIC)
    return interpret.map_features(m.select("feature", F.round("mean", 6).alias("mean")))


@register("csv_input", """
select sample_id, description, serotype, genotype, country, year, host, genome_length::varchar as genome_length,
       is_complete::varchar as is_complete from metadata""")
def q_csv_input(spark, sf_dir):
    """A2: one CSV with a header, read as text columns."""
    import uuid

    from seqlake.session import ensure_checkpoint_dir
    from seqlake.sources.tables import load_input, write_table

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/input-{uuid.uuid4().hex}.csv"
    return load_input(spark, write_table(derived.metadata(spark, sf_dir), path, fmt="csv"))


@register("novelty_split_holdout", f"""
, tr as (select sample_id, genotype, row_number() over (order by {_HK}, sample_id) as rn, count(*) over () as n
         from cleaned where genotype = (select min(genotype) from cleaned)),
  nv as (select sample_id, genotype from cleaned where genotype is not null and genotype <> (select min(genotype) from cleaned)),
  q as (select least((select count(*) from nv), max(n) // 4) as q from tr)
select sample_id, genotype, case when rn <= q.q then 'test' else 'train' end as role, case when rn <= q.q then 0 end as y_true from tr, q
union all select sample_id, genotype, 'test', 1 from nv""")
def q_novelty_split_holdout(spark, sf_dir):
    """E3 with known test rows held out of the training rows."""
    c = derived.cleaned(spark, sf_dir).select("sample_id", "genotype")
    train, test = splits.novelty_split(c, column="genotype", known_from="train_holdout")
    return (train.select("sample_id", "genotype", F.lit("train").alias("role"), F.lit(None).cast("int").alias("y_true"))
            .unionByName(test.select("sample_id", "genotype", F.lit("test").alias("role"), "y_true")))


# ------------------------------------------------ A3: GenBank round trip ---

@register("genbank_roundtrip", f"""
select sample_id || '.1' as sample_id, description,
       {_serotype_sql('description', "'Dengue virus'", "'Dengue virus'")} as serotype,
       genotype, country, right(collection_date, 4) as year, host,
       length(sequence) as genome_length,
       coalesce(contains(lower(description), 'complete genome'), false) as is_complete
from samples""")
def q_genbank_roundtrip(spark, sf_dir):
    """A3 + B1/B2: samples rendered as GenBank text, parsed back by the regex
    ingest, metadata derived from the parsed records."""
    from seqlake.sources import genbank

    text = genbank.render_records(samples(spark, sf_dir))
    return genbank.genbank_metadata(genbank.parse_records(text))


# ------------------------------------- P-class: learned models (rows only) ---
# Model outputs cannot equal another library's; these are checked by
# properties in tests/ and by row counts here. Sizes follow the original
# defaults except where noted.

from seqlake.operators.models.autoencoder import fit_autoencoder  # noqa: E402
from seqlake.operators.models.classify import cross_validate, fit_classifier, select_best  # noqa: E402
from seqlake.operators.models.iforest import fit_isolation_forest  # noqa: E402
from seqlake.operators.models.ocsvm import fit_oneclass_svm  # noqa: E402
from seqlake.operators.sparse import fit_sparse  # noqa: E402


_TASK1: dict = {}


def _task1_frames(spark, sf_dir):
    """Class-size filter, stratified split, frozen schema and scaler fit on the
    train part; the scaled table is checkpointed once per application because
    every model query (and each of their passes) reads it. Where a column has too many levels for a table column
    each, the rows stay as they are stored and ``schema.encoder`` holds all features sparse, as in ``train_task1``."""
    key = input_key(spark, sf_dir)
    if key not in _TASK1:
        c = derived.cleaned(spark, sf_dir)
        from seqlake.session import materialize

        sp = materialize(splits.stratified_split(relational.filter_min_class(c, "serotype"), "serotype"), "split")
        schema = features.fit_feature_schema(sp.where(~F.col("is_test")).drop("is_test"), target="serotype",
                                             exclude=["sample_id", "description", "sequence"])
        if schema.wide:
            schema.encoder = fit_sparse(sp.where(~F.col("is_test")), schema.numeric, schema.categorical)
        _TASK1[key] = (schema, sp if schema.wide else _scaled(sp, schema).checkpoint(eager=True))
    return _TASK1[key]


def _scaled(sp, schema):
    """The columns of a frozen schema, scaled by the train part."""
    X = features.prepare_features(sp, schema, keep=["sample_id", "serotype", "is_test"])
    scaler = features.fit_scaler(X.where(~F.col("is_test")), schema.names)
    return scaler.transform(X, keep=["sample_id", "serotype", "is_test"])


_PREP_NUMERIC = ["genome_length", "gc_content", *[f"kmer_{lv}" for lv in LEVELS], "length_diff", "mutation_density"]
# levels of the derived samples, first one dropped; is_complete is a boolean
_PREP_LEVELS = {"genotype": sorted(f"src{i}" for i in range(20))[1:], "country": [f"country_{i}" for i in range(1, 6)],
                "year": [str(y) for y in range(1991, 2020)], "host": ["Homo sapiens"], "is_complete": ["True"]}
_PREP_SQL = [(c, f"coalesce({c}::double, 0)") for c in _PREP_NUMERIC] + [
    (f"{c}_{v}", f"coalesce(({c} = " + ("true" if v == "True" else f"'{v}'") + ")::int, 0)::double")
    for c, lv in _PREP_LEVELS.items() for v in lv]


@register("prepared_features", f"""
, big as (select * from cleaned where serotype in (select serotype from cleaned group by serotype having count(*) >= 7)),
  r as (select *, row_number() over (partition by serotype order by {_HK}, sample_id) as rn,
               count(*) over (partition by serotype) as cn from big),
  x as (select sample_id, serotype, rn <= round(cn * 0.2) as is_test, """ + ", ".join(f'{e} as "{n}"' for n, e in _PREP_SQL) + """ from r),
  st as (select """ + ", ".join(f'avg("{n}") as m{i}, stddev_pop("{n}") as s{i}' for i, (n, _) in enumerate(_PREP_SQL)) + """ from x where not is_test)
select sample_id, serotype, is_test, """ + ", ".join(
    f'round(("{n}" - m{i}) / case when s{i} = 0 then 1 else s{i} end, 6) as "{n}"' for i, (n, _) in enumerate(_PREP_SQL)) + """
from x, st""")
def q_prepared_features(spark, sf_dir):
    """Frozen schema (kinds, one-hot levels, order) and scaling applied to every row."""
    schema, S = _task1_frames(spark, sf_dir)
    S = _scaled(S, schema) if schema.wide else S
    return S.select("sample_id", "serotype", "is_test", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in schema.names])


@register("sparse_features", f"""
, big as (select * from cleaned where serotype in (select serotype from cleaned group by serotype having count(*) >= 7)),
  n as (select count(*) as n from big),
  cells as (select sample_id, 'country' as c, country as v from big union all select sample_id, 'genotype', genotype from big
            union all select sample_id, 'year', year from big),
  lv as (select c, v, count(*) as k, row_number() over (order by c, v) - 1 as place,
                min(v) over (partition by c) as low, dense_rank() over (order by c) as ci from cells where v is not null group by c, v),
  slots as (select c, v, place - ci + 2 as pos, 1 / sqrt((k / n.n) * (1 - k / n.n)) as value from lv, n where v <> low)
select b.sample_id, s.pos::int as slot, round(s.value, 6) as value
from cells b join slots s on s.c = b.c and s.v = b.v
union all
select sample_id, p as slot, round((x - avg(x) over (partition by p)) / stddev_pop(x) over (partition by p), 6) as value
from (select sample_id, 0 as p, coalesce(gc_content, 0) as x from big union all select sample_id, 1, genome_length::double from big) y""")
def q_sparse_features(spark, sf_dir):
    """D4 + D7: sparse one-hot of any number of levels, one row per filled slot (two numeric slots first)."""
    from pyspark.ml.functions import vector_to_array

    big = relational.filter_min_class(derived.cleaned(spark, sf_dir), "serotype")
    enc = fit_sparse(big, ["gc_content", "genome_length"], ["country", "genotype", "year"])
    v = enc.vectors(big, ["sample_id"]).select("sample_id", F.posexplode(vector_to_array("features")).alias("slot", "value"))
    return v.where("value <> 0 or slot < 2").select("sample_id", "slot", F.round("value", 6).alias("value"))


_FOREST: dict = {}


def _forest(spark, sf_dir):
    """The forest of the train split, fitted once per input for the queries that read it."""
    key = input_key(spark, sf_dir)
    if key not in _FOREST:
        schema, S = _task1_frames(spark, sf_dir)
        _FOREST[key] = fit_classifier(S.where(~F.col("is_test")), schema.names, "serotype", "random_forest", encoder=schema.encoder)
    return _FOREST[key]


@register("random_forest_predictions")
def q_random_forest_predictions(spark, sf_dir):
    """F1 + F12: balanced random forest (100 trees) fit on the train split,
    predicted label and confidence for the test split."""
    _, S = _task1_frames(spark, sf_dir)
    clf = _forest(spark, sf_dir)
    return clf.predict(S.where(F.col("is_test")), keep=["sample_id", "serotype"])


@register("gbt_predictions")
def q_gbt_predictions(spark, sf_dir):
    """F2 + F12: softmax-boosted trees (depth 6, rate 0.1, 100 rounds)."""
    schema, S = _task1_frames(spark, sf_dir)
    clf = fit_classifier(S.where(~F.col("is_test")), schema.names, "serotype", "softmax_boost", encoder=schema.encoder)
    return clf.predict(S.where(F.col("is_test")), keep=["sample_id", "serotype"])


@register("cv_model_selection")
def q_cv_model_selection(spark, sf_dir):
    """5-fold macro-F1 per model, mean and population std, best first."""
    schema, S = _task1_frames(spark, sf_dir)
    cv = cross_validate(S.where(~F.col("is_test")), schema.names, "serotype", folds=5, encoder=schema.encoder)
    return select_best(cv)


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    """H1 + H4: top 20 forest importances with their meaning."""
    clf = _forest(spark, sf_dir)
    return interpret.map_features(interpret.top_importances(clf.importances(), spark, 20))


def _detector_frames(spark, sf_dir):
    e = embedding_rows(spark, sf_dir)
    return e.where("is_train"), e


@register("isolation_forest_scores")
def q_isolation_forest_scores(spark, sf_dir):
    """F4 + F5 + F10 + F11: 100 trees on psi=256 hash samples; 95th-percentile flag."""
    train, e = _detector_frames(spark, sf_dir)
    from seqlake.operators.models.threshold import percentile_threshold

    m = fit_isolation_forest(train, "features", "vec_id", n_trees=100)
    t = percentile_threshold(m.score(train), "score", 95.0)
    return flag(m.score(e), "score", t).select("vec_id", "label", "y_true", "score", "is_novel")


@register("oneclass_svm_scores")
def q_oneclass_svm_scores(spark, sf_dir):
    """RBF one-class SVM (nu 0.1, gamma 'scale') on 300 landmark features, stopped on the duality gap."""
    train, e = _detector_frames(spark, sf_dir)
    m = fit_oneclass_svm(train, "features", nu=0.1)
    return m.score(e, "features").select("vec_id", "label", "y_true", "score",
                                         (F.col("score") > 0).alias("is_outlier"))


@register("autoencoder_errors")
def q_autoencoder_errors(spark, sf_dir):
    """F7 + F8: two-stage ReLU autoencoder (64-32-32 / 32-64-d), reconstruction
    error and 95th-percentile flag (up to 500 epochs of minibatch Adam per stage, 10 a Spark job)."""
    train, e = _detector_frames(spark, sf_dir)
    m = fit_autoencoder(train, "features")
    s = m.score(e, "features")
    return flag(s, "reconstruction_error", m.threshold, "is_potential_new").select(
        "vec_id", "label", "y_true", "reconstruction_error", "is_potential_new")


def _explained(spark, sf_dir):
    """The forest, and exact attributions of its first class for 100 hash-sampled rows."""
    _, S = _task1_frames(spark, sf_dir)
    return _forest(spark, sf_dir), S


@register("shapley_attributions")
def q_shapley_attributions(spark, sf_dir):
    """H2 + H3: exact tree Shapley values of the forest's first-class probability
    for 100 hash-sampled rows; mean |value| top 20."""
    clf, S = _explained(spark, sf_dir)
    attr, _ = clf.attributions(splits.hash_sample(S, 100, seed=42))
    return interpret.attribution_summary(attr, 20)


@register("attribution_breakdown")
def q_attribution_breakdown(spark, sf_dir):
    """H3: the way of one row (first in hash order) from the forest's base value to its probability."""
    from seqlake.operators.models.pathshap import breakdown

    clf, S = _explained(spark, sf_dir)
    attr, base = clf.attributions(splits.hash_sample(S, 1, seed=42))
    return breakdown(attr, base, "sample_id")


@register("interpretation_report")
def q_interpretation_report(spark, sf_dir):
    """H5: importance and attribution sections with meanings, one tidy table."""
    clf, S = _explained(spark, sf_dir)
    imp = interpret.top_importances(clf.importances(), spark, 20)
    attr, _ = clf.attributions(splits.hash_sample(S, 100, seed=42))
    return interpret.interpretation_report(imp, attr, 20)


_TRAINED: dict = {}


def _trained(spark, sf_dir):
    """Models of the three tasks, trained once per application and shared by
    the training-summary and inference queries."""
    from seqlake.plans.training import train_all

    key = input_key(spark, sf_dir)
    if key not in _TRAINED:
        _TRAINED[key] = train_all(derived.cleaned(spark, sf_dir), tasks=(1, 2, 3))
    return _TRAINED[key]


@register("training_summary")
def q_training_summary(spark, sf_dir):
    """The three tasks trained from the cleaned table; one metrics row per
    task."""
    res = _trained(spark, sf_dir)
    t1 = res.task1_metrics.select(F.lit("task1_classification").alias("task"), "accuracy",
                                  F.col("macro_f1").alias("f1"), F.lit(None).cast("double").alias("roc_auc"))
    t2 = res.task2_metrics.select(F.lit("task2_novelty").alias("task"), "accuracy", "f1", "roc_auc")
    t3 = res.task3_metrics.select(F.lit("task3_open_set").alias("task"), "accuracy", "f1", "roc_auc")
    return t1.unionByName(t2).unionByName(t3)


@register("inference_from_sequences")
def q_inference_from_sequences(spark, sf_dir):
    """Raw sequences -> features -> mutation defaults -> all three
    scorers in one narrow plan, one row per sample."""
    from seqlake.plans.inference import infer_from_sequences

    res = _trained(spark, sf_dir)
    return infer_from_sequences(res, derived.raw_sequences(spark, sf_dir))


@register("saved_pipeline_scores")
def q_saved_pipeline_scores(spark, sf_dir):
    """J2 + A7: the three tasks as one pyspark.ml pipeline (novelty and open-set stages at full size, forest only as
    classifier), written, read back and applied to the cleaned samples."""
    import uuid

    from pyspark.ml import Pipeline, PipelineModel

    from seqlake.plans.stages import training_stages
    from seqlake.session import ensure_checkpoint_dir

    c = derived.cleaned(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipelines/{uuid.uuid4().hex}"
    Pipeline(stages=training_stages(kinds=("random_forest",), cv_folds=5)).fit(c).write().save(path)
    out = PipelineModel.load(path).transform(c)
    return out.select("sample_id", "serotype", "predicted_serotype", "prediction_confidence", "is_novel_genotype", "anomaly_score",
                      "is_potential_new_serotype", "reconstruction_error")


# ------------------------------------------ A1 + A6 + J1 from written files ---

@register("table_set_roundtrip", """
select sample_id, serotype, genome_length, gc_content, kmer_AAA, kmer_TTT, mutation_density,
       serotype_label, known_genotype from cleaned""")
def q_table_set_roundtrip(spark, sf_dir):
    """A6 -> A1 -> J1: the derived tables written as CSV under the shared
    checkpoint folder, loaded back as a table set (explicit schemas, header
    read for the wide table) and cleaned."""
    import uuid

    from seqlake.plans.cleaning import clean_tables
    from seqlake.session import ensure_checkpoint_dir
    from seqlake.sources.tables import load_table_set, write_table

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tableset-{uuid.uuid4().hex}"
    for name, df in (("sample_metadata", derived.metadata(spark, sf_dir)),
                     ("sequence_features", derived.sequence_features(spark, sf_dir)),
                     ("mutation_profile", derived.mutation_profile(spark, sf_dir)),
                     ("label_table", derived.label_table(spark, sf_dir))):
        write_table(df, f"{base}/{name}.csv", fmt="csv")
    res = clean_tables(load_table_set(spark, base, "csv"), "serotype")
    return res.cleaned.select("sample_id", "serotype", "genome_length", "gc_content", "kmer_AAA", "kmer_TTT",
                              "mutation_density", "serotype_label", "known_genotype")
