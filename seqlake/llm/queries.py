"""Registered queries of this subpackage: thin calls of the operators on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES = {}
ORACLE = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(spark: SparkSession, name: str) -> str:
    """Path of a tokenizer file: the folder set in ``spark.seqlake.tokenizers``, else that of the public files."""
    folder = spark.conf.get("spark.seqlake.tokenizers", None)
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op5_hilbert_sharding(spark, sf_dir):
    from seqlake.llm.hilbert import shard_report

    return shard_report(table(spark, sf_dir, "documents"))


@query
def op10_weighted_fair_mix(spark, sf_dir):
    from seqlake.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


ORACLE["op10_weighted_fair_mix"] = r"""
with sized as (
    select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
           substr(md5('42|' || coalesce(source, '') || '|' || coalesce(cast(doc_id as varchar), '') || '|'
                      || md5(coalesce(text, ''))), 1, 15) as h
    from documents),
per as (
    select source, cast(sum(size) as bigint) as source_size,
           cast((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1 as double) as weight
    from sized group by source),
ahead as (
    select *, 3.0 * source_size as cap, 3.0 * source_size / weight as ratio,
           cast(sum(source_size) over () as double) as total, sum(weight) over () as weights,
           coalesce(sum(3.0 * source_size) over w, 0) as caps_ahead, coalesce(sum(weight) over w, 0) as weights_ahead
    from per
    window w as (order by 3.0 * source_size / weight, encode(source) rows between unbounded preceding and 1 preceding)),
levels as (
    select *, (total - caps_ahead) / (weights - weights_ahead) as level from ahead),
targets as (
    select source, source_size, total,
           cast(least(cap, (select max(level) from levels where ratio >= level) * weight) as double) as target from levels),
timed as (
    select s.doc_id, s.source, s.size, t.source_size, t.target, t.total,
           sum(s.size) over (partition by s.source order by s.h rows between unbounded preceding and current row) as cum
    from sized s join targets t on s.source is not distinct from t.source),
copies as (
    select (cast((e - 1) * source_size + cum as double)) / target as v, size
    from timed, (values (1), (2), (3)) as p(e) where size > 0 and target > 0),
run as (
    select v, sum(size) as n, sum(sum(size)) over (order by v) as run from copies group by v),
cut as (
    select max(v) as v from run where run - n / 2 <= (select max(total) from targets))
select doc_id, size, source_size, target, source,
       cast(size * case when size > 0 and target > 0 then
            (case when cast(cum as double) / target <= cut.v then 1 else 0 end)
            + (case when cast(source_size + cum as double) / target <= cut.v then 1 else 0 end)
            + (case when cast(2 * source_size + cum as double) / target <= cut.v then 1 else 0 end)
       else 0 end as bigint) as taken
from timed, cut
"""


@query
def op3_sentencepiece(spark, sf_dir):
    from seqlake.llm.pieces import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_file(spark, "piece_bpe_32k.model"))


@query
def op9_arrow_token_files(spark, sf_dir):
    from seqlake.llm.tokenfiles import documents, write

    return documents(write(table(spark, sf_dir, "documents"), tokenizer_file(spark, "word_bpe_49k.json")))


@query
def op8_tag_path_text(spark, sf_dir):
    from seqlake.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op6_ngram_jaccard(spark, sf_dir):
    from seqlake.llm.jaccardjoin import groups

    return groups(table(spark, sf_dir, "documents"))


@query
def op7_pstable_neardup(spark, sf_dir):
    from seqlake.llm.pstable import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op2_simhash(spark, sf_dir):
    from seqlake.llm.simhash import fingerprint_report

    return fingerprint_report(table(spark, sf_dir, "documents"))


@query
def op4_disclosure_pii(spark, sf_dir):
    from seqlake.llm.disclosure import report

    return report(table(spark, sf_dir, "documents"))


@query
def op1_ordinal_quality(spark, sf_dir):
    from seqlake.llm.ordinal import quality_report

    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_bidiagonal_whitening(spark, sf_dir):
    from seqlake.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_suffix_dawg_repair(spark, sf_dir):
    from seqlake.llm.turnrepair import damage_report

    return damage_report(table(spark, sf_dir, "conversations"))


@query
def op11_phrase_automata_dedup(spark, sf_dir):
    from seqlake.llm.repeats import dedup_report

    return dedup_report(table(spark, sf_dir, "documents"))
