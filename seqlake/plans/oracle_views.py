"""DuckDB text of the derived sample tables, for the oracle side of the
registered queries. Written independently of the Spark code (naive SQL:
explicit windows, explicit pivots)."""

from __future__ import annotations

from seqlake.operators.kmers import kmer_levels
from seqlake.sources.fixtures import SAMPLES_SQL

LEVELS = kmer_levels(3)


def gc_sql(s: str) -> str:
    u = f"upper({s})"
    return (f"case when length({u}) > 0 then (length({u}) - length(replace(replace({u},'G',''),'C','')))"
            f"::double / length({u}) else 0.0 end")


def _wide_cols(alias: str = "kc") -> str:
    return ",\n  ".join(
        f"coalesce(max(case when {alias}.kmer = '{lv}' then {alias}.kmer_count::double / {alias}.total end), 0.0)"
        f" as kmer_{lv}" for lv in LEVELS)


def strip_long_sql(src: str) -> str:
    """Long strip-mode 3-mer table over ``src(sample_id, sequence)``."""
    return f"""
  select sample_id, kmer, count(*)::bigint as kmer_count, max(total)::bigint as total,
         count(*)::double / max(total) as freq
  from (select sample_id, substring(q, i, 3) as kmer, length(q) - 2 as total
        from (select sample_id, q, unnest(range(1, length(q) - 1)) as i
              from (select sample_id, regexp_replace(upper(sequence), '[^ACGT]', '', 'g') as q
                    from {src}) a) b) c
  group by sample_id, kmer"""


CTES = f"""
samples as ({SAMPLES_SQL}),
metadata as (
  select sample_id, description, serotype, genotype, country, right(collection_date, 4) as year,
         host, genome_length, coalesce(contains(lower(description), 'complete genome'), false) as is_complete
  from samples),
raw as (select sample_id, sequence from samples where sequence is not null and length(sequence) >= 100),
kc as ({strip_long_sql('raw')}),
seqfeat as (
  select r.sample_id, any_value({gc_sql('r.sequence')}) as gc_content,
  {_wide_cols()}
  from raw r left join kc on kc.sample_id = r.sample_id
  group by r.sample_id),
mutation as (
  select sample_id, length(sequence) - 10700 as length_diff,
         abs(length(sequence) - 10700)::double / 10700.0 as mutation_density
  from raw),
labels as (select sample_id, serotype, genotype, genotype is not null as known_genotype from metadata),
merged as (
  select m.*, s.* exclude (sample_id), u.length_diff, u.mutation_density,
         l.serotype as serotype_label, l.genotype as genotype_label, l.known_genotype
  from metadata m left join seqfeat s on s.sample_id = m.sample_id
       left join mutation u on u.sample_id = m.sample_id
       left join labels l on l.sample_id = m.sample_id),
labelled as (select * from merged where serotype is not null),
cleaned as (
  select * from labelled
  where genome_length >= (select quantile_cont(genome_length, 0.01) from labelled)
    and genome_length <= (select quantile_cont(genome_length, 0.99) from labelled))
"""


def oracle(sql: str) -> str:
    return f"with {CTES.strip()}\n{sql.strip()}"
