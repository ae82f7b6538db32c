"""k-mer frequency features (long and wide) and inference-time extraction.

Plan shape: k-mers are counted per input row (as the original does, record by
record), so no shuffle is needed at all. The long form is a narrow ``mapInPandas``
stage, the wide form one Arrow column function that Catalyst can prune; per-row
work is a vectorised numpy count. Measured at sf0.1 (18M windows) the
exploded-window SQL form (explode + substring + hash aggregate) took ~51 s on
8 cores versus ~0.6 s here, and it also needed a shuffle on (sample, k-mer).

GC content, lengths and all other columns stay JVM expressions.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.functions.sequence import gc_content
from seqlake.operators.ids import dense_index
from seqlake.operators.sparse import ACTIVE, NUMERIC, VALUES, to_vectors
from seqlake.session import materialize

ROWS = 256  # sequences read at once
CELLS = 100_000  # k-mers written at once, beyond the last sequence's own
DICTIONARY_BYTES = 64 << 20  # a dictionary up to this size is handed to every task
ACGT = "ACGT"
_ACGT_LUT = np.full(256, -1, np.int64)
for _i, _c in enumerate(b"ACGT"):
    _ACGT_LUT[_c] = _i


def kmer_levels(k: int = 3, alphabet: str = ACGT) -> list[str]:
    """All k-mers over ``alphabet`` in lexicographic order (4^k for ACGT)."""
    return ["".join(p) for p in itertools.product(sorted(alphabet), repeat=k)]


# ---------------------------------------------------------------- row helpers

def _strip_codes(seq: str, k: int):
    """Base-4 window codes of the uppercased, ACGT-only string."""
    b = np.frombuffer(seq.upper().encode("utf-8"), np.uint8)
    c = _ACGT_LUT[b]
    c = c[c >= 0]
    n = len(c) - k + 1
    if n <= 0:
        return None
    code = np.zeros(n, np.int64)
    for j in range(k):
        code = code * 4 + c[j:j + n]
    return code


def count_strip(seq, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(level indices, counts, total) for strip mode; levels = kmer_levels(k)."""
    if seq is None or seq == "":
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    code = _strip_codes(seq, k)
    if code is None:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    if k <= 10:
        cnt = np.bincount(code, minlength=4 ** k)
        nz = np.nonzero(cnt)[0]
        return nz, cnt[nz], len(code)
    u, cnt = np.unique(code, return_counts=True)
    return u, cnt, len(code)


def count_skip_n(seq, k: int) -> tuple[list[str], np.ndarray, int]:
    """(k-mers, counts, total) on the raw string, case kept, windows with 'N' dropped."""
    if seq is None or len(seq) < k:
        return [], np.empty(0, np.int64), 0
    cp = np.frombuffer(seq.encode("utf-32-le"), np.uint32)
    n = len(cp) - k + 1
    isn = (cp == ord("N")).astype(np.int64)
    csum = np.concatenate([[0], np.cumsum(isn)])
    keep = (csum[k:k + n] - csum[:n]) == 0
    if not keep.any():
        return [], np.empty(0, np.int64), 0
    chars, inv = np.unique(cp, return_inverse=True)
    base = len(chars)
    if base ** k < 2 ** 62:
        code = np.zeros(n, np.int64)
        for j in range(k):
            code = code * base + inv[j:j + n]
        u, cnt = np.unique(code[keep], return_counts=True)
        digits = np.empty((len(u), k), np.int64)
        rest = u.copy()
        for j in range(k - 1, -1, -1):
            digits[:, j] = rest % base
            rest //= base
        if chars[0] == 0:  # numpy drops NULs at a text's end
            kmers = ["".join(chr(x) for x in chars[row]) for row in digits]
        else:
            kmers = np.ascontiguousarray(chars[digits]).view(f"<U{k}").ravel().tolist()
    else:  # very wide alphabets: count the window strings directly
        wins = pd.Series([seq[i:i + k] for i in np.nonzero(keep)[0]])
        vc = wins.value_counts()
        kmers, cnt = list(vc.index), vc.to_numpy()
    return kmers, np.asarray(cnt, np.int64), int(keep.sum())


# ---------------------------------------------------------------- long form

LONG_SCHEMA = "kmer string, kmer_count long, total long, freq double"


def kmer_counts(df: DataFrame, k: int = 3, mode: str = "strip",
                seq_col: str = "sequence", id_col: str = "sample_id",
                keep: list[str] | None = None) -> DataFrame:
    """Long k-mer table per input row: ``id_col, kmer, kmer_count, total, freq``.

    ``mode='strip'``: uppercase and delete non-ACGT characters first, so windows
    span the deleted characters (inference-time features).
    ``mode='skip_n'``: raw string, case kept, windows containing ``N`` dropped,
    other ambiguity codes kept (training-time features).
    Rows with no window produce no k-mer rows. ``keep`` columns (per-row
    attributes such as a label) are repeated on each k-mer row, which saves
    joining them back on the id later.
    """
    keep = [c for c in (keep or []) if c != id_col]
    if k < 1:
        raise ValueError("k must be >= 1")
    if mode not in ("strip", "skip_n"):
        raise ValueError(f"unknown k-mer mode {mode!r} (use 'strip' or 'skip_n')")
    id_type = df.schema[id_col].dataType.simpleString()
    levels = np.array(kmer_levels(k)) if (mode == "strip" and k <= 10) else None

    def counted(seq):
        if mode == "skip_n":
            return count_skip_n(seq, k)
        idx, cnt, tot = count_strip(seq, k)
        return (levels[idx].tolist() if levels is not None else _words(idx, k)), cnt, tot

    def run(batches):
        """A batch's k-mers are written a bounded piece at a time."""
        for pdf in batches:
            rep, kms, cns, tots, held = [], [], [], [], 0
            for r, seq in enumerate(pdf[seq_col]):
                km, cnt, tot = counted(seq)
                if tot == 0:
                    continue
                rep.append(np.full(len(cnt), r))
                kms.extend(km)
                cns.append(cnt)
                tots.append(np.full(len(cnt), tot, np.int64))
                held += len(cnt)
                if held >= CELLS:
                    yield piece(pdf, rep, kms, cns, tots)
                    rep, kms, cns, tots, held = [], [], [], [], 0
            if held:
                yield piece(pdf, rep, kms, cns, tots)

    def piece(pdf, rep, kms, cns, tots):
        at, cnt, tot = np.concatenate(rep), np.concatenate(cns), np.concatenate(tots)
        out = pd.DataFrame({c: pdf[c].to_numpy()[at] for c in (id_col, *keep)})
        out["kmer"], out["kmer_count"], out["total"], out["freq"] = kms, cnt, tot, cnt / tot
        return out

    extra = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(id_col, *keep, seq_col).mapInPandas(
        run, f"`{id_col}` {id_type}{extra}, {LONG_SCHEMA}")


# ---------------------------------------------------------------- wide form

def kmer_vector(seq, levels: list[str], k: int = 3, mode: str = "strip") -> Column:
    """Frequencies of ``levels`` in one sequence as ``array<double>`` (0.0 when absent).

    An Arrow column function, not a plan stage: Catalyst drops it from any plan
    that uses none of its values, together with the sequence column it reads.
    """
    pos = {lv: i for i, lv in enumerate(levels)}
    strip_map = None
    if mode == "strip" and k <= 10:
        strip_map = np.array([pos.get(lv, -1) for lv in kmer_levels(k)], np.int64)
    width = len(levels)

    @F.arrow_udf("array<double>")
    def frequencies(seqs: pa.Array) -> pa.Array:
        out = np.zeros((len(seqs), width), np.float64)
        for r, text in enumerate(seqs.to_pylist()):
            if strip_map is not None:
                idx, cnt, tot = count_strip(text, k)
                if tot:
                    tgt = strip_map[idx]
                    ok = tgt >= 0
                    out[r, tgt[ok]] = cnt[ok] / tot
            else:
                km, cnt, tot = count_skip_n(text, k) if mode == "skip_n" else _strip_as_strings(text, k)
                for word, c in zip(km, cnt):
                    j = pos.get(word)
                    if j is not None:
                        out[r, j] = c / tot
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, max(width, 1), dtype=np.int32)[:len(seqs) + 1], out.ravel())

    return frequencies(F.col(seq) if isinstance(seq, str) else seq)


def kmer_wide_counts(df: DataFrame, levels: list[str], k: int = 3, mode: str = "strip",
                     seq_col: str = "sequence", prefix: str = "kmer_",
                     keep: list[str] | None = None) -> DataFrame:
    """Per row: ``keep`` columns + one frequency column per level (0.0 when absent).

    Narrow, output width fixed by ``levels``; the vector is computed once per row,
    and not at all where no frequency is used.
    """
    keep = [c for c in (keep or df.columns) if c != seq_col]
    vec = df.select(*keep, kmer_vector(seq_col, levels, k, mode).alias("_kmers"))
    return vec.select(*keep, *[F.col("_kmers")[i].alias(f"{prefix}{lv}") for i, lv in enumerate(levels)])


def _strip_as_strings(seq, k):
    idx, cnt, tot = count_strip(seq, k)
    return _words(idx, k), cnt, tot


def _words(idx: np.ndarray, k: int) -> list[str]:
    return ["".join(ACGT[(int(c) // 4 ** (k - 1 - j)) % 4] for j in range(k)) for c in idx]


def discover_levels(df: DataFrame, k: int = 3, mode: str = "skip_n", seq_col: str = "sequence",
                    id_col: str = "sample_id", max_levels: int = 4096) -> list[str] | None:
    """Distinct observed k-mers, sorted; None where they are too many for a table column each (see :func:`sequence_vectors`)."""
    long_df = kmer_counts(df, k=k, mode=mode, seq_col=seq_col, id_col=id_col)
    rows = long_df.select("kmer").distinct().orderBy("kmer").limit(max_levels + 1).collect()
    return None if len(rows) > max_levels else [r[0] for r in rows]


def distinct_kmers(df: DataFrame, k: int, mode: str, seq_col: str) -> DataFrame:
    """``kmer``: the observed k-mers, without a row per sequence and k-mer."""
    def run(batches):
        seen: set[str] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                for seq in batch.column(0).slice(lo, ROWS).to_pylist():
                    seen.update(count_skip_n(seq, k)[0] if mode == "skip_n" else _strip_as_strings(seq, k)[0])
                    if len(seen) > CELLS:
                        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["kmer"])
                        seen = set()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["kmer"])

    return df.select(F.col(seq_col).cast("string")).mapInArrow(run, "kmer string").distinct()


def kmer_dictionary(counts: DataFrame) -> DataFrame:
    """``kmer, slot``: the observed k-mers of a long table, numbered densely in order by a range sort."""
    return dense_index(counts.select("kmer").distinct(), order_by="kmer", col="slot", start=0).select("kmer", "slot")


def sequence_parts(df: DataFrame, k: int = 3, mode: str = "skip_n", seq_col: str = "sequence", id_col: str = "sample_id",
                   dictionary: DataFrame | None = None, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(id, gc_content, keep, slots and frequencies as arrays; dictionary)`` for any k and alphabet.

    The dictionary is a stored table. Up to ``DICTIONARY_BYTES``, measured, every task holds it and finds a sequence's
    slots as it counts, without a shuffle; a larger one is joined with the long counts, whose rows then move to their
    sequence, sorted, and are read as a stream. With a trained ``dictionary`` k-mers outside it are left out. Every input
    row is kept; one without a window has an empty vector.
    """
    keep = list(keep or [])
    if mode not in ("strip", "skip_n"):
        raise ValueError(f"unknown k-mer mode {mode!r} (use 'strip' or 'skip_n')")
    dictionary = kmer_dictionary(distinct_kmers(df, k, mode, seq_col)) if dictionary is None else dictionary
    dictionary = materialize(dictionary, "kmer-dictionary")
    size = dictionary.agg(F.coalesce(F.sum(F.octet_length("kmer") + 16), F.lit(0))).first()[0]
    if size <= DICTIONARY_BYTES:
        return _counted_parts(df, k, mode, seq_col, id_col, dictionary, keep), dictionary
    base = materialize(df.select(id_col, seq_col, *keep).withColumn("_row", F.monotonically_increasing_id()), "kmer-rows")
    counts = kmer_counts(base.select("_row", seq_col), k, mode, seq_col, "_row")
    cells = counts.join(dictionary, "kmer").select("_row", F.col("slot").cast("int").alias("slot"), "freq")
    lists = cells.repartition("_row").sortWithinPartitions("_row", "slot").mapInArrow(_runs, "_r long, s array<int>, f array<double>")
    rows = base.join(lists, F.col("_row") == F.col("_r"), "left")
    parts = rows.select(id_col, gc_content(F.col(seq_col)).alias("gc_content"), *keep, F.array().cast("array<double>").alias(NUMERIC),
                        F.coalesce(F.col("s"), F.array().cast("array<int>")).alias(ACTIVE),
                        F.coalesce(F.col("f"), F.array().cast("array<double>")).alias(VALUES))
    return parts, dictionary


def _runs(batches):
    """Lists per row from cells that come sorted by row; the last row of a batch may go on in the next."""
    last = None
    for batch in batches:
        row, slot, freq = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if last is not None:
            row, slot, freq = (np.concatenate(p) for p in zip(last, (row, slot, freq)))
        if not len(row):
            continue
        cut = int(np.searchsorted(row, row[-1]))
        last = row[cut:], slot[cut:], freq[cut:]
        if cut:
            yield _lists(row[:cut], slot[:cut], freq[:cut])
    if last is not None:
        yield _lists(*last)


def _lists(row, slot, freq) -> pa.RecordBatch:
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    ends = pa.array(np.r_[first, len(row)].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(row[first]), pa.ListArray.from_arrays(ends, pa.array(slot, pa.int32())),
                                       pa.ListArray.from_arrays(ends, pa.array(freq, pa.float64()))], names=["_r", "s", "f"])


def _counted_parts(df: DataFrame, k: int, mode: str, seq_col: str, id_col: str, dictionary: DataFrame, keep: list[str]) -> DataFrame:
    """:func:`sequence_parts` with the whole dictionary, checked to be small, in every task: one narrow stage."""
    spark = df.sparkSession
    listed = dictionary.orderBy("kmer", "slot").toArrow()
    held = spark.sparkContext.broadcast((listed.column("kmer").to_pylist(), listed.column("slot").to_numpy()))
    front = df.select(id_col, gc_content(F.col(seq_col)).alias("gc_content"), *keep, F.col(seq_col).cast("string").alias("_seq"))
    names = [id_col, "gc_content", *keep]

    def run(batches):
        words, slots = held.value
        place: dict[str, list[int]] = {}
        for word, slot in zip(words, slots.tolist()):
            place.setdefault(word, []).append(slot)
        for whole in batches:
            lo = 0
            texts = whole.column(whole.num_columns - 1)
            act, val, size, cells = [], [], [], 0
            for r in range(whole.num_rows):
                km, cnt, tot = (count_skip_n if mode == "skip_n" else _strip_as_strings)(texts[r].as_py(), k)
                found = sorted((s, c / tot) for word, c in zip(km, cnt.tolist()) for s in place.get(word, ()))
                act.append(np.array([s for s, _ in found], np.int32))
                val.append(np.array([f for _, f in found], np.float64))
                size.append(len(found))
                cells += len(found)
                if cells >= CELLS or r == whole.num_rows - 1:
                    ends = pa.array(np.cumsum([0, *size]).astype(np.int32))
                    n = r + 1 - lo
                    none = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.float64()))
                    yield pa.RecordBatch.from_arrays(
                        [*[whole.column(i).slice(lo, n) for i in range(len(names))], none, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(act))),
                         pa.ListArray.from_arrays(ends, pa.array(np.concatenate(val)))], names=[*names, NUMERIC, ACTIVE, VALUES])
                    lo, act, val, size, cells = r + 1, [], [], [], 0

    kinds = ", ".join(f"`{c}` {front.schema[c].dataType.simpleString()}" for c in names)
    return front.mapInArrow(run, f"{kinds}, {NUMERIC} array<double>, {ACTIVE} array<int>, {VALUES} array<double>")


def sequence_vectors(df: DataFrame, k: int = 3, mode: str = "skip_n", seq_col: str = "sequence", id_col: str = "sample_id",
                     dictionary: DataFrame | None = None, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(id, gc_content, kmers SparseVector, keep; dictionary)``: the vector form of :func:`sequence_parts`."""
    parts, dictionary = sequence_parts(df, k, mode, seq_col, id_col, dictionary, keep)
    size = dictionary.agg(F.coalesce(F.max("slot") + 1, F.lit(0))).first()[0]
    return to_vectors(parts, int(size), "kmers").select(id_col, "gc_content", "kmers", *(keep or [])), dictionary


def sequence_features(df: DataFrame, k: int = 3, mode: str = "strip",
                      levels: list[str] | None = None, seq_col: str = "sequence",
                      id_col: str = "sample_id", keep: list[str] | None = None) -> DataFrame:
    """Wide table: id, gc_content, one ``kmer_*`` column per level (0-filled), ``keep``.

    Every input row is kept, so a sequence shorter than k keeps a row of zeros.
    Strip mode uses the fixed 4^k ACGT levels; skip_n the observed levels unless
    ``levels`` is given. Observed levels too many for a column each come as one sparse ``kmers`` column.
    """
    if levels is None:
        levels = kmer_levels(k) if mode == "strip" else discover_levels(
            df, k, mode, seq_col, id_col)
    keep = list(keep or [])
    if levels is None:
        return sequence_vectors(df, k, mode, seq_col, id_col, keep=keep)[0]
    base = df.select(id_col, gc_content(F.col(seq_col)).alias("gc_content"), *keep, seq_col)
    wide = kmer_wide_counts(base, levels, k=k, mode=mode, seq_col=seq_col,
                            keep=[id_col, "gc_content", *keep])
    return wide.select(id_col, "gc_content", *[f"kmer_{lv}" for lv in levels], *keep)


def extract_features(df: DataFrame, k: int = 3, seq_col: str = "sequence",
                     id_col: str = "sample_id", expected: list[str] | None = None,
                     id_order: str | None = None) -> DataFrame:
    """Inference-time extraction: id + gc + strip-mode k-mers + genome_length.

    ``genome_length`` is the raw string length (null -> 0). When ``id_col`` is
    missing, ids ``SAMPLE_0001``... are generated densely in ``id_order``.
    With ``expected`` the output is aligned to that schema (missing -> 0,
    extras dropped, exact order) and ``id_col`` is kept in front.
    """
    from seqlake.operators.features import align_features
    from seqlake.operators.ids import with_sample_ids

    if id_col not in df.columns:
        df = with_sample_ids(df, id_col=id_col, order_by=id_order)
    base = df.select(id_col, seq_col,
                     F.coalesce(F.length(seq_col), F.lit(0)).alias("genome_length"))
    out = sequence_features(base, k=k, mode="strip", seq_col=seq_col, id_col=id_col,
                            keep=["genome_length"])
    if expected is not None:
        return align_features(out, expected, keep=[id_col])
    return out
