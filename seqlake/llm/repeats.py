"""Substring deduplication by repeated-phrase automata: every word of a 20-word window seen earlier goes.

1. Each document is reduced to its word sequence. Of every window's 5-word shingles the one of
   least hash (leftmost on ties) is its seed, so equal windows have the same seed at the same offset.
2. Seeds of all documents are range-sorted by hash; one that lies beside an equal one is shared. Only the
   stretches of text around shared seeds (*segments*) go on, keyed by their seed.
3. Per seed, windows that occur twice are confirmed as recurring phrases and compiled with
   pyahocorasick into automata over words; a shard is a run of seeds of about ``SHARD`` segments. The
   segments of the same seeds stream through their shard, which locates every occurrence; all but the
   first of a phrase are marked.
4. Marks are merged per text, and marked texts are read once more for the words that stay.

A segment meets only the automaton that can hold its phrases, so work grows with the input.
Equal word sequences are one text, judged by its first document; its other documents are removed
whole (if they have a window at all).

Skew: the range sort of seeds splits an equal run over tasks (runs at the edges of tasks are summed from a
table of two rows a task). A seed of more than ``HOT`` occurrences is salted: its windows are merged
per task, its phrases counted by a grouped aggregate and sent to each salt, and its segments are dealt over the salts. A task then holds one shard's
segments, or one hot seed's distinct recurring phrases, at a time.

Edge cases: null and blank texts have no words; texts under 20 words keep all; a null doc_id comes
first; rows of equal id but other words are ordered by the sha256 of their words; equal rows are one document, all kept or
removed alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seqlake.llm import wordhash
from seqlake.operators.ids import dense_index
from seqlake.session import materialize

WINDOW, GRAM = 20, 5
REACH = WINDOW - GRAM + 1  # shingles per window
SHARD, HOT = 4_000, 20_000
STEP = 4_000  # rows of an Arrow batch sent on
HELD = 50_000  # distinct windows of hot seeds that a task holds before it sends them on
NOTHING = hashlib.sha256(b"").hexdigest()
_MULT = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(GRAM)]


def _rolling(h: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` words from each word on."""
    n = len(h) - GRAM + 1
    acc = np.zeros(n, dtype=np.uint64)
    for j in range(GRAM):
        acc += h[j:n + j] * _MULT[j]
    return wordhash.mix(acc)


def _seeds(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, seed hash, seed's word, first window, windows)`` over a run; words are numbered within their row."""
    n = len(h) - WINDOW + 1
    if n < 1:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z, z, z
    g = _rolling(h)
    v, p = g, np.arange(len(g))
    step, width = 1, 1
    while width < REACH:  # leftmost least of a window of shingles, doubling its width
        step = min(width, REACH - width)
        left = v[step:] >= v[:-step]
        p = np.where(left, p[:-step], p[step:])
        v = np.where(left, v[:-step], v[step:])
        width += step
    p = p[:n]
    row = np.searchsorted(bounds, np.arange(n), side="right") - 1
    fine = np.arange(n) + WINDOW <= bounds[row + 1]
    start, p, row = np.flatnonzero(fine), p[fine], row[fine]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(p)))
    return row[at], g[p[at]], p[at] - bounds[row[at]], start[at] - bounds[row[at]], count


def profile(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, t, n_words, z, h, lo, m``: the word sequence (compressed) and its seeds, one row per document.

    ``digest`` is the sha256 of the words joined by a space and ``t`` its first 8 bytes.
    """
    id_type = docs.schema["doc_id"].dataType

    def batches(it):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in it:
            for a, b, data, off in wordhash.runs(batch.column(1)):
                h, bounds, _, _ = wordhash.words(data, off, lower=False)
                row, g, _, first, count = _seeds(h, bounds)
                cut = np.searchsorted(row, np.arange(b - a + 1))
                raw = data.tobytes()
                flat = [b" ".join(raw[i:j].split()) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
                digests = [hashlib.sha256(t).digest() for t in flat]
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(digests, pa.binary()),
                     pa.array([int.from_bytes(d[:8], "big", signed=True) for d in digests], pa.int64()),
                     pa.array(np.diff(bounds), pa.int64()), pa.array([squeeze.compress(t) for t in flat], pa.binary()),
                     lists(g.view(np.int64), pa.int64()), lists(first, pa.int32()), lists(count, pa.int32())],
                    names=["doc_id", "digest", "t", "n_words", "z", "h", "lo", "m"])

    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(
        batches, f"doc_id {id_type.simpleString()}, digest binary, t long, n_words long, z binary, "
                 "h array<long>, lo array<int>, m array<int>")


def shared_seeds(seeds: DataFrame) -> DataFrame:
    """``h, t, lo, m, n``: the seeds (h, t, lo, m) that occur more than once, with the number of rows of their hash.

    Neighbours in the order of (h, t, lo) are compared within each task; runs that touch
    a task's edge are summed over tasks. Equal (h, t, lo), copies of a text, count once.
    """
    order = ["h", "t", "lo"]
    sorted_rows = seeds.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows = sorted_rows.select("h", "t", "lo", "m", F.spark_partition_id().alias("part"))

    def runs(batches):
        held: list[np.ndarray] = []  # columns of the last run, which may go on
        first, part = True, 0

        def out(h, t, lo, m, edge):
            # run lengths over distinct rows; rows of single runs inside a task leave no trace
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(h)))
            n = np.repeat(size, size)
            touch = np.zeros(len(h), bool)
            if edge[0]:
                touch[:size[0]] = True
            if edge[1]:
                touch[-size[-1]:] = True
            keep = (n > 1) | touch
            return pa.RecordBatch.from_arrays(
                [pa.array(h[keep]), pa.array(t[keep]), pa.array(lo[keep], pa.int32()), pa.array(m[keep], pa.int32()),
                 pa.array(n[keep], pa.int64()), pa.array(touch[keep])], names=["h", "t", "lo", "m", "n", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held:
                cols = [np.concatenate((a, b)) for a, b in zip(held, cols)]
            h, t, lo, _ = cols
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (t[1:] == t[:-1]) & (lo[1:] == lo[:-1])
            cols = [c[~again] for c in cols]
            h = cols[0]
            last = int(np.searchsorted(h, h[-1], side="left"))
            if last:
                yield out(*(c[:last] for c in cols), (first, False))
                first = False
            held = [c[last:] for c in cols]
        if held:
            yield out(*held, (first, True))

    found = materialize(sorted_rows.mapInArrow(runs, "h long, t long, lo int, m int, n long, edge boolean"), "repeat-seeds")
    # at most two hashes a task
    edges = found.filter("edge").groupBy(F.col("h").alias("eh")).agg(F.count(F.lit(1)).alias("en"))
    j = found.join(F.broadcast(edges), found["h"] == edges["eh"], "left")
    return j.select("h", "t", "lo", "m", F.coalesce("en", "n").alias("n")).filter("n > 1")


def _lists(column: pa.Array, fields: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """``(first entry of each row, and the end; flat arrays of the fields)`` of a column of lists of structs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    ends = np.cumsum(np.concatenate(([0], column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
    return ends, [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]


def _segments(texts: DataFrame) -> DataFrame:
    """``h, n, no, at, m, words``: the stretch of each shared seed's windows, of ``texts(no, z, spots)``."""

    def cut(batches):
        grow = zstandard.ZstdDecompressor()
        for batch in batches:
            bounds, (h, n, lo, m) = _lists(batch.column(2), ("h", "n", "lo", "m"))
            nos = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(bounds))
            pieces: list[bytes] = []
            at = 0
            for r in range(batch.num_rows):
                words = grow.decompress(batch.column(1)[r].as_py()).split(b" ")
                for i in range(bounds[r], bounds[r + 1]):
                    pieces.append(b" ".join(words[lo[i]:lo[i] + m[i] + WINDOW - 1]))
                    if len(pieces) == STEP or i + 1 == bounds[-1]:
                        to = at + len(pieces)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h[at:to]), pa.array(n[at:to]), pa.array(nos[at:to]), pa.array(lo[at:to], pa.int32()),
                             pa.array(m[at:to], pa.int32()), pa.array(pieces, pa.binary())], names=["h", "n", "no", "at", "m", "words"])
                        pieces, at = [], to

    return texts.select("no", "z", "spots").mapInArrow(cut, "h long, n long, no long, at int, m int, words binary")


def _hot_windows(hot: DataFrame) -> DataFrame:
    """``h, n, no, at, last_no, last_at, words``: the windows of hot seeds; equal ones of a task are one row, with their first and last place."""
    fields = ["h", "n", "no", "at", "last_no", "last_at", "words"]

    def windows(batches):
        places: dict[tuple[int, int, bytes], list[tuple[int, int]]] = {}

        def flush():
            keys, spans = list(places), list(places.values())
            places.clear()
            for i in range(0, len(keys), STEP):
                k, s = keys[i:i + STEP], spans[i:i + STEP]
                first, last = [x[0] for x in s], [x[1] for x in s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in k], pa.int64()), pa.array([x[1] for x in k], pa.int64()), pa.array([x[0] for x in first], pa.int64()),
                     pa.array([x[1] for x in first], pa.int32()), pa.array([x[0] for x in last], pa.int64()),
                     pa.array([x[1] for x in last], pa.int32()), pa.array([x[2] for x in k], pa.binary())], names=fields)

        for batch in batches:
            for h, n, no, at, m, seg in zip(*(batch.column(i).to_pylist() for i in range(6))):
                w = seg.split(b" ")
                for i in range(m):
                    place = (no, at + i)
                    have = places.setdefault((h, n, b" ".join(w[i:i + WINDOW])), [place, place])
                    if place < have[0]:
                        have[0] = place
                    elif place > have[1]:
                        have[1] = place
                if len(places) >= HELD:
                    yield from flush()
        yield from flush()

    return hot.mapInArrow(windows, "h long, n long, no long, at int, last_no long, last_at int, words binary")


def _hot_phrases(hot: DataFrame) -> DataFrame:
    """``h, n, no, at, words``: recurring windows of hot seeds with their first occurrence, counted by a grouped aggregate."""
    first, last = F.min(F.struct("no", "at")), F.max(F.struct(F.col("last_no").alias("no"), F.col("last_at").alias("at")))
    return _hot_windows(hot).groupBy("h", "n", "words").agg(first.alias("a"), last.alias("b")).filter("a != b").select(
        "h", "n", F.col("a.no").alias("no"), F.col("a.at").alias("at"), "words")


class PhraseShard:
    """One automaton of recurring phrases over word numbers; a phrase's value is its first occurrence."""

    def __init__(self) -> None:
        import ahocorasick

        self.words: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.size = 0

    def numbers(self, words: list[bytes]) -> tuple[int, ...]:
        have = self.words
        return tuple(have.setdefault(w, len(have) + 1) for w in words)

    def known(self, words: list[bytes]) -> tuple[int, ...]:
        """Numbers of a text's words; 0, which no phrase holds, for others."""
        get = self.words.get
        return tuple(get(w, 0) for w in words)

    def add(self, phrase: tuple[int, ...], first: tuple[int, int]) -> None:
        self.automaton.add_word(phrase, first)
        self.size += 1

    def compile(self) -> None:
        if self.size:
            self.automaton.make_automaton()

    def repeats(self, numbers: tuple[int, ...], no: int, at: int) -> list[tuple[int, int]]:
        """Merged word ranges ``[start, end)`` of ``no`` covered by occurrences that are not a phrase's first."""
        out: list[list[int]] = []
        if not self.size:
            return []
        for end, first in self.automaton.iter(numbers):
            start = at + end - WINDOW + 1
            if first == (no, start):
                continue
            if out and start <= out[-1][1]:
                out[-1][1] = start + WINDOW
            else:
                out.append([start, start + WINDOW])
        return [(a, b) for a, b in out]


def confirm(segments: list[tuple]) -> tuple[PhraseShard, list[tuple[int, ...]]]:
    """The shard of the windows that occur twice in ``segments(no, at, m, words)``, and the segments' word numbers."""
    shard = PhraseShard()
    numbers = [shard.numbers(words) for _, _, _, words in segments]
    first: dict[tuple[int, ...], tuple[int, int]] = {}
    again = set()
    for (no, at, m, _), x in zip(segments, numbers):
        for i in range(m):
            w = x[i:i + WINDOW]
            place = (no, at + i)
            have = first.setdefault(w, place)
            if have != place:
                again.add(w)
                if place < have:
                    first[w] = place
    for w in again:
        shard.add(w, first[w])
    shard.compile()
    return shard, numbers


def _marks(rows: DataFrame) -> DataFrame:
    """``no, a, b``: word ranges to remove. Rows ``(h, salt, kind, no, at, m, words)`` come sorted, phrases (kind 0) first."""

    def batch_of(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        c = list(zip(*found)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32())],
                                          names=["no", "a", "b"])

    def stream(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # segments of whole seeds, then of the seed at hand
        whole, now = 0, None
        hot: PhraseShard | None = None
        ready = False

        def locate(segments):
            shard, numbers = confirm(segments)
            return [(no, a, b) for (no, at, _, _), x in zip(segments, numbers) for a, b in shard.repeats(x, no, at)]

        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for h, salt, kind, no, at, m, words in zip(*(batch.column(i).to_pylist() for i in range(7))):
                key = (h, salt)
                if key != now:
                    now, hot, ready, whole = key, None, False, len(held)
                    if whole >= SHARD:
                        found += locate(held)
                        held, whole = [], 0
                words = words.split(b" ")
                if kind == 0:
                    hot = hot or PhraseShard()
                    hot.add(hot.numbers(words), (no, at))
                elif salt >= 0:  # a hot seed: its phrases came first, if it has any
                    if hot:
                        if not ready:
                            hot.compile()
                            ready = True
                        found += [(no, a, b) for a, b in hot.repeats(hot.known(words), no, at)]
                else:
                    held.append((no, at, m, words))
            yield batch_of(found)
        yield batch_of(locate(held))

    return rows.mapInArrow(stream, "no long, a int, b int")


def _texts(prof: DataFrame) -> DataFrame:
    """``digest, t, first_id, rid, no``: distinct word sequences with a window, numbered by their first document."""
    first = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "rid")
    per = prof.filter(F.col("n_words") >= WINDOW).groupBy("digest", "t").agg(F.min(first).alias("f"))
    per = per.select("digest", "t", F.col("f.has").alias("has"), F.col("f.doc_id").alias("first_id"), F.col("f.rid").alias("rid"))
    return materialize(dense_index(per, order_by=["has", "first_id", "digest"], col="no"), "repeat-texts")


def _kept(texts: DataFrame) -> DataFrame:
    """``digest, n_removed, kept_sha256`` of ``texts(digest, z, ranges)``."""

    def batches(it):
        grow = zstandard.ZstdDecompressor()
        for batch in it:
            digests, removed, hashes = batch.column(0), [], []
            bounds, (a, b) = _lists(batch.column(2), ("a", "b"))
            for r in range(batch.num_rows):
                words = grow.decompress(batch.column(1)[r].as_py()).split(b" ")
                mine = slice(bounds[r], bounds[r + 1])
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, a[mine], 1)
                np.add.at(gone, b[mine], -1)
                stay = np.cumsum(gone[:-1]) == 0
                removed.append(len(words) - int(stay.sum()))
                hashes.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(stay).tolist()])).hexdigest())
            yield pa.RecordBatch.from_arrays([digests, pa.array(removed, pa.int64()), pa.array(hashes, pa.string())],
                                             names=["d2", "n_removed", "kept_sha256"])

    return texts.select("digest", "z", "ranges").mapInArrow(batches, "d2 binary, n_removed long, kept_sha256 string")


def _of_first(prof: DataFrame, keys: DataFrame) -> DataFrame:
    """Columns of ``keys(rid, ...)`` with the compressed words of each text's first row."""
    return keys.hint("shuffle_hash").join(prof.select(F.col("rid").alias("zid"), "z"), F.col("rid") == F.col("zid"))


def repeated_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(profile, texts, ranges)``: documents, distinct texts, and ``no, ranges`` of the words to remove per text."""
    prof = materialize(profile(docs).withColumn("rid", F.monotonically_increasing_id()), "repeat-profile")
    texts = _texts(prof)
    seeds = prof.select("t", F.explode(F.arrays_zip("h", "lo", "m")).alias("s")).select("s.h", "t", "s.lo", "s.m")
    shared = shared_seeds(seeds)
    spots = shared.groupBy("t").agg(F.collect_list(F.struct("h", "n", "lo", "m")).alias("spots"))
    needed = texts.join(spots.withColumnRenamed("t", "t2"), F.col("t") == F.col("t2")).select("no", "rid", "spots")
    segments = materialize(_segments(_of_first(prof, needed)), "repeat-segments")
    hot = segments.filter(F.col("n") > HOT)
    salts = F.ceil(F.col("n") / HOT)
    phrases = _hot_phrases(hot.select("h", "n", "no", "at", "m", "words"))
    phrases = phrases.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    rows = segments.select("h", F.when(F.col("n") > HOT, F.pmod(F.xxhash64("no", "at"), salts)).otherwise(-1).cast("long").alias("salt"),
                           F.lit(1).alias("kind"), "no", "at", "m", "words")
    rows = rows.union(phrases.select("h", "salt", F.lit(0).alias("kind"), "no", "at", F.lit(1).alias("m"), "words"))
    rows = rows.repartition("h", "salt").sortWithinPartitions("h", "salt", "kind")
    marks = _marks(rows)
    ranges = marks.groupBy("no").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    return prof, texts, ranges


def dedup_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per document after removing repeated windows."""
    prof, texts, ranges = repeated_ranges(docs)
    marked = texts.join(ranges.withColumnRenamed("no", "no2"), F.col("no") == F.col("no2")).select("digest", "rid", "ranges")
    kept = _kept(_of_first(prof, marked))
    per = texts.select(F.col("digest").alias("d1"), "first_id").join(kept, F.col("d1") == F.col("d2"), "left")
    j = prof.select("doc_id", "digest", "n_words").join(per, F.col("digest") == F.col("d1"), "left")
    copy = F.col("d1").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_id"))
    return j.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, NOTHING).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"))
