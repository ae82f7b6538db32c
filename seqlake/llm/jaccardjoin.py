"""N-gram Jaccard join with vertical partitioning: fragments of one global n-gram order, partial overlaps summed per pair.

The order puts rare n-grams first. It comes from a fixed-size table of counts over the
whole corpus (``2**SKETCH_BITS`` hash cells): any common order gives right results, the
counts only make it selective. Two sets with Jaccard t share an n-gram among the
first ``n - ceil(t n) + 1`` of each, so only those are shuffled to find candidates. A
candidate's overlap is counted fragment by fragment and summed.

Equal sets are one class. Links inside large groups are found without all pairs: two
rounds link every member to few hubs of its n-gram (first the class whose rare end is most
widely shared, the centre of a group of edited copies), then only pairs whose members are
still in different components are compared, so no component is split. Of these, a pair
meets only at n-grams that leave both enough n-grams behind them to reach the
threshold; the first one that two linked sets share always does.

Edge cases: null, blank and empty texts have no n-grams and link with nothing; fewer than
five words are one n-gram; repeated rows and repeated ids share their class; a null id
is never the smallest; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm import wordhash
from seqlake.llm.components import components
from seqlake.llm.repeats import shared_seeds
from seqlake.operators.common import bounded_broadcast
from seqlake.session import discard, materialize, short_batches

SKETCH_BITS = 20
SLICES = 64
FRAGMENTS = 4
HUB_ROUNDS, HUBS = 2, 2
MAX_BITS = 27
HOT = 2_000  # pairs of one hub that a task takes
FEW = 500_000  # rows of a few numbers that are broadcast (at most 20 MB)
_MASK = np.uint64((1 << SKETCH_BITS) - 1)


def _sets(column):
    """Yield ``(row, class key, sorted distinct n-gram hashes)``."""
    for a, _, data, off in wordhash.runs(column):
        h, bounds, _, _ = wordhash.words(data, off)
        for i, s in enumerate(wordhash.shingles(h, bounds)):
            key = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True) if len(s) else None
            yield a + i, key, s


def _scan(rows: DataFrame, id_type: str) -> DataFrame:
    """Per row its class and set size; per task its part of the count table."""
    names = ["doc_id", "n", "c", "slice", "counts"]
    doc_type = rows.schema["doc_id"].dataType

    def batches(it):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in it:
            n, c = [], []
            for _, key, s in _sets(batch.column(1)):
                n.append(len(s))
                c.append(key)
                np.add.at(counts, (s & _MASK).astype(np.int64), 1)
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.nulls(k, pa.int32()),
                 pa.nulls(k, pa.binary())], names=names)
        if counts.any():
            blobs = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(SLICES, -1)]
            from pyspark.sql.pandas.types import to_arrow_type
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SLICES, to_arrow_type(doc_type)), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()),
                 pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], names=names)

    return rows.mapInArrow(batches, f"doc_id {id_type}, n long, c long, slice int, counts binary")


def _order(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``(count per cell, fragment per cell)``: fixed size, whatever the corpus."""

    def add(key, pdf):
        total = sum(np.frombuffer(zlib.decompress(b), np.int64) for b in pdf["counts"])
        return pd.DataFrame({"slice": [key[0]], "counts": [total.tobytes()]})

    parts = scan.filter("slice is not null").select("slice", "counts").groupBy("slice").applyInPandas(add, "slice int, counts binary")
    counts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.int64)
    for row in parts.collect():  # SLICES rows
        counts[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    counts = counts.reshape(-1)
    order = np.argsort(counts, kind="stable")
    mass = np.cumsum(counts[order])
    fragment = np.empty(len(counts), np.uint8)
    fragment[order] = np.minimum(mass * FRAGMENTS // max(int(mass[-1]) + 1, 1), FRAGMENTS - 1)
    return counts, fragment


def _tokens(rows: DataFrame, order, num: int, den: int) -> DataFrame:
    """``h, t, lo, m``: n-gram, class, place and 0, for the rare end of every row's set."""

    def batches(it):
        counts = order.value[0]
        for batch in it:
            h, t, lo, m = [], [], [], []
            for _, key, s in _sets(batch.column(1)):
                if key is None:
                    continue
                n = len(s)
                keep = n - (-(-num * n // den)) + 1
                h.append(s[np.lexsort((s, counts[(s & _MASK).astype(np.int64)]))[:keep]].view(np.int64))
                t.append(np.full(keep, key, np.int64))
                lo.append(np.arange(keep, dtype=np.int32))
                m.append(np.zeros(keep, np.int32))  # the size follows from the class
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (h, t, lo, m)], names=["h", "t", "lo", "m"])

    return rows.mapInArrow(batches, "h long, t long, lo int, m int")


def bitmap(hashes: DataFrame, count: int) -> np.ndarray:
    """Packed bitmap over the one long column of ``count`` rows: false positives only cost work, none is missed.

    Eight bits a row, up to ``2**MAX_BITS`` in all (16 MB); beyond that more rows pass and do the full work.
    """
    bits = min(MAX_BITS, max(16, (8 * max(count, 1)).bit_length()))
    cell = np.int64((1 << bits) - 1)

    def batches(it):
        held = np.zeros(1 << (bits - 3), np.uint8)
        for batch in it:
            at = batch.column(0).to_numpy() & cell
            np.bitwise_or.at(held, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        for i, part in enumerate(held.reshape(SLICES, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])],
                                                 names=["slice", "bits"])

    def either(key, pdf):
        parts = [np.frombuffer(zlib.decompress(b), np.uint8) for b in pdf["bits"]]
        return pd.DataFrame({"slice": [key[0]], "bits": [np.bitwise_or.reduce(parts).tobytes()]})

    parts = hashes.mapInArrow(batches, "slice int, bits binary")
    out = np.zeros((SLICES, (1 << (bits - 3)) // SLICES), np.uint8)
    for row in parts.groupBy("slice").applyInPandas(either, "slice int, bits binary").collect():  # SLICES rows
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def in_bitmap(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.int64(8 * len(packed) - 1)
    return (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _sets_of(rows: DataFrame, order, wanted: DataFrame) -> DataFrame:
    """``c, parts``: the classes of ``wanted(c, rep)``, their sets cut into fragments of the global order.

    Cut from the rows whose id is a class's first, and only those are read as words. A class comes once a task at most; a class whose first row
    is repeated may come from several tasks, with equal fragments.
    """
    count = wanted.count()
    sent = rows.sparkSession.sparkContext.broadcast((bitmap(wanted.select(F.xxhash64("rep")), count), bitmap(wanted.select("c"), count)))

    def batches(it):
        fragment, (ids, classes) = order.value[1], sent.value
        seen: set[int] = set()
        for batch in it:
            batch = batch.filter(pa.array(in_bitmap(ids, batch.column(2).to_numpy())))
            c, parts = [], []
            for _, key, s in _sets(batch.column(1)):
                if key is None or key in seen or not in_bitmap(classes, np.array([key]))[0]:
                    continue
                seen.add(key)
                part = fragment[(s & _MASK).astype(np.int64)]
                c.append(key)
                parts.append([s[part == k].view(np.int64) for k in range(FRAGMENTS)])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(parts, pa.list_(pa.list_(pa.int64())))], names=["c", "parts"])

    return rows.withColumn("h", F.xxhash64("doc_id")).mapInArrow(batches, "c long, parts array<array<long>>")


def _linked(pairs: DataFrame, rows: DataFrame, order, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` of ``a, b, na, nb`` that reach the threshold: overlaps counted per fragment, summed per pair.

    The sets of both ends travel to ``b``; a ``b`` of many pairs is salted, its own set sent to each salt.
    """
    pairs = materialize(pairs, "jaccard-pairs")
    ends = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    wanted = materialize(reps.join(ends, "k").select(F.col("k").alias("c"), "rep"), "jaccard-ends")
    many = materialize(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HOT).alias("salts")), "jaccard-hubs")
    salted = pairs.join(many.filter("salts > 1"), "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1)))).drop("salts")
    sets = _sets_of(rows, order, wanted)
    # two ids a row: sent to the sets while they are few, else the sets meet them by a shuffle
    left = sets.select(F.col("c").alias("a"), F.col("parts").alias("x")).join(bounded_broadcast(salted, FEW), "a")
    right = sets.join(bounded_broadcast(many, FEW), sets["c"] == many["b"]).select("b", F.col("parts").alias("y"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    each = F.zip_with("x", "y", lambda p, q: F.size(F.array_intersect(p, q)).cast("long"))
    total = left.join(right, ["b", "salt"]).select("a", "b", "na", "nb", F.aggregate(each, F.lit(0).cast("long"), lambda n, k: n + k).alias("n"))
    total = total.filter(F.col("n") * den >= (F.col("na") + F.col("nb") - F.col("n")) * num)
    found = materialize(total.select("a", "b").distinct(), "jaccard-links")
    discard(pairs, many, wanted)
    return found


def join_classes(docs: DataFrame, text: str = "text", num: int = 3, den: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(doc_id, n, k per row; links a, b between classes; node, component of linked classes)``; ``k`` is the class of equal sets."""
    with short_batches(docs.sparkSession):  # every step on texts ends inside
        return _join_classes(docs, text, num, den)


def _join_classes(docs: DataFrame, text: str, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"], docs[text])
    scan = materialize(_scan(rows, id_type), "jaccard-scan")
    members = scan.filter("slice is null").select("doc_id", "n", F.col("c").alias("k"))
    order = spark.sparkContext.broadcast(_order(scan))

    # n-grams of at least two classes, found between neighbours of a range sort: a common n-gram lies over many tasks
    found = shared_seeds(_tokens(rows, order, num, den)).select(
        F.col("h").alias("tok"), F.col("t").alias("k"), F.col("lo").alias("at"), F.col("n").alias("m"))
    found = materialize(found, "jaccard-found")
    reps = materialize(members.filter("n > 0").groupBy("k").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "jaccard-classes")
    # one short row per class with a shared n-gram: sent to the n-grams while they are few, else they meet by a shuffle
    about = found.groupBy("k").agg(F.sum("m").alias("s")).join(reps.select("k", "n"), "k")
    ends = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    about = materialize(about.select("k", "n", (F.col("s") / ends).alias("central")), "jaccard-about")
    shared = materialize(found.select("tok", "k", "at").join(bounded_broadcast(about, FEW), "k"), "jaccard-shared")
    discard(found)

    fits = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    band = F.floor(F.log("n") / math.log(den / num)).alias("band")
    links, open_ = None, shared.withColumn("comp", F.col("k"))
    for r in range(HUB_ROUNDS):
        grouped = open_.withColumn("band", band)
        first = F.xxhash64("k", F.pmod("tok", F.lit(2)), F.lit(r)) if r else -F.col("central")
        pick = F.struct(first.alias("h"), F.col("k").alias("b"))
        hubs = grouped.groupBy("tok", "band").agg(F.min(pick).alias("hub")).select("tok", "band", "hub.b")
        whose = about.select(F.col("k").alias("b"), F.col("n").alias("nb"))
        if r:
            named_b = bounded_broadcast(comp, FEW).select(F.col("node").alias("nb_"), F.col("component"))
            hubs = hubs.join(named_b, F.col("b") == F.col("nb_"), "left").select("tok", "band", "b", F.coalesce("component", "b").alias("cb"))
        else:
            hubs = hubs.withColumn("cb", F.col("b"))
        hubs = hubs.join(bounded_broadcast(whose, FEW), "b")
        pairs = grouped.join(hubs, ["tok", "band"]).select(F.col("k").alias("a"), "b", F.col("n").alias("na"), "nb", "comp", "cb")
        pairs = pairs.filter("a != b and comp != cb").filter(fits).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("hits"))
        # these rounds only shorten the last one: each class tries its likeliest hubs
        best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("hits"), "b"))
        pairs = pairs.filter(F.col("hits") * 50 >= F.least("na", "nb")).withColumn("r", best).filter(F.col("r") <= HUBS)
        new = _linked(pairs.drop("r", "hits"), rows, order, reps, num, den)
        links = new if links is None else materialize(links.union(new), "jaccard-links")
        comp = materialize(components(links), "jaccard-comp")
        named = shared.drop("central")
        named = named.join(bounded_broadcast(comp, FEW), F.col("k") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "k")).drop("node", "component")
        named = materialize(named, "jaccard-named")
        mixed = named.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("tok")
        open_ = materialize(named.join(mixed, "tok", "left_semi"), "jaccard-open")
        discard(named)
    # (num + den) * overlap >= num * (na + nb) is the threshold; the first shared n-gram has the whole overlap at or behind it
    x = open_.filter(f"(n - at) * {num + den} >= 2 * n * {num}").select(
        "tok", F.col("k").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("comp").alias("ca"))
    y = open_.select("tok", F.col("k").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("comp").alias("cb"))
    behind = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * (num + den) >= (F.col("na") + F.col("nb")) * num
    rest = x.join(y, "tok").filter("ca != cb and (na < nb or na = nb and a < b)").filter(fits).filter(behind)
    rest = rest.select("a", "b", "na", "nb").distinct()
    links = materialize(links.union(_linked(rest, rows, order, reps, num, den)), "jaccard-links")
    comp = components(links)
    discard(shared, open_, reps, about)
    return members, links, comp


def groups(docs: DataFrame, text: str = "text", num: int = 3, den: int = 4) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: the smallest id reachable by links of Jaccard ``num / den`` or more."""
    members, _, comp = join_classes(docs, text, num, den)
    comp = materialize(comp, "jaccard-components")
    m = members.join(comp, members["k"] == comp["node"], "left").withColumn("g", F.coalesce("component", "k"))
    lows = m.filter("n > 0").groupBy(F.col("g").alias("low_g")).agg(F.min("doc_id").alias("low"))
    out = m.join(lows, m["g"] == lows["low_g"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each group: smallest id (null last), then smallest text digest; rows without words stay as they are.

    Rows of one id and one text are alike to the join; of these the smallest row stays.
    """
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                   F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("text"))
    rows = docs.filter(worded)
    found = groups(rows.select(key.alias("doc_id"), text), text)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_key")).distinct()
    # grouped first: copies of one row are merged before they meet in one task
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.lit(0).alias("_")))  # any type has an order as text
    rows = rows.groupBy(key.alias("_key")).agg(F.min_by(every, rest).alias("_row"))
    return rows.join(kept, "_key", "left_semi").select("_row.*").unionByName(docs.filter(~worded))
