"""SimHash document fingerprints (DataFrame functions only).

Terms are pairs of neighbouring lower-cased words (a lone word is a pair with nothing).
A term's 64-bit hash votes +1 or -1 per bit with its weight, the number of times it
occurs; a fingerprint bit is set where the votes are positive. Three bits share a
long (21 bits each), so one text needs 22 running sums. All words of a text are exploded
where they are read and their sums combined map-side: a text leaves its task as one row.

``near_pairs`` finds all fingerprints within a Hamming radius: the 64 bits are cut into
blocks, every choice of ``blocks - radius`` of them is one permuted table, and two
fingerprints within the radius agree on all bits of at least one choice.

Edge cases: null texts are empty; texts without words have the fingerprint of zeros; texts
of up to ``LANE_MASK`` terms (two million) are counted in one go and longer ones in
parts of that size; repeated rows and ids each keep their own row; null ids come last in
descending order; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.operators.ids import dense_index
from seqlake.session import materialize

LANE_BITS, LANES = 21, 3
LANE_MASK = (1 << LANE_BITS) - 1
SUMS = -(-64 // LANES)
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEX_ONES = {f"{v:x}": bin(v).count("1") for v in range(16)}


def terms(text: Column) -> Column:
    """Array of ``(word, next word)``; empty without words."""
    t = F.btrim(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(SPACES))
    words = F.split(t, "[ \\t-\\r]+")
    pairs = F.arrays_zip(words.alias("w"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("x"))
    return F.when(t != "", pairs)


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, fingerprint`` (16 hex digits); ``keys`` tell the rows apart."""
    t = texts.select(*keys, F.posexplode_outer(terms(F.col(text))).alias("_at", "_t"))
    t = t.select(*keys, F.shiftright(F.col("_at"), LANE_BITS - 1).alias("_part"),
                 F.when(F.col("_t").isNotNull(), F.xxhash64("_t")).alias("_h"))
    def lane(j: int) -> Column:
        v = None
        for k in range(LANES):
            bit = LANES * j + k
            if bit < 64:
                b = F.shiftleft(F.shiftrightunsigned(F.col("_h"), bit).bitwiseAND(F.lit(1)), LANE_BITS * k)
                v = b if v is None else v.bitwiseOR(b)
        return F.sum(v).alias(f"_s{j}")

    # a part has at most 2**20 terms, so no lane of a part's sums runs over
    parts = t.groupBy(*keys, "_part").agg(F.count("_h").alias("_n"), *[lane(j) for j in range(SUMS)])
    ones = {bit: F.shiftright(F.col(f"_s{bit // LANES}"), LANE_BITS * (bit % LANES)).bitwiseAND(F.lit(LANE_MASK))
            for bit in range(64)}
    votes = parts.groupBy(*keys).agg(F.sum("_n").alias("_n"), *[F.sum(ones[b]).alias(f"_v{b}") for b in range(64)])
    digits = []
    for d in range(15, -1, -1):
        value = F.lit(0)
        for k in range(4):
            value = value + F.when(F.col(f"_v{4 * d + k}") * 2 > F.col("_n"), 1 << k).otherwise(0)
        digits.append(F.lower(F.hex(value)))
    return votes.select(*keys, F.concat(*digits).alias("fingerprint"))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    def half(c: Column, at: int) -> Column:
        return F.conv(F.substring(c, at, 8), 16, 10).cast("long")

    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return (F.lit(64) - distance(a, b)) / F.lit(64.0)


def near_pairs(fps: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """``query, fingerprint, distance``: for every distinct query all distinct fingerprints within ``radius`` bits.

    Both frames have the column ``fingerprint``. Blocks are runs of bits; one table per choice of
    ``blocks - radius`` blocks, whose bits are hashed to one key.
    """
    if not 0 < radius < blocks <= 16:
        raise ValueError("need 0 < radius < blocks <= 16")
    bits = F.concat(*[F.lpad(F.conv(F.substring("fingerprint", i, 1), 16, 2), 4, "0") for i in range(1, 17)])
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        df = df.select("fingerprint").filter("fingerprint is not null").distinct().withColumn("_bits", bits)
        keys = [F.xxhash64(F.lit(t), *[F.substring("_bits", edge[i] + 1, edge[i + 1] - edge[i]) for i in chosen])
                for t, chosen in enumerate(combinations(range(blocks), blocks - radius))]
        return df.select(F.col("fingerprint").alias(name), F.explode(F.array(*keys)).alias("_key"))

    hit = keyed(queries, "query").join(keyed(fps, "fingerprint"), "_key").select("query", "fingerprint")
    hit = hit.withColumn("distance", distance(F.col("query"), F.col("fingerprint")))
    return hit.filter(F.col("distance") <= radius).distinct()


def edited(text: Column, other: Column) -> Column:
    """The last ``floor(n / 2)`` code points replaced by the first as many (or all) of ``other``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def in_order(docs: DataFrame, text: str = "text") -> DataFrame:
    """``h1, h2, doc_id, n, m, p, b1, b2, half``: the distinct rows in descending id, without their texts.

    ``h1, h2`` tell rows of other id or text apart, ``n`` is the length in code points, ``m`` how often the row
    occurs and ``p`` its place from 0. ``b1, b2`` name the row before (the first's is the last), which takes the first
    ``half`` code points. The order is a range sort of these short rows.
    """
    keys = _row_keys(docs, text)
    rows = keys.groupBy("h1", "h2").agg(F.first("doc_id").alias("doc_id"), F.first(F.char_length("text")).cast("long").alias("n"),
                                        F.count(F.lit(1)).alias("m"))
    rows = dense_index(rows, order_by=[F.col("doc_id").desc_nulls_last(), F.col("h1"), F.col("h2")], col="p", start=0)
    rows = materialize(rows, "simhash-order")
    size = rows.count()
    before = rows.select(F.pmod(F.col("p") + 1, F.lit(max(size, 1))).alias("p"), F.col("h1").alias("b1"), F.col("h2").alias("b2"),
                         F.floor(F.col("n") / 2).cast("int").alias("half"))
    return materialize(rows.join(before, "p"), "simhash-order")


def _row_keys(docs: DataFrame, text: str) -> DataFrame:
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64("text", F.lit(7), "doc_id").alias("h2"))


def _asked() -> Column:
    return F.col("doc_id").cast("string").try_cast("long") % 100 == 0


def fingerprint_report(docs: DataFrame, text: str = "text", radius: int = 3) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses.

    Each distinct row's text moves once, to its key; a row sends on to the row before only the part of
    its text that replaces the other's end. Equal rows follow each other, so all but the last of
    them are edited with their own text. ``n_near`` counts the other fingerprints within ``radius`` bits, for the ids divisible by 100.
    """
    order = in_order(docs, text)
    own = _row_keys(docs, text).groupBy("h1", "h2").agg(F.first("text").alias("text"))
    own = own.join(order.select("h1", "h2", "m", "b1", "b2", "half"), ["h1", "h2"])
    lent = own.select(F.col("b1").alias("h1"), F.col("b2").alias("h2"), F.substring("text", F.lit(1), F.col("half")).alias("lent"))
    both = own.select("h1", "h2", "m", "text").join(lent, ["h1", "h2"])

    def changed(kind: int, other: Column) -> Column:
        t = edited(F.col("text"), other)
        return F.struct(F.lit(kind).alias("kind"), t.alias("t"), F.sha2(t.cast("binary"), 256).alias("sha"))

    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t"), F.lit(None).cast("string").alias("sha")), changed(1, F.col("lent")))
    kinds = F.when(F.col("m") > 1, F.concat(kinds, F.array(changed(2, F.col("text"))))).otherwise(kinds)
    each = both.select("h1", "h2", F.explode(kinds).alias("e")).select("h1", "h2", "e.kind", "e.sha", F.col("e.t").alias("text"))
    prints = materialize(fingerprints(each, ["h1", "h2", "kind", "sha"]), "simhash-prints")
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    wide = prints.groupBy("h1", "h2").agg(of(0, "fingerprint").alias("fingerprint"), *[
        of(k, c).alias(f"{c}{k}") for k in (1, 2) for c in ("fingerprint", "sha")])
    rows = order.select("h1", "h2", "doc_id", "n", "m", "b1", "b2").join(wide, ["h1", "h2"])
    following = rows.select(F.col("b1").alias("h1"), F.col("b2").alias("h2"), F.col("fingerprint").alias("next_fingerprint"))
    rows = rows.join(following, ["h1", "h2"]).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    last = F.col("i") == F.col("m")
    pick = lambda c: F.when(last, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    out = rows.select("doc_id", F.col("n").alias("n_chars"), pick("sha").alias("edited_sha256"), "fingerprint",
                      pick("fingerprint").alias("edited_fingerprint"), F.when(last, F.col("next_fingerprint")).otherwise(F.col("fingerprint")).alias("next"))
    base = prints.filter("kind = 0")
    asked = order.filter(_asked()).join(base, ["h1", "h2"]).select("fingerprint")
    near = near_pairs(base, asked, radius).filter("query <> fingerprint").groupBy("query").agg(F.count(F.lit(1)).alias("found"))
    out = out.join(near, out["fingerprint"] == near["query"], "left")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                      likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
                      F.when(_asked(), F.coalesce("found", F.lit(0))).cast("long").alias("n_near"))
