"""Personal data: pattern spans, and terms that give protected entities away by co-occurrence.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Every distinct base
value is a protected entity. All words (letters and digits, two or more) of a text outside its
base spans are terms. Over the distinct texts of the whole corpus, a term discloses an entity when observing it leaves
little doubt: ``PMI(term, entity) >= THRESHOLD * IC(entity)``, where IC is ``-log2`` of the share of texts with
the entity and PMI the log ratio of their joint share to the product of shares. The
term's count is smoothed by ``PRIOR / both``, where ``both`` counts the texts with term and entity: one joint text is weak evidence, several
are strong. So an entity of a single text is disclosed by that text's words that (nearly) no other text has, once
the corpus is large enough to make that telling; a common word never discloses.
Every occurrence of a disclosing term in a text that holds its entity becomes a span of the kind ``term``.

Each distinct text is stored once, compressed; all counts are of these. An entity of one text has
``both = 1``, so its terms follow from their counts alone, and each rare term brings the few
texts that hold it. Joint counts are taken only for entities of several texts, summed per task before they
are shuffled by entity and term, so a very common entity is spread over its terms.

``sanitise`` generalises base spans to their kind (``[EMAIL]`` ...) and removes disclosing terms
(``[TERM]``).

Edge cases: null and empty texts have no spans; texts are scanned whole; repeated texts count
once; repeated rows and ids are kept; an empty table gives an empty result;
extra columns, of any name and type, are ignored by ``report`` and kept by ``sanitise``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.session import materialize, short_batches

THRESHOLD, PRIOR = 0.9, 1.0
PAIRS = 1 << 20  # entity-term pairs that a task holds at a time
WORDS = 100_000  # distinct words that a task counts before it sends them on
KINDS = ["email", "ip", "card", "phone", "term"]
# fixed values: the patterns of the contract
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]{2,}")
_DIGITS = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        v = int(ch) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str):
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind index, start, end)`` by kind, then start; code points, end exclusive."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def _union(found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The spans merged into disjoint ones, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _terms(text: str, taken: list[tuple[int, int]]):
    """All words of ``text``, none inside a base span: ``(term, start, end)``."""
    for m in WORD.finditer(text):
        i = bisect_left(taken, (m.end(),)) - 1  # the last span that starts before the word ends
        if i < 0 or taken[i][1] <= m.start():
            yield m.group().casefold(), m.start(), m.end()


def _key(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _text_key(column):
    return F.unhex(F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256))


SPANS = "array<struct<k:int,s:int,e:int>>"


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``txt, t, z, base, entities``: each distinct text once, compressed, with its base spans and the distinct entities in them.

    ``txt`` is the sha256 of the text and ``t`` its first 8 bytes.
    """
    rows = docs.select(_text_key(docs[text]), docs[text])
    span = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])

    def batches(it):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in it:
            spans, entities, z = [], [], []
            for x in batch.column(1).to_pylist():
                x = x or ""
                found = base_spans(x)
                spans.append([{"k": k, "s": a, "e": b} for k, a, b in found])
                entities.append(list({_key(f"{k}:{x[a:b]}") for k, a, b in found}))
                z.append(squeeze.compress(x.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(z, pa.binary()), pa.array(spans, pa.list_(span)), pa.array(entities, pa.list_(pa.int64()))],
                names=["txt", "z", "base", "entities"])

    found = rows.mapInArrow(batches, f"txt binary, z binary, base {SPANS}, entities array<long>")
    found = found.groupBy("txt").agg(F.first(F.struct("z", "base", "entities")).alias("x"))  # copies merge before they move
    head = F.conv(F.hex(F.substring("txt", 1, 8)), 16, -10).cast("long")
    with short_batches(docs.sparkSession):
        return materialize(found.select("txt", head.alias("t"), "x.*"), "pii-texts")


def _plain(z: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(z).decode("utf-8", "surrogatepass")


def _term_counts(texts: DataFrame, bound: int) -> DataFrame:
    """``term, df, holders``: in how many texts a term occurs, and of terms in at most ``bound`` texts those with an entity."""

    def batches(it):
        count: dict[str, int] = {}
        holders: dict[str, list[int]] = {}

        def flush():
            words = list(count)
            held = [holders.get(w, []) if count[w] <= bound else [] for w in words]
            out = pa.RecordBatch.from_arrays([pa.array([_key(w) for w in words], pa.int64()), pa.array(list(count.values()), pa.int64()),
                                              pa.array(held, pa.list_(pa.int64()))], names=["term", "df", "holders"])
            count.clear(), holders.clear()
            return out

        for batch in it:
            for z, t, some in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = _plain(z)
                words = {w for w, _, _ in _terms(x, _union(base_spans(x)))} if some else {m.casefold() for m in WORD.findall(x)}
                for w in words:
                    count[w] = count.get(w, 0) + 1
                if some:
                    for w in words:
                        if count[w] <= bound:
                            holders.setdefault(w, []).append(t)
                if len(count) > WORDS:
                    yield flush()
        yield flush()

    rows = texts.select("z", "t", F.size("entities") > 0).mapInArrow(batches, "term long, df long, holders array<long>")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.flatten(F.collect_list(F.when(F.size("holders") > 0, F.col("holders")))).alias("holders"))


def _pairs(held: DataFrame, counted: bool) -> DataFrame:
    """Pairs of the entities and terms of each text ``z, t, entities``: ``entity, term, both`` summed per task, or ``entity, term, t``."""
    last = "both" if counted else "t"

    def out(es, ts, xs):
        cols = {"entity": np.concatenate(es), "term": np.concatenate(ts)}
        if not counted:
            return pa.table({**cols, "t": np.concatenate(xs)}).to_batches()
        got = pa.table(cols).group_by(["entity", "term"]).aggregate([([], "count_all")])
        return got.select(["entity", "term", "count_all"]).rename_columns(["entity", "term", "both"]).combine_chunks().to_batches()

    def batches(it):
        es, ts, xs, n = [], [], [], 0
        for batch in it:
            for z, t, entities in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = _plain(z)
                terms = np.array([_key(w) for w in {w for w, _, _ in _terms(x, _union(base_spans(x)))}], np.int64)
                step = max(1, PAIRS // max(1, len(terms)))
                for i in range(0, len(entities) if len(terms) else 0, step):
                    part = np.array(entities[i:i + step], np.int64)
                    es.append(np.repeat(part, len(terms)))
                    ts.append(np.tile(terms, len(part)))
                    xs.append(np.full(len(es[-1]), t, np.int64))
                    n += len(es[-1])
                    if n >= PAIRS:
                        yield from out(es, ts, xs)
                        es, ts, xs, n = [], [], [], 0
        if n:
            yield from out(es, ts, xs)

    return held.select("z", "t", "entities").mapInArrow(batches, f"entity long, term long, {last} long")


def disclosing(texts: DataFrame, threshold: float = THRESHOLD, prior: float = PRIOR) -> DataFrame:
    """``t, term``: the disclosing terms of each text, from ``texts`` of :func:`distinct_texts`."""
    n = texts.count()
    held = texts.filter(F.size("entities") > 0)
    pairs = held.select("t", F.explode("entities").alias("entity"))
    entity_df = materialize(pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("edf"), F.min("t").alias("t")), "pii-entities")
    # one text: both = 1 and edf = 1, so PMI >= threshold * IC is df + prior <= n ** (1 - threshold)
    bound = max(int(math.floor(n ** (1 - threshold) - prior + 1e-9)), 0) if n else 0
    terms = materialize(_term_counts(texts, bound), "pii-terms")
    rare = terms.filter(F.col("df") <= bound).select(F.explode("holders").alias("t"), "term")
    found = rare.join(entity_df.filter("edf = 1").select("t").distinct(), "t", "left_semi")
    several = entity_df.filter("edf > 1").select("entity", "edf")
    common = pairs.join(several, "entity", "left_semi").groupBy("t").agg(F.collect_set("entity").alias("entities"))
    common = materialize(held.select("t", "z").join(common, "t"), "pii-common")
    joint = _pairs(common, True).groupBy("entity", "term").agg(F.sum("both").alias("both"))
    j = joint.join(several, "entity").join(terms.select("term", "df"), "term")
    pmi = F.log2(F.col("both") * F.lit(float(n)) / (F.col("edf") * (F.col("df") + F.lit(prior) / F.col("both"))))
    ic = -F.log2(F.col("edf") / F.lit(float(max(n, 1))))
    flagged = materialize(j.filter((ic > 0) & (pmi >= threshold * ic)).select("entity", "term"), "pii-flagged")
    more = _pairs(common, False).join(flagged, ["entity", "term"], "left_semi").select("t", "term")
    return found.union(more).distinct()


def term_spans(texts: DataFrame) -> DataFrame:
    """``txt, terms``: the spans of all occurrences of a text's disclosing terms, for texts that have any."""
    with short_batches(texts.sparkSession):  # every step on texts ends inside
        return _term_spans(texts)


def _term_spans(texts: DataFrame) -> DataFrame:
    marked = disclosing(texts).groupBy("t").agg(F.collect_set("term").alias("chosen"))
    marked = texts.filter(F.size("entities") > 0).select("txt", "t", "z").join(marked, "t")
    span = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])

    def batches(it):
        for batch in it:
            out = []
            for z, chosen in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x, chosen = _plain(z), set(chosen)
                known: dict[str, bool] = {}
                spans = []
                for w, a, b in _terms(x, _union(base_spans(x))):
                    if w not in known:
                        known[w] = _key(w) in chosen
                    if known[w]:
                        spans.append({"k": 4, "s": a, "e": b})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], names=["txt", "terms"])

    return materialize(marked.select("txt", "z", "chosen").mapInArrow(batches, f"txt binary, terms {SPANS}"), "pii-spans")


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, txt, base, terms`` per row: base spans and the spans of disclosing terms."""
    texts = distinct_texts(docs, text)
    some = texts.filter(F.size("base") > 0).select("txt", "base").join(term_spans(texts), "txt", "left")
    rows = docs.select(docs["doc_id"], _text_key(docs[text]).alias("txt"))
    none = F.array().cast(SPANS)
    return rows.join(some, "txt", "left").select("doc_id", "txt", F.coalesce("base", none).alias("base"), F.coalesce("terms", none).alias("terms"))


def report(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts per kind, digest of the base spans and the list of all spans per document."""
    found = spans(docs, text)
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(c):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"),
                                                                 x["e"].cast("string"))), ",")

    def n(k):
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    return found.select("doc_id", n(0).alias("n_email"), n(1).alias("n_ip"), n(2).alias("n_card"), n(3).alias("n_phone"),
                        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        listed(F.concat("base", "terms")).alias("spans"))


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span generalised (base kinds) or removed (terms); ``n_chars`` follows the new text.

    Documents that hold disclosing terms meet them by the digest of their text; the patterns
    are found again in the text at hand. Overlapping spans become one, named by the first.
    """
    extra = term_spans(distinct_texts(docs, text)).filter(F.size("terms") > 0)
    at = docs.columns.index(text)
    # the row travels as one struct, so no name of it can clash with ours
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("r"), _text_key(docs[text]).alias("txt"))
    joined = rows.join(extra, "txt", "left").select("r", "terms")

    def batches(it):
        for batch in it:
            row = batch.column(0)
            new = [None if x is None else _rewrite(x, found) for x, found in zip(row.field(at).to_pylist(), batch.column(1).to_pylist())]
            fields = [pa.array(new, row.type.field(i).type) if i == at else row.field(i) for i in range(row.type.num_fields)]
            yield pa.RecordBatch.from_arrays(fields, names=[row.type.field(i).name for i in range(row.type.num_fields)])

    out = joined.mapInArrow(batches, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _rewrite(x: str, found) -> str:
    cuts = [(a, b, KINDS[k]) for k, a, b in base_spans(x)]
    if found:
        cuts += [(t["s"], t["e"], "term") for t in found]
    if not cuts:
        return x
    out, at = [], 0
    for a, b, kind in sorted(cuts):
        if a >= at:
            out += [x[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + x[at:]
