"""Quality classifier: ordinal cumulative-link regression on hashed text.

One weight vector over hashed features is shared by all grades; ordered thresholds
``t_1 < t_2 < ...`` cut the score into grades: ``P(grade >= k) = sigmoid(w.x - t_k)``. The
expected grade is the sum of the tail probabilities; a document is selected when the
tail probability of the grade wanted reaches a threshold.

Features of a whole text: its distinct lower-cased words, and ranges of its shares of
symbols, capitals, digits and repeated words, each hashed to one of ``2**BITS`` weights.

The model is fitted on the driver on at most ``max_labels`` rated rows (the smallest
id hashes; a documented bound, every other step covers all rows) and sent to the tasks;
its size is fixed by ``BITS``.

Edge cases: null texts are empty; labels that are null or of unknown documents are not
used; of several ratings of one id the lowest grade counts, of several texts the one of the smallest sha256 (ties are equal); without two grades in the sample no document can be told from another and all are
kept with the only grade known (or 0); repeated rows and ids are all scored; an empty table
gives an empty result; extra columns pass through ``keep``.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, MAX_LABELS, STEPS, RATE, L2, KEEP = 18, 10_000, 150, 0.05, 1e-3, 0.5
WORD = re.compile(r"[^\W\d_]+")
SYMBOL = re.compile(r"[^\w\s.,;:'\"()-]+")
_known: dict[str, int] = {}
MAX_KNOWN = 50_000
PIECE = 1_024  # texts that a task holds as Python strings at a time


def _bucket(word: str) -> int:
    b = _known.get(word)
    if b is None:
        if len(_known) > MAX_KNOWN:
            _known.clear()
        b = _known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
    return b


def _pieces(batches):
    """The batches in slices of ``PIECE`` rows: a worker keeps the memory it once took, also for the stages that follow."""
    for batch in batches:
        for a in range(0, batch.num_rows, PIECE):
            yield batch.slice(a, PIECE)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    text = text or ""
    found = WORD.findall(text)
    n, words = len(found), {w.lower() for w in found}
    capital = sum(1 for w in found if len(w) > 1 and w.isupper())
    shares = (len(SYMBOL.findall(text)) / (n or 1), capital / (n or 1), len(words) / (n or 1),
              sum(map(len, found)) / (len(text) or 1), n / (text.count("\n") + 1) / 200)
    style = [f"#{i}:{min(int(s * 20), 20)}" for i, s in enumerate(shares)] + [f"#n:{n.bit_length()}", f"#d:{len(words).bit_length()}:{n.bit_length()}"]
    return np.unique(np.fromiter((_bucket(w) for w in [*words, *style]), np.int32))


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, floor: int = 0):
        self.weights, self.thresholds, self.floor = weights, thresholds, floor

    def tails(self, score: np.ndarray) -> np.ndarray:
        """``P(grade >= k)`` for k = floor + 1, ...: one column per threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -30, 30)))

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, steps: int = STEPS, rate: float = RATE, l2: float = L2) -> "OrdinalModel":
        """Maximum likelihood by Adam on all rows; threshold gaps stay positive as exponentials."""
        size = 1 << BITS
        if not len(rows):
            return cls(np.zeros(size), np.zeros(0))
        low, levels = int(grades.min()), int(grades.max() - grades.min())
        if not levels:
            return cls(np.zeros(size), np.zeros(0), low)
        y = np.asarray(grades) - low
        col = np.concatenate(rows)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        share = np.clip([(y >= k + 1).mean() for k in range(levels)], 1e-3, 1 - 1e-3)
        start = -np.log(share / (1 - share))
        theta = np.concatenate((np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        n, at = len(rows), np.arange(len(rows))
        for step in range(1, steps + 1):
            cut = theta[size] + np.concatenate(([0.0], np.cumsum(np.exp(theta[size + 1:]))))
            score = np.bincount(row, weights=theta[col], minlength=n)
            edge = 1 / (1 + np.exp(-np.clip(score[:, None] - cut[None, :], -30, 30)))
            upper = np.concatenate((np.ones((n, 1)), edge), axis=1)  # P(grade >= k)
            lower = np.concatenate((edge, np.zeros((n, 1))), axis=1)  # P(grade >= k + 1)
            p = np.maximum(upper[at, y] - lower[at, y], 1e-12)
            d_up, d_low = upper[at, y] * (1 - upper[at, y]) / p, lower[at, y] * (1 - lower[at, y]) / p
            d_score = (d_up - d_low) / n
            grad = np.zeros_like(theta)
            grad[:size] = np.bincount(col, weights=d_score[row], minlength=size) - l2 * theta[:size]
            d_cut = np.zeros(levels)
            np.add.at(d_cut, y[y > 0] - 1, -d_up[y > 0] / n)
            np.add.at(d_cut, y[y < levels], d_low[y < levels] / n)
            grad[size] = d_cut.sum()
            for j in range(1, levels):
                grad[size + j] = d_cut[j:].sum() * np.exp(theta[size + j])
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            theta = theta + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
        cut = theta[size] + np.concatenate(([0.0], np.cumsum(np.exp(theta[size + 1:]))))
        return cls(theta[:size], cut, low)


def default_grade() -> Column:
    """Rating of ``labels``: 0 toxic, 1 of low quality, 2 good."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)


def train(docs: DataFrame, labels: DataFrame, grade: Column | None = None, text: str = "text",
          max_labels: int = MAX_LABELS) -> OrdinalModel:
    """Fit on at most ``max_labels`` rated documents."""
    g = default_grade() if grade is None else grade
    rated = labels.select(F.col("doc_id").alias("_id"), g.cast("int").alias("_grade")).filter("_grade is not null and _id is not null")
    rated = rated.groupBy("_id").agg(F.min("_grade").alias("_grade")).orderBy(F.xxhash64("_id", F.lit(42)), "_id").limit(max_labels)
    # at most max_labels rows of two numbers
    rows = docs.select(docs["doc_id"], docs[text]).join(F.broadcast(rated), F.col("doc_id") == F.col("_id")).select(
        "_id", "_grade", F.col(text), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))

    def batches(it):
        for batch in _pieces(it):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([features(x) for x in batch.column(2).to_pylist()], pa.list_(pa.int32())),
                 batch.column(3)], names=["id", "grade", "f", "sha"])
        _known.clear()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(batches, f"id {id_type}, grade int, f array<int>, sha string")
    found = found.groupBy("id").agg(F.min("grade").alias("grade"), F.min_by("f", "sha").alias("f")).orderBy("id").toArrow()
    return OrdinalModel.fit([np.array(x, np.int32) for x in found.column("f").to_pylist()], found.column("grade").to_numpy())


def score(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tails`` (``P(grade >= k)`` from the second grade up)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds, model.floor))
    rows = docs.drop("expected_grade", "tails")
    at = rows.columns.index(text)

    def batches(it):
        m = OrdinalModel(*sent.value)
        for batch in _pieces(it):
            s = np.array([float(m.weights[features(x)].sum(dtype=np.float64)) for x in batch.column(at).to_pylist()])
            p = m.tails(s.reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(m.floor + p.sum(axis=1)), pa.array(list(p), pa.list_(pa.float64()))],
                names=[*batch.schema.names, "expected_grade", "tails"])
        _known.clear()

    from pyspark.sql.types import ArrayType, DoubleType, StructType
    schema = StructType(list(rows.schema.fields)).add("expected_grade", DoubleType()).add("tails", ArrayType(DoubleType()))
    return rows.mapInArrow(batches, schema)


def selected(threshold: float = KEEP) -> Column:
    """Whether the top grade's tail probability reaches ``threshold`` (all, if there is but one grade)."""
    return F.coalesce(F.try_element_at("tails", F.lit(-1)) >= threshold, F.lit(True))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = KEEP) -> DataFrame:
    """The documents that the classifier selects, columns as they are, whatever their names."""
    m = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((m.weights.astype(np.float32), m.thresholds, m.floor))
    at = docs.columns.index("text")

    def batches(it):
        m = OrdinalModel(*sent.value)
        for batch in _pieces(it):
            if len(m.thresholds):
                s = np.array([float(m.weights[features(x)].sum(dtype=np.float64)) for x in batch.column(at).to_pylist()])
                batch = batch.filter(pa.array(m.tails(s.reshape(-1))[:, -1] >= threshold))
            yield batch
        _known.clear()

    return docs.mapInArrow(batches, docs.schema)


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = KEEP) -> DataFrame:
    """``doc_id, expected_grade, p_top, kept`` per row."""
    s = score(docs.select("doc_id", "text"), train(docs, labels))
    return s.select("doc_id", "expected_grade", F.try_element_at("tails", F.lit(-1)).alias("p_top"), selected(threshold).alias("kept"))
