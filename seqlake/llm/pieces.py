"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi pass.

The pieces and scores of a SentencePiece model file are read as a unigram
lexicon: the encoding of a text is the segmentation with the highest sum of
scores. The automaton walks a span once; at each position its output links give
all pieces that end there (longest first), and each relaxes the best score at
that position. Ties keep the longer last piece. A character that is no piece
costs ``UNKNOWN_PENALTY`` below the lowest score and becomes its byte pieces.

Normalisation is the model's: identity, spaces become U+2581, one of them goes in
front of a non-empty text, none are dropped. Pieces hold U+2581 only at their
start (checked on load), so the best segmentation of a text is that of its spans (a
run of spaces and what follows), and spans also end at characters that occur in
no longer piece. Each worker segments a distinct span once.

Decoding joins the pieces' bytes and drops the space in front.

Edge cases: a null or empty text has no ids and decodes to the empty text; U+2581 in a
text is a space to the model and decodes to one; equal rows are all kept; very long
texts are runs of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from seqlake.llm import wordhash
from seqlake.llm.spancache import SpanCache, ragged, row_counts

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_models: dict[str, "PieceModel"] = {}


class PieceModel:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.automaton = ahocorasick.Automaton()
        self.byte_ids = [-1] * 256
        decoded: list[bytes] = []
        joined, lowest, self.single = set(), math.inf, set()
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                decoded.append(bytes([value]))
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                decoded.append(b"")
                continue
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} holds a space after its start: spans would not be independent")
            score = sp.get_score(i)
            lowest = min(lowest, score)
            self.automaton.add_word(piece, (len(piece), score, i))
            (joined.update if len(piece) > 1 else self.single.update)(piece)
            decoded.append(piece.replace(SPACE, " ").encode())
        self.automaton.make_automaton()
        self.unknown = lowest - UNKNOWN_PENALTY
        self.apart = np.zeros(256, dtype=bool)  # ASCII characters of no longer piece: spans of their own
        for b in range(128):
            self.apart[b] = chr(b) not in joined and chr(b) != " "
        size = np.array([len(d) for d in decoded], dtype=np.int64)
        self.decoded_at, self.decoded_size = np.cumsum(size) - size, size
        self.decoded = np.frombuffer(b"".join(decoded), dtype=np.uint8)
        self.cache = SpanCache(lambda spans: [self.segment(s.replace(" ", SPACE)) for s in spans], np.int32)

    def segment(self, span: str) -> list[int]:
        """Best segmentation of one normalised span (spaces already U+2581)."""
        n = len(span)
        best = [-math.inf] * (n + 1)
        best[0] = 0.0
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        done = 0  # positions up to here are final
        single, unknown = self.single, self.unknown
        for last, (size, score, piece) in self.automaton.iter(span):
            end = last + 1
            while done < end - 1:  # characters at whose end no piece stops
                done += 1
                if span[done - 1] not in single and best[done - 1] + unknown > best[done]:
                    best[done], back[done] = best[done - 1] + unknown, (done - 1, -1)
            if end > done:
                done = end
                if span[last] not in single and best[last] + unknown > best[end]:
                    best[end], back[end] = best[last] + unknown, (last, -1)
            total = best[end - size] + score
            if total > best[end] or total == best[end] and back[end][1] == -1:
                best[end], back[end] = total, (end - size, piece)
        while done < n:
            done += 1
            if span[done - 1] not in single and best[done - 1] + unknown > best[done]:
                best[done], back[done] = best[done - 1] + unknown, (done - 1, -1)
        ids: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend(self.byte_ids[b] for b in reversed(span[start:at].encode()))
            at = start
        return ids[::-1]

    def _spans(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        space, apart = data == 32, self.apart[data]
        first = np.zeros(n + 1, dtype=bool)
        first[off] = True
        begin = first[:n] | apart
        begin[1:] |= (space[1:] & ~space[:-1]) | apart[:-1]
        starts = np.flatnonzero(begin)
        return starts, np.append(starts[1:], n)

    def encode(self, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Yield ``(first row, last row + 1, ids, ids per row, rows that decode to themselves)``."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        marked = pc.match_substring(column, SPACE).to_numpy(zero_copy_only=False)  # this sign decodes to a space
        column = pc.replace_substring(column, pattern=SPACE, replacement=" ")
        space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        column = pc.if_else(pc.equal(column, none), none, pc.binary_join_element_wise(space, column, none))
        for a, b, data, off in wordhash.runs(column):
            starts, ends = self._spans(data, off)
            ids, per_span = self.cache.ids(wordhash.span_hashes(data, starts, ends), data, starts, ends)
            count = row_counts(per_span, np.searchsorted(starts, off))
            out, _ = self.decode_bytes(ids)
            same = len(out) == len(data) and bool((out == data).all())
            yield a, b, ids, count, (np.full(b - a, same) if same else self._same(ids, count, data, off)) & ~marked[a:b]

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(bytes of all ids in order, bytes per id)``, the space in front included."""
        size = self.decoded_size[ids]
        return self.decoded[ragged(self.decoded_at[ids], size)], size

    def _same(self, ids, count, data, off) -> np.ndarray:
        at = np.concatenate(([0], np.cumsum(count)))
        return np.array([np.array_equal(self.decode_bytes(ids[at[i]:at[i + 1]])[0], data[off[i]:off[i + 1]])
                         for i in range(len(count))], dtype=bool)

    def decode(self, ids) -> str:
        """Text of one id sequence."""
        text = self.decode_bytes(np.asarray(ids, dtype=np.int64))[0].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, roundtrip`` per row: the ids, and whether they decode to the text."""

    def batches(it):
        m = model(model_path)
        for batch in it:
            for a, b, ids, count, same in m.encode(batch.column(1)):
                at = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(count),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int32))), pa.array(same)],
                    names=["doc_id", "n_tokens", "ids", "roundtrip"])

    rows = docs.select(docs["doc_id"], docs[text])
    return rows.mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
                                    "n_tokens long, ids array<int>, roundtrip boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids`` (null ids: the empty text)."""

    def batches(it):
        m = model(model_path)
        for batch in it:
            texts = [m.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(batches, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
