"""Token ids in Arrow files of equal-length sequences, and reading them back.

Documents are range-partitioned and sorted by id; each task encodes its slice
and writes two Arrow IPC files (the stream format with a footer for random access):

* ``tokens-*.arrow``: record batches of ``ids: FixedSizeList[length]`` and
  ``mask: FixedSizeList[length] of bool`` (false marks the padding of the shard's last
  sequence). A memory-mapped sequence is a view, nothing is copied.
  Ids take 16 bits if the vocabulary allows, else 32.
* ``docs-*.arrow``: ``doc_id``, ``start`` (in the shard's ids) and ``n_tokens``.

A file's name holds the task attempt; the manifest, a Parquet table written by
the same tasks, lists the files of the attempts that Spark kept, so a lost
executor only repeats its tasks. Files go to the shared checkpoint folder
(or a given one) through ``pyarrow.fs``.

The tokenizer's words never span the bytes ``\\x20 \\x09-\\x0D`` (its pattern drops
white space), so each distinct word of a worker is encoded once.

Edge cases: null text counts as empty and yields the end id alone; null ids sort
first; rows with equal ids are ordered by text; empty tables give no files and
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm import wordhash
from seqlake.llm.spancache import SpanCache, row_counts
from seqlake.session import ensure_checkpoint_dir, materialize

SEQUENCE_LENGTH = 2048
SEQUENCES_PER_BATCH = 64
END_ID = 1
MANIFEST = "shard int, tokens string, docs string, n_docs long, n_tokens long"
_coders: dict[str, "WordCoder"] = {}


class WordCoder:
    """Ids of whole words by a Hugging Face tokenizer file."""

    SEPARATOR = "<|startoftext|>"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.separator = self.tokenizer.token_to_id(self.SEPARATOR)
        self.cache = SpanCache(self._words, self.dtype)

    def _words(self, words: list[str]) -> list[list[int]]:
        if self.separator is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        out: list[list[int]] = [[]] * len(words)
        plain = [i for i, w in enumerate(words) if "<|" not in w]
        for a in range(0, len(plain), 1000):  # one call for many words; the special token marks their edges
            part = plain[a:a + 1000]
            ids = np.asarray(self.tokenizer.encode(f" {self.SEPARATOR} ".join(words[i] for i in part),
                                                   add_special_tokens=False).ids, dtype=np.uint32)
            for i, x in zip(part, np.split(ids, np.flatnonzero(ids == self.separator))):
                out[i] = (x[1:] if len(x) and x[0] == self.separator else x).tolist()
        for i in set(range(len(words))).difference(plain):
            out[i] = self.tokenizer.encode(words[i], add_special_tokens=False).ids
        return out

    def encode(self, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Yield ``(first row, last row + 1, ids, ids per row)`` of a string column."""
        for a, b, data, off in wordhash.runs(column):
            h, bounds, starts, ends = wordhash.words(data, off, lower=False)
            ids, per_word = self.cache.ids(h, data, starts, ends)
            yield a, b, ids, row_counts(per_word, bounds)


def coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def file_system(uri: str):
    """``(pyarrow file system, path)`` of a Hadoop-style URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class _Writer:
    """Collects a shard's ids and writes full batches of sequences."""

    def __init__(self, sink, dtype, length: int):
        self.length, self.dtype = length, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.parts, self.held = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        block = self.length * SEQUENCES_PER_BATCH
        if self.held >= block:
            ids = np.concatenate(self.parts)
            whole = len(ids) // block * block
            for a in range(0, whole, block):
                self._write(ids[a:a + block], block)
            self.parts, self.held = [ids[whole:]], len(ids) - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.out.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.zeros(-(-self.held // self.length) * self.length, self.dtype)
            ids[:self.held] = np.concatenate(self.parts)
            self._write(ids, self.held)
        self.out.close()


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, length: int = SEQUENCE_LENGTH,
          end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Encode and write ``docs``; returns the manifest with each shard's ``offset`` in the whole id stream."""
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)

    def shard(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        k = context.partitionId()
        name = f"{k:06d}-{context.taskAttemptId()}.arrow"
        fs, path = file_system(folder)
        enc, writer, sink = coder(tokenizer_path), None, None
        doc_ids, counts = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                sink = fs.open_output_stream(f"{path}/tokens-{name}")
                writer = _Writer(sink, enc.dtype, length)
            text = batch.column("text")
            for a, b, ids, n in enc.encode(text):
                ends = np.cumsum(n)
                writer.add(np.insert(ids, ends, end_id))  # the end id after each document's ids
                counts.append(n + 1)
            doc_ids.append(batch.column("doc_id"))
        if writer is None:
            return
        writer.close()
        sink.close()
        n = np.concatenate(counts)
        index = pa.table({"doc_id": pa.chunked_array(doc_ids).combine_chunks(), "start": np.cumsum(n) - n, "n_tokens": n})
        with fs.open_output_stream(f"{path}/docs-{name}") as out, pa.ipc.new_file(out, index.schema) as w:
            w.write_table(index)
        yield pa.RecordBatch.from_pylist(
            [{"shard": k, "tokens": f"{folder}/tokens-{name}", "docs": f"{folder}/docs-{name}",
              "n_docs": len(n), "n_tokens": int(n.sum())}],
            schema=pa.schema([("shard", pa.int32()), ("tokens", pa.string()), ("docs", pa.string()),
                              ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    manifest = materialize(rows.mapInArrow(shard, MANIFEST), "token-manifest")
    # one row per shard
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class TokenFile:
    """Random access to the sequences of one file, without copying when the file system can map it."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        from pyarrow import fs as pafs

        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def batch_ids(self, i: int) -> np.ndarray:
        return self.reader.get_batch(i).column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, mask)`` of sequence ``i``."""
        batch, row = divmod(i, SEQUENCES_PER_BATCH)
        ids = self.batch_ids(batch)[row * self.length:(row + 1) * self.length]
        mask = self.reader.get_batch(batch).column(1)[row].values.to_numpy(zero_copy_only=False)
        return ids, mask

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on: a view inside one batch, else a copy of the pieces."""
        block = self.length * SEQUENCES_PER_BATCH
        parts = []
        while n:
            i, at = divmod(start, block)
            part = self.batch_ids(i)[at:at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id, start`` (in the whole stream), ``n_tokens, ids_crc32``."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens = TokenFile(row["tokens"])
                fs, path = file_system(row["docs"])
                with fs.open_input_file(path) as f:
                    index = pa.ipc.open_file(f).read_all()
                start, n = index["start"].to_numpy(), index["n_tokens"].to_numpy()
                crc = np.empty(len(n), np.int64)
                block, at, held, base = tokens.length * SEQUENCES_PER_BATCH, -1, None, 0
                for i, (s, c) in enumerate(zip(start.tolist(), n.tolist())):
                    if s // block != at:
                        at = s // block
                        held, base = tokens.batch_ids(at), at * block
                    ids = held[s - base:s - base + c] if s - base + c <= len(held) else tokens.ids(s, c)
                    crc[i] = zlib.crc32(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [index["doc_id"].combine_chunks().cast(pa.int64()), pa.array(start + row["offset"]), pa.array(n), pa.array(crc)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = manifest.repartition(files, "shard")
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
