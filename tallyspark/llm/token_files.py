"""Operator 4: token-id files with Elias-Fano document boundaries.

Documents are range-partitioned by doc_id and encoded; each task writes shards of
concatenated ids (two bytes each while the vocabulary allows it), and in front of
them the documents' start offsets and their doc_ids, both Elias-Fano coded. A shard:

    header   magic, part, number in part, documents, null doc_ids, bytes an id, ids, and
             the sizes of the three sections (little-endian)
    starts   Elias-Fano code of documents + 1 offsets
    doc_ids  Elias-Fano code of the doc_ids that are not null (nulls come first)
    ids      the ids of all documents, one after the other

Files are written by Spark's text writer, which ends each shard with a line feed, and
read by its binary reader, so any store that Spark reaches will do.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe_stream
from .ship import ship
from .text import chunks

MAGIC = b"TSEF0001"
HEAD = struct.Struct("<8sIIIIBQQQQ")
PART_BYTES = 8 << 20
SHARD_IDS = 1 << 19
BATCH_ROWS = 256
CALL_BYTES = 1 << 15
TEXT_BYTES = 1 << 17
MARK, MARK_BYTES = "\x01", b"\x01"

_encoders: dict[str, LibraryEncoder] = {}


class LibraryEncoder(bpe_stream.Encoder):
    """Ids of whole texts by the tokenizers library.

    Words are found, told apart and remembered as ``bpe_stream`` does it; the library encodes
    each new word, many in one call with a mark between them, and whole slices of text that are not plain Latin.
    Of the model only its text rules stay in memory, as the library has the merges.
    """

    def __init__(self, path: str):
        model = bpe_stream.Model(path)
        self.tokenizer = model.library
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        super().__init__(SimpleNamespace(special=model.special, kinds=model.kinds), np.uint16 if self.width == 2 else np.uint32)
        mark = self._ids(MARK)
        self.mark = int(mark[0]) if len(mark) == 1 else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _alone(self, part: bytes) -> np.ndarray:
        return self._ids(part.decode())

    def _merged(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = [data[b : b + n].tobytes() for b, n in zip(begin.tolist(), size.tolist())]
        found: list[np.ndarray | None] = [None] * len(words)
        together: list[int] = []
        waiting = 0

        def flush() -> None:
            ids = self._ids(f" {MARK} ".join([words[k].decode() for k in together]))
            for k, some in zip(together, np.split(ids, np.flatnonzero(ids == self.mark))):
                found[k] = some[1:] if k != together[0] else some

        for k, w in enumerate(words):
            if self.mark is None or MARK_BYTES in w:
                found[k] = self._ids(w.decode())
                continue
            together.append(k)
            waiting += len(w)
            if waiting >= CALL_BYTES:
                flush()
                together, waiting = [], 0
        if together:
            flush()
        counts = np.array(list(map(len, found)), np.int64)
        return (np.concatenate(found) if found else np.zeros(0, self.kind)), counts


def encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def shard(part: int, number: int, doc_ids: list[int | None], sizes: list[int], ids: bytes | list[bytes], width: int) -> bytes:
    """The bytes of a shard; ``ids`` in one or in pieces."""
    from . import elias_fano

    ids = ids if isinstance(ids, list) else [ids]
    total = sum(map(len, ids))
    starts = elias_fano.encode(np.concatenate(([0], np.cumsum(np.array(sizes, np.int64)))))
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    names = elias_fano.encode(known)
    head = HEAD.pack(MAGIC, part, number, len(doc_ids), len(doc_ids) - len(known), width, total // width, len(starts), len(names), total)
    return b"".join([head, starts, names, *ids])


def shards(content: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """Part, number, doc_ids, start offsets (one more than documents) and ids of each shard of a file."""
    from .elias_fano import EliasFano

    at = 0
    while at < len(content):
        magic, part, number, docs, nulls, width, count, a, b, c = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no shard at byte {at}")
        at += HEAD.size
        starts, names = EliasFano(content, at).all(), EliasFano(content, at + a).all()
        ids = np.frombuffer(content, np.uint16 if width == 2 else np.uint32, count, at + a + b)
        yield part, number, [None] * nulls + names.tolist(), starts, ids
        at += a + b + c + 1


def counts(content: bytes) -> list[tuple[int, int, int]]:
    """Part, number and ids of each shard of a file, from the headers."""
    out, at = [], 0
    while at < len(content):
        _, part, number, _, _, _, count, a, b, c = HEAD.unpack_from(content, at)
        out.append((part, number, count))
        at += HEAD.size + a + b + c + 1
    return out


def encoded(batches: Iterator[pa.RecordBatch], library: LibraryEncoder) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of each row, about TEXT_BYTES of text at a time: no more texts and ids are held."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in chunks(sizes, TEXT_BYTES):
            some = batch.slice(i, j - i)
            yield from zip(some["doc_id"].to_pylist(), library.texts(some["text"].to_pylist()))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside the block pass ``rows`` rows at most to Python at a time, not a whole partition; the setting before is back after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode (doc_id, text) and write the shards to ``path`` in ascending doc_id order (nulls first).

    ``tokenizer``: file of a tokenizers model that ``bpe_stream`` can read (it drops white space); its special tokens are
    not added; ``end_id`` ends each document. A null text counts as empty; rows with the same
    doc_id follow each other by text hash; further columns are ignored.
    """
    ship(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("tie", F.crc32("text"))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        width = library.width
        end = np.array([end_id], f"<u{width}").tobytes()
        names, sizes, ids, count = [], [], [], 0

        def full() -> pa.RecordBatch:
            data = shard(part, number, names, sizes, ids, width)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["shard"])

        for name, found in encoded(batches, library):
            got = found.astype(f"<u{width}").tobytes() + end
            names.append(name)
            sizes.append(len(got) // width)
            ids.append(got)
            count += sizes[-1]
            if count >= SHARD_IDS:
                yield full()
                names, sizes, ids, count, number = [], [], [], 0, number + 1
        if names:
            yield full()

    with batches_of(docs.sparkSession, BATCH_ROWS):
        rows.mapInArrow(encode, "shard binary").select(F.col("shard").cast("string")).write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files at ``path``: doc_id, start, n_tokens, ids_crc32, ids (little-endian uint32)."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "part int, number int, doc_id long, offset long, n_tokens long, ids_crc32 long, ids binary"

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                for part, number, names, starts, ids in shards(content.as_buffer()):
                    for i in range(0, len(names), 1000):
                        cut = starts[i : i + 1001].tolist()
                        blobs = [ids[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:])]
                        n = len(blobs)
                        yield pa.RecordBatch.from_arrays([
                            pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(names[i : i + n], pa.int64()),
                            pa.array(cut[:-1], pa.int64()), pa.array(np.diff(cut), pa.int64()),
                            pa.array([zlib.crc32(x) for x in blobs], pa.int64()), pa.array(blobs, pa.binary()),
                        ], ["part", "number", "doc_id", "offset", "n_tokens", "ids_crc32", "ids"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                part, number, count = zip(*counts(content.as_buffer()))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(number, pa.int32()), pa.array(count, pa.int64())], ["part", "number", "count"])

    # one row a shard: a running sum over the ids of all shards before it
    before = W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1)
    bases = files.mapInArrow(totals, "part int, number int, count long").select(
        "part", "number", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    found = files.mapInArrow(documents, schema).join(bases, ["part", "number"])
    return found.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "ids")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by ``spark.checkpoint.dir``; set here only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="tallyspark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
