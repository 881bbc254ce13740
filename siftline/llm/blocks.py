"""Blocks of documents: runs of rows that travel together, compressed, under an id that follows from their contents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .memory import trim

#: Characters of text in a block.
BLOCK_CHARS = 4 << 20


def blocks(frames: Iterator[pa.RecordBatch], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, pa.Array, list[str | None]]]:
    """(block id, ids, texts): runs of a partition's rows, however they come in batches.

    The id follows from the contents, so it is the same in each scan and after a retry.
    """
    ids: list = []
    texts: list[str | None] = []
    size, kind = 0, None

    def block() -> tuple[int, pa.Array, list[str | None]]:
        digest = hashlib.blake2b(digest_size=8)
        for t in texts:
            data = (t or "").encode("utf-8", "surrogatepass")
            digest.update(b"%d%c" % (len(data), 45 if t is None else 44))
            digest.update(data)
        return int.from_bytes(digest.digest(), "little", signed=True), pa.array(ids, kind), texts

    for frame in frames:
        kind = frame.column(0).type
        for ident, text in zip(frame.column(0).to_pylist(), frame.column(1), strict=True):
            ids.append(ident)
            texts.append(text.as_py())
            size += len(texts[-1] or "") + 1
            if size >= limit:
                yield block()
                ids, texts, size = [], [], 0
    if ids:
        yield block()
    trim()


def _pack(limit: int):
    """The rows of each block in one compressed row."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in blocks(frames, limit):
            table = pa.table({"doc_id": ids, "text": pa.array(texts, pa.string())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([zstandard.compress(sink.getvalue().to_pybytes(), 3)], pa.binary())], names=["block", "payload"])

    return run


def packed(docs: DataFrame, limit: int = BLOCK_CHARS) -> DataFrame:
    """(block, payload) of (doc_id, text)."""
    return docs.mapInArrow(_pack(limit), "block long, payload binary")


def unpacked(payload: bytes) -> pa.Table:
    """The rows (doc_id, text) of a block."""
    return pa.ipc.open_stream(zstandard.decompress(payload)).read_all()
