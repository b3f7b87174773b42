"""Blocks of documents that ask about their distinct keys, and get the answers back in the order in which they asked.

A block is some megabytes of whole texts, written once to the shared folder. It sends each bucket of the key space the
sorted keys that it holds there, once each, as differences; so a key that a third of all documents share comes at most
once from a block. A bucket answers each block that wrote to it. Only keys move, a few bytes each, not texts. Blocks
and buckets write no empty messages, so there are never more messages than distinct keys of blocks: linear in the data.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from ._common import durable

#: Text bytes of a block; keys that a bucket is to get from all blocks; bits of a key within its bucket.
BLOCK, BUCKET, BITS = 4 << 20, 1 << 20, 40
_MASK = np.uint64((1 << BITS) - 1)
BLOCKS = "block long, n_docs long, n_words long, doc_ids binary, ends binary, texts binary, others binary"


def squeeze(data: bytes | np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data.tobytes() if isinstance(data, np.ndarray) else data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def planes(a: np.ndarray, width: int) -> bytes:
    """Integers as `width` bytes each, all first bytes first."""
    return squeeze(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T))


def unplanes(data: bytes, width: int) -> np.ndarray:
    p = np.frombuffer(expand(data), np.uint8).reshape(width, -1)
    out = np.zeros((p.shape[1], 8), np.uint8)
    out[:, :width] = p.T
    return out.view("<u8").ravel()


@dataclass
class Block:
    block: int
    doc_ids: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    others: bytes | None = None

    @classmethod
    def of(cls, t: pa.Table | pa.RecordBatch, row: int = 0) -> Block:
        get = lambda name: t.column(name)[row].as_py()
        return cls(get("block"), np.frombuffer(expand(get("doc_ids")), "<i8"), np.frombuffer(expand(get("ends")), "<i8"), np.frombuffer(expand(get("texts")), np.uint8), get("others"))

    def text(self, k: int) -> bytes:
        return self.data[self.ends[k] : self.ends[k + 1]].tobytes()


    def carried(self) -> pa.Table:
        return pa.ipc.open_stream(expand(self.others)).read_all().combine_chunks()


def blocks(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """BLOCKS of (doc_id, text), checkpointed, so that every later reader finds the same documents in a block. Columns to
    carry go with their documents."""
    carry = carry or []
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 24, 0
        ids: list[np.ndarray] = []
        data: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        others: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            flat, size = np.concatenate(data), np.concatenate(sizes)
            ends = np.concatenate([[0], np.cumsum(size)]).astype("<i8")
            n = sum(len(words.bounds(flat[ends[a] : ends[b]], ends[a : b + 1] - ends[a])[0]) for a in range(0, len(size), 500) for b in [min(a + 500, len(size))])
            doc_ids = np.concatenate(ids).astype("<i8")
            rest = None
            if carry:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, others[0].schema) as w:
                    for o in others:
                        w.write_batch(o)
                rest = squeeze(sink.getvalue().to_pybytes())
            values = [base + k, len(size), n, squeeze(doc_ids), squeeze(ends), squeeze(flat, 3), rest]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in values], names=names)

        held = 0
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                d, ends = words.buffers(part.column(1))
                ids.append(np.asarray(part.column(0).cast(pa.int64())))
                data.append(d)
                sizes.append(np.diff(ends))
                others.append(pa.RecordBatch.from_arrays(part.columns[2:], names=carry))
                held += len(d)
                if held >= BLOCK:
                    yield out()
                    ids, data, sizes, others, held, k = [], [], [], [], 0, k + 1
        if ids:
            yield out()

    return durable(docs.select("doc_id", "text", *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]).where("doc_id IS NOT NULL").mapInArrow(rows, BLOCKS))


def bucket_bits(held: DataFrame) -> int:
    """Bits that name a bucket, so that one gets about BUCKET keys."""
    n = held.agg(F.sum("n_words")).first()[0] or 0
    return max(3, int(np.ceil(np.log2(max(1, n) / BUCKET))))


def short(keys: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of 64-bit keys that a bucket tells apart: order stays, far keys may become equal."""
    return keys >> np.uint64(64 - BITS - bits)


def runs(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of each bucket that sorted short keys meet: as many steps as there are messages."""
    b = keys >> np.uint64(BITS)
    begin = np.flatnonzero(np.append(True, b[1:] != b[:-1])[: len(b)])
    return list(zip(b[begin].astype(np.int64).tolist(), begin.tolist(), np.append(begin[1:], len(b)).tolist(), strict=True))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct short keys of one bucket."""
    low = keys & _MASK
    return planes(np.diff(low, prepend=np.uint64(0)), 5)


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, 5))


def ask(held: DataFrame, questions: Callable[[Block], Iterator[tuple]], columns: list[tuple[str, pa.DataType]]) -> DataFrame:
    """Rows (bucket, block, *columns) that `questions` makes of each block."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *columns])
    names = {pa.binary(): "binary", pa.int64(): "long"}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                block = Block.of(b, k)
                found = [(q[0], block.block, *q[1:]) for q in questions(block)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return held.mapInArrow(rows, ", ".join(["bucket int", "block long", *(f"{n} {names[t]}" for n, t in columns)]))


def table_of(found: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*found, strict=True)) if found else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
