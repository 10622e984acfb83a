"""Token ids in patched frame-of-reference segments.

A segment is one binary value holding whole documents:

    header     "PFR1", block length, ids, blocks, documents        4 bytes + 4 unsigned ints
    starts     byte offset of each block in the body, and its end  unsigned ints
    documents  ids of each document                                unsigned ints
    body       blocks: minimum (4 bytes), width (1), exceptions (2), then the differences
               from the minimum packed at that width, then the exceptions' positions (2 each)
               and whole differences (4 each)

A block's width holds a chosen share of its differences; the larger ones are exceptions.
Segments are rows of a Parquet table, so Spark's committer makes writing safe against
retried tasks and any store that Spark reaches can hold the file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_bytes, width
from .tokens import encoder, with_end

MAGIC = b"PFR1"
_HEAD = struct.Struct("<4s4I")
_BLOCK_HEAD = 7
_WIDTHS = np.array([int(i).bit_length() for i in range(1 << 16)], np.uint8)


def _bit_length(values: np.ndarray) -> np.ndarray:
    high = (values >> 16).astype(np.int64)
    return np.where(high > 0, _WIDTHS[high] + 16, _WIDTHS[values & 0xFFFF])


def _pack(rows: np.ndarray, bits: int) -> np.ndarray:
    """Rows of differences below 2 ** bits -> rows of packed bytes."""
    lanes = 16 if bits <= 16 else 32
    spread = np.unpackbits(rows.astype(f"<u{lanes // 8}").view(np.uint8), axis=1, bitorder="little").reshape(len(rows), -1, lanes)
    return np.packbits(spread[:, :, :bits].reshape(len(rows), -1), axis=1, bitorder="little")


def _unpack(rows: np.ndarray, bits: int, block: int) -> np.ndarray:
    lanes = 16 if bits <= 16 else 32
    spread = np.zeros((len(rows), block, lanes), np.uint8)
    spread[:, :, :bits] = np.unpackbits(rows, axis=1, count=block * bits, bitorder="little").reshape(len(rows), block, bits)
    return np.packbits(spread.reshape(len(rows), -1), axis=1, bitorder="little").view(f"<u{lanes // 8}").astype(np.uint32)


def encode_segment(ids: np.ndarray, doc_lengths: list[int], block: int = 256, percentile: float = 90.0) -> bytes:
    """ids of whole documents in order -> a segment."""
    n = len(ids)
    blocks = -(-n // block)
    padded = np.concatenate([ids, np.full(blocks * block - n, ids[-1] if n else 0, ids.dtype)]).astype(np.uint32).reshape(blocks, block)
    low = padded.min(axis=1) if blocks else np.empty(0, np.uint32)
    rest = padded - low[:, None]
    rank = min(block - 1, int(block * percentile / 100))
    bits = _bit_length(np.partition(rest, rank, axis=1)[:, rank]) if blocks else np.empty(0, np.int64)
    bodies: list[bytes] = [b""] * blocks
    for b in np.unique(bits):
        at = np.flatnonzero(bits == b)
        part = rest[at]
        over = (part >> np.uint32(b)) > 0 if b < 32 else np.zeros(part.shape, bool)
        packed = _pack(np.where(over, 0, part), int(b)) if b else np.empty((len(at), 0), np.uint8)
        rows, columns = np.nonzero(over)
        cuts = np.searchsorted(rows, np.arange(len(at) + 1))
        values = part[rows, columns].astype("<u4")
        columns = columns.astype("<u2")
        for i, k in enumerate(at):
            x, y = cuts[i], cuts[i + 1]
            bodies[k] = struct.pack("<IBH", int(low[k]), int(b), y - x) + packed[i].tobytes() + columns[x:y].tobytes() + values[x:y].tobytes()
    starts = np.concatenate([[0], np.cumsum([len(x) for x in bodies])]).astype("<u4")
    return b"".join([_HEAD.pack(MAGIC, block, n, blocks, len(doc_lengths)), starts.tobytes(), np.array(doc_lengths, "<u4").tobytes(), *bodies])


class Segment:
    """Reads a segment, whole or by block."""

    def __init__(self, data: bytes) -> None:
        magic, self.block, self.n, self.blocks, docs = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment")
        at = _HEAD.size
        self.starts = np.frombuffer(data, "<u4", self.blocks + 1, at).astype(np.int64)
        at += 4 * (self.blocks + 1)
        self.doc_lengths = np.frombuffer(data, "<u4", docs, at).astype(np.int64)
        self.body = np.frombuffer(data, np.uint8, offset=at + 4 * docs)

    def read(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """ids of blocks first..last (all by default) as unsigned 32-bit values."""
        last = self.blocks if last is None else min(last, self.blocks)
        at = self.starts[first:last]
        if not len(at):
            return np.empty(0, np.uint32)
        heads = self.body[at[:, None] + np.arange(_BLOCK_HEAD)]
        low = np.ascontiguousarray(heads[:, :4]).view("<u4").ravel()
        bits = heads[:, 4].astype(np.int64)
        over = np.ascontiguousarray(heads[:, 5:7]).view("<u2").ravel().astype(np.int64)
        out = np.zeros((len(at), self.block), np.uint32)
        size = -(-self.block * bits // 8)
        for b in np.unique(bits):
            if b:
                rows = np.flatnonzero(bits == b)
                out[rows] = _unpack(self.body[at[rows][:, None] + _BLOCK_HEAD + np.arange(size[rows[0]])], int(b), self.block)
        for k in np.flatnonzero(over):
            p = int(at[k] + _BLOCK_HEAD + size[k])
            where = np.frombuffer(self.body, "<u2", over[k], p)
            out[k, where] = np.frombuffer(self.body, "<u4", over[k], p + 2 * over[k])
        out += low[:, None]
        return out.reshape(-1)[: min(self.n, last * self.block) - first * self.block]


SEGMENTS = "part int, segment int, first_id long, start_in_part long, n_ids long, doc_ids array<long>, payload binary"


def write_segments(docs: DataFrame, tokenizer_path: str, end_id: int, segment_ids: int = 1_000_000, block: int = 256, percentile: float = 90.0) -> DataFrame:
    """documents -> the written file: segments in ascending doc_id order within and across parts.

    Parts are ranges of doc_id (nulls first) and of the first bytes of text, so that equal ids need
    not share a task; equal ids are ordered by text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, start, n, ids, lengths, names = TaskContext.get().partitionId(), 0, 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            doc_ids = pa.concat_arrays(names)
            payload = encode_segment(np.concatenate(ids), np.concatenate(lengths).tolist(), block, percentile)
            first = next((x for x in doc_ids.to_pylist() if x is not None), None)
            listed = pa.ListArray.from_arrays([0, len(doc_ids)], doc_ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([start], pa.int64()), pa.array([n], pa.int64()), listed, pa.array([payload], pa.binary())], names=["part", "segment", "first_id", "start_in_part", "n_ids", "doc_ids", "payload"])

        for batch in batches:
            at = 0
            for coded in encoder(tokenizer_path).encode(batch.column("body")):
                own, starts = with_end(*coded, end_id)
                here = 0
                while here < len(starts) - 1:
                    fits = int(np.searchsorted(starts, starts[here] + segment_ids - n, "right")) - 1
                    if fits <= here:
                        if n:
                            yield close()
                            segment, start, n, ids, lengths, names = segment + 1, start + n, 0, [], [], []
                            continue
                        fits = here + 1  # a document of more ids is a segment alone
                    ids.append(own[starts[here] : starts[fits]])
                    lengths.append(np.diff(starts[here : fits + 1]))
                    names.append(batch.column("doc_id").slice(at + here, fits - here))
                    n += int(starts[fits] - starts[here])
                    here = fits
                at += len(starts) - 1
        if n:
            yield close()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    order = (F.asc_nulls_first("doc_id"), F.asc(F.substring("body", 1, 64)))
    ranged = source.repartitionByRange(width(docs), *order).sortWithinPartitions(F.asc_nulls_first("doc_id"), "body")
    return stage(ranged.mapInArrow(run, SEGMENTS), "ids", compression="uncompressed")


def part_offsets(segments: DataFrame) -> dict[int, int]:
    """ids before each part: one row per part (task of the writer) comes to the driver."""
    rows = segments.groupBy("part").agg(F.min("first_id").alias("first"), F.sum("n_ids").alias("n")).collect()
    offsets, total = {}, 0
    for row in sorted(rows, key=lambda r: (r["first"] is not None, r["first"] or 0, r["part"])):
        offsets[row["part"]] = total
        total += row["n"]
    return offsets


def read_documents(segments: DataFrame) -> DataFrame:
    """The file read back: (doc_id, start, n_tokens, ids_crc32) per document."""
    offsets = part_offsets(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                segment = Segment(batch.column("payload")[i].as_buffer())
                data = memoryview(segment.read().astype("<u4", copy=False)).cast("B")
                ends = np.cumsum(segment.doc_lengths)
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - segment.doc_lengths).tolist(), ends.tolist(), strict=True)]
                starts = offsets[batch.column("part")[i].as_py()] + batch.column("start_in_part")[i].as_py() + ends - segment.doc_lengths
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.array(starts), pa.array(segment.doc_lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("part", "start_in_part", "doc_ids", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file(docs: DataFrame, tokenizer_path: str, end_id: int = 2, segment_ids: int = 1_000_000) -> DataFrame:
    """documents -> (doc_id, start, n_tokens, ids_crc32), read back from the written segments.

    Null and empty texts hold the end id alone. Repeated rows are written each, a null doc_id
    comes first. A document lies in one segment, so a longer one makes a longer segment. An
    empty table gives an empty file. Other columns are not looked at.
    """
    return read_documents(write_segments(docs, tokenizer_path, end_id, segment_ids))
