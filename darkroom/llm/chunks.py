"""Rows in chunks, and a search for values that several chunks hold.

A chunk is some rows of a table, about a megabyte of text, as one compressed Arrow payload, written once to the
shared folder. Chunks send the 64-bit values they hold to the parts of a hash space, each value once, and get
back those that count as repeated. So a value that a third of all rows hold costs one entry a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import giving_back, power_of_two, shuffle_partitions, slices, staged

CHUNK_BYTES = 1 << 20
#: Of the payloads' compression: they are written once and shuffled twice.
LEVEL = 6
MULTI, INDEXED = 1, 2


def pack(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    with pa.ipc.open_stream(payload) as stream:
        return stream.read_all()


def chunked(df: DataFrame, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk_id, payload): all rows and columns of df; chunk_id is unique within the table."""

    @giving_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
            for i, j in slices(batch, lengths, chunk_bytes):
                payload = pack(batch.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([payload], pa.binary())], names=["chunk_id", "payload"])
                chunk += 1

    return staged(df.mapInArrow(cut, "chunk_id long, payload binary"), "chunks", "uncompressed")


def entries(values: np.ndarray, indexed: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values (without their lowest two bits) with flags there, sorted, and the part of each by its first bits."""
    kept = values & np.uint64(0xFFFFFFFFFFFFFFFC)
    kept, inverse, counts = np.unique(kept, return_inverse=True, return_counts=True)
    flags = np.where(counts > 1, MULTI, 0).astype(np.uint64)
    if indexed is None:
        flags |= np.uint64(INDEXED)
    else:
        held = np.zeros(len(kept), dtype=bool)
        held[inverse[indexed]] = True
        flags |= np.where(held, INDEXED, 0).astype(np.uint64)
    return kept | flags, (kept >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(kept), dtype=np.int64)


def repeated(
    chunks: DataFrame, values_of: Callable[[pa.RecordBatch, int], tuple[np.ndarray, np.ndarray | None]], width: int, parts: int | None = None
) -> DataFrame:
    """(chunk_id, hits: array<binary>): for each chunk its values that occur at least twice and are indexed somewhere.

    values_of(batch, row) gives a chunk's 64-bit values and where they are indexed (None: all). width 4 sends the
    30 bits after those that name the part; width 8 sends 62 bits. The hits are whole values of 38 or more bits
    (width 4) or 62 bits (width 8), aligned to the top of 64 bits; hits_of() tests against them.
    """
    parts = power_of_two(parts or 4 * max(64, shuffle_partitions(chunks.sparkSession)))
    bits = parts.bit_length() - 1
    kind = np.dtype("<u4" if width == 4 else "<u8")
    down = np.uint64(32 - bits) if width == 4 else np.uint64(0)

    @giving_back
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                values, indexed = values_of(batch, row)
                if not len(values):
                    continue
                if width == 4:  # bits below those that are sent do not tell values apart
                    values = values & ~np.uint64((1 << (34 - bits)) - 1)
                sent, part = entries(values, indexed, bits)
                if width == 4:
                    sent = (sent >> down) & np.uint64(0xFFFFFFFC) | (sent & np.uint64(3))
                ends = np.searchsorted(part, np.arange(parts + 1))
                full = np.nonzero(np.diff(ends))[0]
                blobs = [sent[ends[p] : ends[p + 1]].astype(kind).tobytes() for p in full]
                chunk = batch.column(0)[row].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk, dtype=np.int64)), pa.array(blobs, pa.binary())], names=["part", "chunk_id", "blob"])

    def match(key: tuple, rows: pa.Table) -> pa.Table:
        blobs = rows.column("blob").combine_chunks()
        blobs = blobs.to_pylist()
        values = np.frombuffer(b"".join(blobs), dtype=kind)
        lengths = np.array([len(x) // kind.itemsize for x in blobs])
        plain = values >> kind.type(2)
        order = np.argsort(plain, kind="stable")
        ordered = plain[order]
        starts = np.nonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))[0]
        sizes = np.diff(np.append(starts, len(ordered)))
        flags = np.bitwise_or.reduceat(values[order] & kind.type(3), starts)
        hit = ((flags & INDEXED) > 0) & ((sizes > 1) | ((flags & MULTI) > 0))
        mask = np.zeros(len(values), dtype=bool)
        mask[order] = np.repeat(hit, sizes)
        owner = np.repeat(np.arange(len(blobs)), lengths)
        part = np.uint64(int(key[0].as_py()))
        whole = (plain.astype(np.uint64) << np.uint64(2)) << down
        if width == 4:
            whole |= part << np.uint64(64 - bits)
        found, chosen = whole[mask].astype("<u8"), owner[mask]
        ends = np.searchsorted(chosen, np.arange(len(blobs) + 1))
        full = np.nonzero(np.diff(ends))[0]
        ids = rows.column("chunk_id").to_numpy()
        return pa.table({"chunk_id": pa.array(ids[full], pa.int64()), "hits": pa.array([found[ends[k] : ends[k + 1]].tobytes() for k in full], pa.binary())})

    sent = chunks.mapInArrow(send, "part int, chunk_id long, blob binary")
    found = sent.groupBy("part").applyInArrow(match, "chunk_id long, hits binary")
    return found.groupBy("chunk_id").agg(F.collect_list("hits").alias("hits"))


def hit_mask(values: np.ndarray, hits: list[bytes] | None, width: int, parts_bits: int) -> np.ndarray:
    """Which of a chunk's values are among its hits."""
    if not hits:
        return np.zeros(len(values), dtype=bool)
    low = 34 - parts_bits if width == 4 else 2
    return np.isin(values & ~np.uint64((1 << low) - 1), np.frombuffer(b"".join(hits), dtype="<u8"))
