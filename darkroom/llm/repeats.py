"""Removal of word windows that repeat anywhere in a corpus, found by fixed-block anchors.

Any window of W words holds a whole block of L = (W + 1) // 2 words at a multiple of L, whatever its start. So the
index holds the non-overlapping L-word blocks of all documents, every rolling L-word window probes it, and hits
are extended: the W-word windows around them are compared, and those that repeat join into maximal exact repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.chunks import CHUNK_BYTES, chunked, hit_mask, repeated, unpack
from darkroom.llm.common import giving_back, power_of_two, shuffle_partitions

#: Fixed value: an odd multiplier for polynomial hashes modulo 2^64.
BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: after it, all bits of a hash depend on all of the input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a chunk's documents: their hashes in one row, and where each document starts."""

    def __init__(self, texts: list[str | None]):
        digest = xxhash.xxh64_intdigest
        self.words = [(x or "").encode("utf-8", "surrogatepass").split() for x in texts]
        self.lengths = np.array([len(x) for x in self.words], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        total = int(self.lengths.sum())
        self.hashes = np.fromiter((digest(w) for doc in self.words for w in doc), dtype=np.uint64, count=total)
        self.place = np.arange(total) - np.repeat(self.starts, self.lengths)
        self.room = np.repeat(self.lengths, self.lengths) - self.place
        inverse = pow(BASE, -1, 1 << 64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.hashes * _powers(total, inverse))])
        self.up = _powers(total + 1, BASE)

    def windows(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the windows that start at these places."""
        return _mixed((self.sums[at + length] - self.sums[at]) * self.up[at])


def _blocks(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all rolling blocks in documents that hold a whole window, their hashes, and which are indexed."""
    block = (window + 1) // 2
    long = np.repeat(words.lengths >= window, words.lengths)
    at = np.nonzero(long & (words.room >= block))[0]
    return at, words.windows(at, block), words.place[at] % block == 0


def _candidates(words: Words, window: int, hits: list[bytes] | None, bits: int) -> np.ndarray:
    """Starts of the windows that hold a block which was hit."""
    at, hashes, _ = _blocks(words, window)
    total = len(words.hashes)
    before = np.zeros(total + 1, dtype=np.int64)
    before[at[hit_mask(hashes, hits, 4, bits)] + 1] = 1
    before = np.cumsum(before)
    start = np.nonzero(words.room >= window)[0]
    return start[before[start + window - (window + 1) // 2 + 1] > before[start]]


def without_repeats(docs: DataFrame, text_col: str = "text", window: int = 35, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All rows and columns of docs, with the columns kept_text, n_words and n_removed.

    A word goes if a window of `window` consecutive words that covers it starts anywhere else too, in any
    row, the same one included. Windows are judged on the input. kept_text joins the words that stay by single
    spaces. Null and empty texts, and those without words, have n_words 0 and kept_text ''. A repeated row counts
    as another place. Columns of docs named like the new ones are replaced. No rows give no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("kept_text", "n_words", "n_removed")
    schema = docs.schema
    bits = power_of_two(4 * max(64, shuffle_partitions(spark))).bit_length() - 1
    chunks = chunked(docs, text_col, chunk_bytes)

    def words_of(batch: pa.RecordBatch, row: int) -> Words:
        return Words(unpack(batch.column(1)[row].as_py()).column(text_col).to_pylist())

    def blocks(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
        return _blocks(words_of(batch, row), window)[1:]

    def candidates(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, None]:
        words = words_of(batch, row)
        return words.windows(_candidates(words, window, batch.column(2)[row].as_py(), bits), window), None

    block_hits = repeated(chunks, blocks, 4, 1 << bits)
    window_hits = repeated(chunks.join(block_hits, "chunk_id"), candidates, 8, 1 << bits)

    @giving_back
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rows = unpack(batch.column(1)[row].as_py())
                hits = batch.column(2)[row].as_py()
                words = Words(rows.column(text_col).to_pylist()) if hits else None
                texts, counts, gone = [], [], []
                if words is None:
                    for text in rows.column(text_col).to_pylist():
                        own = (text or "").encode("utf-8", "surrogatepass").split()
                        texts.append(b" ".join(own)), counts.append(len(own)), gone.append(0)
                else:
                    start = np.nonzero(words.room >= window)[0]
                    start = start[hit_mask(words.windows(start, window), hits, 8, bits)]
                    depth = np.zeros(len(words.hashes) + 1, dtype=np.int64)
                    depth[start] += 1
                    depth[start + window] -= 1
                    covered = np.cumsum(depth) > 0
                    for own, s in zip(words.words, words.starts.tolist()):
                        mask = covered[s : s + len(own)]
                        lost = int(mask.sum())
                        kept = [w for w, m in zip(own, mask.tolist()) if not m] if lost else own
                        texts.append(b" ".join(kept)), counts.append(len(own)), gone.append(lost)
                out = rows.append_column("kept_text", pa.array(texts, pa.binary()).cast(pa.string()))
                out = out.append_column("n_words", pa.array(counts, pa.int64())).append_column("n_removed", pa.array(gone, pa.int64()))
                yield from out.combine_chunks().to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return chunks.join(window_hits, "chunk_id", "left").mapInArrow(finish, f"{fields}, kept_text string, n_words long, n_removed long")
