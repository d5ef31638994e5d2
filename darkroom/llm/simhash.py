"""SimHash near-duplicates linked through the anchors of a covering code.

Every 64-bit fingerprint lies near some word of a covering code, its home anchor. A fingerprint within
`threshold` bits of it lies at most that much farther from the same anchor. So each fingerprint is
copied to all anchors within covering radius plus threshold, and is compared there with those at home.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import joined_by_count, staged
from darkroom.operators.components import components

#: Fixed value: generator polynomial of the perfect binary Golay code of length 23 and radius 3,
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: Blocks of the 64 bits as (shift, length): two Golay blocks and two blocks whose anchors are all zeros and all ones.
GOLAY_BLOCKS = ((0, 23), (23, 23))
MAJORITY_BLOCKS = ((46, 9), (55, 9))


digest = xxhash.xxh64_intdigest


def shingles_of(text: str | None, width: int, seed: int) -> np.ndarray:
    """Hashes of the lower-cased word shingles of a text, repeats included.

    A text of fewer words than a shingle is one shingle; one without words (or null) has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    if len(words) <= width:
        return np.array([digest(b" ".join(words), seed)], dtype="<u8")
    runs = zip(*(words[i:] for i in range(width)))
    return np.array([digest(b" ".join(x), seed) for x in runs], dtype="<u8")


def fingerprint_of(text: str | None, width: int, seed: int) -> int:
    """SimHash of the shingles of a text as an unsigned number; 0 if it has none."""
    return majority(shingles_of(text, width, seed))


@cache
def _bits_of_bytes() -> np.ndarray:
    return ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes; counted in slices to bound memory."""
    counts = np.zeros((8, 256), dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        split = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.int64)
        counts += np.bincount(split.ravel(), minlength=2048).reshape(8, 256)
    bits = (counts @ _bits_of_bytes()) * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits.ravel(), bitorder="little").tobytes(), "little")


def fingerprint(text: Column, width: int = 3, seed: int = 42) -> Column:
    """SimHash of a text column as a long that holds the 64 bits."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint_of(x, width, seed) for x in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(found.view(np.int64))

    return of(text)


def _remainder(values: np.ndarray) -> np.ndarray:
    """Syndromes of 23-bit words: remainders by the generator, bit by bit for all words at once."""
    left = values.astype(np.int64)
    for bit in range(22, 10, -1):
        left = np.where((left >> bit) & 1, left ^ (GOLAY << (bit - 11)), left)
    return left


@cache
def _golay_errors(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome, the error patterns up to radius 3 plus threshold: patterns and their excess over 3
    (the home pattern counts 0), sorted by syndrome, and where each syndrome starts."""
    patterns, weights = [0], [0]
    for weight in range(1, 3 + threshold + 1):
        for places in combinations(range(23), weight):
            patterns.append(sum(1 << p for p in places))
            weights.append(weight)
    patterns, weights = np.array(patterns, dtype=np.int64), np.array(weights)
    syndrome = _remainder(patterns)
    order = np.lexsort((weights, syndrome))
    starts = np.searchsorted(syndrome[order], np.arange(2049))
    return patterns[order], np.maximum(weights[order] - 3, 0), starts


def _block_anchors(values: np.ndarray, shift: int, length: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, excess) of a block: for each row the anchors at most `threshold` beyond the radius."""
    part = ((values >> np.uint64(shift)) & np.uint64((1 << length) - 1)).astype(np.int64)
    rows = np.arange(len(part))
    if length == 23:
        patterns, excess, starts = _golay_errors(threshold)
        syndrome = _remainder(part)
        counts = starts[syndrome + 1] - starts[syndrome]
        row = np.repeat(rows, counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[syndrome], counts)
        return row, (part[row] ^ patterns[at]) >> 11, excess[at]
    ones = np.zeros(len(part), dtype=np.int64)
    for bit in range(length):
        ones += (part >> bit) & 1
    row, anchor = np.concatenate([rows, rows]), np.repeat([0, 1], len(part))
    excess = np.maximum(np.concatenate([ones, length - ones]) - length // 2, 0)
    near = excess <= threshold
    return row[near], anchor[near], excess[near]


def anchors_of(values: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for all anchors of each value within radius plus threshold; threshold 0 gives the home alone.

    Radius and threshold hold block by block: the excess of the blocks over their radii adds up to at most
    the threshold. Two values that differ in at most that many bits share the home anchors of both.
    """
    row, anchor, excess = np.arange(len(values)), np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=np.int64)
    for shift, length in GOLAY_BLOCKS + MAJORITY_BLOCKS:
        r, a, e = _block_anchors(values, shift, length, threshold)
        order = np.argsort(r, kind="stable")
        r, a, e = r[order], a[order], e[order]
        starts = np.searchsorted(r, np.arange(len(values) + 1))
        counts = starts[row + 1] - starts[row]
        pick = np.repeat(np.arange(len(row)), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[row], counts)
        total = excess[pick] + e[at]
        near = total <= threshold
        row, excess = row[pick][near], total[near]
        anchor = (anchor[pick][near] << (12 if length == 23 else 1)) | a[at][near]
    return row, anchor


def _replicated(fingerprints: DataFrame, threshold: int) -> DataFrame:
    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(values), 1024):
                some = values[i : i + 1024]
                row, anchor = anchors_of(some.view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(some[row])], names=["anchor", "fp"])

    return fingerprints.select("fp").mapInArrow(copies, "anchor long, fp long")


def links(fingerprints: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b) with a < b for all pairs of distinct fingerprints (column fp) that differ in at most `threshold` bits.

    Each pair comes once, from the home anchor of its smaller value. Supports thresholds from 0 to 2;
    the copies per value grow quickly with it (about 70 for 2).
    """
    if not 0 <= threshold <= 2:
        raise ValueError("threshold must be 0, 1 or 2")
    home = _replicated(fingerprints, 0).withColumnRenamed("fp", "a")
    near = _replicated(fingerprints, threshold).withColumnRenamed("fp", "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    # by what Spark knows of its size, the replicated side might be broadcast; it is sorted and merged instead
    return home.join(near.hint("merge"), (home["anchor"] == near["anchor"]) & close).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, threshold: int = 2
) -> DataFrame:
    """(id, fp, component_id) per row of docs; component_id is the smallest id reachable over links.

    Equal fingerprints are one node, so copies cost nothing. Rows with a null id get a component id from
    the others of their component, or null if none has an id. Null and empty texts have fingerprint 0 and
    are linked like any other. Repeated rows stay. No rows give no rows. Extra columns are ignored.
    """
    ids = staged(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width, seed).alias("fp")), "fingerprints")
    nodes = nodes_of(ids)
    return labelled(ids, nodes, links(nodes, threshold)).drop("root")


def nodes_of(ids: DataFrame) -> DataFrame:
    """(fp, first_id, n): each fingerprint once, with the smallest id that has it and how many rows do."""
    return staged(ids.groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("n")), "nodes")


def labelled(ids: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """ids (id, fp, ...) with component_id and root, the smallest fingerprint of the component, over links (a, b) between
    fingerprints. Rows whose fingerprint is neither linked nor repeated are components of their own; only the others are
    joined, those of fingerprints that many rows share without a shuffle."""
    total = nodes.agg(F.sum("n")).first()[0] or 0
    linked = components(found).select(F.col("node").alias("fp"), "root").hint("merge").join(nodes, "fp")
    linked = staged(linked, "linked")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("fingerprints"))
    moved = joined_by_count(linked, staged(least, "least"), "root", "fingerprints", linked.count()).select("fp", "component_id", "root", "n")
    again = nodes.where("n > 1").join(linked.select("fp").hint("merge"), "fp", "left_anti")
    rule = staged(moved.unionByName(again.select("fp", F.col("first_id").alias("component_id"), F.col("fp").alias("root"), "n")), "labels")
    out = joined_by_count(ids, rule, "fp", "n", total, "left")
    return out.select(*ids.columns, F.coalesce("component_id", "id").alias("component_id"), F.coalesce("root", "fp").alias("root"))
