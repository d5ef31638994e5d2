"""Document quality: ridge regression on random Fourier features of document statistics, calibrated isotonically.

Random Fourier features approximate a Gaussian kernel over the statistics. Each partition of the labelled rows adds
up its part of the normal equations, so the fit takes one pass and sends fixed-size sums to the driver. Scores of
rows that a model did not see calibrate it: the labelled rows are halved, each half is scored by the other's model.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import slices, staged

STATISTICS = 18
#: Parameters of the model.
FEATURES, WIDTH, RIDGE, SEED, BINS = 384, 3.0, 3e-3, 7, 1024
#: The fit uses at most about this many labelled rows (a sample by hash beyond it) and so many partial sums.
MOST_LABELLED, PARTIAL_SUMS = 2_000_000, 16
BATCH = 4 << 20

_UPPER, _LOWER, _DIGIT, _STOP, _SPACE, _HIGH = range(6)


def _byte_classes() -> np.ndarray:
    """For each byte, one row of which of the counted classes it belongs to; the rest of ASCII counts as signs."""
    out = np.zeros((256, 7), dtype=np.float64)
    out[65:91, _UPPER] = out[97:123, _LOWER] = out[48:58, _DIGIT] = out[128:, _HIGH] = 1
    out[[ord(c) for c in ".,;:?-'\"()"], _STOP] = 1
    out[[32, 9, 10, 11, 12, 13], _SPACE] = 1
    out[out.sum(axis=1) == 0, 6] = 1
    return out


_CLASSES = _byte_classes()


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a text; those of an empty or null text are those of no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _CLASSES
    letters = max(1.0, counts[_UPPER] + counts[_LOWER] + counts[_HIGH])
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    counted = Counter(words)
    distinct, most = len(counted), max(counted.values(), default=1) - 1
    again = sum(a == b for a, b in zip(words, words[1:])) / m
    lines = raw.split(b"\n")
    return np.array([
        np.log1p(len(words)), counts[_UPPER] / letters, counts[_DIGIT] / n, counts[_STOP] / m, counts[6] / m, np.log1p(counts[6]), counts[_SPACE] / n,
        counts[_HIGH] / letters, lengths.mean(), lengths.std(), np.log1p(lengths.max()), distinct / m, np.log(distinct + 1) / np.log(m + 1.718), np.sqrt(again),
        len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)), most / m, np.log1p(n / m),
    ])


def _table(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(x) for x in texts.to_pylist()], dtype=np.float64).reshape(-1, STATISTICS)


@dataclass(frozen=True)
class Model:
    """What scores a document: fixed in size, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, table: np.ndarray) -> np.ndarray:
        return fourier(table, self.mean, self.scale) @ self.weights

    def score(self, table: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(0)
        return np.clip(np.interp(self.raw(table), self.knots, self.levels), 0.0, 1.0)


def fourier(table: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    turn, shift = rng.normal(0, 1 / WIDTH, (STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((table - mean) / scale, -6, 6)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ turn + shift), np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted pool-adjacent-violators over points in ascending x."""
    blocks: list[list[float]] = []
    for value, weight in zip(y.tolist(), w.tolist()):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            total = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _solve(gram: np.ndarray, right: np.ndarray, rows: float) -> np.ndarray:
    penalty = np.eye(len(right)) * RIDGE * max(rows, 1.0)
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(gram + penalty, right)


def _with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch, pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), BATCH):
                some = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(list(_table(some.column(1))), pa.list_(pa.float64()))], names=["id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(of, "id long, stats array<double>")


def held_out(id_col):
    """The rows that no fit sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from labelled rows of docs that are not held out; labels has id_col and label_col (0 or 1).

    Rows with a null id or label are left out, and ids that are labelled both ways count once with either. With no
    label at all, every score is 0.5. Beyond MOST_LABELLED labelled rows, a sample of them by hash is used.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).where(~held_out(id_col)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y"))
    known = staged(known.where("id is not null").distinct(), "labels")
    share = min(1.0, MOST_LABELLED / max(1, known.count()))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # statistics are those of labelled rows only: their ids, at most MOST_LABELLED, are sent to the documents
    some = docs.withColumn(id_col, F.col(id_col).cast("long")).join(F.broadcast(known.select(F.col("id").alias(id_col)).distinct()), id_col, "left_semi")
    rows = _with_statistics(some, id_col, text_col).join(F.broadcast(known), "id").select((F.crc32(F.col("id").cast("string")) % 3 == 0).cast("int").alias("half"), "stats", "y", F.pmod(F.xxhash64("id"), F.lit(PARTIAL_SUMS)).cast("int").alias("slot"))
    rows = staged(rows.repartition(PARTIAL_SUMS, "slot"), "statistics")

    sums = rows.select("half", *[F.col("stats")[k].alias(f"s{k}") for k in range(STATISTICS)]).agg(F.count("*"), *[f(f"s{k}") for k in range(STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    if not sums[0]:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    mean, scale = np.array(sums[1::2], dtype=float), np.maximum(np.array(sums[2::2], dtype=float), 1e-6)

    def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return np.array(batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)).reshape(-1, STATISTICS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right, n = np.zeros((2, FEATURES + 1, FEATURES + 1)), np.zeros((2, FEATURES + 1)), np.zeros(2)
        for batch in batches:
            y, half = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            table = matrix(batch, "stats")
            for h in (0, 1):
                phi = fourier(table[half == h], mean, scale)
                gram[h] += phi.T @ phi
                right[h] += phi.T @ y[half == h]
                n[h] += len(phi)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["gram", "right", "n"])

    gram, right, n = np.zeros((2, FEATURES + 1, FEATURES + 1)), np.zeros((2, FEATURES + 1)), np.zeros(2)
    for row in rows.mapInArrow(partial, "gram binary, right binary, n binary").toLocalIterator():
        gram += np.frombuffer(row["gram"]).reshape(gram.shape)
        right += np.frombuffer(row["right"]).reshape(right.shape)
        n += np.frombuffer(row["n"])
    both = _solve(gram.sum(axis=0), right.sum(axis=0), n.sum())
    other = [_solve(gram[1 - h], right[1 - h], n[1 - h]) if n[1 - h] else both for h in (0, 1)]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((BINS, 2), dtype=np.int64)
        for batch in batches:
            y, half = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            phi = fourier(matrix(batch, "stats"), mean, scale)
            raw = np.where(half == 0, phi @ other[0], phi @ other[1])
            at = np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            found[:, 0] += np.bincount(at, minlength=BINS)
            found[:, 1] += np.bincount(at, weights=y, minlength=BINS).astype(np.int64)
        full = np.nonzero(found[:, 0])[0]
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(found[full, 0]), pa.array(found[full, 1])], names=["bin", "n", "ones"])

    bins = rows.mapInArrow(binned, "bin long, n long, ones long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).orderBy("bin").collect()
    at, count, ones = (np.array([r[k] for r in bins], dtype=float) for k in ("bin", "n", "ones"))
    knots = (at + 0.5) / BINS * 2 - 0.5
    return Model(mean, scale, both, knots, isotonic(knots, ones / count, count))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with the columns score (0 to 1, higher: good likelier) and predicted (0 or 1).

    Every whole text is scored, null and empty ones as texts without words. Columns with these names are replaced.
    """
    docs = docs.drop("score", "predicted")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for i, j in slices(batch, pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist(), BATCH):
                some = batch.slice(i, j - i)
                score = model.score(_table(some.column(at)))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*some.schema.names, "score", "predicted"])

    return docs.mapInArrow(of, f"{fields}, score double, predicted int")


def in_fit(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 != 1
