"""Near copies by the Jaccard likeness of word shingles, found with a prefix filter; none is missed.

All shingles of the corpus have one order. Two sets whose likeness reaches the least one share a shingle among the
first few of both, whatever the order. So only those few meet, in buckets of one shingle. The order is by hash, with
shingles that many texts hold at the end, so that a common passage brings no pairs by itself.

What is asked for are groups, not pairs. So each bucket has a pivot, the set whose first shingles most others share (the
text that others are copies of), which the others are compared with first. Sets that are linked then, by whatever
way, are not compared with each other: a group of copies of one text costs about one comparison a copy. All other sets
of a bucket still are, so no group is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.llm import simhash
from darkroom.llm.common import arrow_rows, bounded_broadcast, giving_back, joined_by_count, power_of_two, shuffle_partitions, slices, staged
from darkroom.operators.components import components

#: The least likeness as a fraction, so that sizes are compared in whole numbers.
LEAST = (4, 5)
#: A shingle is common if it is among the first of more than this many texts of one part in COUNTED, by a hash. At
#: most so many, the commonest, are put last: the order only decides how many sets are compared, not which are found.
COMMON, COUNTED, MOST_COMMON = 6, 4, 200_000
#: Ids that are broadcast at most; more are joined by shuffling.
MOST_BROADCAST = 500_000
#: Bytes of text that are read together.
BATCH = 1 << 20
#: Rows that go to a Python worker together.
ROWS = 1000
#: Words of 64 bits of a set's sketch: a bit is set where a shingle of the set has its number.
SKETCH = 8
#: In buckets of more entries sets have another sketch of FINE words, as pairs that are not like enough grow with the square there.
MANY, FINE = 64, 64
#: Fixed value: the seed of Spark's xxhash64(), which a null leaves as it is.
SEED = 42
#: An entry of a bucket as it is sent.
ENTRY = np.dtype([("shingle", "<i8"), ("key", "<i8"), ("n", "<i4"), ("place", "<i4")])


def _first(n):
    """How many shingles of sets of n meet others: one more than may be missing in a like set."""
    return n - (LEAST[0] * n + LEAST[1] - 1) // LEAST[1] + 1


def _read(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray], np.ndarray]]:
    """Batches of (id, text, ...) in slices, with all shingle hashes of each text, the ascending set of them and its hash."""
    for batch in batches:
        for i, j in slices(batch, pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), BATCH):
            some = batch.slice(i, j - i)
            hashes = [simhash.shingles_of(text, width, seed) for text in some.column(1).to_pylist()]
            sets = [np.unique(x) for x in hashes]
            keys = np.array([simhash.digest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64)
            yield some, hashes, [x.view(np.int64) for x in sets], keys


def _sketch(shingles: np.ndarray, words: int = SKETCH) -> np.ndarray:
    held = np.zeros(words * 64, dtype=bool)
    held[(shingles.view(np.uint64) >> np.uint64(20)) % np.uint64(words * 64)] = True
    return np.packbits(held, bitorder="little").view("<i8")


def _prints(rows: DataFrame, width: int, seed: int) -> DataFrame:
    """(id, hash, fp, key, n, bits, firsts): hash of the text, fingerprint, and hash, size and sketch of the set of each row; of the sets that are
    counted, also twice as many first shingles as meet others, since others move up where common ones are put last."""

    @giving_back
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, hashes, sets, keys in _read(batches, width, seed):
            fps = np.array([simhash.majority(x) for x in hashes], dtype=np.uint64).view(np.int64)
            ns = np.array([len(x) for x in sets], dtype=np.int32)
            own = np.array([SEED if text is None else simhash.digest(text.encode("utf-8", "surrogatepass"), SEED) for text in some.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            firsts = [np.sort(x)[: 2 * _first(len(x))].tobytes() if key % COUNTED == 0 else None for x, key in zip(sets, keys.tolist())]
            bits = pa.array([_sketch(x).tolist() for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(own), pa.array(fps), pa.array(keys), pa.array(ns), bits, pa.array(firsts, pa.binary())], names=["id", "hash", "fp", "key", "n", "bits", "firsts"])

    return staged(rows.mapInArrow(of, f"id {rows.schema['id'].dataType.simpleString()}, hash long, fp long, key long, n int, bits array<long>, firsts binary"), "prints", "uncompressed")


def _common(prints: DataFrame) -> np.ndarray:
    """Shingles that many texts have among their first, ascending. They are counted in parts of the hash space."""
    parts = power_of_two(max(64, shuffle_partitions(prints.sparkSession)))

    @giving_back
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<i8")
            values, counts = np.unique(values, return_counts=True)
            part = values & (parts - 1)
            order = np.argsort(part, kind="stable")
            values, counts, part = values[order], counts[order].astype("<i4"), part[order]
            ends = np.searchsorted(part, np.arange(parts + 1))
            full = np.nonzero(np.diff(ends))[0]
            cut = lambda x: pa.array([x[ends[p] : ends[p + 1]].tobytes() for p in full], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), cut(values), cut(counts)], names=["part", "shingles", "counts"])

    def count(rows: pa.Table) -> pa.Table:
        values = np.frombuffer(b"".join(rows.column("shingles").to_pylist()), dtype="<i8")
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), dtype="<i4")
        kept, at = np.unique(values, return_inverse=True)
        total = np.bincount(at, weights=counts).astype(np.int64) if len(values) else np.zeros(0, dtype=np.int64)
        often = total > COMMON
        return pa.table({"shingle": pa.array(kept[often]), "count": pa.array(total[often])})

    # a copied text counts once
    some = prints.where("firsts is not null").groupBy("key").agg(F.first("firsts").alias("firsts")).select("firsts")
    found = some.mapInArrow(send, "part int, shingles binary, counts binary").groupBy("part").applyInArrow(count, "shingle long, count long")
    most = found.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).select("shingle")
    return np.sort(np.array([r[0] for r in most.toLocalIterator()], dtype=np.int64))


def _ordered(sets: list[np.ndarray], common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, place, whether it is common) of the first shingles of sets, common ones last."""
    n = np.array([len(x) for x in sets], dtype=np.int64)
    values = np.concatenate([np.zeros(0, dtype=np.int64), *map(np.sort, sets)])
    row = np.repeat(np.arange(len(sets)), n)
    held = np.zeros(len(values), dtype=bool)
    if len(common):
        held = common[np.minimum(np.searchsorted(common, values), len(common) - 1)] == values
    order = np.argsort(2 * row + held, kind="stable")
    place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
    kept = place < _first(n)[row]
    order = order[kept]
    return row[kept], values[order], place[kept], held[order]


def _buckets(rows: DataFrame, common: np.ndarray, width: int, seed: int) -> DataFrame:
    """(shingle, key, n, place): the first shingles of each set, where another set has the shingle among its first too.

    Entries meet in parts of the hash space. Those of common shingles are dealt to tasks at random instead and all
    kept, as a part of such shingles might have no bound.
    """
    parts = power_of_two(4 * max(64, shuffle_partitions(rows.sparkSession)))

    @giving_back
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() * 7919
        for _, _, sets, keys in _read(batches, width, seed):
            _, once = np.unique(keys, return_index=True)
            once = np.sort(once)
            sets, keys = [sets[i] for i in once], keys[once]
            row, values, place, held = _ordered(sets, common)
            found = np.zeros(len(values), dtype=ENTRY)
            found["shingle"], found["key"], found["n"], found["place"] = values, keys[row], np.array([len(x) for x in sets], dtype=np.int64)[row], place
            turn += 1
            part = np.where(held, parts + turn % parts, values & (parts - 1))
            order = np.argsort(part, kind="stable")
            found, part = found[order], part[order]
            starts = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0] if len(part) else np.zeros(0, dtype=np.int64)
            ends = np.append(starts[1:], len(part))
            yield pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array([found[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())], names=["part", "entries"])

    def match(key: tuple, rows: pa.Table) -> pa.Table:
        found = np.frombuffer(b"".join(rows.column("entries").to_pylist()), dtype=ENTRY)
        order = np.lexsort((found["key"], found["shingle"]))
        found = found[order]
        same = np.zeros(len(found), dtype=bool)
        same[1:] = found["shingle"][1:] == found["shingle"][:-1]
        again = same.copy()
        again[1:] &= found["key"][1:] == found["key"][:-1]
        found, same = found[~again], same[~again]
        if key[0].as_py() < parts:
            found = found[same | np.append(same[1:], False)]
        return pa.table({c: pa.array(np.ascontiguousarray(found[c])) for c in ENTRY.names})

    sent = rows.mapInArrow(send, "part int, entries binary")
    return staged(sent.groupBy("part").applyInArrow(match, "shingle long, key long, n int, place int"), "entries")


def _tokens(shingles: np.ndarray) -> bytes:
    """The shingles of a set, 32 bits of each. Where these don't tell two apart, a set seems more like another, never less."""
    return np.sort(shingles.view(np.uint64) >> np.uint64(32)).astype("<u4").tobytes()


def _fine_sketch(shingles: np.ndarray) -> bytes:
    return _sketch(shingles, FINE).tobytes()


def _held(rows: DataFrame, prints: DataFrame, keys: DataFrame, width: int, seed: int, form: Callable[[np.ndarray], bytes] = _tokens) -> DataFrame:
    """(key, tokens): a form of each set of keys (key), once each, read again from a row that has it."""
    keys = staged(keys, "paired")
    few = keys.count()
    ids = prints.join(bounded_broadcast(keys, few, MOST_BROADCAST), "key", "left_semi").groupBy("key").agg(F.min("id").alias("id")).select("id").distinct()
    ids = staged(ids, "read")
    some = rows.join(bounded_broadcast(ids.where("id is not null"), few, MOST_BROADCAST), "id", "left_semi")
    if ids.where("id is null").limit(1).count():
        some = some.unionByName(rows.where("id is null"))

    @giving_back
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, sets, keys in _read(batches, width, seed):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(map(form, sets)), pa.binary())], names=["key", "tokens"])

    found = some.select("id", "text").mapInArrow(of, "key long, tokens binary")
    # rows of the same id may hold other texts, and the same one again
    return staged(found.join(bounded_broadcast(keys, few, MOST_BROADCAST), "key", "left_semi").dropDuplicates(["key"]), "held", "uncompressed")


def _alike(pairs: DataFrame, rows: DataFrame, prints: DataFrame, width: int, seed: int) -> DataFrame:
    """The pairs (x, y) of sets whose likeness is at least LEAST."""
    keys = pairs.select(F.col("x").alias("key")).unionByName(pairs.select(F.col("y").alias("key"))).distinct()
    held = _held(rows, prints, keys, width, seed)
    p, q = LEAST

    @giving_back
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_buffer(), dtype="<u4"), np.frombuffer(b.as_buffer(), dtype="<u4")
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
                good.append(bool(len(b)) and (p + q) * int((b[at] == a).sum()) >= p * (len(a) + len(b)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["x", "y"]).filter(pa.array(good, pa.bool_()))

    whole = pairs.join(held.select(F.col("key").alias("x"), F.col("tokens").alias("x_tokens")).hint("merge"), "x")
    whole = whole.join(held.select(F.col("key").alias("y"), F.col("tokens").alias("y_tokens")).hint("merge"), "y")
    return staged(whole.select("x", "y", "x_tokens", "y_tokens").mapInArrow(of, "x long, y long"), "alike")


def _able(x_n: Column, x_place: Column, y_n: Column, y_place: Column) -> Column:
    """Whether two sets that share a shingle at these places may be like enough."""
    p, q = LEAST
    return (p + q) * F.least(x_n - x_place, y_n - y_place) >= p * (x_n + y_n)


def _overlapping(x_n: Column, x_bits: Column, y_n: Column, y_bits: Column) -> Column:
    """Whether two sets may be like enough by their sketches: each bit of one that the other lacks is a shingle that the
    other lacks."""
    p, q = LEAST
    lacks = lambda a, b: sum((F.bit_count(a[i].bitwiseAND(F.bitwise_not(b[i]))) for i in range(SKETCH)), F.lit(0))
    return (p + q) * F.least(x_n - lacks(x_bits, y_bits), y_n - lacks(y_bits, x_bits)) >= p * (x_n + y_n)


def _finely_overlapping(x_n: Column, x_fine: Column, y_n: Column, y_fine: Column) -> Column:
    """As _overlapping(), by long sketches; true where there are none."""
    p, q = LEAST
    lacks = lambda a, b: F.aggregate(F.zip_with(a, b, lambda s, t: F.bit_count(s.bitwiseAND(F.bitwise_not(t)))), F.lit(0), lambda n, m: n + m)
    return F.coalesce((p + q) * F.least(x_n - lacks(x_fine, y_fine), y_n - lacks(y_fine, x_fine)) >= p * (x_n + y_n), F.lit(True))


def _fine(rows: DataFrame, prints: DataFrame, keys: DataFrame, width: int, seed: int) -> DataFrame:
    """(key, fine): long sketches of the sets of keys."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [np.frombuffer(x, dtype="<i8").tolist() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine, pa.list_(pa.int64()))], names=["key", "fine"])

    return _held(rows, prints, keys, width, seed, _fine_sketch).select("key", "tokens").mapInArrow(of, "key long, fine array<long>")


def links(rows: DataFrame, prints: DataFrame, width: int, seed: int) -> DataFrame:
    """(a, b): fingerprints of pairs of texts that are like enough; all groups of such texts are connected by them."""
    keyed = staged(prints.select("key", "fp").distinct().groupBy("key").agg(F.min("fp").alias("first"), F.collect_set("fp").alias("every")), "keys")
    same = keyed.where(F.size("every") > 1).select(F.col("first").alias("a"), F.explode("every").alias("b")).where("a <> b")

    found = _buckets(rows, _common(prints), width, seed)
    entries = found.count()
    sizes = staged(found.groupBy("shingle").agg(F.count("*").alias("held")), "sizes")
    first_n = F.col("n") - F.ceil(F.col("n") * LEAST[0] / LEAST[1]) + 1
    own = (-F.sum("_held").over(Window.partitionBy("key")) / first_n).alias("own")
    counted = sizes.withColumn("_held", F.col("held"))
    ranked = staged(joined_by_count(found, counted, "shingle", "held", entries).select(*found.columns, own), "ranked")
    pivots = ranked.groupBy("shingle").agg(F.min(F.struct("own", "key", "n", "place")).alias("p"), F.count("*").alias("held"))
    pivots = staged(pivots.select("shingle", F.col("p.key").alias("pivot"), F.col("p.n").alias("p_n"), F.col("p.place").alias("p_place"), "held"), "pivots")
    met = staged(joined_by_count(ranked.drop("own"), pivots, "shingle", "held", entries), "met")
    first = met.where((F.col("key") != F.col("pivot")) & _able(F.col("n"), F.col("place"), F.col("p_n"), F.col("p_place")))
    near = _alike(staged(first.select(F.col("key").alias("x"), F.col("pivot").alias("y")).distinct(), "first"), rows, prints, width, seed)
    label = staged(components(near.select(F.col("x").alias("a"), F.col("y").alias("b"))), "labels")

    # a pivot may be that of many entries, but of no more shingles than its own
    p_label = pivots.join(label.select(F.col("node").alias("pivot"), F.col("root").alias("p_label")).hint("merge"), "pivot", "left")
    p_label = staged(p_label.select("shingle", F.coalesce("p_label", "pivot").alias("p_label"), "held"), "pivots")
    of = met.join(label.select(F.col("node").alias("key"), F.col("root").alias("label")).hint("merge"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    of = joined_by_count(staged(of, "named"), p_label, "shingle", "held", entries)
    of = staged(of.select("shingle", "key", "n", "place", "label", "pivot", (F.col("label") != F.col("p_label")).alias("out")), "labelled")
    open_ = of.groupBy("shingle").agg(F.count("*").alias("held"), F.bool_or("out").alias("any")).where("any").select("shingle", "held")
    marks = prints.groupBy("key").agg(F.first("bits").alias("bits"))
    of = joined_by_count(of, staged(open_.withColumn("many", F.col("held") > MANY), "buckets"), "shingle", "held", entries)
    of = staged(of, "opened")
    dense = of.where("many").select("key").distinct()
    fine = _fine(rows, prints, dense, width, seed)
    of = of.join(marks.hint("merge"), "key").join(fine.hint("merge"), "key", "left").withColumn("fine", F.when(F.col("many"), F.col("fine")))
    of = staged(of, "open")
    x, y = (of.select("shingle", *[F.col(c).alias(f"{side}_{c}") for c in ("key", "n", "place", "label", "pivot", "out", "bits", "fine")]) for side in "xy")
    able = (F.col("x_label") != F.col("y_label")) & (~F.col("y_out") | (F.col("x_key") < F.col("y_key"))) & _able(F.col("x_n"), F.col("x_place"), F.col("y_n"), F.col("y_place"))
    able = able & _overlapping(F.col("x_n"), F.col("x_bits"), F.col("y_n"), F.col("y_bits"))
    able = able & _finely_overlapping(F.col("x_n"), F.col("x_fine"), F.col("y_n"), F.col("y_fine"))
    left = x.where("x_out and x_key <> x_pivot").join(y.where("y_key <> y_pivot").withColumnRenamed("shingle", "_shingle").hint("merge"), (F.col("shingle") == F.col("_shingle")) & able)
    left = left.select(F.least("x_key", "y_key").alias("x"), F.greatest("x_key", "y_key").alias("y")).distinct()
    like = near.unionByName(_alike(staged(left, "left"), rows, prints, width, seed))

    first = keyed.select("key", "first")
    like = like.join(first.withColumnsRenamed({"key": "x", "first": "a"}).hint("merge"), "x").join(first.withColumnsRenamed({"key": "y", "first": "b"}).hint("merge"), "y")
    return like.select("a", "b").unionByName(same)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, seed: int = 42, threshold: int = 2) -> DataFrame:
    """(id, hash, fp, component_id, root) per row: as simhash.near_duplicates, with links also between all texts whose shingle
    sets have a Jaccard likeness of LEAST or more. hash is Spark's xxhash64 of the text, root the same for all rows of a
    component, also where ids repeat. Words are lower-cased; a short text is one shingle, and a null or
    empty one has none and the fingerprint 0. Repeated rows stay, other columns are not read, no rows give no rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with arrow_rows(docs.sparkSession, ROWS):
        prints = _prints(rows, width, seed)
        nodes = simhash.nodes_of(prints)
        return simhash.labelled(prints.select("id", "hash", "fp"), nodes, simhash.links(nodes, threshold).unionByName(links(rows, prints, width, seed)))
