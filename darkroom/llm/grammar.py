"""Token ids in shards of Re-Pair grammars: frequent pairs of neighbouring symbols become nonterminals.

A shard holds consecutive documents. Its rounds count all pairs of neighbours within documents, make the most
frequent ones nonterminals and replace them wherever they stand, until no pair pays or no 16-bit symbol is left.
Rules are kept with the lengths of their expansions, so that any span of ids is decoded without what lies before it.
"""

from __future__ import annotations

import operator
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.bpe import BYTE_FORM, Remembered, byte_level, form_of, gathered, plain, without_signs
from darkroom.llm.common import slices

SYMBOLS = 1 << 16
#: The letter of byte-level vocabularies for a space.
SPACE = byte_level(" ")
#: Bytes of text that make a shard, about; a document is never split.
SHARD_BYTES = 4 << 20
RULES_A_ROUND = 5000
#: Bytes of words that an encoder remembers, about, in each of two generations.
REMEMBERED = 48 << 20
#: A rule takes four symbols' room, two for its pair and two for its length, and saves one for each time it is used.
LEAST_COUNT = 5
#: Every so many symbols of a shard, the number of ids before them is kept.
STRIDE = 1024

_ID = operator.attrgetter("id")
_WHOLE = re.compile(r"\s\s")
_LONE = re.compile(r"[.,](?<![^\W\d_].)")


def _cut(text: str) -> str:
    """A text with marks where a token is sure to begin: spaces, line breaks, and points and commas after letters."""
    if _WHOLE.search(text):
        return text
    if not _LONE.search(text):
        text = text.replace(".", "\0.").replace(",", "\0,")
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ")


class ByteEncoder:
    """Ids of whole texts by a file of the tokenizers library, without added ids: piece by piece if its form is BYTE_FORM and
    its model BPE, else by the library alone. Its ids must fit 16 bits and leave some of them free."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding(), self.tokenizer.no_truncation()
        model = self.tokenizer.model
        self.usual = form_of(self.tokenizer) == BYTE_FORM and type(model).__name__ == "BPE" and not model.dropout
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > SYMBOLS:
            raise ValueError(f"more than {SYMBOLS} ids")
        self.tokenize = model.tokenize
        self.known = Remembered(self.ids_of, "<u2", REMEMBERED)

    def ids_of(self, piece: str) -> bytes:
        if piece[-1:].isalpha():
            word = piece[1:] if piece[0] == " " else piece
            if word.isascii():
                if word.isalpha():
                    return array("H", map(_ID, self.tokenize(piece if word is piece else SPACE + word))).tobytes()
            elif plain(word):
                return array("H", map(_ID, self.tokenize(byte_level(piece)))).tobytes()
        elif (head := without_signs(piece)) is not None:
            return self.known[head] + self.known[piece[len(head) :]]
        return array("H", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of whole texts end to end, their number by text).

        A space or line break between other characters always begins a token, so texts are cut there, and each
        distinct piece is encoded once. A text with white space next to white space is one piece.
        """
        self.known.turn()
        if not self.usual:
            each = [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, dtype="<u2") for x in texts]
            return np.concatenate([np.zeros(0, "<u2"), *each]), np.array(list(map(len, each)), dtype=np.int64)
        if any("\0" in x for x in texts):  # the mark of a cut
            each = [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, dtype="<u2") if "\0" in x else self.encode_all([x])[0] for x in texts]
            return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)
        return gathered(pc.split_pattern(pa.array(map(_cut, texts), pa.string()), "\0"), self.known)


@cache
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


#: Of the table that tells whether a pair is replaced: its slots, and a multiplier that spreads pairs over them.
SLOT_BITS, SPREAD = 18, np.uint32(2654435769)
#: Stands for a pair across two documents.
NO_PAIR = np.uint32(0xFFFFFFFF)
#: Symbols that are looked at together: so many stay in the processor's cache.
SLICE = 1 << 14


def _chosen(pairs: np.ndarray, most: int, flags: np.ndarray) -> np.ndarray:
    """The pairs that a round replaces, ascending: those at least a quarter as frequent as the most frequent one, up to
    `most` of them. The others wait, as this round may change their counts. pairs is ascending; flags is spare room."""
    flags = flags[: len(pairs)]
    flags[0] = True
    np.not_equal(pairs[1:], pairs[:-1], out=flags[1:])
    edges = np.flatnonzero(flags)
    counts = np.diff(edges, append=len(pairs))
    distinct = pairs[edges]
    if len(distinct) and distinct[-1] == NO_PAIR:
        distinct, counts = distinct[:-1], counts[:-1]
    if not len(distinct):
        return distinct
    often = np.flatnonzero(counts >= max(LEAST_COUNT, (counts.max() + 3) // 4))
    if len(often) > most:
        often = np.sort(often[np.argpartition(counts[often], len(often) - most)[len(often) - most :]])
    # of pairs whose slots agree, one waits for a later round
    _, first = np.unique((distinct[often] * SPREAD) >> np.uint32(32 - SLOT_BITS), return_index=True)
    return distinct[often[np.sort(first)]]


def _places(keys: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chosen pairs stand, and which; of overlapping places every second one of a run."""
    held, number = np.zeros(1 << SLOT_BITS, dtype=np.uint32), np.zeros(1 << SLOT_BITS, dtype=np.uint32)
    held[0] = NO_PAIR  # free slots hold a pair that has another slot: 0 has the first, and this one has not
    slot = (chosen * SPREAD) >> np.uint32(32 - SLOT_BITS)
    held[slot], number[slot] = chosen, np.arange(len(chosen), dtype=np.uint32)
    places, found = [], []
    for i in range(0, len(keys), SLICE):
        some = keys[i : i + SLICE]
        at = (some * SPREAD) >> np.uint32(32 - SLOT_BITS)
        hit = np.flatnonzero(held[at] == some)
        places.append(hit + i), found.append(number[at[hit]])
    places, found = np.concatenate(places), np.concatenate(found)
    follows = np.flatnonzero(places[1:] == places[:-1] + 1)  # those that overlap the next one
    order = np.arange(len(follows))
    begins = np.maximum.accumulate(np.where(np.diff(follows, prepend=-2) > 1, order, 0))
    kept = np.ones(len(places), dtype=bool)
    kept[follows[(order - begins) % 2 == 0] + 1] = False
    return places[kept], found[kept]


def _without(symbols: np.ndarray, kept: np.ndarray, into: np.ndarray) -> np.ndarray:
    """The symbols that are kept, written into other room."""
    n = 0
    for i in range(0, len(symbols), SLICE):
        some = symbols[i : i + SLICE][kept[i : i + SLICE]]
        into[n : n + len(some)] = some
        n += len(some)
    return into[:n]


def repair(ids: np.ndarray, lengths: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, their number by document, rules): the grammar of some documents' ids, end to end.

    Rule r stands for symbol terminals + r. No symbol spans two documents. Large arrays are used again each round.
    """
    room = [ids.astype(np.uint32), np.empty(len(ids), dtype=np.uint32)]
    symbols, last = room[0], np.cumsum(lengths)[lengths > 0] - 1
    buffer, sorted_buffer, flags = np.empty(len(ids), dtype=np.uint32), np.empty(len(ids), dtype=np.uint32), np.empty(len(ids), dtype=bool)
    rules: list[np.ndarray] = []
    free = SYMBOLS - terminals
    while (n := len(symbols)) >= 2 and free > 0:
        keys, ordered = buffer[: n - 1], sorted_buffer[: n - 1]
        np.left_shift(symbols[:-1], np.uint32(16), out=keys)
        np.bitwise_or(keys, symbols[1:], out=keys)
        keys[last[:-1]] = NO_PAIR
        ordered[:] = keys
        ordered.sort()
        chosen = _chosen(ordered, min(RULES_A_ROUND, free), flags)
        if not len(chosen):
            break
        places, found = _places(keys, chosen)
        # pairs that others' places have left but one of their own make no rule; they may in a later round
        paying = np.bincount(found, minlength=len(chosen)) > 1
        if not paying.any():
            break
        if not paying.all():
            places, found = places[paying[found]], (np.cumsum(paying, dtype=np.uint32) - np.uint32(1))[found[paying[found]]]
            chosen = chosen[paying]
        symbols[places] = found + np.uint32(SYMBOLS - free)
        kept = flags[:n]
        kept[:] = True
        kept[places + 1] = False
        last = last - np.searchsorted(places + 1, last, side="right")
        symbols = _without(symbols, kept, room[1])
        room.reverse()
        rules.append(np.stack([chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)], axis=1))
        free -= len(chosen)
    numbers = np.zeros(len(lengths), dtype=np.int64)
    numbers[lengths > 0] = np.diff(np.concatenate([[-1], last]))
    return symbols.astype("<u2"), numbers, np.concatenate(rules).astype("<u2") if rules else np.zeros((0, 2), dtype="<u2")


def _rounds(rules: np.ndarray, terminals: int) -> Iterator[tuple[int, int]]:
    """Ranges of rules whose symbols are terminals or rules before the range."""
    most, start = rules.max(axis=1) if len(rules) else np.zeros(0), 0
    while start < len(rules):
        later = np.nonzero(most[start:] >= terminals + start)[0]
        stop = start + int(later[0]) if len(later) else len(rules)
        yield start, stop
        start = stop


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that each symbol stands for; rules only use symbols made in earlier rounds or terminals."""
    lengths = np.ones(terminals + len(rules), dtype=np.int64)
    for start, stop in _rounds(rules, terminals):
        lengths[terminals + start : terminals + stop] = lengths[rules[start:stop]].sum(axis=1)
    return lengths


class Grammar:
    """A shard as read back."""

    def __init__(self, symbols: bytes, rules: bytes, rule_lengths: bytes, marks: bytes, terminals: int):
        self.symbols = np.frombuffer(symbols, dtype="<u2")
        self.rules = np.frombuffer(rules, dtype="<u2").reshape(-1, 2)
        self.marks = np.frombuffer(marks, dtype="<u8").astype(np.int64)
        self.lengths = np.concatenate([np.ones(terminals, dtype=np.int32), np.frombuffer(rule_lengths, dtype="<u4").astype(np.int32)])
        self.offsets = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)
        self.flat = np.arange(terminals, dtype="<u4")
        for start, stop in _rounds(self.rules, terminals):
            self.flat = np.concatenate([self.flat, self.expand(self.rules[start:stop].ravel())])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        out = [np.zeros(0, dtype="<u4")]
        for i in range(0, len(symbols), 1 << 15):  # slices that stay in the processor's cache
            some = symbols[i : i + (1 << 15)]
            lengths = self.lengths[some]
            ends = np.cumsum(lengths, dtype=np.int32)
            out.append(self.flat[np.arange(ends[-1], dtype=np.int32) + np.repeat(self.offsets[some] - ends + lengths, lengths)])
        return np.concatenate(out)

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop of the shard; only symbols near the span are expanded."""
        mark = max(0, int(np.searchsorted(self.marks, start, side="right")) - 1)
        last = min(len(self.symbols), int(np.searchsorted(self.marks, stop, side="left")) * STRIDE)
        out = self.expand(self.symbols[mark * STRIDE : last])
        before = int(self.marks[mark]) if len(self.marks) else 0
        return out[start - before : stop - before]


SHARD = (
    "part int, shard int, first_id long, n_docs long, n_ids long, before long, terminals int, "
    "doc_ids binary, doc_lengths binary, rules binary, rule_lengths binary, marks binary, symbols binary"
)


def written(docs: DataFrame, tokenizer_path: str, path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> str:
    """Writes the ids of all texts, in ascending id order, as grammar shards under path, and returns path.

    Null texts count as empty. end_id is appended to each document. Rows with a null id come first; rows of equal id
    lie next to each other, ordered by text. The shards are rows of Parquet files: part and shard give their order, before the ids of
    the part before the shard, then arrays of numbers: document ids and lengths, rules with the lengths of their
    expansions, the number of ids before every STRIDE-th symbol, and the symbols. No rows give no shards.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = byte_encoder(tokenizer_path), TaskContext.get().partitionId()
        terminals = enc.tokenizer.get_vocab_size(with_added_tokens=True)
        shard = before = 0
        for batch in batches:
            for i, j in slices(batch, pc.binary_length(batch.column(1)).to_pylist(), SHARD_BYTES):
                some = batch.slice(i, j - i)
                ids, lengths = enc.encode_all(some.column(1).to_pylist())
                if end_id is not None:
                    ids, lengths = np.insert(ids, np.cumsum(lengths), end_id), lengths + 1
                symbols, _, rules = repair(ids, lengths, terminals)
                sizes = expansion_lengths(rules, terminals)
                marks = np.concatenate([[0], np.cumsum(sizes[symbols])])[:-1][::STRIDE]
                keys = some.column(0).to_pylist()
                row = {
                    "part": part, "shard": shard, "first_id": keys[0], "n_docs": len(keys), "n_ids": int(lengths.sum()), "before": before, "terminals": terminals,
                    "doc_ids": pack_ids(keys), "doc_lengths": lengths.astype("<u4").tobytes(), "rules": rules.tobytes(),
                    "rule_lengths": sizes[terminals:].astype("<u4").tobytes(), "marks": marks.astype("<u8").tobytes(), "symbols": symbols.tobytes(),
                }
                yield pa.RecordBatch.from_pylist([row], schema=SHARD_SCHEMA)
                shard, before = shard + 1, before + row["n_ids"]

    docs.mapInArrow(shards, SHARD).write.option("compression", "zstd").parquet(path)
    return path


SHARD_SCHEMA = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("before", pa.int64()), ("terminals", pa.int32()),
    *((n, pa.binary()) for n in ("doc_ids", "doc_lengths", "rules", "rule_lengths", "marks", "symbols")),
])


def pack_ids(ids: list[int | None]) -> bytes:
    """A byte that tells null from other ids, for each, then the ids."""
    return bytes(x is None for x in ids) + np.array([x or 0 for x in ids], dtype="<i8").tobytes()


def unpack_ids(packed: bytes) -> list[int | None]:
    n = len(packed) // 9
    return [None if null else x for null, x in zip(packed[:n], np.frombuffer(packed[n:], dtype="<i8").tolist())]


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document of the shards under path, in no order.

    start counts the ids of all documents before it; ids are little-endian unsigned 32-bit integers. What lies before
    a part is summed over one row for each part, a number that the writer's setting bounds.
    """
    from pyspark.sql import Window

    shards = spark.read.parquet(path)
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grammar = Grammar(row["symbols"], row["rules"], row["rule_lengths"], row["marks"], row["terminals"])
                ids = grammar.expand(grammar.symbols)
                lengths = np.frombuffer(row["doc_lengths"], dtype="<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                keys = unpack_ids(row["doc_ids"])
                raw = ids.tobytes()
                starts = (ends - lengths).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(ends - lengths + row["base"] + row["before"], pa.int64()), pa.array([raw[4 * s : 4 * (s + n)] for s, n in zip(starts, lengths.tolist())], pa.binary())],
                    names=["doc_id", "start", "ids"],
                )

    return shards.join(F.broadcast(bases), "part").mapInArrow(documents, "doc_id long, start long, ids binary")
