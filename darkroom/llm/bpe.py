"""BPE encoding and decoding of whole texts, as the tokenizers library gives it, with tree concatenation.

Words between ASCII white space are encoded one by one and remembered, as neither the normalizer nor the
pre-tokenizer of the vocabulary reaches across white space. A long unsplit run is halved down to leaves, which are
encoded on their own; two neighbours are joined by encoding growing windows around the join again, until the first
and the last token of a window are the ones that stood there before. BPE keeps all tokens outside such a window:
a sequence is the encoding of its text when each two neighbours are the encoding of theirs.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import giving_back, shuffle_partitions, slices

#: Characters of an unsplit run that are encoded at once.
LEAF = 2048
#: Characters of a text from which its pieces are spread over tasks, and of a piece.
LONG, PIECE = 1 << 18, 1 << 15
#: Bytes of text that are encoded together.
BATCH = 1 << 20
#: Bytes of what an encoder remembers, about, in each of two generations; what an entry takes besides its word and ids;
#: the longest word that is remembered; and slots that tell which words it has met.
REMEMBERED, ENTRY, LONGEST, MET = 20 << 20, 160, 64, 1 << 22


#: Signs that are neither letters, digits nor an apostrophe: after a letter, the first of them begins a pre-token.
SIGNS = ".,;:!?|$%&#*"
#: Letters before this one are their own normal form and are letters to every pre-tokenizer.
PLAIN_BEFORE = "\u0250"


def plain(word: str) -> bool:
    """Whether a word is one pre-token of letters that a normalizer at most lowers."""
    return word.isalpha() and (word.isascii() or max(word) < PLAIN_BEFORE)


def without_signs(piece: str) -> str | None:
    """What stands before the signs at a piece's end, if a letter does."""
    if piece[-1:] in SIGNS:
        head = piece.rstrip(SIGNS)
        if head and head[-1].isalpha():
            return head
    return None


def _byte_letters() -> dict[int, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def form_of(tokenizer) -> tuple[dict | None, dict | None]:
    """What a tokenizer file says of its normalizer and its pre-tokenizer, without offsets, which ids do not depend on."""
    said = [json.loads(x.__getstate__()) if x is not None else None for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    for x in said:
        for part in [x, *(x.get("pretokenizers", []) if x else [])]:
            if part:
                part.pop("trim_offsets", None)
    return said[0], said[1]


#: The forms of file whose rules this package relies on: words end at white space, and signs after letters
#: begin a token. Files of any other form are read by the library alone, whole text by whole text.
BYTE_FORM = (None, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True})
WORD_FORM = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
    ]},
)


def byte_level(text: str) -> str:
    return text.encode("utf-8").decode("latin-1").translate(BYTE_LETTERS)


class Remembered(dict):
    """Bytes of the ids by word; a missing one is computed, and kept once it was missed twice: most words of a corpus
    come once, and would only push out others.

    What it holds is bounded by bytes: when a generation is full it becomes the old one, the one before is forgotten,
    and words of the old one that come again move to the young one.
    """

    def __init__(self, ids_of, kind: str, most: int = REMEMBERED):
        self.ids_of, self.kind, self.most, self.met, self.old, self.bytes = ids_of, kind, most, bytearray(MET), {}, 0

    def __missing__(self, word):
        ids = self.old.get(word)
        if ids is None:
            ids, slot = self.ids_of(word), hash(word) & (MET - 1)
            if not self.met[slot] or len(word) > LONGEST:
                self.met[slot] = 1
                return ids
        self[word] = ids
        self.bytes += ENTRY + 2 * len(word) + len(ids)
        return ids

    def clear(self) -> None:
        super().clear()
        self.met, self.old, self.bytes = bytearray(MET), {}, 0

    def turn(self) -> None:
        """To be called now and then: begins a new generation when the young one is full."""
        if self.bytes > self.most:
            old = dict(self)
            self.clear()
            self.old = old


def gathered(lists: pa.ListArray, ids_of: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, their number by list) for lists of words; each distinct word is looked up once."""
    coded = lists.flatten().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    found = list(map(ids_of.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
    flat = np.frombuffer(b"".join(found), dtype=ids_of.kind)
    lengths = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // flat.itemsize
    offsets = np.cumsum(lengths, dtype=np.int64) - lengths
    bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    out, ends = [flat[:0]], [np.zeros(1, dtype=np.int64)]
    for i in range(0, len(at), 1 << 15):  # slices that stay in the processor's cache
        some = at[i : i + (1 << 15)]
        each = lengths[some]
        upto = np.cumsum(each, dtype=np.int64)
        out.append(flat[np.arange(upto[-1]) + np.repeat(offsets[some] - upto + each, each)])
        ends.append(upto + ends[-1][-1])
    return np.concatenate(out), np.diff(np.concatenate(ends)[bounds])


class Encoder:
    """Encodes with a tokenizer file: by words and trees if its form is WORD_FORM and its model BPE without a decoder, else
    by the library alone."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding(), self.tokenizer.no_truncation()
        model = self.tokenizer.model
        self.usual = form_of(self.tokenizer) == WORD_FORM and type(model).__name__ == "BPE" and not model.dropout and self.tokenizer.decoder is None
        self.path, self.suffix = path, getattr(model, "end_of_word_suffix", None) or ""
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.tokens = np.array([self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))], dtype=object)
        self.known = Remembered(self.word, "<u4")

    @cached_property
    def unended(self):
        """The tokenizer without the mark of a word's end; only parts of long runs need it, so it is loaded for them."""
        from tokenizers import Tokenizer

        unended = Tokenizer.from_file(self.path)
        unended.model.end_of_word_suffix = None
        return unended

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of whole texts end to end, their number by text); null texts count as empty."""
        if not self.usual:
            found = [self.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts.to_pylist()]
            return np.array([i for x in found for i in x], dtype="<u4"), np.array(list(map(len, found)), dtype=np.int64)
        self.known.turn()
        return gathered(pc.ascii_split_whitespace(pc.fill_null(texts, "")), self.known)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text]))[0].tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word between white space, or of ''."""
        if len(word) > LEAF:
            return array("I", self.run(word)).tobytes()
        if (head := without_signs(word)) is not None:
            return self.known[head] + self.known[word[len(head) :]]
        if plain(word):
            low = word.lower()
            return array("I", [t.id for t in self.tokenizer.model.tokenize(low if low.isascii() else byte_level(low))]).tobytes()
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        if not self.usual:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(self.tokens[ids].tolist())

    def pretokens(self, run: str) -> Iterator[str | int]:
        """What the model sees of a run: byte-level strings, or the ids of added tokens in it."""
        for part in self.added_pattern.split(run) if self.added_pattern else [run]:
            if part in self.added:
                yield self.added[part]
            elif part:
                text = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
                    yield piece

    def run(self, run: str) -> list[int]:
        out: list[int] = []
        for piece in self.pretokens(run):
            out += [piece] if isinstance(piece, int) else self.tree(piece, True)
        return out

    def model(self, piece: str, final: bool) -> list[int]:
        """Ids of a part of a pre-token; only its final part carries the mark of a word's end."""
        return [t.id for t in (self.tokenizer if final else self.unended).model.tokenize(piece)]

    def tree(self, piece: str, final: bool) -> list[int]:
        if len(piece) <= LEAF:
            return self.model(piece, final)
        half = len(piece) // 2
        left, right = self.tree(piece[:half], False), self.tree(piece[half:], final)
        return self.joined(left, right, final)

    def symbols(self, ids: list[int], final: bool) -> str:
        """The byte-level string of some tokens; at a final end without the mark."""
        text = "".join(self.tokens[i] for i in ids)
        return text.removesuffix(self.suffix) if final else text

    def joined(self, left: list[int], right: list[int], final: bool) -> list[int]:
        """The encoding of two neighbouring parts from their encodings; final: the second ends the pre-token."""
        if not left or not right:
            return left + right
        k = 4
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            ends = final and b == len(right)
            window = self.symbols(left[-a:], False) + self.symbols(right[:b], ends)
            new = self.model(window, ends)
            starts_same = a == len(left) or new[0] == left[-a]
            ends_same = b == len(right) or new[-1] == right[b - 1]
            if starts_same and ends_same:
                return left[: len(left) - a] + new + right[b:]
            k *= 2


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(encoder: Encoder, text: str) -> Iterator[tuple[int, str]]:
    """Parts of a long text that can be encoded apart: (kind, part). Kind 0: whole words. Kind 1: part of a
    pre-token, to be joined with the next one. Kind 2: the final part of a pre-token. Kind 3: an added token's id."""
    if not encoder.usual:
        yield 0, text
        return
    plain: list[str] = []
    size = 0
    for word in text.encode("utf-8").split():
        if len(word) <= PIECE:
            if size + len(word) > PIECE:
                yield 0, " ".join(plain)
                plain, size = [], 0
            plain.append(word.decode("utf-8"))
            size += len(word) + 1
            continue
        yield 0, " ".join(plain)
        plain, size = [], 0
        for piece in encoder.pretokens(word.decode("utf-8")):
            if isinstance(piece, int):
                yield 3, str(piece)
                continue
            for i in range(0, len(piece), PIECE):
                yield (2 if i + PIECE >= len(piece) else 1), piece[i : i + PIECE]
    yield 0, " ".join(plain)


def _assembled(encoder: Encoder, parts: list[tuple[int, bytes]]) -> bytes:
    """Ids of a text from those of its parts; parts of one pre-token are joined pairwise, level by level."""
    out: list[bytes] = []
    waiting: list[list[int]] = []
    for kind, ids in parts:
        if kind in (0, 3):
            out.append(ids)
            continue
        waiting.append(np.frombuffer(ids, dtype="<u4").tolist())
        if kind == 2:
            while len(waiting) > 1:
                last = len(waiting) - 1
                waiting = [encoder.joined(waiting[i], waiting[i + 1], i + 1 == last) if i < last else waiting[i] for i in range(0, len(waiting), 2)]
            out.append(np.array(waiting[0], dtype="<u4").tobytes())
            waiting = []
    return b"".join(out)


def encoded(docs: DataFrame, tokenizer_path: str, text_col: str = "text", prefix: str = "") -> DataFrame:
    """All rows and columns of docs with the columns ids (binary, little-endian unsigned 32-bit integers) and decoded.

    Null texts count as empty: no ids, decoded ''. Columns of docs with these names are replaced. tokenizer_path is a
    file that every executor has. With a file of WORD_FORM, texts of over LONG characters are cut into pieces that
    separate tasks encode; any other file encodes each text whole.
    """
    docs = docs.drop(f"{prefix}ids", f"{prefix}decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = (f"{prefix}ids", f"{prefix}decoded")

    @giving_back
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(text_col) if at is None else at
            lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
            for i, j in slices(batch, lengths, BATCH):
                some = batch.slice(i, j - i)
                ids, numbers = enc.encode_all(some.column(at))
                ends = np.cumsum(numbers)
                own = [ids[e - n : e] for e, n in zip(ends.tolist(), numbers.tolist())]
                cols = [*some.columns, pa.array([x.tobytes() for x in own], pa.binary()), pa.array(map(enc.decode, own), pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*some.schema.names, *names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for row, text in zip(batch.column(batch.schema.get_field_index("row_key")).to_pylist(), batch.column(at).to_pylist()):
                kinds, parts = zip(*_pieces(enc, text))
                n = len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(kinds, pa.int32()), pa.array(parts, pa.string())], names=["row_key", "seq", "kind", "part"])

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            kinds, parts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ids = []
            for kind, part in zip(kinds, parts):
                if kind == 0:
                    ids.append(enc.encode(part))
                else:
                    ids.append(np.array([int(part)] if kind == 3 else enc.tree(part, kind == 2), dtype="<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], names=["row_key", "seq", "kind", "ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            parts = batch.column(batch.schema.get_field_index(held)).to_pylist()
            ids = [_assembled(enc, [(p["kind"], p["ids"]) for p in sorted(ps, key=lambda p: p["seq"])]) for ps in parts]
            texts = [enc.decode(np.frombuffer(x, dtype="<u4")) for x in ids]
            kept = [c for c in batch.schema.names if c != held]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=[*kept, *names])

    schema = f"{fields}, `{names[0]}` binary, `{names[1]}` string"
    size = F.coalesce(F.length(text_col), F.lit(0))
    short = docs.where(size <= LONG).mapInArrow(whole, schema)
    key = "row_key"
    while key in docs.columns:
        key += "_"
    held = "parts"
    while held in docs.columns:
        held += "_"
    long = docs.where(size > LONG).withColumn(key, F.monotonically_increasing_id())
    parts = long.select(F.col(key).alias("row_key"), F.col(text_col).alias("text")).mapInArrow(cut, "row_key long, seq int, kind int, part string")
    done = parts.repartition(shuffle_partitions(docs.sparkSession), "row_key", "seq").mapInArrow(encode_parts, "row_key long, seq int, kind int, ids binary")
    done = done.groupBy("row_key").agg(F.collect_list(F.struct("seq", "kind", "ids")).alias(held)).withColumnRenamed("row_key", key)
    joined = long.join(done, key).drop(key)
    return short.unionByName(joined.mapInArrow(assemble, schema))
