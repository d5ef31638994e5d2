"""Personal data in texts, plain or disguised, by transducers that remember where each character comes from.

Plain data is found first, by patterns over the text as it stands. Then transducers rewrite the text: homoglyphs and wide
forms become ASCII, invisible characters go, disguised at and dot signs and spelled digits become signs. Each
rewritten character keeps the span of source characters it stands for, so what the same patterns find in the rewritten
text maps back to the source. Only what touches a rewritten character is new; plain finds all stay.

Words alone are weak evidence: `at` and `dot` count as signs only within an address whose last label is a known
one, and spelled digits only where what they make passes the same checks as plain data.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import slices

#: Kinds in the order they are listed, and the digits a card or phone number may have.
KINDS = ("email", "ip", "card", "phone")
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)
#: Letters of other scripts that look like a Latin one.
LOOKALIKES = dict(zip(
    "авеёкмнорстухіѕјԁһԛԝ" "АВЕЁКМНОРСТУХІЅЈҺԚԜ" "αεικνορτυχγ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ɑɡıɩʟο‚",
    "abeekmhopctyxisjdhqw" "ABEEKMHOPCTYXISJHQW" "aeikvoptuxy" "ABEZHIKMNOPTYX" "agiilo,",
))
#: Last labels of addresses that words alone may spell.
LABELS = frozenset(
    "com org net edu gov mil int info biz name io co ai app dev me tv cc eu us uk de fr es it nl be ch at pl pt se no dk fi ie cz ru ua tr gr "
    "ca mx br ar cl au nz jp cn kr in za example test invalid local localhost".split()
)
#: The digits as words of English, German, French and Spanish.
DIGIT_WORDS = {
    word: str(i)
    for words in (
        "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, word in enumerate(words.split())
} | {"oh": "0", "nought": "0", "fuenf": "5"}
TIMES = {"double": 2, "triple": 3}
#: Signs that stand for an uncertain one until the address they make is judged: a worded at, a worded dot, a dot between
#: spaces, and an at between spaces.
SOFT_AT, SOFT_DOT, SPACED_DOT, SPACED_AT = "", "", "", ""
#: Bytes of text that are read together.
BATCH = 4 << 20

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    """Whether a card number passes its checksum."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _begin(text: str, at: int, least: int, allowed: frozenset = _LOCAL) -> int:
    """Where the run of allowed characters that ends before `at` begins, not before `least`."""
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of addresses: the run before each at sign and the labels after it. Looking back from the sign finds the leftmost
    match without trying each character of a long run."""
    found, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = _begin(text, m.start(), last)
        if start < m.start():
            last = m.end()
            found.append((start, last))
    return found


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def numbers(text: str) -> list[Span]:
    """Spans of ip addresses, card and phone numbers; matches that fail their checks are dropped, not tried again."""
    found = [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0]:
            digits = _digits(m.group())
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and _luhn(digits):
                found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if PHONE_DIGITS[0] <= len(_digits(m.group())) <= PHONE_DIGITS[1]:
            found.append(("phone", m.start(), m.end()))
    return found


def plain(text: str) -> list[Span]:
    """What stands in a text undisguised."""
    return [("email", i, j) for i, j in emails(text)] + numbers(text)


class Mapped:
    """A rewritten text; starts and ends give the source span of each of its characters, and changed says which were
    rewritten."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None, changed: np.ndarray | None = None):
        self.text = text
        self.starts = np.arange(len(text)) if starts is None else starts
        self.ends = self.starts + 1 if ends is None else ends
        self.changed = np.zeros(len(text), dtype=bool) if changed is None else changed

    def rewritten(self, pieces: list[tuple[int, int, str]]) -> Mapped:
        """With each (start, end, new text), in order and apart, put in; what is new stands for the whole piece."""
        if not pieces:
            return self
        texts, at = [], 0
        for i, j, new in pieces:
            texts += [self.text[at:i], new]
            at = j
        first, last = (np.array([p[k] for p in pieces], dtype=np.int64) for k in (0, 1))
        long = np.array([len(p[2]) for p in pieces], dtype=np.int64)
        edge = np.zeros(len(self.text) + 1, dtype=np.int64)
        edge[first] += 1
        np.subtract.at(edge, last, 1)
        kept = np.cumsum(edge)[:-1] == 0
        # where among the kept characters those of each piece go
        to = np.repeat(first - (np.cumsum(last - first) - (last - first)), long)
        starts = np.insert(self.starts[kept], to, np.repeat(self.starts[first], long))
        ends = np.insert(self.ends[kept], to, np.repeat(self.ends[last - 1], long))
        return Mapped("".join([*texts, self.text[at:]]), starts, ends, np.insert(self.changed[kept], to, True))

    def source(self, i: int, j: int) -> tuple[int, int]:
        return int(self.starts[i]), int(self.ends[j - 1])

    def disguised(self, i: int, j: int) -> bool:
        """Whether a span holds a rewritten character, or one is gone from within it."""
        return bool(self.changed[i:j].any()) or int(self.ends[j - 1] - self.starts[i]) != j - i


@cache
def _plain_of(c: str) -> str | None:
    """The ASCII text a character stands for; empty if it is invisible, None if it stays."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if SOFT_AT <= c <= SPACED_AT:
        return "\ufffd"
    kind = unicodedata.category(c)
    if kind == "Cf" or "︀" <= c <= "️":
        return ""
    if kind == "Nd":
        return str(unicodedata.decimal(c))
    if kind == "Pd" or c == "−":
        return "-"
    if kind == "Zs":
        return " "
    if c == "。":
        return "."
    if unicodedata.decomposition(c).split(" ")[0] in ("<super>", "<sub>", "<fraction>"):
        return None
    new = unicodedata.normalize("NFKC", c)
    return new if len(new) == 1 and "!" <= new <= "~" else None


_ODD = re.compile(r"[^\x00-\x7f]")


def unmasked(mapped: Mapped) -> Mapped:
    """Homoglyphs, wide and mathematical forms, foreign digits, dashes and spaces as ASCII; invisible characters gone."""
    if mapped.text.isascii():
        return mapped
    odd = {c: new for c in set(_ODD.findall(mapped.text)) if (new := _plain_of(c)) is not None}
    if not odd:
        return mapped
    kept = re.compile(f"[{re.escape(''.join(odd))}]")
    return mapped.rewritten([(m.start(), m.end(), odd[m.group()]) for m in kept.finditer(mapped.text)])


_AT, _DOT = r"(?:at|arroba|arobase|ät)", r"(?:dot|punkt|punto|point)"
_LINE, _HYPHEN = r"underscore", r"(?:dash|hyphen)"
_GAP = r"(?:[ \t]{1,3}|[ \t]?[-_*~|/][ \t]?)"
_OPEN, _CLOSE = r"[ \t]{0,3}[\[({<][ \t]{0,2}", r"[ \t]{0,2}[\])}>][ \t]{0,3}"
#: Forms of at and dot signs between characters of an address: in brackets, spaced, and as words between gaps.
_SIGNS = re.compile(
    rf"(?<=[A-Za-z0-9])(?:(?P<at>{_OPEN}(?:{_AT}|@){_CLOSE}|&#0*64;|&commat;|%40)|(?P<dot>{_OPEN}(?:{_DOT}|\.){_CLOSE}|&#0*46;|&period;|%2E)|(?P<spaced_at>[ \t]{{1,3}}@[ \t]{{0,3}}|@[ \t]{{1,3}})"
    rf"|(?P<spaced_dot>[ \t]{{1,3}}\.[ \t]{{1,3}})|(?P<soft_at>{_GAP}{_AT}{_GAP})|(?P<soft_dot>{_GAP}{_DOT}{_GAP})"
    rf"|(?P<line>{_GAP}{_LINE}{_GAP})|(?P<hyphen>{_GAP}{_HYPHEN}{_GAP}))(?=[A-Za-z0-9])",
    re.IGNORECASE,
)
_SIGN_OF = {"at": "@", "dot": ".", "spaced_at": SPACED_AT, "spaced_dot": SPACED_DOT, "soft_at": SOFT_AT, "soft_dot": SOFT_DOT, "line": "_", "hyphen": "-"}
_SOFT_DOMAIN = re.compile(f"[@{SOFT_AT}{SPACED_AT}]([A-Za-z0-9-]+(?:[.{SOFT_DOT}{SPACED_DOT}][A-Za-z0-9-]+)+)")
_SOFT_LABEL = re.compile(f"([.{SOFT_DOT}{SPACED_DOT}])([A-Za-z0-9-]+)")
_SOFT_LOCAL = _LOCAL | {SOFT_DOT}


def signed(mapped: Mapped) -> Mapped:
    """Disguised at and dot signs as signs, uncertain ones as the SOFT_ and SPACED_ characters."""
    return mapped.rewritten([(m.start(), m.end(), _SIGN_OF[m.lastgroup]) for m in _SIGNS.finditer(mapped.text)])


def _soft_emails(mapped: Mapped) -> Iterator[tuple[int, int]]:
    """Addresses of a signed text. Labels after an uncertain dot count up to the last known one; a worded at needs a
    worded dot, or a local part that no plain word is, too."""
    text, last = mapped.text, 0
    for m in _SOFT_DOMAIN.finditer(text):
        start = _begin(text, m.start(), last, _SOFT_LOCAL)
        while start < m.start() and text[start] == SOFT_DOT:
            start += 1
        labels = [(x.group(1), x.group(2), x.end()) for x in _SOFT_LABEL.finditer(text, m.start() + 1, m.end())]
        end = next((e for sign, label, e in reversed(labels) if sign == "." or label.lower() in LABELS), None)
        if start == m.start() or end is None:
            continue
        sure = text[m.start()] != SOFT_AT or any(c in text[m.start() + 1 : end] for c in (SOFT_DOT, SPACED_DOT)) or not text[start : m.start()].isalpha()
        if sure:
            last = end
            yield start, end


_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_TOKEN = rf"(?:(?:{'|'.join(TIMES)})[ \t]{{1,3}}(?:{_WORDS})|{_WORDS}|[0-9]++|dot|punkt|punto|point|plus|dash|hyphen)"
_BETWEEN = r"(?:[ \t]{1,3}|[ \t]?[,-][ \t]?)"
_CHAIN = re.compile(rf"(?<![^\W_]){_TOKEN}(?:{_BETWEEN}{_TOKEN})*+(?![^\W_])", re.IGNORECASE)
_PART = re.compile(rf"({_TOKEN})({_BETWEEN})?", re.IGNORECASE)
_DEFANGED = re.compile(r"(?<=[0-9])(?:[ \t]?[\[({<][ \t]?(?:\.|dot)[ \t]?[\])}>][ \t]?|[ \t]{1,2}\.[ \t]{1,2})(?=[0-9])", re.IGNORECASE)
_LETTERED = re.compile(r"(?<![A-Za-z0-9])[0-9OolI](?:[ .()-]?[0-9OolI])+(?![A-Za-z0-9])")
_LETTER_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1"}


def _spelled(chain: str) -> Iterator[tuple[int, int, str]]:
    """The pieces of a chain of digit words, digits and signs; spaces beside a word go."""
    parts = list(_PART.finditer(chain))
    for i, m in enumerate(parts):
        word = m.group(1).lower()
        many, _, digit = word.partition(" ")
        if word in DIGIT_WORDS:
            new = DIGIT_WORDS[word]
        elif many in TIMES:
            new = DIGIT_WORDS[digit.strip()] * TIMES[many]
        elif word.isdecimal():
            new = None
        else:
            new = "+" if word == "plus" else "-" if word in ("dash", "hyphen") else "."
        if new is not None:
            yield m.start(1), m.end(1), new
        gap = m.group(2)
        beside = i + 1 < len(parts) and not (new is None and parts[i + 1].group(1).isdecimal())
        if gap and beside:
            yield m.start(2), m.end(2), ""


def counted(mapped: Mapped, low: str) -> Mapped:
    """Spelled digits, worded and bracketed dots between digits, and letters in place of digits as what they stand for;
    low is the text in lower case."""
    if _may_be_spelled(low):
        pieces = []
        for m in _CHAIN.finditer(mapped.text):
            # one word beside digits is more often a word than a digit
            words = [x.group(1).lower() for x in _PART.finditer(m.group()) if not x.group(1).isdecimal()]
            if len(words) > 1 or "plus" in words:
                pieces += [(m.start() + i, m.start() + j, new) for i, j, new in _spelled(m.group())]
        mapped = mapped.rewritten(pieces)
    if _BRACKETED_DOT.search(mapped.text):
        mapped = mapped.rewritten([(m.start(), m.end(), ".") for m in _DEFANGED.finditer(mapped.text)])
    if not _BESIDE_DIGIT.search(mapped.text):
        return mapped
    pieces = []
    for m in _LETTERED.finditer(mapped.text):
        letters = [i for i in range(m.start(), m.end()) if mapped.text[i] in _LETTER_DIGITS]
        if letters and 3 * len(letters) <= m.end() - m.start():
            pieces += [(i, i + 1, _LETTER_DIGITS[mapped.text[i]]) for i in letters]
    return mapped.rewritten(pieces)


def _inside(text: str, i: int, j: int) -> bool:
    """Whether a find is cut out of a longer word of another script."""
    return (i > 0 and not text[i - 1].isascii() and text[i - 1].isalpha()) or (j < len(text) and not text[j].isascii() and text[j].isalpha())


# What a text must hold, in lower case, before a transducer can find anything in it. These only save time.
_NEAR_AT = re.compile(r"[ \t\])}>]@|@[ \t\])}>]|@[a-z0-9.-]+[ \t\[({<_*~|/-]{1,5}(?:dot|pun|poi|\.)")
_WORDED_AT = re.compile(r"[^a-z0-9](?:at|ät|arroba|arobase)[ \t\])}>*_~|/-]{1,6}[a-z0-9-]+(?:[.&%]|[ \t\[({<_*~|/-]{1,6}(?:dot|pun|poi|\.))")
_BRACKETED_DOT = re.compile(r"[0-9][ \t]{0,2}[\[({<.][ \t]{0,2}(?:[.\])}> \t]|dot)")
_BESIDE_DIGIT = re.compile(r"[0-9](?:[ .()-]?[OolI]{1,4}(?![A-Za-z])|(?<=[OolI].)|(?<=[OolI][ .()-].))")
_CHAINED = frozenset(DIGIT_WORDS) | frozenset(TIMES) | frozenset("dot punkt punto point plus dash hyphen".split())
_APART = str.maketrans(",-()[]", "      ")


def _may_be_signed(low: str) -> bool:
    return ("@" in low and bool(_NEAR_AT.search(low))) or bool(_WORDED_AT.search(low)) or any(x in low for x in ("&#", "&commat", "&period", "%40", "%2e"))


def _may_be_spelled(low: str) -> bool:
    """Whether two words or digits of a number stand side by side, one of them a word."""
    words = low.translate(_APART).split()
    if _CHAINED.isdisjoint(words):
        return False
    kind = [1 if w in _CHAINED else 2 if w.isdecimal() else 0 for w in words]
    return any(a and b and a + b < 4 for a, b in zip(kind, kind[1:]))


def disguised(text: str, known: list[Span]) -> list[Span]:
    """What only rewriting shows, but for addresses within a known one, and numbers that share a part with a known one."""
    seen, found = unmasked(Mapped(text)), set()
    low = seen.text.lower()
    rewritten = seen.text is not text
    signs = signed(seen) if _may_be_signed(low) else seen
    if rewritten or signs is not seen:
        found.update(("email", i, j) for i, j in _at_source(signs, _soft_emails(signs)))
    digits = counted(seen, low)
    if rewritten or digits is not seen:
        for kind, i, j in numbers(digits.text):
            found.update((kind, *x) for x in _at_source(digits, [(i, j)]))
    within = lambda x, i, j: i <= x[1] and x[2] <= j if x[0] == "email" else i < x[2] and x[1] < j
    return [x for x in found if not any(k == x[0] and within(x, i, j) for k, i, j in known)]


def _at_source(mapped: Mapped, spans: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for i, j in spans:
        if mapped.disguised(i, j) and not _inside(mapped.text, i, j):
            yield mapped.source(i, j)


def spans_of(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, added) of all finds by kind, then start; ends are exclusive, in code points."""
    known = plain(text)
    rows = [(*x, False) for x in known] + [(*x, True) for x in disguised(text, known)]
    return sorted(rows, key=lambda r: (KINDS.index(r[0]), r[1], r[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))
_NAMES = ("kind", "start", "end", "added")


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) per row of docs: an array of kind, start, end and added, as spans_of gives them.

    Texts are read whole; a null or empty text has no spans. Repeated rows and null ids stay, other columns are not
    read, no rows give no rows. Each row stands alone, so no key can be hot.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch, pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), BATCH):
                some = batch.slice(i, j - i)
                spans = [[dict(zip(_NAMES, s)) for s in spans_of(text)] if text else [] for text in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(spans, _SPANS)], names=["id", "spans"])

    return rows.mapInArrow(of, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long, added: boolean>>")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
