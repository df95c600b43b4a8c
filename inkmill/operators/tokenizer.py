"""Tokens of running text: lines, single ideographs and digits, signs, words without marks, word pieces.

Text is cut at special tokens, then into lines, with a separator for each line end. A line loses control
characters, its ideographs and digits stand alone, and white space ends words. A word is lower-cased and loses
its marks (what is left of its decomposed form without non-spacing marks), each sign in it is a token, and
what is between signs is cut into the longest known pieces. Common words are remembered. A null text has no tokens.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Collection, Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions.batches import by_parts, small_batches
from inkmill.functions.text import ALONE, PART_SEPARATOR, SEGMENT_SEPARATOR, SEP, UNK, as_column
from inkmill.operators.vocabulary import SPECIALS, Pieces

NEVER_CUT = (*SPECIALS, PART_SEPARATOR, SEGMENT_SEPARATOR)
#: Words whose pieces a worker remembers, and letters of these at most.
CACHE_WORDS, CACHE_LETTERS = 100_000, 64
SINGLE = re.compile(f"([{ALONE}])")


def _sign(c: str) -> bool:
    """ASCII signs count like punctuation, whatever their kind."""
    return (c.isascii() and c.isprintable() and not c.isalnum() and c != " ") or unicodedata.category(c)[0] == "P"


def _shown(c: str) -> str:
    if c in " \t\r" or unicodedata.category(c) == "Zs":
        return " "
    return "" if c == "�" or unicodedata.category(c)[0] == "C" else c


#: White space of the fast chain, in which other control characters vanish.
GAPS = re.compile("[^\t\n\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+|\n")
# The fast chain's blocks of ideographs, which stand alone.
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


class FastTokenizer:
    """Tokens of the fast chain, each with its span in the raw text.

    Special tokens are cut out; a line feed becomes the separator's letters; control characters vanish, ideographs,
    digits and signs stand alone, marks fall away, letters become lower case. Each character that is left
    remembers which one of the text it came from, through every step, so a token or a piece of one knows where it
    stands: from its first character to its last. Runs without white space are remembered with their spans.
    """

    def __init__(self, known: Collection[str] | None = None, never: Collection[str] = SPECIALS, unknown: str = UNK):
        self.pieces, self.unknown = None if known is None else Pieces(known, unknown), unknown
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(never, key=len, reverse=True)) + ")") if never else None
        self.letters: dict[str, tuple[str, bool]] = {}
        self.runs: dict[str, list[tuple[str, int, int]]] = {}

    def _letter(self, c: str) -> tuple[str, bool]:
        """(what becomes of a character, whether it stands alone)."""
        if (found := self.letters.get(c)) is None:
            if c in "\0�" or c not in "\t\n\r" and unicodedata.category(c)[0] == "C":
                found = ("", False)
            elif any(a <= ord(c) <= b for a, b in IDEOGRAPHS):
                found = ("".join(x.lower() for x in unicodedata.normalize("NFD", c)), True)
            else:
                plain = "".join(x.lower() for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
                found = (plain, False)
            self.letters[c] = found
        return found

    def _run(self, run: str) -> list[tuple[str, int, int]]:
        words: list[tuple[list[str], list[int]]] = [([], [])]
        for i, c in enumerate(run):
            plain, alone = self._letter(c)
            if alone:
                words.append(([], []))
            for x in plain:
                if unicodedata.category(x)[0] == "N" or _sign(x):
                    words += [([x], [i]), ([], [])]
                else:
                    words[-1][0].append(x)
                    words[-1][1].append(i)
            if alone:
                words.append(([], []))
        out = []
        for letters, origin in words:
            if not letters:
                continue
            word = "".join(letters)
            pieces = [word] if self.pieces is None else self.pieces(word)
            if pieces == [self.unknown] or len(pieces) == 1:
                out.append((pieces[0], origin[0], origin[-1] + 1))
                continue
            at = 0
            for n, piece in enumerate(pieces):
                size = len(piece) - (2 if n else 0)
                out.append((piece, origin[at], origin[at + size - 1] + 1))
                at += size
        return out

    def __call__(self, text: str | None) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        at = 0
        for i, part in enumerate(self.cut.split(text or "") if self.cut else [text or ""]):
            if i % 2:
                out.append((part, at, at + len(part)))
            else:
                for m in GAPS.finditer(part):
                    begin, run = at + m.start(), m[0]
                    if run == "\n":
                        out += [(t, begin, begin + 1) for t, _, _ in self._known(SEP)]
                    else:
                        out += [(t, begin + a, begin + b) for t, a, b in self._known(run)]
            at += len(part)
        return out

    def _known(self, run: str) -> list[tuple[str, int, int]]:
        if (found := self.runs.get(run)) is None:
            found = self._run(run)
            if len(run) <= CACHE_LETTERS:
                if len(self.runs) >= CACHE_WORDS:
                    self.runs.clear()
                self.runs[run] = found
        return found


class Shown(dict):
    """What each character is shown as, for str.translate."""

    def __missing__(self, code: int) -> str:
        found = self[code] = _shown(chr(code))
        return found


class Tokenizer:
    """Tokens of texts by a vocabulary; without one, words and signs are not cut into pieces."""

    def __init__(self, known: Collection[str] | None = None, never: Collection[str] = NEVER_CUT, unknown: str = UNK):
        self.pieces = None if known is None else Pieces(known, unknown)
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(never, key=len, reverse=True)) + ")")
        self.shown, self.words = Shown(), {}

    def word(self, word: str) -> list[str]:
        if (found := self.words.get(word)) is None:
            plain = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")
            parts = "".join(f" {c} " if _sign(c) else c for c in plain).split()
            found = parts if self.pieces is None else [p for x in parts for p in self.pieces(x)]
            if len(word) <= CACHE_LETTERS:
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                self.words[word] = found
        return found

    def __call__(self, text: str | None) -> list[str]:
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text or "")):
            if i % 2:
                out.append(part)
                continue
            for n, line in enumerate(part.split("\n")):
                if n:
                    out.append(SEP)
                for word in unicodedata.normalize("NFC", SINGLE.sub(r" \1 ", line.translate(self.shown))).split():
                    out += self.word(word)
        return out


def tokenized(text: Column | str, known: Collection[str] | None = None) -> Column:
    """The tokens of each text."""
    known = None if known is None else frozenset(known)
    small_batches()

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cut = Tokenizer(known)
        for texts in batches:
            yield by_parts(lambda part: pa.array([cut(t) for t in part.to_pylist()], pa.list_(pa.string())), texts)

    return run(as_column(text))


def spans(text: Column | str, known: Collection[str] | None = None) -> Column:
    """The fast chain's tokens of each text as (token, start, end), places in characters of the raw text."""
    kept = None if known is None else list(known)
    kind = pa.list_(pa.struct([("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    small_batches()

    @F.arrow_udf("array<struct<token:string,start:int,end:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cut = FastTokenizer(kept)

        def made(texts: pa.Array) -> pa.Array:
            found = [cut(t) for t in texts.to_pylist()]
            flat = [x for f in found for x in f]
            columns = [pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
            return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, names=["token", "start", "end"])).cast(kind)

        for texts in batches:
            yield by_parts(made, texts)

    return run(as_column(text))


def cuts(text: Column | str, found: Column | str) -> Column:
    """What each of the spans cuts from a text, in time in proportion to it: a place is reached from none but itself."""
    small_batches()

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        def made(texts: pa.Array, lists: pa.Array) -> pa.Array:
            places = lists.flatten()
            bounds = list(zip(places.field("start").to_pylist(), places.field("end").to_pylist()))
            out, at = [], 0
            for t, n in zip(texts.to_pylist(), pc.list_value_length(lists).to_pylist()):
                out.append(None if n is None else [t[a:b] for a, b in bounds[at : at + n]])
                at += n or 0
            return pa.array(out, pa.list_(pa.string()))

        for texts, lists in batches:
            yield by_parts(made, texts, lists)

    return run(as_column(text), as_column(found))


def looked_up(texts: Column | str, table: dict[str, int], unknown: int) -> Column:
    """For each array of texts, the ids of each: that of the text itself if it is one token, else those of its tokens."""
    small_batches()

    @F.arrow_udf("array<array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cut = Tokenizer(table)

        def ids(text: str | None) -> list[int]:
            return [table[text]] if text in table else [table.get(t, unknown) for t in cut(text)]

        def made(arrays: pa.Array) -> pa.Array:
            each = pa.array([ids(t) for t in arrays.flatten().to_pylist()], pa.list_(pa.int64()))
            size = pc.fill_null(pc.list_value_length(arrays), 0)
            bounds = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(size).cast(pa.int32())])
            return pa.ListArray.from_arrays(bounds, each, mask=arrays.is_null() if arrays.null_count else None)

        for arrays in batches:
            yield by_parts(made, arrays)

    return run(as_column(texts))
