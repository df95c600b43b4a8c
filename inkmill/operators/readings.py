"""Readings of ideographs by phrase tables, which are given as arguments.

A text is read from its left: the longest phrase of the table that begins at a place gives the readings of all its
characters, so that a character is read as its phrase wants it; where none begins, the character has its own
reading, or stands for itself. What is no ideograph is left to the tokenizer of running text, run by run,
so there are as many readings as that has tokens. A null text has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions.batches import by_parts, small_batches
from inkmill.functions.text import as_column
from inkmill.operators.tokenizer import IDEOGRAPHS, Tokenizer

HAN = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in IDEOGRAPHS) + "]+)")


class Reader:
    """Reads texts by phrases (each with a reading for every character) and single characters."""

    def __init__(self, phrases: Mapping[str, Sequence[str]], singles: Mapping[str, str]):
        if any(len(p) != len(r) or not p for p, r in phrases.items()):
            raise ValueError("a phrase needs a reading for each of its characters")
        self.singles, self.others = dict(singles), Tokenizer()
        # a node: what goes on from it by the next character, and the readings of a phrase that ends there
        self.root: dict = {}
        for phrase, readings in phrases.items():
            node = self.root
            for c in phrase:
                node = node.setdefault(c, {})
            node[""] = list(readings)

    def run(self, run: str) -> list[str]:
        out: list[str] = []
        at = 0
        while at < len(run):
            node, best, end = self.root, None, at
            while end < len(run) and (node := node.get(run[end])) is not None:
                end += 1
                best = node.get("", best)
            if best is None:
                out.append(self.singles.get(run[at], run[at]))
                at += 1
            else:
                out += best
                at += len(best)
        return out

    def __call__(self, text: str | None) -> list[str]:
        out: list[str] = []
        for i, part in enumerate(HAN.split(text or "")):
            out += self.run(part) if i % 2 else self.others(part)
        return out


def readings(text: Column | str, phrases: Mapping[str, Sequence[str]], singles: Mapping[str, str]) -> Column:
    """The readings of each text."""
    small_batches()

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = Reader(phrases, singles)
        for texts in batches:
            yield by_parts(lambda part: pa.array([read(t) for t in part.to_pylist()], pa.list_(pa.string())), texts)

    return run(as_column(text))
