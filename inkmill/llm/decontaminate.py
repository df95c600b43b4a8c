"""Benchmark decontamination: edit distance within a budget, found through exact pieces.

A test item of m characters may differ by up to k = floor(m * BUDGET) edits. Cut into k + 1 pieces, one
piece at least stands unharmed in any text that holds the item within k edits (pigeonhole). One
automaton finds all pieces of all items in a text; around each hit Myers' bit-parallel algorithm gives
the least edit distance of the whole item to any passage there. Nothing is missed: what lies within the
budget has a hit, and the window around a hit is wide enough for k edits on either side.

Both sides are lower-cased, and each run of ASCII signs and white space becomes one space.

Items are few and fixed: they are taken in blocks of `ITEM_CHARS` characters, one pass over the
documents for each block, so that the automaton a worker holds stays bounded whatever the benchmark.

Defined results: null and empty texts match nothing, nor do items that are null or without a letter or
digit; an item shorter than `LEAST_CHARS` has a budget of 0; equal items each give their own match;
equal documents each give their own rows; empty tables give no matches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm._shared import small_batches

BUDGET, LEAST_CHARS, ITEM_CHARS = 0.08, 40, 500_000
SIGNS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normalise(text: str | None) -> str:
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(SIGNS).split()).decode()


def budget(item: str, share: float = BUDGET) -> int:
    return int(len(item) * share) if len(item) >= LEAST_CHARS else 0


def least_distance(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the passage of text closest to item, the first of equals; None beyond most."""
    m = len(item)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best: tuple[int, int] | None = None
    masks_get = masks.get
    for at, c in enumerate(text):
        eq = masks_get(c, 0)
        cross = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(cross | up)), up & cross
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(cross | plus)), plus & cross
        if score <= most:
            best, most = (score, at + 1), score - 1
            if not score:
                break
    return best


class Matcher:
    """Finds items (item_id, normalised text) in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], share: float = BUDGET):
        self.items = [(i, t, budget(t, share)) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, t, k) in enumerate(self.items):
            ends = [len(t) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(ends, ends[1:]):
                places[t[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def __call__(self, text: str) -> list[tuple[int, int]]:
        """(item_id, least distance) of the items that text holds within their budgets."""
        if self.empty or not text:
            return []
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for end, (length, where) in self.automaton.iter(text):
            for n, offset in where:
                _, item, k = self.items[n]
                start = end + 1 - length - offset
                a, b = max(0, start - k), min(len(text), start + len(item) + k)
                spans = windows[n]
                if spans and a <= spans[-1][1] and a >= spans[-1][0]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
        found = []
        for n, spans in windows.items():
            item_id, item, k = self.items[n]
            most, best = k, None
            for a, b in spans:
                if b - a < len(item) - most:
                    continue
                if (hit := least_distance(item, text[a:b], most)) is not None:
                    best, most = hit[0], hit[0] - 1
                    if not best:
                        break
            if best is not None:
                found.append((item_id, best))
        return sorted(found)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, normalised, in blocks of bounded size."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if item := normalise(row.text):
            block.append((row.item_id, item))
            size += len(item)
            if size >= ITEM_CHARS:
                yield block
                block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance: each item that a document holds within its budget."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = []
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in batches:
                rows = [(d, i, n) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for i, n in matcher(normalise(t))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "distance"])

        parts.append(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, distance int"))
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long, distance int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item of the benchmark."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index("text")
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in batches:
                yield batch.filter(pa.array([not (t and matcher(normalise(t))) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs, benchmark).select("doc_id", "item_id", F.col("distance").cast("long").alias("distance"))
