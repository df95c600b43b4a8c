"""Fixed windows over the stream of all documents' tokens.

Only lengths go through a running total. Each document's tokens are then cut into the pieces that windows
take from it, and a window is put together from its pieces: rows are pieces, never single tokens. Between
tasks tokens travel as one text, a byte more each than their letters, where an array takes 16 or more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.operators.offsets import ranges, running


#: Documents in a range of the running total: fewer than where only lengths are summed.
ROWS_IN_RANGE = 5000


#: Stands between tokens on their way, and begins what stands for itself (e), for the former (b) and for null (n) within them.
BETWEEN, ESCAPE = "\x1f", "\x1b"


def sized(docs: DataFrame, columns: Sequence[str], tokens: str) -> DataFrame:
    """columns.., tokens as one text, len: how many they are."""
    kept = docs.select(*columns, F.col(tokens).alias("_tokens")).withColumn("_plain", F.array_join("_tokens", BETWEEN, ESCAPE + "n"))
    plain = F.octet_length("_plain") - F.octet_length(F.replace("_plain", F.lit(BETWEEN), F.lit(""))) == F.size("_tokens") - 1
    marked = F.transform("_tokens", lambda t: F.coalesce(F.replace(F.replace(t, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(BETWEEN), F.lit(ESCAPE + "b")), F.lit(ESCAPE + "n")))
    one = F.when(plain & ~F.contains("_plain", F.lit(ESCAPE)), F.col("_plain")).otherwise(F.array_join(marked, BETWEEN))
    return kept.select(*columns, one.alias("tokens"), F.size("_tokens").cast("long").alias("len"))


def _split(text: Column | str) -> Column:
    """The marked tokens of a text of at least one."""
    return F.split(text, BETWEEN)


def _cut(items: Column | str, start: Column, n: Column) -> Column:
    """Some of these as one text again."""
    return F.array_join(F.slice(items, (start + 1).cast("int"), n.cast("int")), BETWEEN)


def _unmarked(text: Column) -> Column:
    """The tokens that a text of at least one stands for."""

    def one(t: Column) -> Column:
        return F.when(t != ESCAPE + "n", F.replace(F.replace(t, F.lit(ESCAPE + "b"), F.lit(BETWEEN)), F.lit(ESCAPE + "e"), F.lit(ESCAPE)))

    return F.when(F.contains(text, F.lit(ESCAPE)), F.transform(_split(text), one)).otherwise(_split(text))


def _together(pieces: DataFrame, *by: str) -> DataFrame:
    """by.., tokens: the pieces (by.., at, piece) of each window in their order."""
    # dealt before they are listed: lists made earlier would be shuffled, and sorted, as well as pieces
    grouped = pieces.repartition(*by).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
    return grouped.select(*by, F.array_join("pieces.piece", BETWEEN).alias("_text")).select(*by, _unmarked(F.col("_text")).alias("tokens"))


def check(n: int, stride: int) -> None:
    if n <= 0 or stride <= 0:
        raise ValueError("window length and stride must be positive")


def windows(docs: DataFrame, key: str, tokens: str, n: int, stride: int | None = None, by: Sequence[str] = (), last: bool = False) -> DataFrame:
    """by.., w, tokens: each full window of n tokens, `stride` apart, over documents in the order of key.

    The stream of each group in `by` stands for itself. A short rest at the end makes no window.
    Documents without a key come first, as rests of a stream do, or last.
    """
    stride = stride or max(1, n // 2)
    check(n, stride)
    if stride > n:
        return _sparse_windows(docs, key, tokens, n, stride, by, last=last)
    by = list(by)
    # tokens go along to their range, so they are shuffled once
    met = running(sized(docs, [*by, key], tokens), key, "len", "at", by, ROWS_IN_RANGE, "total", last=last)
    first = F.greatest(F.floor((F.col("at") - n) / stride) + 1, F.lit(0))
    last = F.least(F.floor((F.col("at") + F.col("len") - 1) / stride), F.floor((F.col("total") - n) / stride))

    def piece(w):
        start = F.greatest(w * stride - F.col("at"), F.lit(0))
        end = F.least(w * stride + n - F.col("at"), F.col("len"))
        return F.struct(w.alias("w"), _cut("items", start, end - start).alias("piece"))

    some = met.where("len > 0 and total >= " + str(n)).withColumn("items", _split("tokens"))
    pieces = some.select(*by, "at", F.inline(F.when(last >= first, F.transform(F.sequence(first, last), piece))))
    return _together(pieces, *by, "w")


def starts(lengths: Iterable[int], n: int, stride: int) -> Iterator[int]:
    """Where windows start in a stream that is loaded document by document.

    With strides beyond n a start is brought forward to the end of what has been loaded so far.
    """
    loaded, at = 0, 0
    for length in lengths:
        loaded += length
        while loaded - at >= n:
            yield at
            at = min(at + stride, loaded)


def _followed(rest: np.ndarray, length: int, n: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """starts() for one document and many rests at once: (tokens behind the next start, windows)."""
    rest = rest + length
    made = np.where(rest >= n, (rest - n) // stride + 1, 0)
    return np.maximum(rest - made * stride, 0), made


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(range, at, len) of the runs of rows (range, at, len) of one range; a range may come in several runs."""
    for batch in batches:
        number, at, length = (c.to_numpy() for c in batch.columns)
        cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True][: len(number) + 1]) if len(number) else np.zeros(0, np.int64)
        for a, b in zip(cuts, [*cuts[1:], len(number)]):
            if a < b:
                yield int(number[a]), at[a:b], length[a:b]


def _passages(n: int, stride: int):
    """mapInArrow function: what each range makes of any rest: the rest behind it, and the windows, for rests of 0 to n - 1 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rests, which, made = None, None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([rests[which].tolist()], pa.list_(pa.int64())), pa.array([made.tolist()], pa.list_(pa.int64()))], names=["range", "rests", "made"])

        for number, _, length in _by_range(batches):
            if number != now:
                if now is not None:
                    yield row()
                now, rests, which, made = number, np.arange(n), np.arange(n), np.zeros(n, np.int64)
            for size in length:
                rests, more = _followed(rests, int(size), n, stride)
                made += more[which]
                # once two rests have met they stay together: soon few are left to follow
                if len(rests) > 1:
                    rests, met = np.unique(rests, return_inverse=True)
                    which = met[which]
        if now is not None:
            yield row()

    return run


def _begun(placed: DataFrame, n: int, stride: int, rows: int) -> DataFrame:
    """w, start of windows further apart than they are long, over documents (at, len) of some tokens each.

    Before a range of documents less than n tokens wait behind the next start, so what the range does is told by n
    numbers, whatever comes before it. These are put one behind the other, range by range, and give each
    range its first rest and window; then all ranges follow their own windows side by side.
    """
    dealt = placed.select(ranges(placed, "at", rows).alias("range"), "at", "len")
    ordered = dealt.repartition("range").sortWithinPartitions("range", "at")
    # as many rows as there are ranges, of n numbers each
    told = sorted(ordered.mapInArrow(_passages(n, stride), "range long, rests array<long>, made array<long>").collect())
    rest, w, heads = 0, 0, {}
    for r in told:
        heads[r.range] = (rest, w)
        rest, w = r.rests[rest], w + r.made[rest]
    shared = placed.sparkSession.sparkContext.broadcast(heads)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rest, w = None, 0, 0
        for number, at, length in _by_range(batches):
            if number != now:
                now, (rest, w) = number, shared.value[number]
            out = []
            for a, size in zip(at.tolist(), length.tolist()):
                after, made = _followed(np.array([rest]), size, n, stride)
                out += [a - rest + i * stride for i in range(int(made[0]))]
                rest = int(after[0])
            yield pa.RecordBatch.from_arrays([pa.array(range(w, w + len(out)), pa.int64()), pa.array(out, pa.int64())], names=["w", "start"])
            w += len(out)

    return ordered.mapInArrow(follow, "w long, start long")


def _sparse_windows(docs: DataFrame, key: str, tokens: str, n: int, stride: int, by: Sequence[str], rows: int = ROWS_IN_RANGE, last: bool = False) -> DataFrame:
    """Windows further apart than they are long: each start depends on the one before and on where documents end."""
    if by:
        raise ValueError("strides beyond the window length are for one stream")
    met = running(sized(docs, [key], tokens), key, "len", "at", rows=rows, last=last).where("len > 0")
    begun = _begun(met.select("at", "len"), n, stride, rows)
    # windows and documents meet in cells of n tokens; either touches few cells
    cells = begun.select("w", "start", F.explode(F.sequence(F.floor(F.col("start") / n), F.floor((F.col("start") + n - 1) / n))).alias("cell"))

    def shelf(cell):
        # of a document a cell holds its own tokens alone
        start = F.greatest(cell * n - F.col("at"), F.lit(0))
        some = F.least((cell + 1) * n - F.col("at"), F.col("len")) - start
        return F.struct(cell.alias("cell"), (F.col("at") + start).alias("at"), some.alias("len"), _cut("items", start, some).alias("tokens"))

    held = F.transform(F.sequence(F.floor(F.col("at") / n), F.floor((F.col("at") + F.col("len") - 1) / n)), shelf)
    shelves = met.withColumn("items", _split("tokens")).select(F.inline(held))
    pieces = shelves.join(cells, "cell").where("start < at + len and start + %d > at" % n)
    a = F.greatest(F.col("start") - F.col("at"), F.lit(0))
    b = F.least(F.col("start") + n - F.col("at"), F.col("len"))
    return _together(pieces.select("w", "at", _cut(_split("tokens"), a, b - a).alias("piece")), "w")


def epochs(docs: DataFrame, n: int) -> DataFrame:
    """The documents n times, by `epoch`; packing by epoch lets no rest of one reach into the next."""
    return docs.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
