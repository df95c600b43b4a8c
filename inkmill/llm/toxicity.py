"""Toxicity from two class-conditional Kneser-Ney models over the bytes of words.

Each word, lower-cased and closed by spaces, is generated byte by byte from up to seven bytes before it.
Toxic and ordinary training rows have counts of their own for these sequences; what a class has seen too
rarely falls back on one Kneser-Ney model of both classes together, whose lower orders count the distinct
sequences that a suffix ends (continuation counts). `SHARED_WEIGHT` counts of that shared model are added
to each context, so that rare expressions lean on it whatever a class's size.

A word's evidence is the difference of its log-likelihoods under both models. A text's base figure `whole`
is the length-normalised difference, the mean of its words' evidence. A few toxic words hardly move the
mean of a long text that is ordinary otherwise, so two more figures go with it into a logistic curve, which
is fitted on labelled rows that the counts have not seen: `part`, the mean of the words' likelihood ratios
before the logarithm is taken, and `second`, the evidence of the second most toxic word, as a single odd
word may be chance. The fit pulls its weights to those of `USUAL_CURVE`, as `PULL` rows would: few rows hardly
move it away, many take no notice, and a class of one document leaves it as it is.

Up to `CROSS_ROWS` labelled documents all are used twice: parted within each class into `FOLDS` parts or as many as
the rarer class has documents, each part has its figures from counts of the others, and counts of all make the
model. Of more documents a part of each class is set aside for the curve, at most half of it and
together about `CURVE_ROWS`, those with the least hashes of doc_id; counts cover all others. A sequence is one
64-bit number, its bytes. All that a sequence's probability needs shares the last two bytes of its
context, so the model is worked out in tasks that each have all sequences of some such pairs; only the
orders 1 and 2, at most 65,536 sequences, are gathered. Up to `MOST_GRAMS` sequences the evidence is
broadcast; beyond, texts are cut into words, whose evidence comes from joins.

Defined results: null, empty and wordless texts have the score of a text without evidence; without
labelled training rows of both classes every score is 0; a doc_id with several labels is toxic if one of them says
so; null labels and null doc_ids teach nothing; equal texts have equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.llm._shared import cut, hash_order, held_out, small_batches

#: Bytes in a sequence: as many as a 64-bit number holds.
ORDER, DISCOUNT, SHARED_WEIGHT = 8, 0.75, 60.0
FIGURES = ("whole", "part", "second")
FIGURE_KINDS = ", ".join(f"{f} double" for f in FIGURES)
CURVE_ROWS, CURVE_SHARE, CURVE_LEAST = 20_000, 0.25, 50
CROSS_ROWS, FOLDS = 5000, 4
#: Weights of `FIGURES` and the offset as on tables of many rows, and the rows that speak for them.
USUAL_CURVE, PULL = (-2.0, 3.0, 2.0, -7.0), (5.0, 5.0, 5.0, 0.1)
#: Sequences (12 bytes each) and contexts that are broadcast at most; more are joined.
MOST_GRAMS = 16_000_000
#: Sequences in a task that works out their evidence.
GRAMS_IN_TASK = 1_000_000
#: Labels up to this number are broadcast to the texts; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
THRESHOLD = 0.7
#: Words whose evidence a worker remembers, and words it counts before it passes their sequences on.
CACHE_WORDS, COUNTED_WORDS = 200_000, 150_000
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sequences, places of their words): for each byte of a word and its closing space, that byte behind up to seven."""
    data = np.frombuffer(f" {' '.join(words)} ".encode("utf-8", "replace"), np.uint8)
    space = data == 32
    at = np.arange(len(data))
    # a word's closing space is the next one's opening space
    start = np.r_[0, np.maximum.accumulate(np.where(space, at, 0))[:-1]]
    out = np.zeros(len(data), np.uint64)
    for k in range(min(ORDER, len(data))):
        out[k:] |= np.where(at[k:] - k >= start[k:], data[: len(data) - k], 0).astype(np.uint64) << np.uint64(8 * k)
    return out[1:], (np.cumsum(space) - 1)[:-1]


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys in order, the sums of each of the values)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (text, toxic), the sequences with their counts in both classes."""
    words: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        seen = list(words[0].keys() | words[1].keys())
        found, place = grams(seen) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        counts = [np.array([words[y][w] for w in seen], np.int64)[place] for y in (0, 1)]
        keys, n0, n1 = _sums(found, *counts)
        for y in (0, 1):
            words[y].clear()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n0), pa.array(n1)], names=["gram", "n0", "n1"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words[toxic].update(words_of(text))
            if len(words[0]) + len(words[1]) >= COUNTED_WORDS:
                yield flush()
    yield flush()


def _mask(n: int) -> np.uint64:
    """Of the last n bytes."""
    return np.uint64((1 << 8 * n) - 1)


def _smoothed(count: np.ndarray, context: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Kneser-Ney probabilities of sequences in order, from their counts and the probabilities of their suffixes."""
    _, total, kinds = _sums(context, count, np.ones(len(count), np.int64))
    group = np.cumsum(np.r_[False, context[1:] != context[:-1]])[: len(context)]
    return (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds[group] * below) / total[group]


def short_orders(pairs: dict[int, int], begins: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of single bytes, of pairs of bytes): of pairs with their continuation counts, and those that begin words."""
    one = np.zeros(1 << 8)
    known = np.array(sorted({*pairs, *begins}), np.int64)
    ends, times = np.unique(known & 0xFF, return_counts=True)
    if len(ends):
        one[ends] = (np.maximum(times - DISCOUNT, 0) + DISCOUNT * len(ends) / 256) / times.sum()
    two = np.zeros(1 << 16)
    h = np.array(sorted(pairs), np.uint64)
    if len(h):
        two[h] = _smoothed(np.array([pairs[int(x)] for x in h]), h >> np.uint64(8), one[h & _mask(1)])
    return one, two


def evidence(gram: np.ndarray, n0: np.ndarray, n1: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
    """(sequences, evidence of each, contexts, evidence of a byte that neither class has seen behind each).

    The sequences are all those whose contexts end with certain pairs of bytes.
    """
    order = np.argsort(gram)
    gram, n = gram[order], (n0[order], n1[order])
    length = np.ones(len(gram), np.int64)
    for k in range(1, ORDER):
        length += gram >= np.uint64(1 << 8 * k)
    below = np.zeros(len(gram))
    # distinct sequences of each order with the number of those a byte longer that they end
    ends, longer = {}, gram[length == ORDER]
    for k in range(ORDER - 1, 2, -1):
        ends[k] = np.unique(longer & _mask(k), return_counts=True)
        longer = np.r_[ends[k][0], gram[length == k]]
    known, shares = np.arange(1 << 16, dtype=np.uint64), two
    below[length == 2] = one[gram[length == 2] & _mask(1)]
    below[length == 3] = two[gram[length == 3] & _mask(2)]
    for k in range(3, ORDER):
        h, times = ends[k]
        shares = _smoothed(times, h >> np.uint64(8), shares[np.searchsorted(known, h & _mask(k - 1))])
        known, mine = h, length == k + 1
        below[mine] = shares[np.searchsorted(known, gram[mine] & _mask(k))]
    context = gram >> np.uint64(8)
    shared = _smoothed(n[0] + n[1], context, below)
    group = np.cumsum(np.r_[False, context[1:] != context[:-1]])[: len(context)]
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]][: len(context)])
    logs, unseen = [], []
    for count in n:
        _, total, kinds = _sums(context, count, (count > 0).astype(np.int64))
        # a class that has not seen the context has the shared probability
        weight = np.where(total > 0, (DISCOUNT * kinds + SHARED_WEIGHT) / (total + SHARED_WEIGHT), 1.0)
        own = np.where(total[group] > 0, np.maximum(count - DISCOUNT, 0) / (total[group] + SHARED_WEIGHT), 0.0)
        logs.append(np.log(own + weight[group] * shared))
        unseen.append(np.log(weight))
    # of a byte that neither class has seen here the shared probability cancels out
    return gram, logs[1] - logs[0], context[first], unseen[1] - unseen[0]


def _evidence_rows(shared):
    """mapInArrow function: of rows (gram, n0, n1), rows (kind, key, value): 0 for sequences, 1 for contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not parts:
            return
        gram, n0, n1 = (np.concatenate(c) for c in zip(*parts))
        if not len(gram):
            return
        found = evidence(gram.view(np.uint64), n0, n1, *shared.value)
        for kind, keys, values in ((0, *found[:2]), (1, *found[2:])):
            for at in range(0, len(keys), 100_000):
                some = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some.view(np.int64)), pa.array(values[at : at + 100_000].astype(np.float32))], names=["kind", "key", "value"])

    return run


class Table:
    """Evidence of sequences and contexts in sorted arrays."""

    def __init__(self, rows: pa.Table):
        kind, key, value = (rows.column(c).to_numpy() for c in ("kind", "key", "value"))
        self.parts = []
        for k in (0, 1):
            keys, values = key[kind == k].view(np.uint64), value[kind == k]
            order = np.argsort(keys)
            self.parts.append((keys[order], values[order]))

    def _find(self, part: int, wanted: np.ndarray, other: np.ndarray | float) -> np.ndarray:
        keys, values = self.parts[part]
        if not len(keys):
            return np.broadcast_to(other, wanted.shape)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], other)

    def __call__(self, words: list[str]) -> np.ndarray:
        """The evidence of each word."""
        found, place = grams(words)
        values = self._find(0, found, self._find(1, found >> np.uint64(8), 0.0))
        return np.bincount(place, values, len(words))


def figures(values: np.ndarray) -> tuple[float, ...]:
    """`FIGURES` of a text from its words' evidence."""
    if not len(values):
        return 0.0, 0.0, 0.0
    top = float(values.max())
    return float(values.mean()), top + math.log(float(np.exp(values - top).mean())), float(np.partition(values, -2)[-2]) if len(values) > 1 else top


def _columns(found: list[tuple[float, ...]]) -> list[pa.Array]:
    return [pa.array([x[i] for x in found], pa.float64()) for i in range(len(FIGURES))]


class Reader(dict):
    """Figures of texts; evidence by word is remembered."""

    def __init__(self, table: Table):
        self.table = table

    def __call__(self, texts: list[str | None]) -> list[tuple[float, ...]]:
        cut_up = [words_of(t) for t in texts]
        if len(self) > CACHE_WORDS:
            self.clear()
        new = list(set().union(*cut_up).difference(self))
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            self.update(zip(some, self.table(some).tolist()))
        known = self.__getitem__
        return [figures(np.fromiter(map(known, words), np.float64, len(words))) for words in cut_up]


def _curve(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression of y on the columns of x by Newton's method, pulled to the usual curve."""
    x = np.c_[x, np.ones(len(x))]
    usual, pull = np.array(USUAL_CURVE), np.array(PULL)

    def cost(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, np.where(y > 0, -z, z)).sum() + (pull * (w - usual) ** 2).sum() / 2)

    w = usual.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * (w - usual))
        while np.abs(step).max() > 1e-9 and cost(w + step) > cost(w):
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def model_rows(counted: DataFrame, n_grams: int) -> DataFrame:
    """Rows (kind, key, value) of the model: evidence of the sequences (kind 0) and contexts (1) of rows (gram, n0, n1)."""
    spark = counted.sparkSession
    third, pair = F.col("gram").bitwiseAND(F.lit(0xFFFFFF)), F.col("three").bitwiseAND(F.lit(0xFFFF))
    # a sequence of two bytes is below 2**16; those of eight may be negative as signed numbers
    longer = counted.where("gram < 0 or gram >= 65536").select(third.alias("three")).distinct()
    pairs = {r.pair: r.n for r in longer.groupBy(pair.alias("pair")).agg(F.count("*").alias("n")).collect()}
    begins = [r.gram for r in counted.where("gram >= 0 and gram < 65536").select("gram").collect()]
    shared = spark.sparkContext.broadcast(short_orders(pairs, begins))
    ending = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(0xFFFF))
    tasks = max(1, -(-n_grams // GRAMS_IN_TASK))
    return cut(counted.select("gram", "n0", "n1").repartition(tasks, ending).mapInArrow(_evidence_rows(shared), "kind int, key long, value float"))


class Model:
    """Scores of texts, broadcast or joined, by the size of the model."""

    def __init__(self, rows: DataFrame, most_grams: int = MOST_GRAMS):
        self.rows, self.table = rows, None
        if rows.count() <= 2 * most_grams:
            self.table = rows.sparkSession.sparkContext.broadcast(Table(rows.toArrow()))
        self.curve = list(USUAL_CURVE)

    def figures(self, docs: DataFrame, *more: str) -> DataFrame:
        """The columns `more` of docs with `FIGURES` of each row's text."""
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*more).schema)
        if self.table is None:
            return self._joined(docs, *more)
        shared = self.table

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = Reader(shared.value)
            for batch in batches:
                found = read(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *_columns(found)], names=[*more, *FIGURES])

        return docs.select("text", *more).mapInArrow(run, f"{kinds}, {FIGURE_KINDS}")

    def _joined(self, docs: DataFrame, *more: str) -> DataFrame:
        """figures() where the model is too large for a worker: by joins on words and their sequences."""

        def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k1, k2, text in zip(*(c.to_pylist() for c in batch.columns)):
                    words = words_of(text)
                    n = len(words)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int64()) for k in (k1, k2)] + [pa.array(range(n), pa.int64()), pa.array(words, pa.string())], names=["k1", "k2", "place", "word"])

        def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    found, place = grams(batch.column(2).to_pylist())
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(place)) for i in (0, 1)), pa.array(found.view(np.int64))], names=["w1", "w2", "gram"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [figures(np.array(v, np.float64)) for v in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *_columns(found)], names=["k1", "k2", *FIGURES])

        keys = [F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2")]
        # equal texts are cut up once
        texts = docs.where("text is not null").select(*keys, "text").dropDuplicates(["k1", "k2"])
        # a word may be as long as a text: it goes by two hashes
        words = cut(texts.mapInArrow(cut_up, "k1 long, k2 long, place long, word string").withColumns({"w1": F.xxhash64("word"), "w2": F.xxhash64("word", F.lit(1))}))
        seen, unseen = (self.rows.where(F.col("kind") == k).select(F.col("key").alias(n), F.col("value").alias(v)) for k, n, v in ((0, "gram", "own"), (1, "context", "none")))
        spelled = words.select("w1", "w2", "word").dropDuplicates(["w1", "w2"]).mapInArrow(spelt, "w1 long, w2 long, gram long").withColumn("context", F.shiftrightunsigned("gram", 8))
        value = spelled.join(seen, "gram", "left").join(unseen, "context", "left").groupBy("w1", "w2").agg(F.sum(F.coalesce("own", "none", F.lit(0.0)).cast("double")).alias("value"))
        lists = words.drop("word").join(value, ["w1", "w2"]).groupBy("k1", "k2").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("values"))
        found = lists.mapInArrow(summed, f"k1 long, k2 long, {FIGURE_KINDS}")
        met = docs.select(*more, *keys).join(found, ["k1", "k2"], "left")
        return met.select(*more, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in FIGURES))


def counts(rows: DataFrame) -> DataFrame:
    """(gram, n0, n1) of rows (text, mark): every sequence with its counts in ordinary and toxic rows."""
    found = rows.select("text", "mark").mapInArrow(_count, "gram long, n0 long, n1 long")
    return cut(found.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def _counted(rows: DataFrame, most_grams: int) -> Model:
    counted = counts(rows)
    return Model(model_rows(counted, counted.count()), most_grams)


def _crossed(rows: DataFrame, sizes: dict[int, int], most_grams: int) -> list[pd.DataFrame]:
    """Figures of all rows, each from counts of the other parts."""
    folds = min(FOLDS, *sizes.values())
    if folds < 2:
        return []
    place = F.dense_rank().over(Window.partitionBy("mark").orderBy(hash_order("doc_id", 41), "doc_id"))
    # few rows, and all of them labelled
    parted = cut(rows.withColumn("fold", place % folds))
    seen = (_counted(parted.where(F.col("fold") != i), most_grams).figures(parted.where(F.col("fold") == i), "mark") for i in range(folds))
    return [f.toPandas() for f in seen]


def _spare(rows: DataFrame, sizes: dict[int, int]) -> Column:
    """Whether a row is set aside for the curve."""
    place, out = hash_order("doc_id", 41), F.lit(False)
    for mark, n in sizes.items():
        wanted = min(n // 2, max(CURVE_LEAST, int(n * min(CURVE_SHARE, CURVE_ROWS / sum(sizes.values())))))
        if wanted:
            bound = rows.where(F.col("mark") == mark).select(place.alias("place")).distinct().orderBy("place").limit(wanted).agg(F.max("place")).first()[0]
            out = out | ((F.col("mark") == mark) & (place <= bound))
    return out


def learn(docs: DataFrame, labels: DataFrame, most_grams: int = MOST_GRAMS) -> Model | None:
    """The model from the labelled rows among docs, or None where a class has no rows."""
    small_batches(docs.sparkSession)
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("marked_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("mark"))
    if labels.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    rows = docs.select("doc_id", "text").where("text is not null").join(marks, F.col("doc_id") == F.col("marked_id"))
    sizes = {r.mark: r.n for r in rows.select("mark", "doc_id").distinct().groupBy("mark").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    if sum(sizes.values()) <= CROSS_ROWS:
        model, seen = _counted(rows, most_grams), _crossed(rows, sizes, most_grams)
    else:
        spare = _spare(rows, sizes)
        model = _counted(rows.where(~spare), most_grams)
        # repeated documents of one label may be more than the labels: they are bounded too
        seen = [model.figures(rows.where(spare), "doc_id", "mark").orderBy(hash_order("doc_id", 42), "doc_id", "whole").limit(2 * CURVE_ROWS).toPandas()]
    if seen:
        found = pd.concat(seen)
        model.curve = _curve(found[list(FIGURES)].to_numpy(), found["mark"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model | None, *more: str) -> DataFrame:
    """The columns `more` of docs (doc_id, unless others are named) and the score of every row."""
    more = more or ("doc_id",)
    if model is None:
        return docs.select(*more, F.lit(0.0).alias("score"))
    *weights, offset = model.curve
    z = F.greatest(F.lit(-700.0), sum((F.col(f) * w for f, w in zip(FIGURES, weights)), F.lit(offset)))
    return model.figures(docs, *more).select(*more, (1 / (1 + F.exp(-z))).alias("score"))


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learnt from labels outside the held-out third."""
    model = learn(docs.where(~held_out("doc_id", 3, 1)), labels)
    found = score(docs, model)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    model = learn(docs.where(~held_out("doc_id", 3, 1)), labels)
    if model is None:
        return docs
    if model.table is None:
        row = docs.select("text", F.struct(*docs.columns).alias("row"))
        return score(row, model, "row").where(F.col("score") < THRESHOLD).select("row.*")
    columns = docs.columns
    shared, (*weights, offset) = model.table, model.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(shared.value)
        for batch in batches:
            z = [sum((f * w for f, w in zip(found, weights)), offset) for found in read(batch.column(columns.index("text")).to_pylist())]
            yield batch.filter(pa.array([1 / (1 + math.exp(-max(v, -700.0))) < THRESHOLD for v in z], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
