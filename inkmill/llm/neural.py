"""Language-model scores from a log-bilinear neural model, trained by noise-contrastive estimation.

A text's tokens are its words and one end. The model predicts classes of tokens: the end, each of the
`SHORTLIST` most frequent words for itself, and `BUCKETS` classes of all other words by their last bytes. The
vectors of the `CONTEXT` classes before a token, each through a matrix of its distance, sum up to a
prediction; its product with the vectors of all classes gives logits, in one matrix product for many tokens,
and their softmax is the class's probability. Within a bucket a word has its smoothed share of the
bucket's training tokens, with one share left for words that training has not seen, so all
probabilities over all words sum up to one.

Training: by noise-contrastive estimation each token is told apart from `NOISE` classes drawn by their
frequency, under a normaliser of one. Every training token of the corpus is learnt from: first one
task learns from `SEED_TOKENS` tokens of about `SEED_DOCS` documents, drawn by a hash, then each task goes on
from there over all its documents, and the models are averaged by their tokens, `FAN` at a time.

Counts are those of all words of all documents. The words that occur most, `KNOWN_WORDS` at most, go to
every worker; the occurrences of the others are joined with their counts by word. As each of these is
rarer than any of the former, no word makes a large task.

Defined results: null and empty texts are one end; a null doc_id teaches nothing and is not held out;
repeated rows each count and have their row; words of more than `LONG_WORD` bytes go by their SHA-256; without
training tokens both scores are 0; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.llm._shared import cut, held_out, new_folder, small_batches

SHORTLIST, BUCKETS, CONTEXT, DIM = 511, 512, 2, 24
NOISE, STEP_TOKENS, RATE = 32, 1024, 0.3
#: The first round, in one task: so many tokens of about as many documents.
SEED_TOKENS, SEED_DOCS = 1_000_000, 4000
KNOWN_WORDS = 65_536
#: Models that are averaged at a time.
FAN = 32
#: Tokens that a worker scores at a time.
LOGIT_TOKENS = 4096
LONG_WORD, ENDING = 64, 3
END = b""
#: Sixteenths of powers of two, by which words are parted into frequent and rare ones.
GRAIN = 16
SCORED = "key long, doc_id long, held_out boolean, word binary, times long, n_tokens long, n_known long, base double, model double"
NAMES = [c.split()[0] for c in SCORED.split(", ")]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of texts one behind the other, the number of each text's), A-Z lower-cased.

    Very long words stand as their hash behind a space, which no word holds.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, text = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    # white space at the ends of a text makes empty words
    size = pc.binary_length(words).to_numpy(zero_copy_only=False)
    words, text = words.filter(pa.array(size > 0)).cast(pa.binary()), text[size > 0]
    if size.max(initial=0) > LONG_WORD:
        words = pa.array([w if len(w) <= LONG_WORD else b" " + hashlib.sha256(w).hexdigest().encode() + w[-ENDING:] for w in words.to_pylist()], pa.binary())
    return words, np.bincount(text, minlength=len(texts))


def buckets_of(words: pa.Array) -> np.ndarray:
    """The bucket of each word, by its last bytes as a number."""
    if not len(words):
        return np.zeros(0, np.int64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    code = np.zeros(len(words), np.int64)
    for k in range(ENDING, 0, -1):
        there = np.diff(ends) >= k
        code[there] = code[there] * 256 + data[ends[1:][there] - k]
    return code * 40503 % 65521 % BUCKETS


def bucket_column(word: Column) -> Column:
    """buckets_of() of a column."""
    code = F.conv(F.hex(F.substring(word, -ENDING, ENDING)), 16, 10).cast("long")
    return code * 40503 % 65521 % BUCKETS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (text, teaches), words with their numbers in training texts and in all, batch by batch."""
    for batch in batches:
        words, n = words_of(batch.column(0))
        teaches = batch.column(1).to_numpy(zero_copy_only=False)
        coded = words.dictionary_encode()
        place = coded.indices.to_numpy(zero_copy_only=False)
        total = np.bincount(place, minlength=len(coded.dictionary))
        train = np.bincount(place[np.repeat(teaches, n)], minlength=len(coded.dictionary))
        named = pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())])
        yield pa.RecordBatch.from_arrays([named, pa.array(np.r_[train, teaches.sum()]), pa.array(np.r_[total, len(n)])], names=["word", "train", "total"])


class Classes:
    """The classes of tokens: 0 is the end, then the shortlist, then buckets; one more stands before a text."""

    def __init__(self, known: list[tuple[bytes, int]], sums: dict[int, tuple[int, int]], n: int, v: int, ends: int):
        """known: the most frequent words with their training counts; sums: by bucket, counts and number of all training words."""
        ranked = sorted((-c, w) for w, c in known if c)[:SHORTLIST]
        self.shortlist = [w for _, w in ranked]
        own = {w: i + 1 for i, w in enumerate(self.shortlist)}
        self.first_bucket = 1 + len(own)
        self.size = self.pad = self.first_bucket + BUCKETS
        self.known = pa.array([w for w, _ in known], pa.binary())
        bucket = buckets_of(self.known)
        counts, kinds = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b, (c, k) in sums.items():
            counts[b], kinds[b] = c, k
        short = buckets_of(pa.array(self.shortlist, pa.binary()))
        taken = np.array([-c for c, _ in ranked], np.int64)
        np.subtract.at(counts, short, taken)
        np.subtract.at(kinds, short, 1)
        self.frequency = np.r_[ends, taken, counts].astype(np.float64)
        #: log10 of what a word's count + 0.1 is divided by within its class
        self.within = np.r_[np.zeros(self.first_bucket), np.log10(counts + 0.1 * (kinds + 1))]
        self.base = math.log10(n + 0.1 * (v + 1))
        self.of_known = np.array([own.get(w, 0) for w, _ in known], np.int64)
        self.of_known = np.where(self.of_known > 0, self.of_known, self.first_bucket + bucket)
        self.log = np.log10(np.array([c for _, c in known], np.float64) + 0.1)
        self.seen = np.array([c > 0 for _, c in known], bool)
        self.end_log = math.log10(ends + 0.1)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(class of each token, number of tokens of each text, place of each word among the known or -1, the words)."""
        words, n = words_of(texts)
        place = pc.fill_null(pc.index_in(words, self.known), -1).to_numpy(zero_copy_only=False)
        if len(self.known):
            kind = np.where(place >= 0, self.of_known[place], 0)
        else:
            kind = np.zeros(len(words), np.int64)
        other = place < 0
        kind[other] = self.first_bucket + buckets_of(words.filter(pa.array(other)))
        out = np.zeros(len(words) + len(n), np.int64)
        out[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = kind
        return out, n + 1, place, words

    def contexts(self, kind: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The classes before each token, the nearest first."""
        at = np.arange(len(kind)) - np.repeat(np.cumsum(n) - n, n)
        out = np.full((CONTEXT, len(kind)), self.pad)
        for j in range(1, CONTEXT + 1):
            out[j - 1, j:] = np.where(at[j:] >= j, kind[:-j], self.pad)
        return out


def _rows_added(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, the sums of their rows)."""
    order = np.argsort(ids.astype(np.uint16) if ids.max() < 1 << 16 else ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return ids[first], np.add.reduceat(rows[order], first, axis=0)


class Model:
    """Vectors of contexts and of classes, matrices by distance, biases."""

    def __init__(self, frequency: np.ndarray, flat: np.ndarray | None = None):
        k = len(frequency)
        self.noise = (frequency + 0.1) / (frequency + 0.1).sum()
        self.shapes = [(k + 1, DIM), (k, DIM), (CONTEXT, DIM, DIM), (k,)]
        if flat is None:
            rng = np.random.default_rng(1)
            parts = [rng.normal(0, 0.1, s) for s in self.shapes[:2]] + [np.stack([np.eye(DIM) / (j + 1) for j in range(CONTEXT)]), np.log(self.noise)]
        else:
            parts = [x.reshape(s) for x, s in zip(np.split(flat, np.cumsum([int(np.prod(s)) for s in self.shapes])[:-1]), self.shapes)]
        self.contexts, self.classes, self.matrices, self.bias = (np.ascontiguousarray(p, np.float32) for p in parts)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (self.contexts, self.classes, self.matrices, self.bias)])

    def predicted(self, before: np.ndarray) -> np.ndarray:
        return sum(self.contexts[b] @ m for b, m in zip(before, self.matrices))

    def chances(self, before: np.ndarray, kind: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, ...]:
        """(predictions, for each token's class and for each class drawn beside it, the chance that it is the token's)."""
        predicted = self.predicted(before)
        shift = (np.log(len(drawn) * self.noise)).astype(np.float32) - self.bias
        own = np.einsum("td,td->t", predicted, self.classes[kind]) - shift[kind]
        others = predicted @ self.classes[drawn].T
        others -= shift[drawn]
        for x in (own, others):
            np.clip(x, -30, 30, out=x)
            np.negative(x, out=x)
            np.exp(x, out=x)
            x += 1
            np.reciprocal(x, out=x)
        return predicted, own, others

    def loss(self, before: np.ndarray, kind: np.ndarray, drawn: np.ndarray) -> float:
        """The contrastive loss: how surely tokens are told from the classes drawn."""
        _, own, others = (x.astype(np.float64) for x in self.chances(before, kind, drawn))
        return float(-np.log(own).sum() - np.log1p(-others).sum())

    def gradients(self, before: np.ndarray, kind: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the loss: for the vectors of all of `before`, those of `kind` and `drawn`, the matrices, and the biases of `kind` and `drawn`."""
        predicted, own, others = self.chances(before, kind, drawn)
        own -= 1
        d_predicted = own[:, None] * self.classes[kind]
        d_predicted += others @ self.classes[drawn]
        d_classes = np.concatenate([own[:, None] * predicted, others.T @ predicted])
        d_matrices = np.stack([self.contexts[b].T @ d_predicted for b in before])
        d_contexts = np.concatenate([d_predicted @ m.T for m in self.matrices])
        return d_contexts, d_classes, d_matrices, np.r_[own, others.sum(axis=0)]

    def normalisers(self, first: int) -> np.ndarray:
        """Logarithms of the sums over all classes for the contexts that begin with a class, by the class before that."""
        through = self.contexts @ self.matrices
        logits = (through[0][first] + through[1]) @ self.classes.T
        logits += self.bias
        most = logits.max(axis=1, keepdims=True)
        logits -= most
        np.exp(logits, out=logits)
        return most[:, 0] + np.log(logits.sum(axis=1, dtype=np.float64))

    def logs(self, before: np.ndarray, kind: np.ndarray, normalisers: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of the tokens' classes."""
        through = self.contexts @ self.matrices
        out = np.empty(len(kind))
        for a in range(0, len(kind), LOGIT_TOKENS):
            some, (b0, b1) = kind[a : a + LOGIT_TOKENS], before[:, a : a + LOGIT_TOKENS]
            out[a : a + LOGIT_TOKENS] = np.einsum("td,td->t", through[0][b0] + through[1][b1], self.classes[some]) + self.bias[some] - normalisers[b0, b1]
        return out / math.log(10)


class Trainer:
    """Steps of AdaGrad over tokens."""

    def __init__(self, model: Model, salt: int):
        self.model, self.rng, self.tokens = model, np.random.default_rng(salt), 0
        self.squares = [np.full(x.shape, 1e-2, np.float32) for x in (model.contexts, model.classes, model.matrices, model.bias)]

    def _step(self, part: int, value: np.ndarray, gradient: np.ndarray, ids: np.ndarray | None = None) -> None:
        if ids is None:
            self.squares[part] += gradient * gradient
            value -= RATE * gradient / np.sqrt(self.squares[part])
            return
        ids, gradient = _rows_added(ids, gradient)
        self.squares[part][ids] += gradient * gradient
        value[ids] -= RATE * gradient / np.sqrt(self.squares[part][ids])

    def learn(self, before: np.ndarray, kind: np.ndarray) -> None:
        m, limits = self.model, np.cumsum(self.model.noise)
        for a in range(0, len(kind), STEP_TOKENS):
            ctx, some = before[:, a : a + STEP_TOKENS], kind[a : a + STEP_TOKENS]
            drawn = np.minimum(np.searchsorted(limits, self.rng.random(NOISE)), len(limits) - 1)
            # means over a step, so that its length does not change its size
            d_contexts, d_classes, d_matrices, d_bias = (g / np.float32(len(some)) for g in m.gradients(ctx, some, drawn))
            ids = np.r_[some, drawn]
            self._step(0, m.contexts, d_contexts, ctx.ravel())
            self._step(1, m.classes, d_classes, ids)
            self._step(2, m.matrices, d_matrices)
            self._step(3, m.bias, d_bias.astype(np.float32), ids)
            self.tokens += len(some)


def _parts(model: Model, tokens: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([(model.flat().astype(np.float64) * tokens).tobytes()], pa.binary())], names=["tokens", "sums"])


def _learning(classes: Broadcast, start: Broadcast | None, most: int | None = None):
    """mapInArrow function: learns from texts, at most so many tokens; a task gives its model, times its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = classes.value
        trainer = Trainer(Model(known.frequency, start.value if start else None), TaskContext.get().partitionId())
        for batch in batches:
            kind, n, _, _ = known.read(batch.column(0))
            trainer.learn(known.contexts(kind, n), kind)
            if most and trainer.tokens >= most:
                break
        if trainer.tokens:
            yield _parts(trainer.model, trainer.tokens)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of a task's models, one of which is held at a time."""
    tokens, sums = 0, None
    for batch in batches:
        for n, more in zip(batch.column(0), batch.column(1)):
            tokens += n.as_py()
            more = np.frombuffer(more.as_buffer())
            sums = more if sums is None else sums + more
    if sums is not None:
        yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["tokens", "sums"])


def _averaged(models: DataFrame) -> np.ndarray:
    """The mean of rows (tokens, sums)."""
    kind = "tokens long, sums binary"
    tasks = models.rdd.getNumPartitions()
    models = cut(models)
    while tasks > 1:
        tasks = -(-tasks // FAN)
        models = models.repartition(tasks).mapInArrow(_added, kind)
    row = models.mapInArrow(_added, kind).first()
    return np.frombuffer(row.sums) / row.tokens


def train(docs: DataFrame, classes: Classes, n_docs: int) -> np.ndarray:
    """The parameters of the model, from the texts of n_docs training documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(classes)
    kind = "tokens long, sums binary"
    share = min(1.0, SEED_DOCS / max(1, n_docs))
    drawn = cut(docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(51)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text"))
    texts = docs.select("text")
    start = _averaged(drawn.coalesce(1).mapInArrow(_learning(shared, None, SEED_TOKENS), kind)) if not drawn.isEmpty() else None
    return _averaged(texts.mapInArrow(_learning(shared, spark.sparkContext.broadcast(start) if start is not None else None), kind))


def _normalisers(spark, classes: Broadcast, flat: Broadcast, size: int) -> np.ndarray:
    """Of all pairs of classes: (size + 1) squared numbers, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(classes.value.frequency, flat.value)
        for batch in batches:
            for first in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([model.normalisers(first).astype(np.float32).tobytes()], pa.binary())], names=["first", "logs"])

    rows = spark.range(0, size + 1, 1, 32).mapInArrow(run, "first long, logs binary").collect()
    return np.stack([np.frombuffer(r.logs, np.float32) for r in sorted(rows, key=lambda r: r.first)])


def _scoring(classes: Broadcast, flat: Broadcast, normalisers: Broadcast):
    """mapInArrow function: of rows (doc_id, held_out, text), one row a document without, and one a rare word of it with, a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = classes.value, normalisers.value
        model = Model(known.frequency, flat.value)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = batch.num_rows
            kind, n, place, words = known.read(batch.column(2))
            keys = np.arange(key, key + rows)
            key += rows
            add = lambda at, values: np.bincount(at, values, rows)
            token_of, word_of = np.repeat(np.arange(rows), n), np.repeat(np.arange(rows), n - 1)
            frequent = place >= 0
            logs = np.zeros(len(place))
            logs[frequent] = known.log[place[frequent]]
            # classes of the words, without the ends
            ends = np.zeros(len(kind), bool)
            ends[np.cumsum(n) - 1] = True
            shared = kind[~ends] >= known.first_bucket
            base = add(word_of, logs) + known.end_log - n * known.base
            whole = add(token_of, model.logs(known.contexts(kind, n), kind, table) - known.within[kind]) + add(word_of[shared], logs[shared])
            n_known = add(word_of[frequent], known.seen[place[frequent]]).astype(np.int64) + (known.end_log > -1)
            none = pa.nulls(rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys), *batch.columns[:2], none, pa.nulls(rows, pa.int64()), pa.array(n), pa.array(n_known), pa.array(base), pa.array(whole)], names=NAMES)
            rare = words.filter(pa.array(~frequent)).dictionary_encode()
            if len(rare):
                cells, times = np.unique(word_of[~frequent] * len(rare.dictionary) + rare.indices.to_numpy(), return_counts=True)
                at, word = np.divmod(cells, len(rare.dictionary))
                many = len(cells)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.nulls(many, pa.int64()), pa.nulls(many, pa.bool_()), rare.dictionary.take(pa.array(word)), pa.array(times.astype(np.int64)), *(pa.nulls(many, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=NAMES)

    return run


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of tokens alone."""
    for batch in batches:
        _, n = words_of(batch.column(2))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n + 1)], names=["doc_id", "held_out", "n_tokens"])


def _stored(df: DataFrame, kind: str) -> DataFrame:
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def score(docs: DataFrame, teaches: Column, held: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all rows of docs, learnt from those that teach."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    marked = docs.select("doc_id", "text", teaches.alias("teaches"))
    counts = _stored(marked.select("text", "teaches").mapInArrow(_count, "word binary, train long, total long").groupBy("word").agg(F.sum("train").alias("train"), F.sum("total").alias("total")), "words")
    end = F.col("word") == F.lit(END)
    n, v, ends = counts.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0), F.coalesce(F.sum(F.when(end, F.col("train"))), F.lit(0))).first()
    if not n:
        return rows.mapInArrow(_plain, "doc_id long, held_out boolean, n_tokens long").select("doc_id", "held_out", "n_tokens", *[F.lit(0).cast("long").alias(c) for c in ("n_known", "train_tokens")], *[F.lit(0.0).alias(c) for c in ("base_score", "score")])
    words = counts.where(~end).withColumn("size", F.floor(F.log2("total") * GRAIN))
    many, least = 0, 1 << 20
    for size, k in sorted(((r["size"], r["count"]) for r in words.groupBy("size").count().collect()), reverse=True):
        many += k
        if many > KNOWN_WORDS:
            break
        least = size
    # KNOWN_WORDS rows at most
    known = words.where(F.col("size") >= least).select("word", "train").toArrow()
    sums = {r.bucket: (r.c, r.k) for r in words.groupBy(bucket_column(F.col("word")).alias("bucket")).agg(F.sum("train").alias("c"), F.count_if(F.col("train") > 0).alias("k")).collect()}
    classes = Classes(sorted(zip(known.column(0).to_pylist(), known.column(1).to_pylist())), sums, n, v, ends)
    flat = train(marked.where("teaches"), classes, ends)
    sc = spark.sparkContext
    shared, weights = sc.broadcast(classes), sc.broadcast(flat)
    table = sc.broadcast(_normalisers(spark, shared, weights, classes.size))
    found = _stored(rows.mapInArrow(_scoring(shared, weights, table), SCORED), "scored")
    rare = found.where("word is not null").select("key", "word", "times").join(words.where(F.col("size") < least).select("word", "train"), "word")
    rare = rare.groupBy("key").agg(F.sum(F.col("times") * F.log10(F.col("train") + 0.1)).alias("logs"), F.sum(F.when(F.col("train") > 0, F.col("times")).otherwise(0)).alias("known"))
    met = found.where("word is null").join(rare, "key", "left")
    more = F.coalesce("logs", F.lit(0.0))
    return met.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))


def op13(docs: DataFrame) -> DataFrame:
    held = held_out("doc_id", 10, 0)
    return score(docs, F.col("doc_id").isNotNull() & ~held, held)
