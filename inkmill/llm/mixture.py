"""Mixing sources to target weights, block by block.

The words of each source are set one behind the other and packed into blocks of `block_words`. Every
output shard draws how many of its slots each source gets; a slot's number within its source goes through
a pseudorandom permutation of the source's block indexes (a new one for each round through the source),
and slots meet blocks by index.

Sources sorted by code point, null last, weigh 5, 2, 1 in turn; together they get as many words as all
documents have; a source gets at most `MOST_REPEATS` times its own size, and what is over goes to the
others by weight. A source's slots are fixed to its target. The shards' counts are multinomial draws given
those totals: the slots are halved again and again, and each half draws its counts from what there is
(multivariate hypergeometric), so that any shard can be worked out alone and without a pass over the
others. Draws and permutations depend on the seed, the source's rank and the shard only, so reruns agree.

Places within a source come from running sums over chunks of documents, dealt by a hash of doc_id, and
over the chunks; no task has all documents of a source. Sources are gathered on the driver: more than
`MOST_SOURCES` are refused.

Defined results: words are runs of bytes other than space and \\t .. \\r; a null, empty or wordless text
has size 0, is taken 0 times and has a row; rows that are equal are places of their own; a null source is
a source; an empty table gives no rows. Only doc_id, text and source are read by `placed`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmill.llm._shared import cut, row_hash, small_batches

WEIGHTS, MOST_REPEATS, MOST_SOURCES = (5, 2, 1), 3, 100_000
BLOCK_WORDS, SHARD_SLOTS, SEED = 64, 4096, 20
ROWS_IN_CHUNK, SHARDS_IN_TASK = 20_000, 16
#: Slots up to which the library draws; beyond, counts are drawn from the normal curve with the same mean and spread.
MOST_DRAWN = 1_000_000_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: list[int]) -> list[float]:
    """Words for each source, in the order of the weights."""
    total = float(sum(sizes))
    weight = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s}, total
    while open_:
        share = left / sum(weight[i] for i in open_)
        full = {i for i in open_ if weight[i] * share > MOST_REPEATS * sizes[i]}
        if not full:
            for i in open_:
                out[i] = weight[i] * share
            break
        for i in full:
            out[i] = float(MOST_REPEATS * sizes[i])
        open_ -= full
        left = total - sum(out)
    return out


def slots_of(size: int, target: float, block: int) -> tuple[int, int]:
    """(blocks, slots) of a source: whole rounds through its blocks, then the nearest number of blocks."""
    blocks = -(-size // block)
    if not size:
        return 0, 0
    rounds = int(target // size)
    return blocks, rounds * blocks + min(blocks, round((target - rounds * size) / block))


class Draw:
    """Counts of all sources in any range of shards."""

    def __init__(self, slots: list[int], shard_slots: int, seed: int):
        self.slots, self.size, self.seed = np.array(slots, np.int64), shard_slots, seed
        self.total = int(self.slots.sum())
        self.shards = -(-self.total // shard_slots)

    def _half(self, counts: np.ndarray, first: int, last: int, n: int) -> np.ndarray:
        rng, total = np.random.default_rng([self.seed, first, last]), int(counts.sum())
        if total < MOST_DRAWN:
            return rng.multivariate_hypergeometric(counts, n, method="marginals")
        # source by source, each from what is left
        out = np.zeros_like(counts)
        for i, k in enumerate(counts.tolist()):
            others = total - k
            if total < MOST_DRAWN:
                drawn = int(rng.hypergeometric(k, others, n)) if total else 0
            else:
                share = k / total
                spread = math.sqrt(n * share * (1 - share) * (total - n) / (total - 1))
                drawn = min(k, n, max(0, n - others, round(n * share + spread * float(rng.standard_normal()))))
            out[i], n, total = drawn, n - drawn, others
        return out

    def __call__(self, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, counts, counts of all shards before it) for the shards from first to before last."""
        todo = [(0, self.shards, np.zeros_like(self.slots), self.slots)]
        while todo:
            a, b, before, counts = todo.pop()
            if a >= last or b <= first or a == b:
                continue
            if b - a == 1:
                yield a, counts, before
                continue
            mid = (a + b) // 2
            left = self._half(counts, a, b, (mid - a) * self.size)
            todo += [(mid, b, before + left, counts - left), (a, mid, before, left)]


def permute(index: np.ndarray, blocks: int, n: int, key: tuple[int, ...]) -> np.ndarray:
    """The places of indexes 0 .. blocks-1 under a pseudorandom permutation (a Feistel net, walked in cycles).

    Only the first n blocks, the full ones, change places: a source's short last block comes last in each round.
    """
    if n < blocks:
        out = index.copy()
        out[index < n] = permute(index[index < n], n, n, key)
        return out
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(list(key)).integers(0, 1 << 63, 4, dtype=np.uint64)
    out = index.astype(np.uint64)
    walk = np.ones(len(out), bool)
    while walk.any():
        x = out[walk]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            z = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ z >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (z >> np.uint64(32)) & mask
        out[walk] = left << np.uint64(half) | right
        walk = out >= n
    return out.astype(np.int64)


class Mixture:
    """Placed documents, targets and slots of one mix."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED):
        self.spark, self.block, self.seed = docs.sparkSession, block_words, seed
        small_batches(self.spark)
        sized = docs.select("doc_id", "source", F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("size"), F.xxhash64("text").alias("tie"))
        self.sized = sized = cut(sized.withColumn("size", F.coalesce("size", F.lit(0).cast("long"))))
        rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        # UTF-8 bytes sort by code point, as Python's strings do
        rows.sort(key=lambda r: (r.source is None, r.source or ""))
        self.sources = [r.source for r in rows]
        self.sizes = [r["size"] for r in rows]
        self.targets = targets(self.sizes)
        pairs = [slots_of(s, t, block_words) for s, t in zip(self.sizes, self.targets)]
        self.blocks, self.slots = [p[0] for p in pairs], [p[1] for p in pairs]
        self.draw = Draw(self.slots, shard_slots, seed)
        ranks = self.spark.createDataFrame([(i, s, z, t) for i, (s, z, t) in enumerate(zip(self.sources, self.sizes, self.targets))], "rank int, of string, source_size long, target double")
        chunks = max(1, -(-sum(r.n for r in rows) // ROWS_IN_CHUNK))
        ranked = sized.join(F.broadcast(ranks), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(chunks)))
        within = Window.partitionBy("rank", "chunk").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
        over = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        heads = ranked.groupBy("rank", "chunk").agg(F.sum("size").alias("all")).select("rank", "chunk", F.coalesce(F.sum("all").over(over), F.lit(0)).alias("head"))
        ordered = ranked.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
        #: Each document with its place among the words of its source.
        self.placed = cut(ordered.join(heads, ["rank", "chunk"]).withColumn("start", F.col("head") + F.col("before")).drop("chunk", "head", "before"))

    def block_table(self) -> DataFrame:
        """rank, block, start (of the document), doc_id, tie, word (in the document), n_words: blocks by their parts."""
        some = self.placed.where("size > 0").select("rank", "start", "doc_id", "tie", "size", F.explode(F.sequence(F.floor(F.col("start") / self.block), F.floor((F.col("start") + F.col("size") - 1) / self.block))).alias("block"))
        a, b = F.greatest("start", F.col("block") * self.block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * self.block)
        return some.select("rank", "block", "start", "doc_id", "tie", (a - F.col("start")).alias("word"), (b - a).alias("n_words"))

    def slot_table(self) -> DataFrame:
        """shard, slot, rank, round and block: what each slot of the output holds."""
        draw, blocks, full, seed = self.draw, self.blocks, [s // self.block for s in self.sizes], self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    for shard, counts, before in draw(at * SHARDS_IN_TASK, (at + 1) * SHARDS_IN_TASK):
                        n = int(counts.sum())
                        rank = np.repeat(np.arange(len(counts)), counts)
                        number = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(before, counts)
                        size = np.array(blocks, np.int64)[rank]
                        turn, index = number // size, number % size
                        place = np.empty(n, np.int64)
                        for r in np.flatnonzero(counts):
                            mine = rank == r
                            for t in np.unique(turn[mine]):
                                some = mine & (turn == t)
                                place[some] = permute(index[some], blocks[r], full[r], (seed, int(r), int(t)))
                        slot = np.random.default_rng([seed, shard]).permutation(n)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(slot), pa.array(rank.astype(np.int32)), pa.array(turn), pa.array(place)], names=["shard", "slot", "rank", "round", "block"])

        tasks = max(1, -(-draw.shards // SHARDS_IN_TASK))
        return self.spark.range(0, tasks, 1, max(1, min(tasks, 4096))).mapInArrow(run, "shard long, slot long, rank int, round long, block long")

    def mixed(self) -> DataFrame:
        """Each slot with the parts of its block: shard, slot, rank, round, block, start, doc_id, tie, word, n_words."""
        # Spark takes what Python makes of a short range for a small table and would broadcast all slots
        return self.slot_table().hint("merge").join(self.block_table(), ["rank", "block"])


def op9(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words taken of every document."""
    mix = Mixture(docs)
    taken = mix.mixed().groupBy("rank", "start").agg(F.sum("n_words").alias("taken"))
    sized = mix.placed.where("size > 0").join(taken, ["rank", "start"], "left")
    columns = ("doc_id", "size", "source_size", "target")
    none = mix.placed.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    return sized.select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).unionByName(none)


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of docs: a row for each round in which a document is taken.

    Its text is the whole text where all of it is taken, else the words taken, each run of them as it
    stands and the runs set apart by a line end. n_chars, where it is a column, follows the text.
    """
    mix = Mixture(docs)
    parts = mix.mixed().groupBy("doc_id", "tie", "rank", "start", "round").agg(F.sort_array(F.collect_list(F.struct("word", "n_words"))).alias("runs"))
    # rows that are equal but for other columns share a key: their lists are dealt to them in order
    dealt = parts.groupBy("doc_id", "tie", "rank", "start").agg(F.sort_array(F.collect_list("runs")).alias("rounds"))
    sources = mix.spark.createDataFrame(list(enumerate(mix.sources)), "rank int, of string")
    numbered = dealt.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "tie", "rank").orderBy("start"))).join(F.broadcast(sources), "rank")
    names = [c for c in docs.columns]
    kept = docs.select(F.struct(*names).alias("row"), F.col("doc_id").alias("k_doc"), F.xxhash64("text").alias("k_tie"), F.col("source").alias("k_source"), row_hash(docs).alias("k_row"))
    kept = kept.withColumn("k_copy", F.row_number().over(Window.partitionBy("k_doc", "k_tie", "k_source").orderBy("k_row")))
    met = kept.join(numbered, F.col("k_doc").eqNullSafe(F.col("doc_id")) & (F.col("k_tie") == F.col("tie")) & F.col("k_source").eqNullSafe(F.col("of")) & (F.col("k_copy") == F.col("copy")))
    at_text = names.index("text")
    at_chars = names.index("n_chars") if "n_chars" in names else None
    small_batches(mix.spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, texts = [], []
            for i, (text, rounds) in enumerate(zip(batch.column(at_text).to_pylist(), batch.column(len(names)).to_pylist())):
                spans = None
                for runs in rounds:
                    spans = spans or [m.span() for m in WORD.finditer(text)]
                    joined: list[list[int]] = []
                    for r in runs:
                        if joined and joined[-1][1] == r["word"]:
                            joined[-1][1] += r["n_words"]
                        else:
                            joined.append([r["word"], r["word"] + r["n_words"]])
                    take.append(i)
                    texts.append(text if joined == [[0, len(spans)]] else "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in joined))
            rows = [batch.column(k).take(pa.array(take, pa.int64())) for k in range(len(names))]
            rows[at_text] = pa.array(texts, pa.string())
            if at_chars is not None:
                rows[at_chars] = pa.array([len(t) for t in texts]).cast(batch.schema.field(at_chars).type)
            yield pa.RecordBatch.from_arrays(rows, names=names)

    return met.select(*[F.col("row")[n].alias(n) for n in names], "rounds").mapInArrow(run, docs.schema)
