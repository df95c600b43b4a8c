"""Vocabularies: deriving one, tokens to ids and back, ambiguous ids, word pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions.batches import small_batches
from inkmill.functions.text import BOS, CLS, EOS, MASK, PAD, SEP, UNK

SPECIALS = (PAD, UNK, SEP, CLS, MASK, BOS, EOS)
#: Words whose pieces a worker remembers between batches.
CACHE_WORDS = 50_000
#: A vocabulary with more rows is joined by a shuffle, not held in memory.
BROADCAST_ROWS = 500_000


def special_rows(specials: Sequence[str] = SPECIALS, reserved: Sequence[str] = ()) -> list[tuple[str, int]]:
    """Ids of special tokens: those given first, then the reserved ones that are new, in order."""
    return [(t, i) for i, t in enumerate([*specials, *sorted(set(reserved) - set(specials))])]


def derive(docs: DataFrame, tokens: str, size: int, specials: Sequence[str] = SPECIALS) -> DataFrame:
    """token, id, cnt: specials, then the commonest tokens, equal counts in the order of the token."""
    counts = docs.select(F.explode(tokens).alias("token")).where(~F.col("token").isin(*specials)).groupBy("token").agg(F.count("*").alias("cnt"))
    # the limit makes the order a top-k of bounded size
    top = counts.orderBy(F.desc("cnt"), "token").limit(size - len(specials)).agg(F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("order"), "token"))).alias("all"))
    rows = top.select(F.posexplode("all").alias("at", "row")).select(F.col("row.token").alias("token"), (F.col("at") + len(specials)).cast("long").alias("id"), (-F.col("row.order")).alias("cnt"))
    fixed = docs.sparkSession.createDataFrame([(t, i, 0) for t, i in special_rows(specials)], "token string, id long, cnt long")
    return fixed.unionByName(rows)


def held(vocabulary: DataFrame, *columns: str) -> pa.Table | None:
    """The vocabulary in memory, or None if it has more than BROADCAST_ROWS rows."""
    rows = vocabulary.select(*columns).limit(BROADCAST_ROWS + 1).toArrow()
    return rows if rows.num_rows <= BROADCAST_ROWS else None


def kept(vocabulary: DataFrame) -> DataFrame:
    """The vocabulary worked out once, where it fits in memory; else as it is."""
    rows = held(vocabulary, *vocabulary.columns)
    return vocabulary if rows is None else vocabulary.sparkSession.createDataFrame(rows)


def looked_up(spark: SparkSession, keys: pa.Array, values: pa.Array, missing, kind: str) -> Callable[[Column | str], Column]:
    """An expression that looks up the items of an array: a hash look-up by the batch, without a shuffle."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast((keys, pa.concat_arrays([values, pa.array([missing], values.type)])))

    @F.arrow_udf(f"array<{kind}>")
    def run(arrays: pa.Array) -> pa.Array:
        names, found = shared.value
        flat = arrays.flatten()
        at = pc.index_in(flat.cast(names.type), value_set=names).fill_null(len(names))
        size = pc.fill_null(pc.list_value_length(arrays), 0)
        bounds = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(size).cast(pa.int32())])
        return pa.ListArray.from_arrays(bounds, found.take(at), mask=arrays.is_null() if arrays.null_count else None)

    return run


def encode(docs: DataFrame, key: str, tokens: str, vocabulary: DataFrame, unknown: int) -> DataFrame:
    """key, ids: each document's tokens as ids, in order; tokens that are not in the vocabulary are unknown.

    A vocabulary that fits in memory is looked up within each row's batch, so no token is shuffled.
    """
    table = held(vocabulary, "token", "id")
    if table is not None:
        names, ids = (table.column(c).combine_chunks() for c in ("token", "id"))
        return docs.select(key, looked_up(docs.sparkSession, names.cast(pa.string()), ids.cast(pa.int64()), unknown, "bigint")(tokens).alias("ids"))
    flat = docs.select(key, F.posexplode(tokens).alias("at", "token"))
    met = flat.join(vocabulary.select("token", "id"), "token", "left")
    found = met.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("id", F.lit(unknown).cast("long")).alias("id")))).alias("all")).select(key, F.col("all.id").alias("ids"))
    return docs.select(key).join(found, key, "left").select(key, F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def token_of(vocabulary: DataFrame, unknown: str = UNK) -> DataFrame:
    """id, n, token: the token of each id, or unknown where several tokens share it."""
    return vocabulary.groupBy("id").agg(F.count("*").alias("n"), F.first("token").alias("one")).select("id", "n", F.when(F.col("n") > 1, F.lit(unknown)).otherwise(F.col("one")).alias("token"))


def last_token_of(vocabulary: DataFrame, line: str) -> DataFrame:
    """id, token: of tokens that share an id, the one on the last line."""
    return vocabulary.groupBy("id").agg(F.max_by("token", line).alias("token"))


def decode(docs: DataFrame, key: str, ids: str, vocabulary: DataFrame, unknown: str = UNK) -> DataFrame:
    """key, tokens: ids back as tokens, unknown for those without one or with several."""
    names = token_of(vocabulary, unknown)
    table = held(names, "id", "token")
    if table is not None:
        keys, tokens = (table.column(c).combine_chunks() for c in ("id", "token"))
        return docs.select(key, looked_up(docs.sparkSession, keys.cast(pa.int64()), tokens.cast(pa.string()), unknown, "string")(ids).alias("tokens"))
    flat = docs.select(key, F.posexplode(ids).alias("at", "id")).join(names, "id", "left")
    found = flat.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("token", F.lit(unknown)).alias("token")))).alias("all"))
    return docs.select(key).join(found.select(key, F.col("all.token").alias("tokens")), key, "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def others(candidates: Column, size: int) -> Column:
    """The ids below size that are no candidates."""
    return F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), candidates)


class Pieces:
    """Cuts words into the longest known pieces from their left, later ones with ##, in time in proportion to their length.

    Two tries, of pieces that begin a word and of those that go on one, share their nodes' failure links: where no
    child goes on from a node, what it has spelt so far is cut into the pieces that it `gives`, and the rest of it goes on
    from the node that its link points to. No character is read twice.
    """

    def __init__(self, known: Iterable[str], unknown: str = UNK, most: int = 100):
        self.unknown, self.most = unknown, most
        self.children: list[dict[str, int]] = [{}, {}]
        ends: dict[int, str] = {}
        for piece in known:
            # naive matching takes a piece with its signs at the start of a word, too
            for root, text in ((0, piece), *([(1, piece[2:])] if piece.startswith("##") else [])):
                at = root
                for c in text:
                    at = self._child(at, c)
                if at > 1:
                    ends[at] = piece
        self.fail: list[int] = [-1] * len(self.children)
        self.gives: list[tuple[str, ...]] = [()] * len(self.children)
        row = [0, 1]
        while row:
            below = []
            for node in row:
                for c, child in self.children[node].items():
                    below.append(child)
                    if child in ends:
                        self.fail[child], self.gives[child] = 1, (ends[child],)
                        continue
                    at, given = self.fail[node], self.gives[node]
                    while at >= 0 and c not in self.children[at]:
                        given += self.gives[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.gives[child] = self.children[at][c], given
            row = below

    def _child(self, node: int, c: str) -> int:
        found = self.children[node].get(c)
        if found is None:
            found = self.children[node][c] = len(self.children)
            self.children.append({})
        return found

    def __call__(self, word: str) -> list[str]:
        if len(word) > self.most:
            return [self.unknown]
        out: list[str] = []
        at = 0
        for c in word:
            while (child := self.children[at].get(c)) is None:
                out += self.gives[at]
                at = self.fail[at]
                if at < 0:
                    return [self.unknown]
            at = child
        while at > 1:
            out += self.gives[at]
            at = self.fail[at]
        return out if at >= 0 else [self.unknown]


def word_pieces(docs: DataFrame, tokens: str, known: Sequence[str], out: str = "pieces") -> DataFrame:
    """docs with each token cut into word pieces; a batch's words are told apart before any is cut."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(list(known))

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces, seen = Pieces(shared.value), {}
        for arrays in batches:
            if len(seen) > CACHE_WORDS:
                seen.clear()
            words = arrays.flatten().dictionary_encode()
            rows = []
            for w in words.dictionary.to_pylist():
                if (found := seen.get(w)) is None:
                    found = seen[w] = pieces(w)
                rows.append(found)
            each = pa.array(rows, pa.list_(pa.string())).take(words.indices)
            # pieces before each word, and so before each document
            before = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(each), 0).to_numpy(zero_copy_only=False))]
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False))]
            yield pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), each.flatten())

    return docs.withColumn(out, cut(tokens))
