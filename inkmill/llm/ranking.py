"""Ranked lexical search: the best documents for each item, by a join that thresholds prune from the start.

A document's score for an item is the sum of whole-number impacts of the item's terms in it; an impact grows
with the term's rarity and its share of the document (`weight`, `impacts`). Exactly the `K` highest scores
of each item are wanted, equal ones by doc_id.

1. Each document becomes one small row: its length, and of the items' terms those it holds with their
   numbers. These rows are stored; document frequencies are counted from them.
2. Each term's highest and `K`th highest impact are found. As `K` documents reach the latter with this term
   alone, the greatest `K`th impact of an item's terms is a lower bound of the item's `K`th score: the seed
   of its threshold.
3. An item's terms are ordered by their highest impact; where the sum of the highest impacts of all later
   ones (suffix bound) is below the threshold, a document with none but those cannot be among the best.
   Documents are joined with items by the other terms, the essential ones. A pair whose essential
   impacts and suffix bound reach the threshold is a candidate and scored exactly. Every task raises the
   thresholds by the `K`th of the scores it has seen, which is a lower bound, too.
4. The best of each item in each task, `K` rows at most, meet in a window by item.

Nothing is approximate, as a pair is left out only if its score is proven to be below `K` others. What a
task holds depends on the items: they are taken in blocks of about `BLOCK_TERMS` pairs of item and term, one
run over the documents for each block. No posting is shuffled, so no frequent term makes a large task.

Defined results: null and empty texts have no terms, as documents (they count nowhere) and as items (no
rows); documents that share no term with weight have no rank; equal documents each have their own; equal
documents of one doc_id, too; documents without a doc_id come last among equal scores; equal rows of items are
one item, rows of one item_id with other texts are ranked for themselves; empty tables give no rows. Only
doc_id, item_id and the texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmill.llm._shared import new_folder, small_batches

K, BLOCK_TERMS = 10, 300_000
#: Cells (document, item) that a task looks at in one go.
CELLS = 2_000_000
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
ROW = "doc_id long, n long, terms array<int>, times array<int>"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LETTERS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def penalty(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of documents with n terms each."""
    if 90 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 10 + 90 * n * n_docs // n_terms
    return np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)


def impacts(times: np.ndarray, penalties: np.ndarray) -> np.ndarray:
    """Of postings, without the weights of their terms."""
    return 1_000_000_000 * times // (1000 * times + 8 * penalties)


def _blocks(benchmark: DataFrame, block_terms: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their distinct terms, in blocks of bounded size."""
    block: list[tuple[int | None, list[bytes]]] = []
    size = 0
    for row in benchmark.select("item_id", "text").where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        if terms := sorted(set(terms_of(row.text))):
            block.append((row.item_id, terms))
            size += len(terms)
            if size >= block_terms:
                yield block
                block, size = [], 0
    if block:
        yield block


def _shorten(index: Broadcast):
    """mapInArrow function: documents to rows of `ROW`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            words = [terms_of(t) for t in batch.column(1).to_pylist()]
            n = np.array([len(w) for w in words], np.int64)
            found = np.fromiter((known.get(w, -1) for ws in words for w in ws), np.int64, int(n.sum()))
            # documents above one another, terms side by side
            cells = (np.repeat(np.arange(len(n)), n) * len(known) + found)[found >= 0]
            cells, times = np.unique(cells, return_counts=True)
            docs, terms = np.divmod(cells, max(1, len(known)))
            ends = pa.array(np.searchsorted(docs, np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "times"])

    return run


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(n, place of the document, term, times) of a batch of rows: the first by documents, the others by postings."""
    n = batch.column(1).to_numpy(zero_copy_only=False)
    sizes = np.diff(batch.column(2).offsets.to_numpy())
    terms, times = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
    return n, np.repeat(np.arange(len(n)), sizes), terms, times


def _best(group: np.ndarray, order: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Places of the first k of each group, in the order of the arrays, the most important last."""
    place = np.lexsort((*order, group))
    group = group[place]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
    rank = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
    return place[rank < k]


def _peaks(n_docs: int, n_terms: int, k: int):
    """mapInArrow function: the k highest impacts of each term in a task, without its weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, impact = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            n, doc, terms, times = _flat(batch)
            term = np.r_[term, terms]
            impact = np.r_[impact, impacts(times, penalty(n, n_docs, n_terms)[doc])]
            kept = _best(term, (-impact,), k)
            term, impact = term[kept], impact[kept]
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(impact)], names=["term", "impact"])

    return run


class Join:
    """Items with the terms that documents are joined by; thresholds only rise."""

    def __init__(self, items: list[list[int]], weights: np.ndarray, highest: np.ndarray, kth: np.ndarray, k: int = K):
        self.k, self.weights, self.n_items = k, weights, len(items)
        item = np.repeat(np.arange(len(items)), [len(t) for t in items])
        term = np.concatenate([np.asarray(t, np.int64) for t in items])
        bound, seed = (weights * highest)[term], (weights * kth)[term]
        self.threshold = np.zeros(self.n_items, np.int64)
        np.maximum.at(self.threshold, item, seed)
        # the sum of the bounds of a term and of all lower ones of its item
        order = np.lexsort((bound, item))
        item, term, bound = item[order], term[order], bound[order]
        sums = np.cumsum(bound)
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        suffix = sums - np.repeat(sums[first] - bound[first], np.diff(np.r_[first, len(item)]))
        by_term = np.argsort(term, kind="stable")
        self.item, self.term, self.suffix = item[by_term], term[by_term], suffix[by_term]
        # no score can reach it where even the sum of all bounds is 0
        self.none = np.iinfo(np.int64).max

    def _lists(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(items by term, where each term's begin, how many there are) of some of the pairs."""
        many = np.bincount(self.term[some], minlength=len(self.weights))
        return self.item[some], np.cumsum(many) - many, many

    def _cells(self, lists, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """Sums of impacts by document and item, over the postings joined with the lists."""
        items, begin, many = lists
        times = many[term]
        at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[term], times)
        cell = np.repeat(doc, times) * self.n_items + items[at]
        # whole numbers below 2**53
        return np.bincount(cell, np.repeat(impact, times), n_docs * self.n_items)

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> tuple[np.ndarray, ...]:
        """(document, item, score) of all pairs that may be among the best."""
        least = np.maximum(self.threshold, 1)
        essential = self.suffix >= least[self.item]
        rest = np.zeros(self.n_items, np.int64)
        np.maximum.at(rest, self.item[~essential], self.suffix[~essential])
        partial = self._cells(self._lists(essential), doc, term, impact, n_docs)
        # impacts of a weight of 0 make no candidate
        hit = (partial > 0) & (partial.reshape(n_docs, -1) + rest >= least).ravel()
        chosen = np.flatnonzero(hit)
        in_hit = np.zeros(n_docs, bool)
        in_hit[chosen // self.n_items] = True
        mine = in_hit[doc]
        exact = partial[chosen] + self._cells(self._lists(~essential), doc[mine], term[mine], impact[mine], n_docs)[chosen]
        exact = exact.astype(np.int64)
        kept = exact >= least[chosen % self.n_items]
        return chosen[kept] // self.n_items, chosen[kept] % self.n_items, exact[kept]

    def raised(self, item: np.ndarray, score: np.ndarray) -> None:
        """Takes note of the best scores so far, at most k of each item."""
        lowest = np.full(self.n_items, self.none)
        np.minimum.at(lowest, item, score)
        full = np.bincount(item, minlength=self.n_items) >= self.k
        self.threshold[full] = np.maximum(self.threshold[full], lowest[full])


def _search(shared: Broadcast, n_docs: int, n_terms: int, k: int):
    """mapInArrow function: the best documents of each item in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = Join(*shared.value, k)
        item, score, doc_id, no_id = (np.zeros(0, np.int64) for _ in range(4))
        per = max(1, CELLS // join.n_items)
        for whole in batches:
            for at in range(0, whole.num_rows, per):
                batch = whole.slice(at, per)
                ids = batch.column(0)
                missing = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                n, doc, terms, times = _flat(batch)
                impact = join.weights[terms] * impacts(times, penalty(n, n_docs, n_terms)[doc])
                d, i, s = join.scores(doc, terms, impact, len(n))
                if not len(d):
                    continue
                item, score, doc_id, no_id = np.r_[item, i], np.r_[score, s], np.r_[doc_id, ids[d]], np.r_[no_id, missing[d]]
                kept = _best(item, (doc_id, no_id, -score), k)
                item, score, doc_id, no_id = item[kept], score[kept], doc_id[kept], no_id[kept]
                join.raised(item, score)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc_id, mask=no_id.astype(bool)), pa.array(score)], names=["item", "doc_id", "score"])

    return run


def _ranked(docs: DataFrame, block: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms in block for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    path = new_folder(spark, "postings")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_shorten(spark.sparkContext.broadcast(number)), ROW).write.parquet(path)
    rows = spark.read.parquet(path)
    n_docs, n_terms = rows.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    held = rows.where(F.size("terms") > 0)
    # as many rows as the block has terms at most, here and below
    weights, highest, kth = (np.zeros(len(vocabulary), np.int64) for _ in range(3))
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        weights[r.term] = weight(n_docs, r["count"])
    peaks = held.mapInArrow(_peaks(n_docs, n_terms, k), "term int, impact long")
    peaks = peaks.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))).where(F.col("rank") <= k)
    for r in peaks.groupBy("term").agg(F.max("impact").alias("highest"), F.min("impact").alias("least"), F.count("*").alias("n")).toLocalIterator():
        highest[r.term], kth[r.term] = r.highest, r.least if r.n == k else 0
    shared = spark.sparkContext.broadcast(([[number[t] for t in terms] for _, terms in block], weights, highest, kth))
    found = held.mapInArrow(_search(shared, n_docs, n_terms, k), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], "item long, item_id long")
    # as many names as the block has items
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, benchmark: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark = docs.sparkSession
    small_batches(spark)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(benchmark, block_terms):
        if (found := _ranked(docs, block, k)) is not None:
            out = out.unionByName(found)
    return out


def op11(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(docs, benchmark)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: The same over the documents and benchmark tables in DuckDB, without any threshold.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
c AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d WHERE len(t) > 0),
q AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
k AS (SELECT i, unnest(t) AS term FROM q),
p AS (SELECT r, n, term, count(*) AS tf FROM (SELECT r, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM k) GROUP BY r, n, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
s AS (SELECT i, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS score FROM p JOIN w USING (term) JOIN k USING (term), c GROUP BY i, r),
o AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM o JOIN q USING (i) WHERE rank <= {K}
"""
