"""Encoded records: filters with rejects, batches, shards, metadata, duplicates, references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import arrays
from inkmill.functions.text import IGNORE_ID, ITEMS_PER_FILE, numbered_name
from inkmill.operators.offsets import numbered

#: Rows in a range of those that carry texts or ids along to be numbered.
WIDE_ROWS = 5000
TOO_LONG, MISALIGNED = "too long", "ids and pinyin differ in length"


def judged(rows: DataFrame, ids: str, most: int, pinyin: str | None = None) -> DataFrame:
    """rows with `reason`: why a row is to be discarded, or null."""
    reason = F.when(F.size(ids) > most, TOO_LONG)
    if pinyin:
        reason = F.when(F.size(ids) != F.size(pinyin), MISALIGNED).otherwise(reason)
    return rows.withColumn("reason", reason)


def kept(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").drop("reason")


def rejects(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null")


def repaired(ids: Column | str, pinyin: Column | str) -> Column:
    """Pinyin ids, or as many zeros as there are ids where the lengths differ."""
    return F.when(F.size(ids) == F.size(pinyin), F.col(pinyin) if isinstance(pinyin, str) else pinyin).otherwise(F.array_repeat(F.lit(0), F.size(ids)))


def batched(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with `batch`, by their order; those without a key come last, as in SQL."""
    return numbered(rows, key, "_at", rows=WIDE_ROWS, last=True).withColumn("batch", F.floor(F.col("_at") / size)).drop("_at")


def padded_batches(rows: DataFrame, key: str, size: int, columns: Sequence[str], labels: str | None = None) -> DataFrame:
    """rows with `batch`, each array padded to the longest of its batch: labels on the right, others on the left."""
    out = batched(rows, key, size)
    names = [*columns, *([labels] if labels else [])]
    most = out.groupBy("batch").agg(*[F.max(F.size(c)).alias(f"_{c}") for c in names])
    out = out.join(most, "batch")
    for c in columns:
        out = out.withColumn(c, arrays.pad_left(c, F.col(f"_{c}")))
    if labels:
        out = out.withColumn(labels, arrays.pad_right(labels, F.col(f"_{labels}"), IGNORE_ID))
    return out.drop(*[f"_{c}" for c in names])


def with_files(rows: DataFrame, key: str, items: int = ITEMS_PER_FILE, end: str = ".tfrecord.gz", dense: bool = False) -> DataFrame:
    """rows with `shard` and `file` by the place among the rows written; dense: key is that place, as of windows of one stream."""
    placed = rows.withColumn("_at", F.col(key)) if dense else numbered(rows, key, "_at", rows=WIDE_ROWS, last=True)
    out = placed.withColumn("shard", F.floor(F.col("_at") / items)).drop("_at")
    return out.withColumn("file", numbered_name(F.col("shard"), 8, end))


def with_input_files(rows: DataFrame, key: str, split: str, items: int = ITEMS_PER_FILE) -> DataFrame:
    """rows with `file` by the place among the rows read: filter afterwards, discarded rows keep their places."""
    n = rows.count()
    files = -(-n // items)
    width = len(str(files))
    out = numbered(rows, key, "_at", rows=WIDE_ROWS, last=True)
    return out.withColumn("file", F.concat(F.lit(f"{split}-"), numbered_name(F.floor(F.col("_at") / items), width), F.lit(f"-of-{files}"))).drop("_at")


def meta(rows: DataFrame, ids: str, file: str, labels: str | None = None, window: int | None = None) -> DataFrame:
    """One row: padding_shape, count, files, and whether rows have masks and labels."""
    shape = F.lit(window) if window else F.coalesce(F.max(F.size(ids)), F.lit(0))
    return rows.agg(
        shape.cast("long").alias("padding_shape"),
        F.count("*").alias("count"),
        F.sort_array(F.collect_set(file)).alias("files"),
        F.lit("GZIP").alias("compression_type"),
        F.lit(True).alias("has_attention_mask"),
        (F.coalesce(F.bool_or(F.col(labels).isNotNull()), F.lit(False)) if labels else F.lit(False)).alias("has_label"),
    )


def first_by(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key, in the order given; the others are dropped before they are shuffled."""
    names = [c for c in rows.columns if c not in keys]
    least = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), order).alias("_row"))
    return least.select(*keys, *[F.col("_row")[c].alias(c) for c in names]).select(*rows.columns)


def regrouped(rows: DataFrame, keys: Sequence[str], order: str, labels: str) -> DataFrame:
    """A row for each key: the first row's fields, `first` (its place) and all labels in order; null if one has none."""
    names = [c for c in rows.columns if c not in (*keys, labels)]
    out = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*names), order).alias("_row"), F.min(order).alias("first"), F.bool_or(F.col(labels).isNull()).alias("_open"), F.sort_array(F.collect_list(F.struct(F.col(order).alias("_at"), F.col(labels).alias("_label")))).alias("_all")
    )
    return out.select(*keys, *[F.col("_row")[c].alias(c) for c in names if c != order], "first", F.when(~F.col("_open"), F.col("_all._label")).alias(labels))


def regrouped_in_chunks(rows: DataFrame, keys: Sequence[str], order: str, labels: str, size: int = ITEMS_PER_FILE) -> DataFrame:
    """keys.., chunk, first, labels: each group's labels in the order of a whole number, `size` in a row, groups of any length.

    Places within a group come from running totals over ranges, so no task holds more of one than a range or a chunk.
    """
    placed = numbered(rows.select(*keys, order, labels), order, "_at", keys, last=True)
    chunks = placed.withColumn("chunk", F.floor(F.col("_at") / size)).groupBy(*keys, "chunk").agg(F.min(order).alias("first"), F.sort_array(F.collect_list(F.struct("_at", F.col(labels).alias("_label")))).alias("_all"))
    return chunks.select(*keys, "chunk", "first", F.col("_all._label").alias(labels))
