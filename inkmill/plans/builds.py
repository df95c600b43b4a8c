"""Whole plans: corpus to windows, task records to training examples, evaluation sets and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions import arrays
from inkmill.functions import text as T
from inkmill.operators import packing, records, scoring, tokenizer, vocabulary
from inkmill.plans import templates

Encode = Callable[[Column], Column]


def id_lookup(table: dict[str, int], unknown: int) -> Encode:
    """Ids of each text of an array: that of the text itself if it is one token, else those of its tokens."""
    return lambda texts: tokenizer.looked_up(texts, table, unknown)


def encoded(parts: Column | str, encode: Encode) -> Column:
    """Parts with their ids."""
    parts = T.as_column(parts)
    return F.zip_with(parts, encode(F.transform(parts, lambda p: p["text"])), lambda p, ids: F.struct(ids.alias("ids"), p["is_label"].alias("is_label")))


def corpus_tokens(text: Column | str, vocabulary_table: DataFrame) -> Column:
    """The tokens of texts by a vocabulary that workers hold."""
    rows = vocabulary.held(vocabulary_table, "token")
    if rows is None:
        raise ValueError(f"word pieces need a vocabulary of at most {vocabulary.BROADCAST_ROWS} rows")
    return tokenizer.tokenized(text, rows.column(0).to_pylist())


def pack_corpus(docs: DataFrame, key: str, text: str, vocabulary_table: DataFrame, unknown: int, n: int, stride: int | None = None) -> DataFrame:
    """w, data, attention_mask: windows of a corpus as ids."""
    framed = docs.select(key, T.framed(corpus_tokens(text, vocabulary_table)).alias("tokens"))
    packed = packing.windows(framed, key, "tokens", n, stride)
    ids = vocabulary.encode(packed, "w", "tokens", vocabulary_table, unknown)
    return ids.select("w", F.col("ids").alias("data"), arrays.ones("ids").alias("attention_mask"))


def build_training(rows: DataFrame, name: str, encode: Encode, most: int = T.MODEL_WINDOW, number: int = 0, marks=templates.Marks(), split: str = "train", items: int = T.ITEMS_PER_FILE) -> tuple[DataFrame, DataFrame]:
    """(examples with data, label, attention_mask and file; rejects with a reason)."""
    numbered = records.with_input_files(rows, "pos", split, items)
    parts = templates.training(numbered, name, number, marks).withColumn("_parts", encoded("parts", encode))
    made = parts.withColumn("data", arrays.joined_ids("_parts")).withColumn("label", arrays.loss_labels("_parts")).withColumn("attention_mask", arrays.ones("data")).drop("_parts")
    judged = records.judged(made, "data", most)
    return records.kept(judged).select("pos", "data", "label", "attention_mask", "file"), records.rejects(judged)


def build_evaluation(rows: DataFrame, name: str, encode: Encode, number: int = 0, marks=templates.Marks()) -> DataFrame:
    """pos, input_ids, label_ids (null without a label) and, for products, type and id with all references."""
    made = templates.evaluation(rows, name, number, marks)
    made = made.withColumn("input_ids", arrays.joined_ids(encoded("prompt", encode))).withColumn("label_ids", F.when(F.col("labels").isNotNull(), arrays.joined_ids(encoded("labels", encode))))
    if name == "cepsum2":
        flat = made.select("type", "id", F.struct("pos", "at").alias("place"), "input_ids", "label_ids")
        return records.regrouped(flat, ["type", "id"], "place", "label_ids")
    return made.select("pos", "input_ids", "label_ids")


def score(predictions: DataFrame, names: DataFrame, metric: str | None) -> DataFrame | None:
    """The metric over the first prediction of each id, decoded; None without a metric."""
    measure = scoring.metric(metric)
    if measure is None:
        return None
    first = scoring.first_predictions(scoring.cleaned(predictions))
    said = vocabulary.decode(first, "id", "generated_ids", names).select("id", T.decoded("tokens").alias("prediction"))
    wanted = vocabulary.decode(first.where("label_ids is not null"), "id", "label_ids", names).select("id", T.decoded("tokens").alias("label"))
    return measure(said.join(wanted, "id", "left"))
