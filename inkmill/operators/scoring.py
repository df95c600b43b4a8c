"""After generation: cleaning predictions, first of each id, metrics, logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions import arithmetic, arrays
from inkmill.functions.text import EOS_ID, IGNORE_ID, PAD_ID
from inkmill.operators.records import first_by


def cleaned(rows: DataFrame, end: int = EOS_ID, pad: int = PAD_ID) -> DataFrame:
    """generated_ids without the padded prompt and what follows the end id; prompts and labels without fill."""
    out = rows.withColumn("generated_ids", arrays.until_end(arrays.cut_prompt("generated_ids", "input_ids"), end)).withColumn("input_ids", arrays.without("input_ids", pad))
    return out.withColumn("label_ids", arrays.without("label_ids", IGNORE_ID)) if "label_ids" in rows.columns else out


def first_predictions(rows: DataFrame, order: str = "pos") -> DataFrame:
    return first_by(rows, ["id"], order)


def accuracy(rows: DataFrame, correct: Column, labelled: Column | None = None) -> DataFrame:
    """correct, total and accuracy; all null if a row has no label, accuracy null for no rows."""
    whole = F.coalesce(F.bool_and(labelled), F.lit(True)) if labelled is not None else F.lit(True)
    right, n = F.coalesce(F.sum(correct.cast("long")), F.lit(0).cast("long")), F.count("*")
    out = rows.agg(whole.alias("_whole"), right.alias("_right"), n.alias("_n"))
    return out.select(
        F.when(F.col("_whole"), F.col("_right")).alias("correct"), F.when(F.col("_whole"), F.col("_n")).alias("total"), F.when(F.col("_whole") & (F.col("_n") > 0), F.col("_right") / F.col("_n")).alias("accuracy")
    )


def arithmetic_accuracy(rows: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Share of predictions that come to the label's number; what cannot be read is wrong."""
    line = arithmetic.rewritten(F.concat(F.col(prediction), F.lit("="), F.col(label)))
    left, right = arithmetic.sides(line)
    values = rows.select(F.col(label).isNotNull().alias("_has"), arithmetic.evaluated(left).alias("_a"), arithmetic.evaluated(right).alias("_b"))
    return accuracy(values, arithmetic.close(F.col("_a"), F.col("_b")), F.col("_has"))


METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {"arithmetic": arithmetic_accuracy}


def metric(name: str | None) -> Callable[[DataFrame], DataFrame] | None:
    """The metric of that name; None for none."""
    return METRICS.get(name) if name else None


def parameter_share(rows: DataFrame, size: str, trainable: Column) -> DataFrame:
    """trainable and total sums, and their ratio as a percentage with three decimals."""
    out = rows.agg(F.sum(F.when(trainable, F.col(size)).otherwise(0)).alias("trainable"), F.sum(size).alias("total"))
    return out.withColumn("percent", F.format_string("%.3f%%", F.col("trainable") * 100.0 / F.col("total")))
