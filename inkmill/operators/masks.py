"""What a model's attention and loss say in tables: visible keys, cross-entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions.text import IGNORE_ID


def causal(q: Column, k: Column) -> Column:
    return k <= q


def strided(q: Column, k: Column, stride: int, last: int) -> Column:
    """Keys of the same stretch of `stride` places, and the last `last` places of each earlier stretch."""
    return causal(q, k) & ((F.floor(k / stride) == F.floor(q / stride)) | (k % stride >= stride - last))


def visible(spark: SparkSession, n: int, stride: int | None = None, last: int = 1) -> DataFrame:
    """q, n_visible: keys that each of n places sees; each place lists its own keys, so nothing is joined."""
    places = spark.range(n).select(F.col("id").alias("q"))
    keys = F.sequence(F.lit(0).cast("long"), F.col("q"))
    seen = F.filter(keys, lambda k: strided(F.col("q"), k, stride, last)) if stride else keys
    return places.select("q", F.size(seen).cast("long").alias("n_visible"))


def visible_at(q: Column, stride: int | None = None, last: int = 1) -> Column:
    """How many keys place q sees: all up to it, or those of its stretch and the last ones of each earlier stretch."""
    if not stride:
        return q + 1
    return q % stride + 1 + F.floor(q / stride) * min(last, stride)


def visible_in(rows: DataFrame, length: str, window: int, stride: int | None = None, last: int = 1) -> DataFrame:
    """rows with n_visible: the keys that all places of a row of so many tokens see, cut into windows."""
    # places of a window are few: what they see is added up once for each length of a window
    sums = [0]
    for q in range(window):
        sums.append(sums[-1] + (q + 1 if not stride else q % stride + 1 + q // stride * min(last, stride)))
    known = F.from_json(F.lit(str(sums)), "array<bigint>")
    n = F.col(length)
    whole = F.floor(n / window)
    return rows.withColumn("n_visible", (whole * sums[window] + F.element_at(known, (n - whole * window + 1).cast("int"))).cast("long"))


def cross_entropy(logits: Column | str, label: Column | str) -> Column:
    """log(sum(exp(x))) - x[label], with the greatest value taken out first; null for a label that is to be ignored."""
    x = F.col(logits) if isinstance(logits, str) else logits
    y = F.col(label) if isinstance(label, str) else label
    x = F.transform(x, lambda v: v.cast("double"))
    most = F.array_max(x)
    loss = most + F.ln(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - most))) - F.element_at(x, y + 1)
    return F.when(y != IGNORE_ID, loss)
