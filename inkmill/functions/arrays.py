"""Array expressions over token ids: padding, masks, labels, cuts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from inkmill.functions.text import BOS, EOS, EOS_ID, IGNORE_ID, PAD_ID, as_column


def pad_right(x: Column | str, n: Column | int, value: int = PAD_ID) -> Column:
    x, n = as_column(x), F.lit(n) if isinstance(n, int) else n
    return F.concat(x, F.array_repeat(F.lit(value), F.greatest(n - F.size(x), F.lit(0))))


def pad_left(x: Column | str, n: Column | int, value: int = PAD_ID) -> Column:
    x, n = as_column(x), F.lit(n) if isinstance(n, int) else n
    return F.concat(F.array_repeat(F.lit(value), F.greatest(n - F.size(x), F.lit(0))), x)


def ones(x: Column | str) -> Column:
    return F.transform(as_column(x), lambda _: F.lit(1))


def joined_ids(parts: Column | str) -> Column:
    """The ids of all parts, one behind the other."""
    return F.flatten(F.transform(as_column(parts), lambda p: p["ids"]))


def loss_labels(parts: Column | str) -> Column:
    """The ids of label parts; those of all others are ignored."""
    return F.flatten(F.transform(as_column(parts), lambda p: F.when(p["is_label"], p["ids"]).otherwise(F.transform(p["ids"], lambda _: F.lit(IGNORE_ID)))))


def part(text: Column | str, is_label: bool | Column = False) -> Column:
    """A piece of an example: its text, and whether it is to be learnt."""
    text = F.lit(text) if isinstance(text, str) else text
    return F.struct(text.alias("text"), (F.lit(is_label) if isinstance(is_label, bool) else is_label).alias("is_label"))


def started(parts: Column) -> Column:
    return F.concat(F.array(part(BOS)), parts)


def closed(parts: Column) -> Column:
    """Parts between a start that is not learnt and an end that is."""
    return F.concat(started(parts), F.array(part(EOS, True)))


def interleaved(items: Column | str, between: Column) -> Column:
    """Items with a separator between each two."""
    items = as_column(items)
    both = F.flatten(F.transform(items, lambda x: F.array(x, between)))
    return F.when(F.size(items) > 0, F.slice(both, 1, F.greatest(2 * F.size(items) - 1, F.lit(1)))).otherwise(items)


def cut_prompt(generated: Column | str, prompt: Column | str) -> Column:
    generated = as_column(generated)
    return F.slice(generated, F.size(as_column(prompt)) + 1, F.greatest(F.size(generated), F.lit(1)))


def until_end(ids: Column | str, end: int = EOS_ID) -> Column:
    """Ids before the first end id."""
    ids = as_column(ids)
    at = F.array_position(ids, end)
    return F.when(at > 0, F.slice(ids, 1, (at - 1).cast("int"))).otherwise(ids)


def without(ids: Column | str, value: int = PAD_ID) -> Column:
    return F.filter(as_column(ids), lambda x: x != value)


@F.arrow_udf(ArrayType(IntegerType()))
def _places(masks: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(masks), 0).to_numpy(zero_copy_only=False)
    bounds = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    flat = pc.fill_null(masks.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    sums = np.r_[0, np.cumsum(flat)]
    within = sums[1:] - np.repeat(sums[bounds[:-1]], sizes)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.where(flat == 0, 1, within - 1).astype(np.int32)), mask=masks.is_null() if masks.null_count else None)


def position_ids(mask: Column | str) -> Column:
    """Places among the unmasked, from 0; masked ones have place 1. One sum over a batch's masks, whatever their lengths."""
    return _places(as_column(mask))


def shifted(labels: Column | str) -> Column:
    """Labels without the first: what each place but the last is to foretell."""
    labels = as_column(labels)
    return F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))


def choice(i: Column, *texts: str) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), i + 1)
