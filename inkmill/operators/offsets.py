"""Running totals over all rows in an order, without one task that sees all of them.

Rows are dealt to ranges of a whole-number key by fixed bounds, so the deal is the same whenever it is
worked out. Each range has its own running total; the ranges' totals, few rows, are added up before them.
Rows of one key stand in the order of a hash of the whole row; equal rows may change places, which no one
can tell. A key that fills ranges of its own, null included, is dealt on by that hash; its equal rows are
one row with a count until all totals are known, so that no number of copies makes a large task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a range, about, and ranges at most, beyond which they hold more rows.
ROWS_IN_RANGE, MOST_RANGES = 100_000, 4096
#: Room for the parts of a key between one range and the next.
PARTS = 1 << 20


def _bounds(df: DataFrame, key: str, rows: int) -> tuple[list[int], int]:
    """(quantiles of the key, repeated where a key fills several ranges; number of rows without a key)."""
    n, nulls = df.agg(F.count(key), F.count_if(F.col(key).isNull())).first()
    many = min(MOST_RANGES, -(-n // rows))
    if many < 2:
        return [], nulls
    shares = F.from_json(F.lit(str([i / many for i in range(1, many)])), "array<double>")
    return sorted(df.agg(F.percentile_approx(key, shares, 10 * many)).first()[0]), nulls


def _range(key: str, bounds: list[int], last: bool = False) -> Column:
    """The number of bounds below a key, found by halving; without a key -1, or one more than any (last)."""
    bounds = sorted(set(bounds))
    none = len(bounds) + 1 if last else -1
    if not bounds:
        return F.when(F.col(key).isNull(), none).otherwise(0).cast("long")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    # filled up, so that every step has a bound to look at
    known = F.from_json(F.lit(str(bounds + [(1 << 63) - 1] * (2 * steps[0] - 1 - len(bounds)))), "array<bigint>")
    found = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: at + F.when(F.element_at(known, at + step) < F.col(key), step).otherwise(F.lit(0)))
    return F.when(F.col(key).isNull(), F.lit(none)).otherwise(found).cast("long")


def ranges(df: DataFrame, key: str, rows: int = ROWS_IN_RANGE) -> Column:
    """An expression for the range of each row, in the order of the key; rows without a key come first.

    Bounds are quantiles of the key, worked out once, so that far-off or clustered keys leave no range with most
    rows; a row finds its range among them by halving.
    """
    return _range(key, _bounds(df, key, rows)[0])


def _hash(df: DataFrame, salt: int) -> Column:
    """A hash of whole rows; of maps, which have none, as JSON."""
    return F.xxhash64(*[F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema], F.lit(salt))


def _dealt(df: DataFrame, key: str, rows: int, last: bool = False) -> tuple[DataFrame, bool]:
    """(df with `_range` and `_tie`, the order within it, whether equal rows of crowded keys are one with `_copies`)."""
    bounds, nulls = _bounds(df, key, rows)
    times = Counter(bounds)
    crowded = [b for b, n in times.items() if n > 1]
    parts = max([n + 1 for n in times.values()] + [min(MOST_RANGES, -(-nulls // rows))])
    tied = df.withColumns({"_tie": _hash(df, 0), "_range": _range(key, bounds, last) * PARTS})
    if not crowded and nulls <= rows:
        return tied, False
    hot = F.coalesce(F.col(key).isin(crowded), F.lit(nulls > rows))
    # before them in their range are lower keys
    part = F.floor((F.col("_tie") / float(1 << 64) + 0.5) * parts).cast("long") + 1
    few = tied.where(hot).groupBy(key, "_tie", _hash(df, 1).alias("_more"), "_range").agg(F.first(F.struct(*[f"`{c}`" for c in df.columns])).alias("_row"), F.count("*").alias("_copies"))
    few = few.select("_row.*", "_tie", (F.col("_range") + F.least(part, F.lit(parts))).alias("_range"), "_copies")
    return tied.where(~hot).withColumn("_copies", F.lit(1).cast("long")).unionByName(few), True


def running(df: DataFrame, key: str, value: str, out: str, by: Sequence[str] = (), rows: int = ROWS_IN_RANGE, total: str = "_total", last: bool = False) -> DataFrame:
    """df with `out`: the sum of value over earlier rows in the order of key, and `total`: that over all, within each group of `by`.

    Rows without a key come first, or last.
    """
    by = list(by)
    dealt, copies = _dealt(df, key, rows, last)
    worth = F.col(value) * F.col("_copies") if copies else F.col(value)
    heads = dealt.groupBy(*by, "_range").agg(F.sum(worth).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a struct equals one with the same nulls, so the join finds rows dealt as the window has dealt them
    group = F.struct(*by) if by else F.lit(0)
    heads = heads.select(group.alias("_whose"), F.col("_range").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_head"), F.sum("_sum").over(Window.partitionBy(*by)).alias(total))
    if by:
        dealt = dealt.withColumn("_group", group)
    place = ["_group", "_range"] if by else ["_range"]
    within = Window.partitionBy(*place).orderBy(key, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_range") == F.col("_of")
    if by:
        same = (F.col("_group") == F.col("_whose")) & same
    met = dealt.withColumn("_own", F.coalesce(F.sum(worth).over(within), F.lit(0))).join(heads, same)
    met = met.withColumn(out, F.col("_head") + F.col("_own")).drop("_of", "_whose", "_group")
    if copies:
        met = met.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
        met = met.withColumn(out, F.col(out) + F.col("_copy") * F.coalesce(F.col(value), F.lit(0)))
    return met.drop("_range", "_head", "_own", "_tie", "_copies", "_copy")


def numbered(df: DataFrame, key: str, out: str, by: Sequence[str] = (), rows: int = ROWS_IN_RANGE, last: bool = False) -> DataFrame:
    """df with `out`: the number of earlier rows in the order of key; rows without one come first, or last."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), key, "_one", out, by, rows, last=last).drop("_one", "_total")
