"""Bounds on what a Python worker holds at a time, whatever the session's batches and the table are."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes that one Arrow batch to a Python worker may hold, and rows whose Python objects it holds.
BATCH_ROWS, BATCH_BYTES, PART_ROWS = 2000, 16 << 20, 100


def small_batches(spark: SparkSession | None = None) -> None:
    """Bounds the Arrow batches of a session, or the active one, by rows and bytes, since one text may be very long."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        said = spark.conf.get(key, None)
        now = int("".join(c for c in said if c.isdigit()) or 0) if said else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def by_parts(make: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """make() of a batch's columns, worked out some rows at a time, so that only their objects are there at once."""
    # an empty batch is one part, too
    return pa.concat_arrays([make(*[c.slice(at, PART_ROWS) for c in columns]) for at in range(0, max(1, len(columns[0])), PART_ROWS)])
