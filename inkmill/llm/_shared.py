"""What the operators share: the common folder, lineage cuts and batch sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions.batches import BATCH_BYTES, BATCH_ROWS, small_batches  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where that is unset, as in local tests, a folder of this machine is made.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='inkmill-')}")
    # Spark gives it with its file system, and a folder of this application's own in it
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, where the loss of an executor cannot reach it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_as_dealt(df: DataFrame) -> DataFrame:
    """cut(df), of which Spark still knows by what columns its rows are dealt, so that joins by them move the other side only."""
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    said = conf.get(key)
    try:
        # an adaptive plan doesn't tell
        conf.set(key, "false")
        return cut(df)
    finally:
        conf.set(key, said)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column, mod: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod `mod` is `remainder`; false for a null doc_id."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % mod == remainder, F.lit(False))


def hash_order(doc_id: str, salt: int) -> Column:
    """A fixed pseudorandom number for a doc_id, by which bounded samples are drawn."""
    return F.xxhash64(F.col(doc_id), F.lit(salt))


def row_hash(docs: DataFrame) -> Column:
    """A hash of whole rows; of maps, which have none, as JSON."""
    return F.xxhash64(*[F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema])
