"""Packing as a stream: documents come in, full windows go out, the rest of the tokens waits.

Each micro-batch is packed as a table (`operators/packing.py`): lengths go through running totals by ranges and tokens
to their windows, so one stream uses as many tasks as its batch needs. Between batches a stream is the number of
its windows and its rest, the tokens that no window has dropped yet (fewer than a window holds). Both are kept as a row in a
folder for each batch, read by the next, so a batch that runs again finds what it found before and writes the
same files again.

Windows further apart than they are long follow one another from document to document; for these
(`windows`) a stream is one key of a stateful operator, several streams (`by`) run side by side.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from inkmill.functions import arrays
from inkmill.functions import text as T
from inkmill.operators import packing, tokenizer, vocabulary
from inkmill.operators.offsets import running

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_KEY = "spark.sql.streaming.stateStore.providerClass"


class Sink:
    """A function for foreachBatch: packs rows (by.., order, tokens), and writes by.., w, tokens to a folder for each batch.

    `order` is a whole number or a text. Batches follow each other: what comes later stands behind all that came before.
    With `epochs` the rests of all but the latest of these are let go, and `idle` tells that one of them ended
    without a window, as all later ones would.
    """

    def __init__(self, path: str, state: str, n: int, stride: int, by: Sequence[str] = (), order: str = "path", epochs: str | None = None):
        packing.check(n, stride)
        if stride > n:
            raise ValueError("windows further apart than they are long are packed by windows()")
        self.path, self.state, self.n, self.stride, self.order = path.rstrip("/"), state.rstrip("/"), n, stride, order
        self.by, self.epochs, self.idle = [*([epochs] if epochs else []), *by], epochs, False

    def _before(self, rows: DataFrame, batch: int) -> DataFrame:
        """by.., w, rest of the streams as the batch before left them."""
        kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in self.by)
        if not batch:
            return rows.sparkSession.createDataFrame([], f"{kinds}w long, rest array<string>")
        return rows.sparkSession.read.schema(f"{kinds}w long, rest array<string>").parquet(f"{self.state}/batch={batch - 1}")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            self._pack(rows, batch)
        finally:
            rows.unpersist()

    def _pack(self, rows: DataFrame, batch: int) -> None:
        before = self._before(rows, batch)
        if dict(rows.dtypes)[self.order] == "string":
            # a batch has few files
            places = rows.select(F.col(self.order).alias("_name")).distinct().withColumn("_key", F.row_number().over(Window.orderBy("_name")).cast("long"))
            keyed = rows.join(places, F.col(self.order) == F.col("_name")).drop("_name")
        else:
            keyed = rows.withColumn("_key", F.col(self.order).cast("long"))
        # what is left of a stream stands before all that comes, as if it had no key
        rest = before.select(*self.by, F.lit(None).cast("long").alias("_key"), F.col("rest").alias("tokens"))
        docs = keyed.select(*self.by, "_key", "tokens").unionByName(rest)
        packed = packing.windows(docs, "_key", "tokens", self.n, self.stride, self.by)
        known = before.select(*[F.col(c).alias(f"_{c}") for c in self.by], F.col("w").alias("_w"))
        met = F.lit(True)
        for c in self.by:
            met = met & F.col(c).eqNullSafe(F.col(f"_{c}"))
        # a row for each stream
        numbered = packed.join(F.broadcast(known), met, "left").select(*self.by, (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), "tokens")
        numbered.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        placed = running(docs.select(*self.by, "_key", "tokens", F.size("tokens").cast("long").alias("len")), "_key", "len", "at", self.by, packing.ROWS_IN_RANGE, "total")
        made = F.greatest(F.floor((F.col("total") - self.n) / self.stride) + 1, F.lit(0)).cast("long")
        left = F.greatest(made * self.stride - F.col("at"), F.lit(0))
        late = placed.withColumns({"made": made, "left": left})
        # of documents before the rest nothing but the count goes on
        tail = F.when(F.col("at") + F.col("len") > F.col("made") * self.stride, F.struct("at", F.slice("tokens", (F.col("left") + 1).cast("int"), (F.col("len") - F.col("left")).cast("int")).alias("piece")))
        after = late.groupBy(*self.by).agg(F.max("made").alias("made"), F.flatten(F.sort_array(F.collect_list(tail))["piece"]).alias("rest"))
        streams = after.join(F.broadcast(known), met, "left").select(*self.by, (F.col("made") + F.coalesce("_w", F.lit(0))).alias("w"), "rest")
        if self.epochs:
            latest = F.max(self.epochs).over(Window.partitionBy(F.lit(0)))
            # a row for each stream and epoch of the batch
            marked = streams.withColumn("_over", F.col(self.epochs) < latest).collect()
            over = {r[self.epochs] for r in marked if r["_over"]}
            self.idle = self.idle or any(not any(r.w for r in marked if r[self.epochs] == e) for e in over)
            streams = rows.sparkSession.createDataFrame([[r[c] for c in (*self.by, "w", "rest")] for r in marked if not r["_over"]], before.schema)
        streams.write.mode("overwrite").parquet(f"{self.state}/batch={batch}")


def read_files(spark: SparkSession, path: str, files_per_batch: int = 2, known: Collection[str] | None = None) -> DataFrame:
    """path and tokens of text files as they arrive, in the pieces that are known, if given; files without content give no row."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path", T.framed(tokenizer.tokenized(F.decode("content", "UTF-8"), known)).alias("tokens"))


def examples(packed: DataFrame, table: dict[str, int], unknown: int) -> DataFrame:
    """Windows with their ids as data and label, and the attention mask."""
    names, ids = pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())
    data = packed.withColumn("data", vocabulary.looked_up(packed.sparkSession, names, ids, unknown, "bigint")("tokens"))
    return data.select(*[c for c in packed.columns if c != "tokens"], "data", arrays.ones("data").alias("attention_mask"), F.col("data").alias("label"))


def start(stream: DataFrame, sink: Sink, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Packs a stream into a sink's folder: all that has come in, in its batches, or on and on."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_until_idle(stream: DataFrame, sink: Sink, checkpoint: str, most_epochs: int | None = None) -> None:
    """Packs a replay until an epoch has given no window, or all epochs that the source has are through."""
    query = start(stream, sink, checkpoint, once=False)
    try:
        if most_epochs is not None:
            query.processAllAvailable()
        else:
            while not sink.idle and not query.awaitTermination(1):
                pass
    finally:
        query.stop()


def pack_once(spark: SparkSession, path: str, sink: str, checkpoint: str, n: int, stride: int) -> DataFrame:
    """Packs all text files that have come in below a path, then stops; the next call goes on from there."""
    start(read_files(spark, path), Sink(sink, f"{checkpoint}/rest", n, stride), f"{checkpoint}/query").awaitTermination()
    return spark.read.schema("w long, tokens array<string>").parquet(sink)


class Packer(StatefulProcessor):
    """Holds the tokens that no window has dropped yet, and how many windows there were."""

    def __init__(self, n: int, stride: int):
        self.n, self.stride = n, stride

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "tokens array<string>, w long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pool, w = [], 0
        if self.rest.exists():
            held = self.rest.get()
            pool, w = list(held[0]), held[1]
        files = pd.concat(list(rows)).sort_values("path")
        out, at = [], 0
        for tokens in files["tokens"]:
            pool += list(tokens)
            while len(pool) - at >= self.n:
                out.append((key[0], w, pool[at : at + self.n]))
                # beyond what has been read nothing can be dropped yet
                at, w = min(at + self.stride, len(pool)), w + 1
        self.rest.update((pool[at:], w))
        yield pd.DataFrame(out, columns=["stream", "w", "tokens"])

    def close(self) -> None:
        pass


def windows(stream: DataFrame, n: int, stride: int, by: str | None = None) -> DataFrame:
    """stream, w, tokens: windows of any stride as they fill, numbered for each stream; files of a batch go by their path.

    The session's state store has to be `ROCKS` (`STATE_KEY`).
    """
    packing.check(n, stride)
    key = F.col(by) if by else F.lit("all")
    return stream.withColumn("stream", key).groupBy("stream").transformWithStateInPandas(Packer(n, stride), "stream string, w long, tokens array<string>", "append", "none")
