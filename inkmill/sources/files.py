"""Readers of corpora and task files, configurations, and small sinks.

Paths go through the Hadoop file system of the session, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkmill.functions import text as T

FORMATS = ("txt", "json", "jsonl")
#: Line ends of a file of JSON lines: others may stand inside its strings.
RECORD_END = r"\r\n|[\r\n]"
#: Places of splits up to this number are broadcast to the lines; more are joined by a shuffle.
BROADCAST_SPLITS = 200_000


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that driver and executors share, as spark.checkpoint.dir names it; a local one where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix=f'inkmill-{kind}-')}"


def listing(spark: SparkSession, path: str, end: str = ".txt") -> list[str]:
    """Files below a folder whose names have this end, in the order of their paths."""
    _, fs, at = _fs(spark, path)
    found, each = [], fs.listFiles(at, True)
    while each.hasNext():
        file = each.next().getPath()
        if file.getName().endswith(end):
            found.append(file.toUri().getPath())
    return sorted(found)


def _plain_path() -> Column:
    """The path of a row's file, as a URI's path with its escapes undone."""
    return F.expr("url_decode(replace(regexp_replace(_metadata.file_path, '^[a-zA-Z0-9+.-]+:(//[^/]*)?', ''), '+', '%2B'))")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """place, path and text of all `*.txt` below a folder, empty files too, which Spark's reader leaves out."""
    files = [(i, p) for i, p in enumerate(listing(spark, path))]
    listed = spark.createDataFrame(files, "place long, path string")
    if not files:
        return listed.withColumn("text", F.lit(""))
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    texts = read.select(_plain_path().alias("path"), F.col("value").alias("text"))
    return listed.join(texts, "path", "left").select("place", "path", F.coalesce("text", F.lit("")).alias("text"))


def split_file(spark: SparkSession, folder: str, split: str) -> str:
    """The first file of a folder whose name begins with the split's name."""
    _, fs, at = _fs(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith(split))
    if not names:
        raise FileNotFoundError(f"no file for {split} in {folder}")
    return f"{folder}/{names[0]}"


def _unended(spark: SparkSession, path: str) -> list[str]:
    """Paths of the files, of a file or a folder, whose last line has no end."""
    jvm, fs, at = _fs(spark, path)
    names = [at] if fs.getFileStatus(at).isFile() else [s.getPath() for s in fs.listStatus(at) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    out = []
    for name in names:
        if size := fs.getFileStatus(name).getLen():
            stream = fs.open(name)
            try:
                stream.seek(size - 1)
                if stream.read() != 10:
                    out.append(name.toUri().getPath())
            finally:
                stream.close()
    return out


def numbered_lines(spark: SparkSession, path: str, end: str = T.LINE_END) -> DataFrame:
    """pos and value: the lines of a file, or of a folder's files in the order of their paths, in as many tasks as they have splits.

    Two passes: the first counts the lines of every split (a range of bytes of a file, as Spark deals them), and sums
    over earlier splits give each its first place; in the second a line's place is that and its number within
    the split. Only the sums, a row for each split, are gathered. No line moves between tasks, unless lines have ends other
    than a line feed within: then splits are brought into the order of their lines.
    """
    open_ended = _unended(spark, path)
    read = spark.read.option("lineSep", "\n").text(path)
    split = [_plain_path().alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("size")]
    # a carriage return before the line feed belongs to the line's end
    pieces = F.split(F.regexp_replace("value", r"\r\z", ""), end)
    rows = read.select(*split, F.monotonically_increasing_id().alias("id"), pieces.alias("pieces"))
    many = F.size("pieces").cast("long")
    counted = rows.groupBy("path", "start", "size").agg(F.sum(many).alias("lines"), F.min("id").alias("first"), F.count("*").alias("rows")).collect()
    if not counted:
        return spark.createDataFrame([], "pos long, value string")
    at, heads = 0, []
    for r in sorted(counted, key=lambda r: (r.path, r.start)):
        heads.append((r.path, r.start, r.size, r.first, at))
        at += r.lines
    known = spark.createDataFrame(heads, "path string, start long, size long, first long, head long")
    if at == sum(r.rows for r in counted):
        within = F.col("id") - F.col("first")
    else:
        before = Window.partitionBy("path", "start", "size").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("within", F.coalesce(F.sum(many).over(before), F.lit(0)))
        within = F.col("within")
    met = rows.join(F.broadcast(known) if len(heads) <= BROADCAST_SPLITS else known, ["path", "start", "size"], "left")
    # had Spark dealt the bytes otherwise in the second pass, no place would be right
    first = F.when(F.col("head").isNull(), F.raise_error(F.lit("the file's splits changed while it was read"))).otherwise(F.col("head") + within)
    out = met.select(first.alias("first"), "path", F.posexplode("pieces").alias("i", "value")).select((F.col("first") + F.col("i")).alias("pos"), "path", "value")
    # white space of a line end at the end of all opens no further line
    spare = F.lit(False)
    if open_ended:
        # one path for each file of a folder
        spare = (F.col("pos") == at - 1) & (F.col("value") == "") & F.col("path").isin(open_ended)
    return out.where(~spare).select("pos", "value")


def load(spark: SparkSession, path: str, schema: str | StructType | None = None, kind: str | None = None) -> DataFrame:
    """A task file by its extension or a given kind, with `pos`, the place of each record.

    txt: `value`, a row for each line. jsonl: a record a line; a line that is none is an error. Both are read in splits, and the
    path may be a folder of such files. json: a list of records, or an object of which the values are taken in order, in one row.
    """
    kind = kind or path.rpartition(".")[2].lower()
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if kind == "txt":
        return numbered_lines(spark, path)
    if schema is None:
        raise ValueError("records need a schema")
    ddl = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">")
    if kind == "jsonl":
        record = F.from_json("value", ddl, {"mode": "FAILFAST"})
        checked = F.when(F.trim("value") == "", F.raise_error(F.lit("an empty line is no record"))).otherwise(record)
        return numbered_lines(spark, path, RECORD_END).select("pos", checked.alias("r")).select("pos", "r.*")
    whole = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{ddl}>>", {"mode": "FAILFAST"})
    named = F.map_values(F.from_json("value", f"map<string,struct<{ddl}>>", {"mode": "FAILFAST"}))
    return whole.select(F.posexplode(F.when(F.ltrim("value").startswith("["), listed).otherwise(named)).alias("pos", "r")).select(F.col("pos").cast("long").alias("pos"), "r.*")


def config(spark: SparkSession, path: str, key: str | None = None, kind: str | None = None) -> dict:
    """A configuration from JSON or YAML (where a YAML library is installed), or the part of it under a key."""
    kind = kind or path.rpartition(".")[2]
    content = spark.read.text(path, wholetext=True).first()[0]
    if kind == "json":
        out = json.loads(content)
    else:
        if kind not in ("yaml", "yml"):
            import warnings

            warnings.warn(f"{path} is taken for YAML", stacklevel=2)
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no YAML library is installed") from e
        out = yaml.safe_load(content)
    return out[key] if key else out


def merged(*configs: dict) -> dict:
    """Configurations one over the other: dicts merge, lists are joined, the last of other values counts."""
    out: dict = {}
    for c in configs:
        for k, v in c.items():
            if isinstance(v, dict) and isinstance(out.get(k), dict):
                out[k] = merged(out[k], v)
            elif isinstance(v, list) and isinstance(out.get(k), list):
                out[k] = out[k] + v
            else:
                out[k] = v
    return out


def output_folder(base: str, template: int | None = None, pinyin: bool = False) -> str:
    return base + (f"/template-{template}" if template is not None else "") + ("-pinyin" if pinyin else "")


def cached(spark: SparkSession, folder: str, split: str, template: int, build, use_cache: bool = True) -> DataFrame:
    """The rows that build() gives, kept as Parquet by split and template and read from there again."""
    path = f"{folder}/{split}-template-{template}"
    jvm, fs, _ = _fs(spark, path)
    if not (use_cache and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_meta(meta: DataFrame, path: str) -> None:
    meta.coalesce(1).write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """id, prompt, label where there is one, and predict, added to a log of JSON lines."""
    rows.select("id", "prompt", *(["label"] if "label" in rows.columns else []), "predict").write.mode("append").json(path)


def from_list(spark: SparkSession, rows: Iterable[dict], schema: str) -> DataFrame:
    """Records in memory with `id`, their place, and a mask of ones where they have none."""
    numbered = [{**r, "id": i} for i, r in enumerate(rows)]
    out = spark.createDataFrame(numbered, f"id long, {schema}")
    if "attention_mask" not in out.columns:
        out = out.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))
    return out


def sample(rows: DataFrame, order: str, n: int = 3) -> list:
    """The first rows, to be looked at."""
    return rows.orderBy(order).limit(n).collect()
