import io
import json
import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkmill.functions import text as T
from inkmill.sources import files, replay, tfrecord
from inkmill.streaming import packing as stream
from tests.test_operators import pool


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def test_corpus_keeps_empty_files(spark, tmp_path):
    for name, text in (("b/1.txt", "one\n"), ("a 文/2+.txt", ""), ("c.txt", "three"), ("d.md", "no")):
        write(f"{tmp_path}/{name}", text)
    got = files.corpus(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r.path.rpartition("/")[2], r.text) for r in got] == [("2+.txt", ""), ("1.txt", "one\n"), ("c.txt", "three")]


def test_task_files(spark, tmp_path):
    write(f"{tmp_path}/train-1.txt", "a b\r\n\nc\n")
    write(f"{tmp_path}/train.json", '[{"x": 1, "y": "é"},\n {"x": 2}]')
    write(f"{tmp_path}/dev.json", '{"p": {"x": 3}, "a": {"x": 1}}')
    write(f"{tmp_path}/dev.jsonl", '{"x": 1}\n{"x": 2}\n')
    write(f"{tmp_path}/bad.jsonl", '{"x": 1}\n\n{"x": 2}\n')
    at = lambda n: f"{tmp_path}/{n}"
    assert [r.value for r in files.load(spark, at("train-1.txt")).orderBy("pos").collect()] == ["a", "b", "", "c"]
    assert [(r.x, r.y) for r in files.load(spark, at("train.json"), "x int, y string").orderBy("pos").collect()] == [(1, "é"), (2, None)]
    assert [r.x for r in files.load(spark, at("dev.json"), "x int").orderBy("pos").collect()] == [3, 1]
    assert [r.x for r in files.load(spark, at("dev.jsonl"), "x int").orderBy("pos").collect()] == [1, 2]
    with pytest.raises(Exception):
        files.load(spark, at("bad.jsonl"), "x int").collect()
    with pytest.raises(ValueError):
        files.load(spark, at("x.csv"))
    assert files.split_file(spark, str(tmp_path), "train").endswith("train-1.txt")


@pytest.fixture
def small_splits(spark):
    """Files are dealt in splits of a few dozen bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "1"}
    was = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


ENDS = ["\n", "\r\n", "\r", "\x0b", "\x85", "\u2028"]


@pytest.mark.parametrize("seed", range(6))
def test_lines_over_many_splits(spark, tmp_path, small_splits, seed):
    """Places are those of Python's own reading, whatever ends the lines and the file."""
    rng = random.Random(seed)
    ends = ["\n"] if seed < 2 else ENDS
    text = "".join(f"{'é' * rng.randint(0, 9)}{i}" * rng.randint(0, 3) + rng.choice(ends) for i in range(150)) + rng.choice(["", "last", "\n"] if seed < 2 else ["", "last", "last\r", "last\x0b", "\n"])
    write(f"{tmp_path}/t.txt", text)
    with open(f"{tmp_path}/t.txt", encoding="utf-8") as f:
        wanted = f.read().splitlines()
    got = files.load(spark, f"{tmp_path}/t.txt")
    # lines with no other ends stay where they are read
    assert seed >= 2 or got.rdd.getNumPartitions() > 10
    assert [(r.pos, r.value) for r in got.orderBy("pos").collect()] == list(enumerate(wanted))


def test_json_lines_over_many_splits(spark, tmp_path, small_splits):
    said = [f"{'ü' * (i % 7)}\u2028{i}\x85" for i in range(90)]
    write(f"{tmp_path}/t.jsonl", "".join(json.dumps({"x": i, "t": t}, ensure_ascii=False) + "\n" for i, t in enumerate(said)))
    got = files.load(spark, f"{tmp_path}/t.jsonl", "x int, t string")
    assert got.rdd.getNumPartitions() > 10
    assert [(r.pos, r.x, r.t) for r in got.orderBy("pos").collect()] == [(i, i, t) for i, t in enumerate(said)]
    write(f"{tmp_path}/gap.jsonl", '{"x": 1}\n' * 30 + "\n" + '{"x": 1}\n')
    with pytest.raises(Exception, match="empty line"):
        files.load(spark, f"{tmp_path}/gap.jsonl", "x int").collect()
    write(f"{tmp_path}/none.txt", "")
    assert files.load(spark, f"{tmp_path}/none.txt").count() == 0


def test_lines_of_a_folder_go_on(spark, tmp_path, small_splits):
    parts = [f"{a}{i}" for a in "abc" for i in range(40)]
    for k in range(3):
        write(f"{tmp_path}/in/part-{k} é.txt", "\n".join(parts[40 * k : 40 * k + 40]) + ("\n" if k else ""))
    write(f"{tmp_path}/in/_SUCCESS", "")
    got = files.load(spark, f"{tmp_path}/in", kind="txt").orderBy("pos").collect()
    assert [(r.pos, r.value) for r in got] == list(enumerate(parts))


def test_configs_and_sinks(spark, tmp_path):
    write(f"{tmp_path}/c.json", '{"a": {"b": [1], "c": 1}}')
    assert files.config(spark, f"{tmp_path}/c.json", "a") == {"b": [1], "c": 1}
    assert files.merged({"a": {"b": [1], "c": 1}}, {"a": {"b": [2], "c": 2}, "d": 3}) == {"a": {"b": [1, 2], "c": 2}, "d": 3}
    assert files.output_folder("x", 2, True) == "x/template-2-pinyin"
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.cached(spark, str(tmp_path), "dev", 0, build).count() == 3
    assert len(calls) == 1
    log = spark.createDataFrame([(1, "p", "l", "g")], "id long, prompt string, label string, predict string")
    files.append_log(log, f"{tmp_path}/log")
    files.append_log(log.drop("label"), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    rows = files.from_list(spark, [{"input_ids": [1, 2]}], "input_ids array<int>")
    assert rows.first().attention_mask == [1, 1] and len(files.sample(rows, "id")) == 1


def plain_crc(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    crc ^= 0xFFFFFFFF
    return (crc >> 15 | crc << 17) + 0xA282EAD8 & 0xFFFFFFFF


def test_record_bytes():
    assert tfrecord.masked_crc(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    rng = random.Random(0)
    messages = [rng.randbytes(rng.choice([0, 1, 2, 7, 300])) for _ in range(40)]
    assert tfrecord.masked_crcs(messages).tolist() == [plain_crc(m) for m in messages]
    numbers = [0, 1, 127, 128, 300, 2**14, 2**35, 2**63 - 1, -1, -100, -(2**63)]
    body, ends = tfrecord.varints(np.array(numbers))
    assert tfrecord.whole_numbers(body).tolist() == numbers and body[: ends[4]] == b"\x00\x01\x7f\x80\x01\xac\x02"
    features = {"data": numbers, "label": [], "pinyin": None}
    back = tfrecord.parse(tfrecord.serialize(features))
    assert {k: v.tolist() for k, v in back.items()} == {"data": numbers, "label": []}
    columns = {"data": pa.array([[1, 2], [], [-3]]), "label": pa.array([None, [5], []], pa.list_(pa.int64()))}
    assert tfrecord.serialized(columns) == [tfrecord.serialize({c: columns[c][i].as_py() for c in columns}) for i in range(3)]
    # unpacked numbers are read, too
    loose = tfrecord._field(1, tfrecord._entry("data", b"")[:0] + tfrecord._field(1, tfrecord._field(1, b"data") + tfrecord._field(2, tfrecord._field(3, b"\x08\x05\x08\x07"))))
    assert tfrecord.parse(loose)["data"].tolist() == [5, 7]
    whole = tfrecord.framed(messages)
    assert [m for some in tfrecord.unframed(io.BytesIO(whole)) for m in some] == messages
    for broken in (whole[:-1], whole[:5], bytes([whole[0] ^ 1]) + whole[1:], whole[:-6] + bytes([whole[-6] ^ 1]) + whole[-5:]):
        with pytest.raises(ValueError):
            list(tfrecord.unframed(io.BytesIO(broken)))


def test_record_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"f{i // 3}.tfrecord.gz", [i, i + 1]) for i in range(7)], "pos long, file string, data array<long>")
    folder = f"file://{tmp_path}/out"
    written = tfrecord.write(rows, folder, "file", "pos").collect()
    assert sorted((r.file, r.n_items) for r in written) == [("f0.tfrecord.gz", 3), ("f1.tfrecord.gz", 3), ("f2.tfrecord.gz", 1)]
    back = tfrecord.read(spark, folder)
    assert [(r.file, r.pos, r.data) for r in back.orderBy("file", "pos").collect()][4] == ("f1.tfrecord.gz", 1, [4, 5])
    whole = tfrecord.defaults(back, 4).where("data[0] = 4").first()
    assert (whole.data, whole.attention_mask, whole.label) == ([4, 5, 0, 0], [1, 1, 0, 0], [4, 5, -100, -100])


def test_record_source(spark, tmp_path, monkeypatch):
    """Files of so many records in the order of rows, counts beside them, and only the features that are asked for."""
    tfrecord.register(spark)
    at = f"{tmp_path}/records"
    rows = spark.range(0, 95, 1, 4).select(F.sequence(F.lit(0), F.col("id") % 7).cast("array<int>").alias("data"), F.when(F.col("id") % 2 == 0, F.array(F.col("id"))).alias("label"), F.lit("x").alias("other"))
    rows.write.format(tfrecord.FORMAT).option("items", 10).mode("overwrite").save(at)
    told = json.load(open(f"{at}/meta.json"))
    assert told == {"padding_shape": 7, "count": 95, "files": [f"{i:08d}.tfrecord.gz" for i in range(12)], "compression_type": "GZIP", "has_attention_mask": False, "has_label": True}
    back = tfrecord.read(spark, at).orderBy("file", "pos").collect()
    assert [(r.data, r.label, r.pinyin) for r in back] == [(list(range(i % 7 + 1)), [i] if i % 2 == 0 else None, None) for i in range(95)]
    only = spark.read.format(tfrecord.FORMAT).schema("label array<bigint>").load(at)
    assert only.columns == ["label"] and only.where("label is not null").count() == 48
    with pytest.raises(Exception, match="already"):
        rows.write.format(tfrecord.FORMAT).mode("append").save(at)
    rows.limit(3).write.format(tfrecord.FORMAT).mode("overwrite").save(at)
    assert tfrecord.read(spark, at).count() == 3 and len([f for f in os.listdir(at) if not f.startswith(".")]) == 2


def test_failed_write_leaves_nothing(spark, tmp_path):
    tfrecord.register(spark)
    at = f"{tmp_path}/records"
    bad = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") == 3500, F.raise_error(F.lit("no"))).otherwise(F.array("id")).alias("data"))
    with pytest.raises(Exception):
        bad.write.format(tfrecord.FORMAT).mode("overwrite").save(at)
    assert not os.path.exists(at) or os.listdir(at) == []


def test_stream_packs_like_a_pool(spark, tmp_path):
    texts = ["a b c", "d", "e f g h i", "j k", "l m n o"]
    for i, t in enumerate(texts):
        write(f"{tmp_path}/in/{i}.txt", t)
        os.utime(f"{tmp_path}/in/{i}.txt", (1000 + i, 1000 + i))
    run = lambda: stream.pack_once(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", 4, 3)
    expected = pool([[T.BOS, *t.split(), T.EOS] for t in texts], 4, 3)
    assert [r.tokens for r in run().orderBy("w").collect()] == expected
    assert len([d for d in os.listdir(f"{tmp_path}/out") if d.startswith("batch=")]) == 3
    # what comes later goes on where the stream stopped
    write(f"{tmp_path}/in/9.txt", "p q r s")
    expected = pool([[T.BOS, *t.split(), T.EOS] for t in [*texts, "p q r s"]], 4, 3)
    got = run().orderBy("w")
    assert [r.tokens for r in got.collect()] == expected
    table = {t: i + 5 for i, t in enumerate("abcdefg")}
    first = stream.examples(got, table, 1).orderBy("w").first()
    assert first.data == first.label == [1, 5, 6, 7] and first.attention_mask == [1] * 4


def test_batches_that_run_again(spark, tmp_path):
    """Streams side by side, null and empty token lists, streams that pause; a batch that is done twice changes nothing."""
    rng = random.Random(4)
    batches = [[(rng.choice(["x", "y", None]), i * 100 + k, [f"{i}.{k}.{j}" for j in range(rng.choice([0, 1, 5, 30]))]) for k in range(12)] for i in range(4)]
    batches[2] = [(g, k, None if k % 5 == 0 else t) for g, k, t in batches[2] if g == "x"]
    sink = stream.Sink(f"{tmp_path}/out", f"{tmp_path}/rest", 7, 4, by=["g"], order="k")
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "g string, k long, tokens array<string>").repartition(3)
        for _ in range(2):
            sink(frame, i)
    got = {}
    for r in spark.read.schema("g string, w long, tokens array<string>").parquet(f"{tmp_path}/out").orderBy("g", "w").collect():
        got.setdefault(r.g, []).append((r.w, r.tokens))
    for g in ("x", "y", None):
        assert got[g] == list(enumerate(pool([t or [] for rows in batches for h, _, t in rows if h == g], 7, 4)))
    with pytest.raises(ValueError):
        stream.Sink("o", "r", 3, 5)


def test_sparse_windows_as_a_stream(spark, tmp_path):
    texts = ["a b c", "d", "e f g h i", "j k", "l m n o"] * 3
    for i, t in enumerate(texts):
        write(f"{tmp_path}/in/{i:02d}.txt", t)
        os.utime(f"{tmp_path}/in/{i:02d}.txt", (1000 + i, 1000 + i))
    was = spark.conf.get(stream.STATE_KEY)
    spark.conf.set(stream.STATE_KEY, stream.ROCKS)
    try:
        rows = stream.windows(stream.read_files(spark, f"{tmp_path}/in", 4), 3, 7)
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(stream.STATE_KEY, was)
    assert [r.tokens for r in spark.read.parquet(f"{tmp_path}/out").orderBy("w").collect()] == pool([[T.BOS, *t.split(), T.EOS] for t in texts], 3, 7)


def test_offsets_of_a_replay():
    sizes = [3, 0, 5, None, 2]
    at, seen = (0, 0, 0), []
    for _ in range(12):
        end = replay.advanced(at, sizes, 4, 2)
        seen += list(replay.between(at, end, sizes))
        at = end
    assert at == (2, 0, 0) and replay.advanced(at, sizes, 4, 2) == at
    for e in (0, 1):
        rows = [(f, i) for k, f, a, b in seen if k == e for i in (range(a, b) if b is not None else ["all"])]
        assert rows == [(f, i) for f, n in enumerate(sizes) for i in (range(n) if n is not None else ["all"])]
    assert replay.advanced((0, 0, 0), [0, 0], 4, None) == (0, 0, 0) and replay.advanced((0, 0, 0), [], 4, None) == (0, 0, 0)
    assert replay.advanced((5, 1, 2), [1, 9], 3, None) == (5, 1, 5)


def test_replay_goes_on_in_mid_epoch(spark, tmp_path):
    """Two runs of one query over an endless replay, stopped and started again: no row is lost or comes twice."""
    for i in range(3):
        pq.write_table(pa.table({"x": list(range(i * 10, i * 10 + 7)), "other": ["o"] * 7}), f"{tmp_path}/part-{i}.parquet")
    seen = []

    def note(rows, batch):
        seen.append((batch, sorted((r.epoch, r.place >> 40, r.x) for r in rows.collect())))

    for wanted in (4, 11):
        read = replay.replay(spark, str(tmp_path), "x long", 4)
        query = read.writeStream.foreachBatch(note).option("checkpointLocation", f"{tmp_path}/_state").start()
        while len({b for b, _ in seen}) < wanted and not query.awaitTermination(0.2):
            pass
        query.stop()
    rows = [r for b, some in sorted(dict(seen).items()) for r in some]
    every = [(e, i, i * 10 + k) for e in range(9) for i in range(3) for k in range(7)]
    assert len(rows) > 30 and rows == every[: len(rows)]


def test_replay_ends_when_no_window_fills(spark, tmp_path):
    """Epochs do not share a window; an endless replay of too few tokens ends, one that is told its epochs packs them all."""
    tfrecord.register(spark)
    spark.createDataFrame([([1, 2, 3],), ([4, 5],), ([6],)], "data array<long>").coalesce(1).write.format(tfrecord.FORMAT).mode("overwrite").save(f"{tmp_path}/few")
    read = lambda epochs=None: replay.replay(spark, f"{tmp_path}/few", "data array<bigint>", 2, epochs).withColumn("tokens", F.col("data").cast("array<string>"))
    sink = stream.Sink(f"{tmp_path}/out", f"{tmp_path}/rest", 7, 7, order="place", epochs="epoch")
    stream.run_until_idle(read(), sink, f"{tmp_path}/query")
    assert sink.idle and spark.read.schema("epoch int, w long, tokens array<string>").parquet(f"{tmp_path}/out").count() == 0
    sink = stream.Sink(f"{tmp_path}/out2", f"{tmp_path}/rest2", 4, 2, order="place", epochs="epoch")
    stream.run_until_idle(read(3), sink, f"{tmp_path}/query2", 3)
    got = spark.read.schema("epoch int, w long, tokens array<string>").parquet(f"{tmp_path}/out2").orderBy("epoch", "w").collect()
    assert [(r.epoch, r.w, "".join(r.tokens)) for r in got] == [(e, w, t) for e in range(3) for w, t in enumerate(["1234", "3456"])]


def test_markup_in_plans_is_plain_columns(spark):
    rows = spark.createDataFrame([("xthey",)], "t string")
    assert rows.select(T.marked("t", "the", "<", ">").alias("m")).first().m == "x<the>y"
    assert rows.select(F.size(T.split_keeping("t", "the")).alias("n")).first().n == 3
