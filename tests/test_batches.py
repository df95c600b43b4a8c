"""What Python workers hold at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from inkmill.functions import batches
from inkmill.functions import text as T
from inkmill.operators import readings, tokenizer, vocabulary


def test_parts_put_together():
    seen = []

    def made(texts, lists):
        seen.append(len(texts))
        return pa.array([None if t is None else [t, str(len(x))] for t, x in zip(texts.to_pylist(), lists.to_pylist())], pa.list_(pa.string()))

    texts = pa.array([None if i % 7 == 0 else str(i) for i in range(250)])
    lists = pa.array([[i] * (i % 3) for i in range(250)])
    assert batches.by_parts(made, texts, lists).to_pylist() == made(texts, lists).to_pylist()
    assert seen == [100, 100, 50, 250]
    assert batches.by_parts(made, texts[:0], lists[:0]).to_pylist() == []


def test_sessions_give_small_batches(spark):
    key, tables = "spark.sql.execution.arrow.maxRecordsPerBatch", pa.array(["a"])
    for make in (lambda: tokenizer.tokenized("text"), lambda: tokenizer.spans("text"), lambda: tokenizer.looked_up("text", {"a": 1}, 0), lambda: readings.readings("text", {}, {}), lambda: T.normalised("text"), lambda: vocabulary.looked_up(spark, tables, pa.array([1]), 0, "bigint")):
        spark.conf.set(key, "10000")
        make()
        assert int(spark.conf.get(key)) <= batches.BATCH_ROWS


def test_caches_of_words_are_bounded(monkeypatch):
    monkeypatch.setattr(tokenizer, "CACHE_WORDS", 10)
    plain, fast = tokenizer.Tokenizer(), tokenizer.FastTokenizer()
    text = " ".join([*(f"w{i}" for i in range(35)), "x" * 5000])
    assert plain(text)[-1] == "x" * 5000 == fast(text)[-1][0]
    for kept in (plain.words, fast.runs):
        assert len(kept) <= 10 and "x" * 5000 not in kept


def test_spans_cut_the_raw_text(spark):
    texts = [None, "", "Abé 12\n\U0001f600x", "é " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", "text", tokenizer.spans("text").alias("t"))
    got = {r.i: (r.t, r.cut) for r in rows.select("i", "t", tokenizer.cuts("text", "t").alias("cut")).collect()}
    assert got[0][1] == [] == got[1][1]
    for i in (2, 3):
        assert got[i][1] == [texts[i][s.start : s.end] for s in got[i][0]]
    plan = rows.select(tokenizer.cuts("text", "t"))
    assert plan.count() == 4 and rows.where(F.size("t") > 0).count() == 2
