"""Sizes of what tasks read, hold and shuffle, as tables grow."""

from pyspark.sql import functions as F

from inkmill import queries
from inkmill.operators import offsets, packing, records


def test_any_tokens_travel_as_text(spark):
    lists = [["a", "b"], [], [""], ["", ""], [None], ["a", None, ""], ["\x1f", None], ["\x1f"], ["\x1b", "n"], ["\x1bn", "\x1be", "b\x1bb\x1f\x1f"], ["x"] * 20]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i long, t array<string>")
    flat = [x for t in lists for x in t]
    for n, stride in ((4, 2), (3, 3), (1, 1), (2, 5)):
        got = {r.w: r.tokens for r in packing.windows(docs, "i", "t", n, stride).collect()}
        begins = list(packing.starts(map(len, lists), n, stride))
        assert got == {w: flat[at : at + n] for w, at in enumerate(begins)}
    assert packing.sized(docs.where("i = 10"), ["i"], "t").first().tokens == "\x1f".join("x" * 20)


def test_a_shelf_holds_its_own_tokens(spark):
    docs = spark.createDataFrame([(0, [f"t{i}" for i in range(5000)])], "i long, t array<string>")
    got = {r.w: r.tokens for r in packing.windows(docs, "i", "t", 300, 1000).collect()}
    assert got == {w: [f"t{i}" for i in range(w * 1000, w * 1000 + 300)] for w in range(5)}


def test_groups_are_joined_as_they_are_dealt(spark):
    rows = spark.createDataFrame([(None, "b", 1, 2), (None, "b", 3, 4), (1, "a", 2, 5), (1, None, 1, 6), (None, "b", 2, 7)], "g int, h string, k long, v long")
    met = offsets.running(rows, "k", "v", "at", ["g", "h"], 1)
    assert {(r.g, r.h, r.k, r.at, r._total) for r in met.collect()} == {(None, "b", 1, 0, 13), (None, "b", 2, 2, 13), (None, "b", 3, 9, 13), (1, "a", 2, 0, 5), (1, None, 1, 0, 6)}
    # keys that were made for nulls alone would have all rows shuffled again
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(" in plan and "hashpartitioning(coalesce" not in plan and "isnull(g" not in plan.split("hashpartitioning(", 1)[1]


def test_wide_rows_are_numbered_in_small_ranges(spark, monkeypatch):
    seen = []
    numbered = records.numbered
    monkeypatch.setattr(records, "numbered", lambda *a, **more: seen.append(more.get("rows")) or numbered(*a, **more))
    rows = spark.range(30).select(F.col("id").alias("k"), F.array("id").alias("ids"))
    files = {r.k: r.file for r in records.with_input_files(rows, "k", "train", 10).collect()}
    assert files[9] == "train-0-of-3" and files[10] == "train-1-of-3"
    records.with_files(rows, "k", 10)
    records.padded_batches(rows, "k", 8, ["ids"])
    assert seen == [records.WIDE_ROWS] * 3


def test_files_and_batches_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(queries, "FILE_ROWS", 10)
    rows = spark.range(95).select(F.col("id").alias("doc_id"))
    assert queries._in_files(rows).rdd.getNumPartitions() == 10
    assert queries._in_files(rows.limit(20)).rdd.getNumPartitions() == 5
    assert queries._stream_sizes(1000) == (100, 450)
    # ten times the table is not ten times the batches, until a batch is as large as may be
    assert [-(-n // queries._stream_sizes(n)[1]) for n in (50_000, 200_000, 3_000_000)] == [4, 4, 60]
    assert all(queries._stream_sizes(n)[0] <= queries.MOST_FILE_DOCS for n in (10**5, 10**8))
