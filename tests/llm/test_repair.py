"""Conversation structure repair against a plain search."""

import hashlib
import random
import re
import zlib
from functools import cache

import duckdb
import pytest
from pyspark.sql import functions as F

from inkmill.llm import repair
from inkmill.llm.queries import QUERIES, SQL

KIND = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def slow_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = out.setdefault(conv, [])
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        mine += [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def slow_repair(rows):
    """The same from the end: every edit of every turn is tried in every state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    steps = {("o", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a", ("o", "s"): "s"}

    @cache
    def best(i, state, inserted):
        """(cost, audit, lines) of the rest."""
        ways = []
        if i == len(rows) and state in "oa":
            ways.append((0, "", ()))
        if inserted < 2:
            for role in ("user", "assistant"):
                if (state, role[0]) in steps:
                    c, a, x = best(i, role[0], inserted + 1)
                    ways.append((c + 5, "I" + a, (role + ":",) + x))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, x = best(i + 1, state, 0)
            ways.append((c + 2, "D" + a, x))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                for letter, cost, name in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if (state, name[:1]) in steps:
                        c, a, x = best(i + 1, steps[state, name[:1]], 0)
                        ways.append((c + cost + more, letter + a, (f"{name}:{text}",) + x))
        return min(ways, default=(10**9, "", ()))

    cost, audit, lines = best(0, "o", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def found(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


def conversations(seed, many=120, longest=9):
    random.seed(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "agent", "", None, "User"]
    texts = ["Yes.", "No!", "why", "hm ", " \n", "", "Well?\t ", None, "é…", "ok.", "a.b"]
    rows = []
    for conv in range(many):
        for _ in range(random.randint(0, longest)):
            rows.append((conv, random.choice([None, 0, 1, 2, 3, 4, 5, 6, 7, 900, -3]), random.choice(roles), random.choice(texts) if random.random() < 0.5 else f"{random.random()}."))
    return rows


@pytest.mark.parametrize("block", [512, 3, 1])
def test_against_a_plain_search(spark, block):
    rows = conversations(block)
    df = spark.createDataFrame(rows, KIND)
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    wanted = {c: slow_repair(r) for c, r in by.items()}
    got = found(repair.report(df, block_turns=block))
    assert got == {c: w for c, (w, _) in wanted.items()}
    lines = {}
    for r in repair.repaired(df, block_turns=block).orderBy("conv_id", "block", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert lines == {c: list(x) for c, (_, x) in wanted.items() if x}


def test_damaged_rows_and_odd_ones(spark):
    rows = conversations(5, 60) + [(None, 1, "user", "Hi."), (None, None, None, None), (7, 2, "user", "Hi."), (7, 2, "user", "Hi.")]
    df = spark.createDataFrame(rows, KIND).withColumns({"n": F.lit(5), "block": F.lit("x"), "audit": F.lit(1)})
    got = found(repair.op12(df))
    assert got == {c: slow_repair(r)[0] for c, r in slow_damage(rows).items()}
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert found(repair.op12(spark.createDataFrame([(1, gone, "user", "Hi.")], KIND))) == {1: (0, 0, 0, 0, 0, 0, "", EMPTY)}
    empty = repair.op12(spark.createDataFrame([], KIND))
    assert empty.count() == 0 and ", ".join(map(" ".join, empty.dtypes)) == "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def test_one_long_conversation_in_blocks(spark):
    """A conversation of many blocks, many equal rows, and all turns null, as with one block."""
    random.seed(3)
    long = [(1, t, random.choice(["user", "assistant", "system"]), random.choice(["Yes.", "so", f"{t}.", f"{t}!"])) for t in range(400)]
    same = [(2, 4, "user", "Again.")] * 700 + [(2, 5, "assistant", "Stop.")]
    null = [(3, None, random.choice(["user", "assistant"]), f"{i}.") for i in range(300)]
    df = spark.createDataFrame(long + same + null, KIND)
    whole, parts = (found(repair.report(df, block_turns=n)) for n in (1000, 16))
    assert whole == parts
    assert parts[2][6] == "K" + "D" * 699 + "K"


def test_agrees_with_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{data}/conversations.parquet'")
    got = QUERIES["op12_conversation_repair"](spark, data).toPandas()
    wanted = con.sql(SQL["op12_conversation_repair"]).df()
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns) and len(got)
    assert sorted(map(tuple, got[columns].astype(str).values.tolist())) == sorted(map(tuple, wanted[columns].astype(str).values.tolist()))
