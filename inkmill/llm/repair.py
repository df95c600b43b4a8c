"""Conversation structure repair by one fold over each conversation's turns, in Spark SQL.

A conversation is well formed if its role initials read `(s?(ua)+)?`: an opening system turn or none, then
user and assistant by turns. Every turn is kept (cost 0), given the role that is due (1) or deleted (2),
empty turns are inserted (5 each), and a truncated turn that stays costs 5 more; blank and repeated turns
have to go. Of the cheapest repairs the one whose letters (K, R, D, I) are least in ASCII is taken.

Four states tell how far a repair has come: nothing said yet, last a system, a user, an assistant turn.
For each the fold carries the cheapest (cost, audit), and `least` compares these structs: first by cost,
then by letters. Two audits of the same turns and the same cost differ before either ends, since one that
continues the other has inserted more and costs more, so the better of two stays the better whatever
follows, and the four structs are all that has to be carried. The role of a rewritten or inserted turn
follows from the one before it, so the audit alone gives the repaired conversation.

Faults come from windows: a row's number, the row before it, the first place of its role and text. Equal
rows of one turn number are one row with a count. No window and no list grows with a conversation: turns go
by blocks of `BLOCK_TURNS` turn numbers, and these by parts of as many rows. What a block does to the four
states is a matrix of four by four such structs, and those of a conversation are folded in their order, so
a conversation of any length costs no task more than its audit and matrices. Conversations of one block, the
usual ones, need no matrix. The repaired text of a longer one passes through its hash as a stream.

Defined results: a null role or text is one space; a null turn comes first; turns of one number stand in the
order of role and text; rows with a null conv_id are one conversation; a conversation all of whose
rows are gone has zeros, an empty audit and no turns; an empty table gives no rows. Only conv_id, turn,
role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.llm._shared import cut, small_batches

BLOCK_TURNS = 512
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The cost of a state that cannot be reached.
NEVER = 1 << 50
STATES = ("o", "s", "u", "a")
LINE = "struct<role:string,text:string>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _option(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _then(option: Column, cost: Column | int, letters: Column | str) -> Column:
    more = F.lit(cost) if isinstance(cost, int) else cost
    return _option(option["cost"] + more, F.concat(option["audit"], F.lit(letters) if isinstance(letters, str) else letters))


def _states(options: list[Column]) -> Column:
    return F.struct(*[o.alias(s) for s, o in zip(STATES, options)])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def _closed(states: Column) -> Column:
    """The states after such insertions as pay."""
    o, s, u, a = (states[x] for x in STATES)
    user = _let(F.least(o, s, a), lambda e: F.least(u, _then(e, INSERT, "I")))
    return _let(user, lambda v: _states([o, s, v, F.least(a, _then(v, INSERT, "I"))]))


def _after(states: Column, turn: Column) -> Column:
    """The states behind a turn and its copies, which are deleted."""
    o, s, u, a = (states[x] for x in STATES)
    extra = F.when(turn["truncated"], TRUNCATED).otherwise(0)

    def stay(option: Column, initial: str) -> Column:
        same = turn["initial"] == initial
        return _then(option, extra + F.when(same, 0).otherwise(REROLE), F.when(same, "K").otherwise("R"))

    gone = [_then(x, DELETE, "D") for x in (o, s, u, a)]
    opened = F.when(turn["initial"] == "s", F.least(gone[1], _then(o, extra, "K"))).otherwise(gone[1])
    spoken = _let(F.least(o, s, a), lambda e: F.least(gone[2], stay(e, "u")))
    alive = _states([gone[0], opened, spoken, F.least(gone[3], stay(u, "a"))])
    copies = lambda v: _states([_then(v[x], turn["gone"] * DELETE, F.repeat(F.lit("D"), turn["gone"].cast("int"))) for x in STATES])
    return _let(F.when(turn["dead"], states).otherwise(alive), lambda v: _let(copies(v), _closed))


def _entry(state: str) -> Column:
    return _states([_option(F.lit(0 if x == state else NEVER), F.lit("")) for x in STATES])


def folded(turns: Column, entry: Column) -> Column:
    """The cheapest (cost, audit) of each state behind all turns, from those before them."""
    return F.aggregate(turns, entry, _after)


def started() -> Column:
    return _states([_option(F.lit(0), F.lit("")), _option(F.lit(NEVER), F.lit("")), _option(F.lit(INSERT), F.lit("I")), _option(F.lit(2 * INSERT), F.lit("II"))])


def _lines(turns: Column, audit: Column, after_user: Column) -> Column:
    """The repaired turns that an audit gives; after_user: whether the turn before them is a user's."""
    due = lambda user_last: F.when(user_last, "assistant").otherwise("user")
    begin = F.struct(F.lit(0).cast("long").alias("at"), after_user.alias("user"), F.array().cast(f"array<{LINE}>").alias("lines"))

    def read(acc: Column, op: Column) -> Column:
        letter = F.substring(op, 1, 1)
        turn = F.get(F.filter(turns, lambda t: (t["at"] == acc["at"]) & ~t["dead"]), 0)
        role = F.when(letter == "K", turn["role"]).otherwise(due(acc["user"]))
        line = F.struct(role.alias("role"), F.when(letter == "I", "").otherwise(turn["text"]).alias("text"))
        opened = (letter == "K") & (turn["initial"] == "s")
        return F.struct(
            (acc["at"] + F.when(letter == "I", 0).otherwise(F.length(op))).cast("long").alias("at"),
            F.when(letter == "D", acc["user"]).otherwise(~acc["user"] & ~opened).alias("user"),
            F.when(letter == "D", acc["lines"]).otherwise(F.concat(acc["lines"], F.array(line))).alias("lines"),
        )

    return F.aggregate(F.regexp_extract_all(audit, F.lit("(D+|[KRI])"), 1), begin, read, lambda acc: acc["lines"])


def _rows(turns: DataFrame, block_turns: int) -> DataFrame:
    """Distinct rows with the number of their copies, `n`, their block and their faults."""
    blank = F.lit(" ")
    plain = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), "n")
    # a row that is gone still names its conversation
    gone = F.col("n") == 0
    named = plain.withColumns({"role": F.when(gone, "").otherwise(F.col("role")), "text": F.when(gone, "").otherwise(F.col("text"))})
    rows = named.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("block", F.floor(F.col("turn") / block_turns).cast("long"))
    wordless = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    # where a role says a text for the first time: by blocks, then over those
    said = rows.where((F.col("n") > 0) & ~wordless).select("conv_id", "block", "role", F.md5(F.col("text").cast("binary")).alias("said"), F.struct("turn").alias("place"))
    firsts = said.groupBy("conv_id", "block", "role", "said").agg(F.min("place").alias("place"), F.count("*").alias("times"))
    over = Window.partitionBy("conv_id", "role", "said")
    firsts = firsts.withColumns({"first": F.min("place").over(over), "all": F.sum("times").over(over)}).where("all > 1").drop("place", "times", "all")
    rows = rows.withColumn("said", F.md5(F.col("text").cast("binary"))).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "block", "role", "said")]
    met = rows.join(firsts.alias("f"), same[0] & same[1] & same[2] & same[3], "left").select("r.*", "f.first")
    again = ~wordless & F.coalesce(F.struct("turn") > F.col("first"), F.lit(False))
    return met.select("conv_id", "block", "turn", "role", "text", "n", wordless.alias("wordless"), again.alias("again"), (~wordless & ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"))


def _blocks(turns: DataFrame, block_turns: int) -> DataFrame:
    """conv_id, block, part and their turns in order, with sums of their faults and what joins them to their neighbours."""
    there = F.col("n") > 0
    by = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = _rows(turns, block_turns).withColumn("initial", F.when(there, F.substring("role", 1, 1)))
    rows = rows.withColumns(
        {
            "number": F.row_number().over(by),
            "previous": F.last("initial", True).over(before),
            "last_turn": F.last(F.when(there, F.col("turn")), True).over(before),
        }
    ).withColumn("part", F.floor((F.col("number") - 1) / block_turns))
    inner = Window.partitionBy("conv_id", "block", "part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    dead = F.col("wordless") | F.col("again")
    pair = F.concat("previous", "initial")
    rows = rows.withColumns({"at": F.coalesce(F.sum("n").over(inner), F.lit(0)), "dead": dead, "fit": pair.isin("su", "ua", "au")})
    turn = F.struct("number", "at", "role", "text", "initial", "dead", F.when(F.col("dead"), F.col("n")).otherwise(F.col("n") - 1).alias("gone"), F.col("open").alias("truncated"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy("conv_id", "block", "part").agg(
        F.sort_array(F.collect_list(F.when(there, turn))).alias("turns"),
        F.sum(F.when(F.col("wordless"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("again"), F.col("n")).when(~F.col("wordless") & there, F.col("n") - 1).otherwise(0)).alias("duplicate"),
        one(there & ~dead & F.col("open")).alias("truncated"),
        # copies stand behind one another with one initial
        (F.sum(F.when(there, F.col("n") - 1).otherwise(0)) + one(~F.col("fit"))).alias("illegal"),
        one(there & F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last_turn"))).alias("distinct"),
        F.min(F.when(there, F.col("turn"))).cast("long").alias("least"),
        F.max(F.when(there, F.col("turn"))).cast("long").alias("most"),
        F.min(F.when(there & F.col("previous").isNull(), F.col("initial"))).alias("head"),
        F.max_by("initial", F.when(there, F.col("number"))).alias("tail"),
    )


def _gaps(most: Column, least: Column, distinct: Column) -> Column:
    return F.coalesce(most - least + 1 - distinct, F.lit(0)).cast("long")


def _text(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")


def _best(states: Column, use: Callable[[Column], Column]) -> Column:
    return _let(F.least(states["o"], states["a"]), use)


def _matrix(turns: Column) -> Column:
    return F.array(*[folded(turns, _entry(x)) for x in STATES])


def _composed(blocks: Column) -> Column:
    """(cost, audit, path) of the cheapest repair over blocks in order; path: the state before each block, and the last."""

    def option(o: Column, path: Column) -> Column:
        return F.struct(o["cost"].alias("cost"), o["audit"].alias("audit"), path.alias("path"))

    begin = _let(started(), lambda v: F.array(*[option(v[x], F.lit("")) for x in STATES]))

    def follow(acc: Column, block: Column) -> Column:
        def way(i: int, x: str) -> Column:
            step = block["matrix"][i][x]
            return F.struct((acc[i]["cost"] + step["cost"]).alias("cost"), F.concat(acc[i]["audit"], step["audit"]).alias("audit"), F.concat(acc[i]["path"], F.lit(str(i))).alias("path"))

        return F.array(*[F.least(*[way(i, x) for i in range(4)]) for x in STATES])

    ends = lambda acc, i: option(acc[i], F.concat(acc[i]["path"], F.lit(str(i))))
    return F.aggregate(blocks, begin, follow, lambda acc: F.least(ends(acc, 0), ends(acc, 3)))


def _long(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row a conversation, one row a block with its repaired turns) of conversations of several blocks."""
    worked = cut(blocks.select("*", _matrix(F.col("turns")).alias("matrix")))
    seen = F.struct("block", "part", "matrix", "head", "tail")
    whole = worked.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(seen)).alias("blocks"),
        *[F.sum(c).alias(c) for c in COUNTS],
        _gaps(F.max("most"), F.min("least"), F.sum("distinct")).alias("gaps"),
    )
    # pairs of turns with the border of blocks between them; a part that does not begin its block has no head
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("tail"))
    meet = lambda acc, b: F.struct((acc["n"] + F.when(F.concat(acc["tail"], b["head"]).isin("su", "ua", "au"), 0).when(acc["tail"].isNull() | b["head"].isNull(), 0).otherwise(1)).cast("long").alias("n"), F.coalesce(b["tail"], acc["tail"]).alias("tail"))
    borders = F.aggregate("blocks", begin, meet, lambda acc: acc["n"])
    found = cut(whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + borders).alias("illegal"), _composed(F.col("blocks")).alias("best"), F.transform("blocks", lambda b: F.struct(b["block"].alias("block"), b["part"].alias("part"))).alias("places")))
    each = found.select("conv_id", F.col("best.path").alias("path"), F.posexplode("places").alias("i", "place"))
    state = lambda i: F.substring(F.col("path"), i, 1).cast("int")
    each = each.select("conv_id", "place.*", "i", state(F.col("i") + 1).alias("before"), state(F.col("i") + 2).alias("behind")).alias("e")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("conv_id", "block", "part")]
    met = worked.alias("w").join(each, same[0] & same[1] & same[2]).select("w.conv_id", "i", "before", "turns", F.element_at(F.transform("matrix", lambda m: F.array(*[m[x]["audit"] for x in STATES])), F.col("before") + 1)[F.col("behind")].alias("audit"))
    # what is inserted before all turns
    begun = F.when((F.col("i") == 0) & (F.col("before") == 2), "I").when((F.col("i") == 0) & (F.col("before") == 3), "II").otherwise("")
    lines = met.select("conv_id", "i", _lines(F.col("turns"), F.concat(begun, F.col("audit")), (F.col("i") > 0) & (F.col("before") == 2)).alias("lines"))
    return found.select("conv_id", "gaps", *COUNTS, "best.cost", "best.audit"), lines


def _streamed(lines: DataFrame) -> DataFrame:
    """conv_id and the hash of each conversation's repaired text, of which no task holds more than some blocks."""
    small_batches(lines.sparkSession)
    kind = lines.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []
        hashed, begun = hashlib.sha256(), False

        def row(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(now, batch.column(0).type), pa.array([hashed.hexdigest()])], names=["conv_id", "repaired_sha256"])

        last = None
        for batch in batches:
            last = batch
            for conv, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now != [conv]:
                    if now:
                        yield row(batch)
                    now, hashed, begun = [conv], hashlib.sha256(), False
                if n:
                    hashed.update(("\n" if begun else "").encode() + text.encode())
                    begun = True
        if now:
            yield row(last)

    dealt = lines.select("conv_id", "i", F.size("lines").alias("n"), _text(F.col("lines")).alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "i")
    return dealt.select("conv_id", "n", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def _parted(turns: DataFrame, block_turns: int) -> tuple[DataFrame, DataFrame | None]:
    """Blocks of the conversations that have one, and of those that have several, if there are any."""
    blocks = cut(_blocks(turns, block_turns))
    several = cut(blocks.groupBy("conv_id").agg(F.count("*").alias("blocks")).where("blocks > 1").select(F.col("conv_id").alias("id")))
    if several.isEmpty():
        return blocks, None
    met = F.col("conv_id").eqNullSafe(F.col("id"))
    return blocks.join(several, met, "left_anti"), blocks.join(several, met, "left_semi")


def _short(blocks: DataFrame) -> DataFrame:
    best = _best(folded(F.col("turns"), started()), lambda v: v)
    found = blocks.select("conv_id", "turns", *COUNTS, _gaps(F.col("most"), F.col("least"), F.col("distinct")).alias("gaps"), best.alias("best"))
    return found.select("conv_id", "gaps", *COUNTS, "best.cost", "best.audit", _lines(F.col("turns"), F.col("best.audit"), F.lit(False)).alias("lines"))


def _with_copies(turns: DataFrame, copies: str | None) -> DataFrame:
    return turns.select("conv_id", "turn", "role", "text", (F.col(copies) if copies else F.lit(1)).cast("long").alias("n"))


def repaired(turns: DataFrame, copies: str | None = None, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, block, place, role, text: the turns of the repaired conversations, in the order of block and place.

    `copies` names a column that tells how often a row stands in its place; 0 only names its conversation.
    """
    short, long = _parted(_with_copies(turns, copies), block_turns)
    lines = _short(short).select("conv_id", F.lit(0).alias("i"), "lines")
    if long is not None:
        lines = lines.unionByName(_long(long)[1])
    return lines.select("conv_id", F.col("i").alias("block"), F.posexplode("lines").alias("place", "line")).select("conv_id", "block", "place", "line.*")


def report(turns: DataFrame, copies: str | None = None, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the hash of the repaired text, for every conv_id."""
    short, long = _parted(_with_copies(turns, copies), block_turns)
    few = _short(short).select("conv_id", "gaps", *COUNTS, "cost", "audit", F.sha2(_text(F.col("lines")).cast("binary"), 256).alias("repaired_sha256"))
    if long is None:
        return few
    whole, lines = _long(long)
    hashes = _streamed(lines).withColumnRenamed("conv_id", "id")
    many = whole.join(hashes, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
    return few.unionByName(many.select(few.columns))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with faults put in by a hash of conv_id and turn, and the number of each row's copies, `n`."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    n = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), n.alias("n"))


def op12(conversations: DataFrame) -> DataFrame:
    return report(damaged(conversations), "n")


def _sql() -> str:
    """The same over the conversations table in DuckDB: a recursive query over turns; a state is (cost and audit, text)."""

    def then(v: str, cost: str, letter: str, line: str) -> str:
        return f"{{'k': lpad(CAST(CAST(left({v}.k, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({v}.k, 13) || {letter}, 'x': {v}.x || {line}}}"

    nl, text = "chr(10)", "chr(10) || role || ':' || text"
    more = f"CASE WHEN fault = 't' THEN {TRUNCATED} ELSE 0 END"
    gone = {s: then(s, str(DELETE), "'D'", "''") for s in STATES}

    def stay(v: str, initial: str, role: str) -> str:
        same = f"c = '{initial}'"
        return then(v, f"({more} + CASE WHEN {same} THEN 0 ELSE {REROLE} END)", f"CASE WHEN {same} THEN 'K' ELSE 'R' END", f"{nl} || CASE WHEN {same} THEN role ELSE '{role}' END || ':' || text")

    alive = {"o": gone["o"], "s": f"CASE WHEN c = 's' THEN least({gone['s']}, {then('o', more, chr(39) + 'K' + chr(39), text)}) ELSE {gone['s']} END"}
    alive["u"] = f"least({gone['u']}, {stay('e', 'u', 'user')})"
    alive["a"] = f"least({gone['a']}, {stay('u', 'a', 'assistant')})"
    stepped = ", ".join(f"CASE WHEN fault IN ('b', 'd') THEN {gone[s]} ELSE {alive[s]} END AS {s}" for s in STATES)
    insert = lambda v, role: then(v, str(INSERT), "'I'", f"{nl} || '{role}:'")
    word = r"[^\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), bits AS (
  SELECT *, flatten(list_transform(string_split(key, ''), lambda b: [CAST(ord(b) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS bytes FROM keyed
), coded AS (
  SELECT *, xor(list_reduce(bytes, lambda r, b: CASE WHEN xor(r, b) & 1 = 1 THEN xor(xor(r, b) >> 1, 3988292384) ELSE xor(r, b) >> 1 END, CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS f FROM bits
), d AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded
), n AS (
  SELECT *, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d
), t AS (
  SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS p, CASE WHEN NOT regexp_matches(text, '{word}') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM n
), v AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'k': '{0:012d}', 'x': ''}} AS o, {{'k': '{10**11}', 'x': ''}} AS s, {{'k': '{INSERT:012d}I', 'x': chr(10) || 'user:'}} AS u, {{'k': '{2 * INSERT:012d}II', 'x': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, o, s, u, least(a, {insert('u', 'assistant')}) FROM (
    SELECT conv_id, i, o, s, least(u, {insert('e', 'user')}) AS u, a FROM (
      SELECT conv_id, i, o, s, u, a, least(o, s, a) AS e FROM (
        SELECT conv_id, i, {stepped} FROM (SELECT t.conv_id, t.i, t.c, t.role, t.text, t.fault, v.o, v.s, v.u, v.a, least(v.o, v.s, v.a) AS e FROM v JOIN t ON t.conv_id IS NOT DISTINCT FROM v.conv_id AND t.i = v.i + 1))))
), ends AS (
  SELECT conv_id, least(o, a) AS best FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated, count_if(p || c NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id
)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(left(best.k, 12) AS BIGINT) AS cost, substr(best.k, 13) AS audit, sha256(substr(best.x, 2)) AS repaired_sha256
FROM ends e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id"""


SQL = _sql()
