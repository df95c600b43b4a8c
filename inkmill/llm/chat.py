"""Chat formatting by perspective rotation, in DataFrame operations only.

Every participant of a conversation (role) gets a rendering of the whole dialogue in which they are the
assistant and the others are users with their names. The mask tells training text (1) from context (0) as
runs of characters: what the speaker says, with its end mark, counts, headers and other turns do not.

A rendering is given in parts of `PART_TURNS` turns by turn number, so that no row grows with the longest
conversation; part 0 is the whole of any usual one, and parts in their order, set one behind the other,
are the rendering.

Defined results: a null role speaks as `unknown` (`unnamed`), apart from a role of that name; a null text is
empty, a null turn comes first; turns of one number stand in the order of role (null first) and text,
repeated rows are kept; control marks inside names and texts are broken by a space, and line ends in names
are spaces; rows with a null conv_id make a conversation of their own; an empty table
gives no rows. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TURNS = 512
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
UNNAMED = "unknown"


def _plain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, speaker, unnamed, part, n_turns, n_own, text and mask (`0*n` and `1*n` runs, set apart by spaces)."""
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce(F.concat(F.lit("="), "role"), F.lit("")).alias("role"),
        F.translate(_plain(F.coalesce("role", F.lit(UNNAMED))), "\r\n", "  ").alias("name"),
        _plain(F.coalesce("text", F.lit(""))).alias("text"),
        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(0)).cast("long").alias("part"),
    )
    parts = turns.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "name"))).alias("turns"))
    # names are few: they are summed up before they are shuffled, and joined to whole parts
    speakers = turns.select("conv_id", "role", "name").distinct().groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct("role", "name"))).alias("speakers"))
    met = parts.alias("p").join(speakers.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))).select("p.conv_id", "part", "turns", F.explode("speakers").alias("who"))

    def own(t: Column) -> Column:
        return t["role"] == F.col("who.role")

    def header(t: Column) -> Column:
        return F.when(own(t), F.lit(f"{OPEN}assistant{CLOSE}")).otherwise(F.concat(F.lit(f"{OPEN}user name="), t["name"], F.lit(CLOSE)))

    def runs(t: Column) -> Column:
        head, body = F.length(header(t)), F.length(t["text"]) + len(END)
        return F.when(own(t), F.concat(F.lit("0*"), head, F.lit(" 1*"), body)).otherwise(F.concat(F.lit("0*"), head + body))

    mine = F.filter("turns", own)
    return met.select(
        "conv_id",
        F.col("who.name").alias("speaker"),
        (F.col("who.role") == "").alias("unnamed"),
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(mine).cast("long").alias("n_own"),
        F.aggregate(mine, F.lit(0).cast("long"), lambda n, t: n + F.length(t["text"]) + len(END)).alias("n_trained"),
        F.array_join(F.transform("turns", lambda t: F.concat(header(t), t["text"], F.lit(END))), "").alias("text"),
        F.array_join(F.transform("turns", runs), " ").alias("mask"),
    )


def op7(conversations: DataFrame) -> DataFrame:
    """Every rendering's figures, with the MD5 of its text and mask."""
    return rotate(conversations).select(
        "conv_id", "speaker", "unnamed", "part", "n_turns", "n_own", "n_trained", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.md5(F.col("mask").cast("binary")).alias("mask_md5")
    )


#: The same over the conversations table in DuckDB.
SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce('=' || role, '') AS role, translate(replace(replace(coalesce(role, '{UNNAMED}'), '<|', '< |'), '|>', '| >'), chr(13) || chr(10), '  ') AS name,
         replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') AS text,
         coalesce(CAST(floor(turn / {PART_TURNS}.0) AS BIGINT), 0) AS part FROM conversations
), s AS (SELECT DISTINCT conv_id, role AS who, name AS speaker FROM t),
r AS (
  SELECT t.conv_id, s.speaker, s.who, t.part, t.turn, t.role, t.text, t.role = s.who AS own,
         CASE WHEN t.role = s.who THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || t.name || '|>' || chr(10) END AS header
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), u AS (
  SELECT *, CASE WHEN own THEN '0*' || length(header) || ' 1*' || (length(text) + {len(END)}) ELSE '0*' || (length(header) + length(text) + {len(END)}) END AS run FROM r
), g AS (
  SELECT conv_id, speaker, who, part, CAST(count(*) AS BIGINT) AS n_turns, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_own,
         CAST(sum(CASE WHEN own THEN length(text) + {len(END)} ELSE 0 END) AS BIGINT) AS n_trained,
         string_agg(header || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS body,
         string_agg(run, ' ' ORDER BY turn NULLS FIRST, role, text) AS mask
  FROM u GROUP BY conv_id, speaker, who, part
)
SELECT conv_id, speaker, who = '' AS unnamed, part, n_turns, n_own, n_trained, CAST(length(body) AS BIGINT) AS n_chars, md5(body) AS text_md5, md5(mask) AS mask_md5 FROM g
"""
