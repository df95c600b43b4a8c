"""String expressions: normalising, tokenising, decoding, small formats. All but decomposing marks run inside the JVM."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkmill.functions.batches import small_batches

# Special tokens and their ids, and the separators of parts and segments.
UNK, SEP, PAD, CLS, MASK, BOS, EOS = "<unk>", "<sep>", "<pad>", "<cls>", "<mask>", "<|startoftext|>", "<|endoftext|>"
PAD_ID, EOS_ID, BOS_ID, IGNORE_ID = 0, 8, 10, -100
PART_SEPARATOR, SEGMENT_SEPARATOR = "<unused1>", "<unused2>"
RESERVED = tuple(f"<unused{i}>" for i in range(1, 11))
MODEL_WINDOW, MODEL_VOCABULARY, ITEMS_PER_FILE = 1024, 13312, 200_000

#: White space as Unicode has it, with the four separators that count as such in Python.
SPACE = r"(?U)[\s\x1c-\x1f]+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: White space of SQL's patterns, which a vertical tab is not; Java's has it.
TOKEN = r"(\p{L}+|[0-9]|[^ \t\n\f\r\p{L}0-9])"


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def despace(x: Column | str) -> Column:
    """The text without any white space."""
    return F.regexp_replace(as_column(x), SPACE, "")


def words(x: Column | str) -> Column:
    """The text cut at white space, without empty pieces."""
    return F.filter(F.split(as_column(x), SPACE), lambda w: w != "")


def trim(x: Column | str) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(as_column(x), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def lines(x: Column | str) -> Column:
    """The text's lines; a line end at its end opens no further line."""
    parts = F.split(as_column(x), LINE_END)
    last = F.element_at(parts, -1) == ""
    return F.when(last, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def drop_double_spaces(x: Column | str) -> Column:
    return F.replace(as_column(x), F.lit("  "), F.lit(""))


def triple(x: Column | str, mark: str = "|||") -> Column:
    """The three trimmed parts of a text between marks; another number of parts is an error."""
    parts = F.transform(F.split(trim(x), "\\" + "\\".join(mark)), trim)
    return F.when(F.size(parts) == 3, parts).otherwise(F.raise_error(F.lit(f"a triple needs three parts between {mark}")))


def after(x: Column | str, n: int) -> Column:
    """The text without its first n characters."""
    x = as_column(x)
    return F.substring(x, F.lit(n + 1), F.length(x))


def listed(items: Column, joint: str = "，", end: str = "；") -> Column:
    """Items set apart by joint and closed by end."""
    return F.concat(F.array_join(items, joint), F.lit(end))


def pairs(m: Column | str, colon: str = "：", joint: str = "；") -> Column:
    """A map as `key：value` pieces without white space, in the map's order."""
    return F.array_join(F.transform(F.map_entries(as_column(m)), lambda e: F.concat(despace(e["key"]), F.lit(colon), despace(e["value"]))), joint)


@F.arrow_udf(StringType())
def _unmarked(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_normalize(texts, "NFD"), r"\p{Mn}+", "")


def normalised(x: Column | str) -> Column:
    """Lower case, decomposed without non-spacing marks, control characters or odd spaces."""
    small_batches()
    plain = _unmarked(F.lower(as_column(x)))
    plain = F.regexp_replace(plain, r"[\x00�\p{Cc}\p{Cf}&&[^\t\n\r]]", "")
    return F.regexp_replace(plain, r"[\p{Zs}\t\r]", " ")


def _alone() -> str:
    """The inside of a character class: ideographs, and digits of any kind as `str.isdigit` has them."""
    # Blocks of unified and compatibility ideographs
    blocks = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]
    digits = [i for i in range(0x20000) if chr(i).isdigit()]
    known = set(digits)
    runs = [(i, next(j for j in range(i, 0x20000) if j + 1 not in known)) for i in digits if i - 1 not in known]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in runs + blocks)


ALONE = _alone()


def isolate(x: Column | str) -> Column:
    """Ideographs and digits of any kind with spaces around, so that each is a token."""
    return F.regexp_replace(as_column(x), f"([{ALONE}])", " $1 ")


def tokens(x: Column | str) -> Column:
    """Words of letters, single digits and single signs of the text, lower-cased letter by letter."""
    # the two capitals that Java lowers to two characters, or by what stands around them
    x = F.replace(F.replace(as_column(x), F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ"))
    return F.regexp_extract_all(F.lower(x), F.lit(TOKEN), 1)


def tokens_with_lines(x: Column | str) -> Column:
    """Tokens with a separator for each line end."""
    pieces = F.split(as_column(x), "\n")
    many = F.transform(pieces, lambda p, i: F.concat(F.when(i > 0, F.array(F.lit(SEP))).otherwise(F.array().cast("array<string>")), tokens(p)))
    return F.flatten(many)


def framed(x: Column, first: str = BOS, last: str = EOS) -> Column:
    """An array between a first and a last token."""
    return F.concat(F.array(F.lit(first)), x, F.array(F.lit(last)))


def decoded(pieces: Column | str) -> Column:
    """Tokens as text: pieces that go on a word are set to it, a space stays before a Latin letter only."""
    joined = trim(F.replace(F.array_join(as_column(pieces), " "), F.lit(" ##"), F.lit("")))
    return F.regexp_replace(joined, " (?![A-Za-z])", "")


def marked(text: Column | str, pattern: str, before: str, after_: str) -> Column:
    """Matches of a pattern between marks."""
    return F.regexp_replace(as_column(text), f"({pattern})", f"{before}$1{after_}")


def split_keeping(text: Column | str, pattern: str) -> Column:
    """The text cut around matches of one pattern, none of which is empty; the matches are pieces too."""
    text = as_column(text)
    # what stands before each match, and the match; behind the last one the rest
    cut = F.lit(f"(?s)(.*?)({pattern}|\\z)")
    plain, found = (F.regexp_extract_all(text, cut, i) for i in (1, 2))
    n = F.size(F.filter(found, lambda m: m != ""))
    return F.concat(F.flatten(F.zip_with(F.slice(plain, 1, n), F.slice(found, 1, n), lambda p, m: F.array(p, m))), F.slice(plain, n + 1, 1))


def edited(text: Column | str, edits: Column | str) -> Column:
    """The text with characters replaced: edits are (place from 1 as text, character)."""
    letters = F.split(as_column(text), "")
    changed = F.aggregate(as_column(edits), letters, lambda acc, e: F.transform(acc, lambda c, i: F.when(i == e[0].cast("int") - 1, e[1]).otherwise(c)))
    return F.array_join(changed, "")


def edit_script(text: Column | str, edits: Column | str) -> Column:
    """The edits as `place from 0:-old+new`, set apart by semicolons."""
    letters = F.split(as_column(text), "")

    def one(e: Column) -> Column:
        at = e[0].cast("int")
        return F.concat((at - 1).cast("string"), F.lit(":-"), F.element_at(letters, at), F.lit("+"), e[1])

    return F.array_join(F.transform(as_column(edits), one), ";")


def prompt(x: Column | str, prefix: str = "", suffix: str = "", fill: dict[str, Column] | None = None) -> Column:
    """Start token, prefix, text and suffix; `{NAME}` stands for the column of that name."""
    out = F.concat(F.lit(BOS + prefix), as_column(x), F.lit(suffix))
    for name, value in (fill or {}).items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def sample_text(x: Column | str) -> Column:
    """A generated text up to its first separator."""
    return F.substring_index(F.substring_index(as_column(x), SEP + EOS, 1), SEP, 1)


def preview(x: Column | str, n: int = 10) -> Column:
    x = as_column(x)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def version_parts(x: Column | str) -> Column:
    """A version without its local part, as numbers that compare in order."""
    return F.transform(F.split(F.substring_index(as_column(x), "+", 1), "\\."), lambda p: F.regexp_extract(p, r"^\d+", 0).cast("int"))


def numbered_name(i: Column, width: int | Column = 8, end: str = "") -> Column:
    return F.concat(F.lpad(i.cast("string"), width, F.lit("0")), F.lit(end))


def any_of(names: Sequence[str]) -> str:
    """A pattern for any of these texts as they stand."""
    return "|".join(r"\Q" + n.replace(r"\E", r"\E\\E\Q") + r"\E" for n in names)


def pretty(value, indent: int | str | None = 2, ascii_only: bool = False) -> str:
    """A value as indented JSON; objects by their fields, anything else by its text."""
    return json.dumps(value, indent=indent, ensure_ascii=ascii_only, default=lambda o: getattr(o, "__dict__", None) or str(o))
