"""Scalar text functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.session import strip_blanks

# The spaces that cell text is cleaned of, and units dropped from numbers.
CELL_SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u205f\u3000\t\r"
UNITS = ("PPS", "pps", "㎲", "㎾", "㎒", "MHz", "kW", "%", "원", r"\$")


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; '' where there is none."""
    return F.regexp_extract(F.lower(name), r"\.([^./\\]+)$", 1)


def original_name(file_id: Column) -> Column:
    """A stored file's name without its 32 hex digits."""
    return F.regexp_replace(file_id, "^[a-f0-9]{32}_", "")


def tag_list(tags: Column, keep_empty: bool = False) -> Column:
    """The comma-separated tags, each without blanks at its ends."""
    each = F.transform(F.split(F.coalesce(tags, F.lit("")), ","), strip_blanks)
    return each if keep_empty else F.filter(each, lambda t: t != "")


def section_key(section_id: Column) -> Column:
    """The leading dotted number as an array of integers, [999] where there is none; arrays compare like lists."""
    number = F.regexp_extract(section_id, r"^(\d+(?:\.\d+)*)", 1)
    return F.when(number == "", F.array(F.lit(999))).otherwise(F.transform(F.split(number, r"\."), lambda x: x.cast("int")))


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / length of the longer, of lower case without blanks at the ends; 1 of equal texts, 0 where one is empty."""
    a, b = F.lower(strip_blanks(a)), F.lower(strip_blanks(b))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def clean_cell(text: Column, keep_lines: bool = False) -> Column:
    """Runs of blanks of any kind as one space; with keep_lines within each line. NULL gives ''."""
    text = F.translate(F.coalesce(text, F.lit("")), CELL_SPACES, " " * len(CELL_SPACES))
    if keep_lines:
        return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(strip_blanks(x), r"\s+", " ")), "\n")
    return F.regexp_replace(strip_blanks(text), r"\s+", " ")


def normalized(text: Column) -> Column:
    """Blanks collapsed, zero-width spaces out, no-break spaces plain."""
    return strip_blanks(F.regexp_replace(F.translate(text, "\u00a0\u200b", " "), r"(?U)\s+", " "))


def is_number(text: Column) -> Column:
    """Whether a cell holds a number once commas, blanks, units and a leading limit sign are gone."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[,\s]", ""), "|".join(UNITS), "")
    return F.coalesce(F.regexp_replace(plain, "^[≤≥]", "").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.lit(False))


def uptime_text(seconds: Column) -> Column:
    """Seconds as Korean days, hours, minutes and seconds; leading parts that are 0 are left out."""
    s = F.floor(seconds)
    parts = [(F.floor(s / 86400), "일"), (F.floor(s / 3600) % 24, "시간"), (F.floor(s / 60) % 60, "분"), (s % 60, "초")]
    text = F.concat_ws(" ", *(F.when(v > 0, F.concat(v.cast("string"), F.lit(u))) for v, u in parts))
    return F.when(s.isNotNull(), F.when(text == "", F.lit("0초")).otherwise(text))


def sse_frame(content: Column) -> Column:
    """A server-sent event of {"content": ...}."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(content.alias("content"))), F.lit("\n\n"))


def chat_messages(prompt: Column) -> Column:
    """The messages of a ChatML prompt as (role, content); one without an end is dropped."""
    parts = F.regexp_extract_all(prompt, F.lit(r"(?s)<\|im_start\|>(.*?)<\|im_end\|>"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(strip_blanks(F.substring_index(p, "\n", 1)).alias("role"), strip_blanks(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("content")))
