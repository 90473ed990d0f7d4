"""Several values packed in one text field, taken apart by array folds inside SQL.

The text is cut at its quote characters. Pieces outside quotes are split on the delimiters, pieces inside are literal;
a fold over the pieces puts the values together again, in order. Everything runs in the JVM.

Defined results: NULL, empty and blank fields give no row. A value is quoted only if it is wholly in quotes (straight
single or double, or curly double) with nothing but blanks up to the delimiter on either side; then doubled closing quotes inside
stand for one. A quote that never closes, or that closes before the value ends, is a plain character. Repeated values stay,
empty ones are dropped and take no ordinal. Other columns are carried along; a clash with the new names raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.session import strip_blanks, table

# What separates values by itself, and what does so only between blanks.
HARD = ",;|，；｜、､\t\r\n\x0b\x0c\x85  "
SOFT = "/·／・･"
QUOTES = {'"': '"', "'": "'", "“": "”"}

DELIMITER = rf"(?U)[{HARD}]|(?<=\s)[{SOFT}](?=\s)"
AT_QUOTES = "(?=[\"'“”])|(?<=[\"'“”])"
ENDS_HERE = rf"(?sU)^\s*([{HARD}]|(?<=\s)[{SOFT}]\s).*"


def split_packed(text: Column) -> Column:
    """ARRAY<STRING> of the values in text, in order."""
    none = F.array().cast("array<string>")

    def plain(s):
        return F.split(s, DELIMITER, -1)

    def state(cur, close, raw, body, skip, done):
        return F.struct(cur.alias("cur"), close.alias("close"), raw.alias("raw"), body.alias("body"), skip.alias("skip"), done.alias("done"))

    nothing, no = F.lit(""), F.lit(False)

    def all_but_last(a):
        return F.slice(a, 1, F.size(a) - 1)

    def fold(pieces):
        def step(s, i):
            p, n = F.get(pieces, i), F.get(pieces, i + 1)
            opens = p.isin(list(QUOTES)) & (strip_blanks(s.cur) == "")
            close = F.when(p == "“", F.lit("”")).otherwise(p)
            is_quote = p.isin(*QUOTES, "”")
            parts = plain(F.concat(s.cur, p))
            outside = (
                F.when(opens, state(nothing, close, F.concat(s.cur, p), nothing, no, s.done))
                .when(is_quote, state(F.concat(s.cur, p), nothing, nothing, nothing, no, s.done))
                .otherwise(state(F.element_at(parts, -1), nothing, nothing, nothing, no, F.concat(s.done, F.transform(all_but_last(parts), strip_blanks))))
            )
            ended = n.isNull() | n.rlike(ENDS_HERE) | ((strip_blanks(n) == "") & (i + 2 >= F.size(pieces)))
            failed = plain(F.concat(s.raw, p))
            inside = (
                F.when(s.skip, state(nothing, s.close, F.concat(s.raw, p), s.body, no, s.done))
                .when(p != s.close, state(nothing, s.close, F.concat(s.raw, p), F.concat(s.body, p), no, s.done))
                .when(n == s.close, state(nothing, s.close, F.concat(s.raw, p), F.concat(s.body, p), F.lit(True), s.done))
                .when(ended, state(nothing, nothing, nothing, nothing, no, F.concat(s.done, F.array(s.body))))
                .otherwise(state(F.element_at(failed, -1), nothing, nothing, nothing, no, F.concat(s.done, F.transform(all_but_last(failed), strip_blanks))))
            )
            return F.when(s.close == "", outside).otherwise(inside)

        def finish(s):
            return F.concat(s.done, F.transform(plain(F.when(s.close == "", s.cur).otherwise(s.raw)), strip_blanks))

        return F.aggregate(F.sequence(F.lit(0), F.size(pieces) - 1), state(nothing, nothing, nothing, nothing, no, none), step, finish)

    values = F.when(text.rlike("[\"'“”]"), F.get(F.transform(F.array(F.split(text, AT_QUOTES, -1)), fold), 0)).otherwise(F.transform(plain(text), strip_blanks))
    return F.when(text.isNotNull(), F.filter(values, lambda v: strip_blanks(v) != ""))


def explode_packed(df: DataFrame, column: str, value: str = "value", ordinal: str = "ordinal") -> DataFrame:
    """One row per value of a packed column, with its place from 1; the packed column goes."""
    if {value, ordinal} & ({*df.columns} - {column}):
        raise ValueError(f"there is a column {value} or {ordinal} already")
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.where(F.col(column).isNotNull()).select(*rest, F.posexplode(split_packed(F.col(column))).alias("_pos", value)).select(*rest, (F.col("_pos") + 1).alias(ordinal), value)


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Every tag of every file. The rows of a file agree in tags: one is kept by a map-side aggregate before the fold."""
    files = table(spark, sf_dir, "chunks").where("file_id IS NOT NULL AND tags IS NOT NULL").groupBy("file_id").agg(F.min("tags").alias("tags"))
    return explode_packed(files, "tags", "tag", "tag_no").select("file_id", "tag_no", "tag")
