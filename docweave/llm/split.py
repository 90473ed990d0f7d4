"""Oversized text cut into overlapping pieces at natural boundaries, by bounded-quantifier expressions over a skeleton of the text.

The text is taken apart into units: words with the blanks after them (characters, where the size counts these). A unit's strength says what
ends with it: an empty line, a line, a sentence, a word, or nothing but a character. The skeleton has one letter a unit, its strength, so an
expression of one quantified letter class and a look-behind finds a segment: its alternatives stand in the order of boundary strength, each
consumes up to the limit, and the last, the fallback, takes any unit. Matching letters of one width needs no recursion, whatever the limit.
The first segment may be ``limit`` long, later ones ``limit - overlap``; a piece is a segment with a lookback of ``overlap`` units, whose places
SQL array functions compute. So no piece exceeds the limit, and the segments together are the text, unchanged.

Defined results: NULL and texts within the limit are not cut (one piece, or none with ``only_oversized``); NULL gives a NULL piece. A word is
what stands between blanks of any kind; characters without width are no blanks. A word of more than ``longest`` characters has no boundary
inside and falls back to characters: it counts as so many units of ``longest``; ``only_oversized`` goes by words as they are. With ``unit="char"`` a
surrogate pair counts as one character. Repeated rows are cut each; other columns go along; a clash with the new names raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.session import table

# Strengths of boundaries, strongest first: empty line, line, sentence, blank.
STRENGTHS = "plsw"
PARAGRAPH, LINE = r"(?sU)\n[^\S\n]*\r?\n", "\n"
SENTENCE = r"(?sU)[.!?。！？…][\"'”’)\]]{0,2}\s*$"
LONGEST = 10_000


def segment_pattern(limit: int, overlap: int) -> str:
    def segment(n: int) -> str:
        return "|".join([rf"(?:.{{1,{n}}}\z)", *(rf"(?:.{{{max(1, n // 2)},{n}}}(?<={s}))" for s in STRENGTHS), rf"(?:.{{1,{n}}})"])

    return rf"\A(?:{segment(limit)})|(?<!\A)(?:{segment(limit - overlap)})"


def units(text: Column, unit: str, longest: int) -> Column:
    """The units of a text, in order; together they are the text."""
    if unit == "char":
        return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.regexp_extract_all(text, F.lit(rf"(?sU)(?:\A\s++)?\S{{1,{longest}}}+\s*+|\A\s++\z"), F.lit(0))


def strength(u: Column, nxt: Column, unit: str) -> Column:
    """The letter of a unit's end. A line end within a run of characters shows in the character itself, a sentence's in the next being blank."""
    if unit == "char":
        return (
            F.when((u == "\n") & nxt.rlike(r"^\r?\n?$") & (nxt != ""), "p").when(u == "\n", "l")
            .when(u.rlike("[.!?。！？…]") & nxt.rlike(r"(?U)^\s"), "s").when(u.rlike(r"(?U)^\s"), "w").otherwise("c")
        )
    return F.when(~u.contains("\n"), F.when(u.rlike(SENTENCE), "s").when(u.rlike(r"(?U)\s$"), "w").otherwise("c")).when(u.rlike(PARAGRAPH), "p").otherwise("l")


def split_oversized(df: DataFrame, column: str, limit: int = 700, overlap: int = 100, unit: str = "word", only_oversized: bool = False, longest: int = LONGEST) -> DataFrame:
    """One row per piece: the other columns, piece_no from 1, start (0-based character offset in the text) and piece."""
    if not 0 <= overlap <= limit // 3:
        raise ValueError("the overlap must be at most a third of the limit")
    if clash := {"piece_no", "start", "piece", "_text", "_units", "_ends", "_lengths", "_starts", "_i", "_p"} & {*df.columns}:
        raise ValueError(f"there are columns {clash} already")
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    text = F.col(f"`{column}`")
    least = F.length(text) > (2 * limit - 2 if unit == "word" else limit)  # so many characters it takes at least
    may_exceed = least if only_oversized or unit == "char" else least | (F.length(text) > longest)
    d = df.where(may_exceed) if only_oversized else df
    d = d.select(*rest, text.alias("_text"), F.when(may_exceed, units(text, unit, longest)).otherwise(F.array(text)).alias("_units"))
    if only_oversized:
        words = F.size("_units") if unit == "char" else F.size(F.filter("_units", lambda u, i: u.rlike(r"(?U)\s$") | (i + 1 == F.size("_units"))))  # the others go on
        d = d.where((F.size("_units") > limit) & (words > limit))
    skeleton = F.array_join(F.transform("_units", lambda u, i: strength(u, F.coalesce(F.get("_units", i + 1), F.lit("")), unit)), "")
    cut = F.transform(F.regexp_extract_all(skeleton, F.lit(segment_pattern(limit, overlap)), F.lit(0)), F.length)
    ends = F.when(F.size("_units") > limit, F.aggregate(cut, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))).otherwise(F.array(F.lit(0), F.size("_units")))
    d = d.withColumn("_ends", ends)

    def length_of(a: Column, n: Column) -> Column:
        return F.length(F.array_join(F.slice("_units", a + 1, n), ""))

    # Of each segment where it ends, and of each piece how far it looks back, in characters.
    lengths = F.transform(F.slice("_ends", 1, F.size("_ends") - 1), lambda a, i: F.struct(length_of(a, F.get("_ends", i + 1) - a).alias("own"), F.when(i > 0, length_of(a - overlap, F.lit(overlap))).otherwise(0).alias("back")))
    d = d.withColumn("_lengths", F.when(F.size("_ends") > 2, lengths))
    starts = F.aggregate("_lengths", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x.own)))
    d = d.withColumn("_starts", F.coalesce(starts, F.array(F.lit(0), F.lit(0))))
    lookback = F.lit(overlap)
    pieces = F.transform(
        F.slice("_ends", 1, F.size("_ends") - 1),
        lambda a, i: F.when(F.size("_ends") == 2, F.struct(F.lit(0).alias("start"), F.col("_text").alias("piece"))).otherwise(
            F.struct(
                (F.get("_starts", i) - F.get("_lengths", i).back).alias("start"),
                F.array_join(F.when(i > 0, F.slice("_units", a - lookback + 1, F.get("_ends", i + 1) - a + lookback)).otherwise(F.slice("_units", a + 1, F.get("_ends", i + 1) - a)), "").alias("piece"),
            )
        ),
    )
    d = d.select(*rest, F.posexplode(pieces).alias("_i", "_p"))
    return d.select(*rest, (F.col("_i") + 1).alias("piece_no"), F.col("_p.start").alias("start"), F.col("_p.piece").alias("piece"))


CARRIED = ("doc_id", "file_id", "original_filename", "section_id", "section_title", "section_number", "page_number", "total_pdf_pages")


def p6_pieces(spark, sf_dir: str) -> DataFrame:
    """The pieces of every chunk of more than 700 words, with the chunk's file, section and page."""
    c = table(spark, sf_dir, "chunks").select(*CARRIED, "content").where(F.length("content") > 1400).dropDuplicates(["doc_id"])
    return split_oversized(c, "content", only_oversized=True)


def p6_found(spark, sf_dir: str) -> DataFrame:
    return p6_pieces(spark, sf_dir).where("piece_no = 2").select("doc_id")
