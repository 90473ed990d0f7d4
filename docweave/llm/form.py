"""One form for visually identical text, computed by DuckDB inside Arrow partitions.

The text of a batch goes through one embedded SQL statement: ``translate`` maps single code points
(compatibility forms, blanks, look-alike letters) and drops characters without width, ``replace`` expands
compatibility forms of several letters, ``nfc_normalize`` composes, and ``regexp_replace`` folds blanks.
A first statement finds which of the mapped characters the batch holds, so that the literals of the second
stay short whatever the size of the whole map.

Defined results: NULL text gives NULL; empty or blank text gives ''; letter case and visible accents stay;
texts of any length are processed whole; rows, order and repeated rows are kept.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.session import materialize, once, schema_with, ship, site_key, spread, table

# Letters of other scripts that look like a Latin letter, and dashes that look like "-".
LOOK_ALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "γ": "y", "χ": "x", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I", "Ԁ": "D", "Ԋ": "H",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ү": "y", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "г": "r", "к": "k", "ԍ": "g",
    # Armenian
    "Ս": "U", "Օ": "O", "Տ": "S", "Լ": "L", "օ": "o", "ս": "u", "ո": "n", "հ": "h", "զ": "q", "ց": "g", "յ": "j",
    # Latin of other codes
    "ɡ": "g", "ɑ": "a", "ı": "i", "ɩ": "i", "ʏ": "Y", "ʋ": "u", "ⅼ": "l", "ǀ": "l",
    # Dashes
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "⁃": "-", "˗": "-", "➖": "-", "Ⲻ": "-", "۔": "-",
}

# Code points without width that are not of the category "format".
NO_WIDTH = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))


@once
def char_map() -> dict[str, str]:
    """Every code point that FORM changes by itself, with what it becomes; by rule from the Unicode data of Python."""
    out = {}
    for i in range(0x80, 0x1F300):
        if 0xAC00 <= i < 0xF900 or 0x3400 <= i < 0xA000 or 0x1100 <= i < 0x1200 and chr(i) not in NO_WIDTH:  # syllables, plain ideographs, surrogates, conjoining letters
            continue
        c = chr(i)
        if c.isspace():
            out[c] = " "
        elif c in NO_WIDTH or unicodedata.category(c) == "Cf":
            out[c] = ""
        elif (to := unicodedata.normalize("NFC", "".join(LOOK_ALIKES.get(x, x) for x in unicodedata.normalize("NFKD", c)))) != c:
            out[c] = to
    return out | {chr(i): "" for i in [*range(0xE0001, 0xE0080), *range(0xE0100, 0xE01F0)]}


def _class(chars: list[str]) -> str:
    """A regular-expression class of these characters, as ranges."""
    parts, codes = [], sorted(map(ord, chars))
    start = last = codes[0]
    for c in [*codes[1:], -1]:
        if c != last + 1:
            parts.append(f"\\x{{{start:x}}}-\\x{{{last:x}}}")
            start = c
        last = c
    return "[" + "".join(parts) + "]"


@once
def mapped_class() -> str:
    return _class(list(char_map()))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@once
def unsettled_class() -> str:
    """Characters without which a text is composed already: marks, conjoining letters, and what composition changes."""
    return _class([c for c in map(chr, [*range(0x300, 0xD800), *range(0xF900, 0x1E950)]) if unicodedata.category(c)[0] == "M" or "ᄀ" <= c <= "ᇿ" or not unicodedata.is_normalized("NFC", c)])


BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"


def mapped_sql(expr: str, present: list[str]) -> str:
    """The first half of FORM: single characters. ``present`` are the mapped characters that can occur."""
    m = char_map() | dict.fromkeys(BLANKS, " ")
    one = [c for c in present if len(m[c]) == 1] + list(BLANKS)
    gone = [c for c in present if not m[c]]
    expr = f"translate({expr}, {quoted(''.join(one + gone))}, {quoted(''.join(m[c] for c in one))})"
    for c in present:
        if len(m[c]) > 1:
            expr = f"replace({expr}, {quoted(c)}, {quoted(m[c])})"
    return expr


def composed_sql(expr: str) -> str:
    """The second half of FORM: composition and runs of blanks."""
    return f"trim(regexp_replace(CASE WHEN regexp_matches({expr}, {quoted(unsettled_class())}) THEN nfc_normalize({expr}) ELSE {expr} END, '  +', ' ', 'g'))"


def connect():
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute("SET threads=1")
    con.execute("SET memory_limit='1GB'")  # two workers share an executor; a longer text than that allows spills
    con.execute("SET preserve_insertion_order=true")
    return con


def pieces(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded bytes (a row is never divided), so that memory doesn't follow the longest texts."""
    n, size = batch.num_rows, max(1, batch.nbytes)
    step = max(1, min(n, n * limit // size))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def run_forms(con, batch: pa.RecordBatch, column: str, expr: str, select: str) -> pa.Table:
    """Run ``SELECT select FROM batch`` where select may name ``form``: FORM(expr), of the text in the given column."""
    con.register("batch", pa.Table.from_batches([batch]))
    found = con.execute(f"SELECT DISTINCT unnest(regexp_extract_all({column}, {quoted(mapped_class())})) FROM batch WHERE regexp_matches({column}, {quoted(mapped_class())})").fetchall()
    inner = f"SELECT *, {mapped_sql(expr, sorted(x for (x,) in found))} AS mapped FROM batch"
    out = con.sql(f"SELECT {select} FROM (SELECT *, {composed_sql('mapped')} AS form FROM ({inner}))").to_arrow_table()
    con.unregister("batch")
    return out


def body_of(content):
    """Of chunks.content, what follows the second line end; '' where there are fewer lines, NULL of NULL."""
    return F.regexp_extract(content, r"(?s)^[^\n]*\n[^\n]*\n(.*)$", 1)


def with_form(df: DataFrame, column: str, out: str = "form", expr: str = "form", keep_text: bool = True) -> DataFrame:
    """df with FORM(column), or a SQL expression of ``form``, in a new text column. A clashing name raises; other columns go through untouched."""
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")
    kept = [c for c in df.columns if keep_text or c != column]
    schema = schema_with(df, kept, out, "string")

    def each(batches):
        con = connect()
        for batch in batches:
            for part in pieces(batch):
                r = run_forms(con, part.select([column]).rename_columns(["text"]), "text", "text", f"{expr} AS r")
                yield pa.RecordBatch.from_arrays([*part.select(kept).columns, r.column("r").combine_chunks().cast(pa.string())], [*kept, out])

    return df.mapInArrow(each, schema)


def equal_looking(df: DataFrame, key: str, text: str, by: list[str] = ()) -> DataFrame:
    """Pairs (key_a < key_b) of rows whose text has one form but other code points; ``by`` columns must agree too.

    Rows are first reduced to (key, 128-bit hash of the form, 128-bit hash of the text). Keys of one form and one
    spelling are never paired, so a group of exact copies costs nothing by itself.
    NULL text joins no pair. Repeated keys count once.
    """
    names = [f"_by{i}" for i in range(len(by))]  # names of the caller's columns must not meet ours
    h = df.where(F.col(text).isNotNull() & F.col(key).isNotNull())
    h = h.select(F.col(key).alias("_key"), *(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), F.col(text).alias("_text"), F.md5(text).alias("t"))
    return variant_pairs(with_form(h, "_text", "f", "md5(form)", keep_text=False).distinct(), "_key", names)


#: Rows of a group that one task compares with each other; larger groups are cut in blocks.
GROUP = 2_000


def in_blocks(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """rows with _blocks, how many blocks of some ``limit`` rows their group has, and _blk, a hash of the row that says which is its own."""
    large = rows.groupBy(*by).agg(F.ceil(F.count("*") / limit).cast("int").alias("_blocks")).where("_blocks > 1")
    rows = rows.join(large, by, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    return rows.withColumn("_blk", F.pmod(F.xxhash64(*(c for c in rows.columns if c != "_blocks")), "_blocks").cast("int"))


def paired(rows: DataFrame, by: list[str], limit: int = GROUP) -> DataFrame:
    """Every two rows of a group, both ways around, as structs x and y. Two blocks of a large group meet in a task of their own, so no task sees a whole group."""
    r = in_blocks(rows, by, limit)
    cols = F.struct(*rows.columns)
    x = r.select(*by, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_j"), F.col("_blk").alias("_i"), cols.alias("x"))
    y = r.select(*by, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_i"), F.col("_blk").alias("_j"), cols.alias("y"))
    return x.join(y, [*by, "_i", "_j"]).select(*by, "x", "y")


def crossed(left: DataFrame, right: DataFrame, by: list[str], limit: int = GROUP) -> DataFrame:
    """left joined with right on ``by``; large groups of either are cut in blocks, and every two blocks meet in a task of their own."""
    x, y = in_blocks(left, by, limit), in_blocks(right, by, limit)
    nx, ny = (d.where("_blocks > 1").select(*by, F.col("_blocks").alias("_n")).distinct() for d in (x, y))

    def placed(d: DataFrame, own: str, others: DataFrame, other: str) -> DataFrame:
        d = d.withColumnRenamed("_blk", own).drop("_blocks").join(others, by, "left")
        return d.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")

    return placed(x, "_x", ny, "_y").join(placed(y, "_y", nx, "_x"), [*by, "_x", "_y"]).drop("_x", "_y")


def variant_pairs(h: DataFrame, key: str, by: list[str] = ()) -> DataFrame:
    """Of rows (key, by, f, t) the pairs of equal f and different t. Forms written in one way only are left out before the join."""
    h = materialize(h, "forms")
    spelled = h.groupBy("f", "t", *by).agg(F.lit(1).alias("one")).groupBy("f", *by).agg(F.count("*").alias("n")).where("n > 1").select("f", *by)
    h = h.join(spelled, ["f", *by], "left_semi").select(F.col(key).alias("_k"), "f", "t", *by)
    return paired(h, ["f", *by]).where("x.t <> y.t AND x._k < y._k").select(F.col("x._k").alias("key_a"), F.col("y._k").alias("key_b")).distinct()


def look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, spellings, records): of each text the smallest key of its form, and how many spellings and records the form has. Linear, however many look alike.

    NULL text has no class; a repeated key counts once.
    """
    h = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.md5(text).alias("t"))
    h = materialize(with_form(h, "_text", "f", "md5(form)", keep_text=False).distinct(), "forms")
    c = h.groupBy("f", "t").agg(F.min("_key").alias("k"), F.count("*").alias("n")).groupBy("f").agg(F.min("k").alias("class_id"), F.count("*").alias("spellings"), F.sum("n").alias("records"))
    return h.join(c, "f").select(F.col("_key").alias(key), "class_id", "spellings", "records")


def requested_names(requests: DataFrame) -> DataFrame:
    """(key, name, s) of each requested name of a site; key as r<request_id, 10 digits>:<place>."""
    r = requests.select("request_id", site_key(F.col("sosok"), F.col("site")).alias("s"), F.posexplode("filenames").alias("i", "name"))
    key = F.format_string("r%010d:%d", F.col("request_id"), F.col("i") + 1)
    return r.where("s IS NOT NULL AND name IS NOT NULL").select(key.alias("key"), "name", "s").distinct()


def stored_names(chunks: DataFrame) -> DataFrame:
    """(key = file_id, name, s) of each file of a site."""
    return chunks.select(F.col("file_id").alias("key"), F.col("original_filename").alias("name"), site_key(F.col("sosok"), F.col("site")).alias("s")).where("s IS NOT NULL AND name IS NOT NULL AND key IS NOT NULL").distinct()


def bodies(chunks: DataFrame) -> DataFrame:
    """(doc_id, body) with LF for CR LF."""
    return spread(chunks.where("content IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "content")).select("doc_id", F.regexp_replace(body_of(F.col("content")), "\r\n", "\n").alias("body"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks")
    found = equal_looking(bodies(chunks), "doc_id", "body")
    names = stored_names(chunks).withColumn("side", F.lit(0)).union(requested_names(table(spark, sf_dir, "duplicate_requests")).withColumn("side", F.lit(1)))
    names = materialize(with_form(names.withColumn("t", F.md5("name")), "name", "f", "md5(form)", keep_text=False), "names")
    a = names.where("side = 0").select("f", "s", F.col("key").alias("key_a"), F.col("t").alias("ta"))
    b = names.where("side = 1").select("f", "s", F.col("key").alias("key_b"), F.col("t").alias("tb"))
    named = crossed(a, b, ["f", "s"]).where("ta <> tb").select("key_a", "key_b").distinct()
    return found.select(F.lit("content").alias("field_name"), "key_a", "key_b").union(named.select(F.lit("filenames").alias("field_name"), F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")))


def p5_classes(spark, sf_dir: str) -> DataFrame:
    """Every chunk's class of equal-looking bodies, with the spellings and records of it."""
    return look_classes(bodies(table(spark, sf_dir, "chunks")), "doc_id", "body")


def p5_forms(spark, sf_dir: str) -> DataFrame:
    """Every chunk's content and file name in one form, and every requested name: rows without doc_id, by request_id and place from 1."""
    c = table(spark, sf_dir, "chunks").dropDuplicates(["doc_id"]).select("doc_id", "content", "original_filename")
    c = with_form(with_form(c, "content", "content_form"), "original_filename", "filename_form").select("doc_id", "content_form", "filename_form")
    r = table(spark, sf_dir, "duplicate_requests").select("request_id", F.posexplode("filenames").alias("i", "name"))
    r = with_form(r, "name", "filename_form").select("request_id", (F.col("i") + 1).alias("place"), "filename_form")
    return c.unionByName(r, allowMissingColumns=True)


ship(__name__)
