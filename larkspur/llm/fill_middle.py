"""Fill-in-middle transformation by escaped markers, in SQL functions only.

A delimiter is escaped in the text, ``regexp_replace`` puts it behind every unit (a word with the white
space before it, or the white space at the end), counting it tells the number of units, and
``substring_index`` cuts the ranked parts; parts lose their delimiters and escapes before they are
put together.  Delimiter and escape are no white space, so escaping moves no border of a unit.

One pass over the table: no row is shuffled, and no text meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Put behind every unit, and the lead of the two escapes that stand for it and for itself.
MARK, ESCAPE = "\x01", "\x02"
UNIT = r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
# The sentinels of the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def _cut(text: Column, mark: str, count: Column | int) -> Column:
    """``substring_index`` with a count that may differ by row."""
    return F.call_function("substring_index", text, F.lit(mark), count if isinstance(count, Column) else F.lit(count))


def marked(text: Column) -> Column:
    """The escaped text with the delimiter behind every unit."""
    return F.regexp_replace(_swap(_swap(text, ESCAPE, ESCAPE + "b"), MARK, ESCAPE + "a"), UNIT, "$1" + MARK)


def bare(part: Column) -> Column:
    """The text of a part, without its delimiters and escapes."""
    return _swap(_swap(_swap(part, MARK, ""), ESCAPE + "a", MARK), ESCAPE + "b", ESCAPE)


def restored(output: Column, form: Column) -> Column:
    """The text from which ``output`` was put together, from the output and its form alone.

    No sentinel stands in a text that is not plain, and none arises where a part meets a sentinel, so
    each one is found once.
    """
    body, middle = _cut(output, MIDDLE, 1), _cut(output, MIDDLE, -1)
    psm = F.concat(_cut(_cut(body, SUFFIX, 1), PREFIX, -1), middle, _cut(body, SUFFIX, -1))
    spm = F.concat(_cut(body, PREFIX, -1), middle, _cut(_cut(body, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transformed(docs: DataFrame, seed: int = 42, share: int = 50, spm: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) per row of docs.

    n is the number of units; ``share`` of 100 texts are cut, ``spm`` of 100 of these get the suffix
    first, as a digest of seed and doc_id says.  prefix, middle and suffix are null if form is plain.

    Null texts are empty, and an empty text is plain with n = 0; a null doc_id draws as an empty one.
    Texts of any length are cut whole; repeated rows give equal rows; columns other than doc_id and
    text are not looked at; an empty table gives an empty result.
    """
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    part = lambda i: F.conv(F.substring("_draw", 8 * i + 1, 8), 16, 10).cast("long")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), draw.alias("_draw"))
    own = F.greatest(*[F.contains("_text", F.lit(x)).cast("int") for x in (PREFIX, SUFFIX, MIDDLE)]) > 0
    form = F.when((F.col("_text") == "") | own | (part(2) % 100 >= share), "plain").when(part(3) % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "_text", marked(F.col("_text")).alias("_marked"), part(0).alias("_a"), part(1).alias("_b"), form.alias("form"))
    rows = rows.withColumn("n", (F.char_length("_marked") - F.char_length(_swap(F.col("_marked"), MARK, ""))).cast("long"))
    a, b = F.col("_a") % (F.col("n") + 1), F.col("_b") % (F.col("n") + 1)
    rows = rows.withColumn("_low", F.least(a, b).cast("int")).withColumn("_high", F.greatest(a, b).cast("int"))
    whole, low, high = F.col("_marked"), F.col("_low"), F.col("_high")
    cut = F.col("form") != "plain"
    rows = rows.select(
        "doc_id", "n", "form", "_text",
        F.when(cut, bare(_cut(whole, MARK, low))).alias("prefix"),
        F.when(cut, bare(_cut(_cut(whole, MARK, high), MARK, low - high))).alias("middle"),
        F.when(cut, bare(_cut(whole, MARK, high - F.col("n").cast("int") - 1))).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm_ = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("_text"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def query(spark, sf_dir):
    from .common import read

    rows = transformed(read(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return rows.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents
), cut AS (
  SELECT doc_id, body, regexp_extract_all(body, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    CAST('0x' || substr(draw, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(draw, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(draw, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(draw, 25, 8) AS BIGINT) AS h4 FROM texts
), ranked AS (
  SELECT doc_id, body, units, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut
), parts AS (
  SELECT doc_id, body, n, form, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix FROM ranked
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE body END) AS output_sha256,
  sha256(body) AS restored_sha256 FROM parts
"""
