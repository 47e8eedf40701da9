"""Fill-in-middle transformation by markers in the text, in column expressions alone.

A delimiter character is escaped in the text, ``regexp_replace`` appends it after every unit, and the
units are then counted and cut by the delimiter's rank: ``substring_index`` gives the first or the last
k of them. The parts lose their delimiters, are unescaped, and are put together behind sentinels.

A unit is white space and the word behind it, or white space that ends the text. Delimiter and escape
are no white space, so that escaping moves no unit's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import col, text_of

DELIMITER, ESCAPE = "\x01", "\x02"
#: Possessive, so that no run of white space is tried twice.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 texts so many are cut, and of 100 that are cut so many have the suffix in front.
RATE, SUFFIX_FIRST = 50, 80
PARTS = ("prefix", "middle", "suffix")
ADDED = ("n", "form", *PARTS, "output")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def unescaped(text: Column) -> Column:
    """Text of marked units: without delimiters, escapes undone."""
    bare = F.replace(text, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def marked(text: Column) -> Column:
    """Escaped text with the delimiter behind every unit."""
    return F.regexp_replace(escaped(text), UNIT, "$0" + DELIMITER)


def ranked(text: Column, count: Column) -> Column:
    """The first ``count`` units of a marked text, or with a count below zero the last ones and what follows the last delimiter."""
    return F.call_function("substring_index", text, F.lit(DELIMITER), count.cast("int"))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of seed and id; a null id is hashed as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(documents: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``documents`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix``, ``middle``, ``suffix`` and ``output``.

    Id and seed alone decide where a text is cut and in which form, so repeated rows come out alike. Null
    texts count as empty; empty texts and texts that hold a sentinel stay plain, with null parts, as their
    output. White space alone is one unit. Columns of the added names and those that start with ``_fim_``
    are replaced, others pass through; an empty table gives no rows.
    """
    h1, h2, h3, h4 = draws(col("doc_id"), seed)
    rows = documents.withColumns({"_fim_text": text_of(), "_fim_marked": marked(text_of()), "_fim_1": h1, "_fim_2": h2, "_fim_3": h3, "_fim_4": h4})
    text, units = F.col("_fim_text"), F.col("_fim_marked")
    # Every delimiter in the marked text ends a unit.
    rows = rows.withColumn("n", (F.length(units) - F.length(F.replace(units, F.lit(DELIMITER), F.lit("")))).cast("long"))
    one, two = F.col("_fim_1") % (F.col("n") + 1), F.col("_fim_2") % (F.col("n") + 1)
    held = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    rows = rows.withColumns({
        "_fim_from": F.least(one, two), "_fim_to": F.greatest(one, two),
        "form": F.when((text == "") | held | (F.col("_fim_3") % 100 >= rate), "plain").when(F.col("_fim_4") % 100 < suffix_first, "spm").otherwise("psm"),
    })
    cut, start, end, n = F.col("form") != "plain", F.col("_fim_from"), F.col("_fim_to"), F.col("n")
    # The middle is the last end - start units of the first end ones, whose final delimiter substring_index leaves out.
    last = F.when(end > start, ranked(ranked(units, end), start - end)).otherwise(F.lit(""))
    rows = rows.withColumns({
        "prefix": F.when(cut, unescaped(ranked(units, start))),
        "middle": F.when(cut, unescaped(last)),
        "suffix": F.when(cut, unescaped(ranked(units, end - n - 1))),
    })
    prefix, middle, suffix = (F.col(p) for p in PARTS)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    rows = rows.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(text))
    return rows.drop(*(c for c in rows.columns if c.startswith("_fim_")))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` and ``form`` were made from; the parts hold no sentinel, so each is found at its first place."""
    first, second = (F.substring_index(F.substring(output, len(PREFIX) + 1, 2**31 - 1), s, 1) for s in (SUFFIX, PREFIX))
    behind = F.substring_index(F.substring_index(output, MIDDLE, 1), SUFFIX, -1), F.substring_index(F.substring_index(output, MIDDLE, 1), PREFIX, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    return F.when(form == "psm", F.concat(first, middle, behind[0])).when(form == "spm", F.concat(behind[1], middle, second)).otherwise(output)


def transform_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars and middle_chars (null if plain), output_sha256 and restored_sha256 of every row of ``documents``."""
    rows = transform(documents.select(col("doc_id"), col("text")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
