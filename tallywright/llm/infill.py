"""Fill-in-middle: texts cut into prefix, middle and suffix by a counted-quantifier regex.

A unit is a run of Latin letters or any other single code point. ``regexp_count`` gives
the number of units. Each row then has a pattern of its own, in which one possessive
group takes as many units as the prefix has and another as many as the middle has; what
is left is the suffix. One match of it rewrites the whole text into its form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks, the shares of a hundred, and the units.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHANGED, SUFFIX_FIRST = 90, 20
UNITS = "[A-Za-z]+|[^A-Za-z]"
#: As possessive a run never gives letters back, so a counted group matches without
#: backtracking, in a loop, however many units it takes.
_UNIT = "(?:[A-Za-z]++|[^A-Za-z])"
_MARK_LENGTH = len(PREFIX)


def _draws(name: str, key: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of a row's key."""
    digest = F.sha2(F.concat(F.lit(f"{name}:"), key), 256)
    return [F.conv(F.substring(digest, 1 + 8 * at, 8), 16, 10).cast("long") for at in range(4)]


def _between(text: Column, start: Column, end: Column) -> Column:
    """The code points of a text from ``start`` to before ``end``, counted from 1."""
    return F.substring(text, start, end - start)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    first = _MARK_LENGTH + 1
    end = F.length(output) + 1
    psm_suffix, psm_middle = F.instr(output, SUFFIX), F.instr(output, MIDDLE)
    spm_prefix = F.instr(output, PREFIX)
    psm = F.concat(
        _between(output, F.lit(first), psm_suffix),
        _between(output, psm_middle + _MARK_LENGTH, end),
        _between(output, psm_suffix + _MARK_LENGTH, psm_middle),
    )
    spm = F.concat(
        _between(output, spm_prefix + _MARK_LENGTH, psm_middle),
        _between(output, psm_middle + _MARK_LENGTH, end),
        _between(output, F.lit(first), spm_prefix),
    )
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(documents: DataFrame, seed: str = "1") -> DataFrame:
    """``doc_id, text, n, form, output, prefix_chars, middle_chars`` of every document.

    ``n`` counts the units of the whole text. The bounds of the middle are drawn from
    the hash of ``seed`` and ``doc_id``; so is the form: ``plain`` leaves the text,
    ``psm`` gives prefix, suffix and middle behind their marks, ``spm`` gives suffix,
    prefix and middle. ``prefix_chars`` and ``middle_chars`` count code points and are
    null for ``plain``.

    A null text is an empty one; an empty text, or one that holds a mark already, stays
    plain. A null ``doc_id`` is hashed as if it were empty text, repeated rows give
    equal rows, other columns are ignored, an empty table gives no rows. Nothing is
    shuffled, and no row is looked at beside another.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2, h3, h4 = _draws(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    counted = documents.select(
        "doc_id",
        text.alias("text"),
        F.regexp_count(text, F.lit(UNITS)).cast("long").alias("n"),
        h1.alias("h1"),
        h2.alias("h2"),
        h3.alias("h3"),
        h4.alias("h4"),
    )
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX))
    marked = marked | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= CHANGED)
    cut = counted.select(
        "doc_id",
        "text",
        "n",
        F.when(plain, "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm").alias("form"),
        F.least(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)).alias("a"),
        F.greatest(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)).alias("b"),
    )
    pattern = F.format_string(rf"(?s)\A({_UNIT}{{%d}}+)({_UNIT}{{%d}}+)(.*+)\z", F.col("a"), F.col("b") - F.col("a"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(
        f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"
    )
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(
        F.regexp_replace("text", pattern, order)
    )
    made = cut.select("doc_id", "text", "n", "form", output.alias("output"))
    # No text of a changed form holds a mark, so the marks tell where each part begins.
    at_middle = F.instr("output", MIDDLE)
    prefix = (
        F.when(F.col("form") == "psm", F.instr("output", SUFFIX) - _MARK_LENGTH - 1)
        .when(F.col("form") == "spm", at_middle - F.instr("output", PREFIX) - _MARK_LENGTH)
    )
    middle = F.when(F.col("form") != "plain", F.length("output") - at_middle - _MARK_LENGTH + 1)
    return made.select(
        "*", prefix.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars")
    )
