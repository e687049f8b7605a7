"""Fill-in-middle texts by escaped marker injection, in DataFrame functions only.

A delimiter is escaped in the text and then put after every unit (code point).  Its
count is the number of units, and the parts before and after its k-th place are cut
out by ``substring_index``.  ``restore`` rebuilds the text from output and form alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks the parts in the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The delimiter, what escapes it, and what stands for each in an escaped text.
DELIMITER, ESCAPE = "\x1e", "\x1f"
ESCAPED_DELIMITER, ESCAPED_ESCAPE = ESCAPE + "d", ESCAPE + "e"
#: Of 100 texts so many stay plain, and of 100 others so many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def inject(text: Column) -> Column:
    """The escaped text with the delimiter after each of its code points."""
    escaped = _replace(_replace(text, ESCAPE, ESCAPED_ESCAPE), DELIMITER, ESCAPED_DELIMITER)
    return F.regexp_replace(escaped, f"(?s)({ESCAPE}[de]|.)", f"$1{DELIMITER}")


def recover(marked: Column) -> Column:
    """The text of :func:`inject`'s result or of a part of it."""
    return _replace(_replace(_replace(marked, DELIMITER, ""), ESCAPED_DELIMITER, DELIMITER), ESCAPED_ESCAPE, ESCAPE)


def first_units(marked: Column, n: Column) -> Column:
    """The first ``n`` units, without the last one's delimiter."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), n.cast("int"))


def last_units(marked: Column, n: Column) -> Column:
    """The last ``n`` units of a text that ends in a delimiter."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), (-n - 1).cast("int"))


def _draws(key: Column) -> list[Column]:
    """Four unsigned 32-bit numbers of a row's key."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n, form, prefix_chars, middle_chars, output`` of every row.

    ``n`` counts code points.  A row's digest gives two cuts from 0 to n and the form:
    ``plain`` (the text as it is: empty ones, those that contain a marker, and some
    others), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle).
    Null texts are empty, a null id is an empty one, texts of any length are cut whole,
    rows alike in id and text give the same, other columns aren't read, and an empty
    table gives no rows.
    """
    h1, h2, h3, h4 = _draws(F.col("doc_id"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = rows.withColumn("_marked", inject(F.col("text")))
    counted = marked.withColumn("n", (F.char_length("_marked") - F.char_length(_replace(F.col("_marked"), DELIMITER, ""))).cast("long"))
    plain = (F.col("n") == 0) | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE) | (h3 % 100 >= 100 - PLAIN)
    units = F.col("n") + 1
    cut = counted.select(
        "*", F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm").alias("form"),
        F.least(h1 % units, h2 % units).alias("_from"), F.greatest(h1 % units, h2 % units).alias("_to"),
    )
    head = first_units(F.col("_marked"), F.col("_to"))
    prefix = recover(first_units(F.col("_marked"), F.col("_from")))
    middle = recover(last_units(F.concat(head, F.lit(DELIMITER)), F.col("_to") - F.col("_from")))
    suffix = recover(last_units(F.col("_marked"), F.col("n") - F.col("_to")))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    known = F.col("form") != "plain"
    return cut.select(
        "doc_id", "text", "n", "form", F.when(known, F.col("_from")).alias("prefix_chars"), F.when(known, F.col("_to") - F.col("_from")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output of the form was made from.

    Parts hold no marker and no marker overlaps itself, so the first one found is the
    one that was written.  A null output gives null.
    """
    def after(text: Column, mark: str) -> Column:
        return F.substr(text, F.char_length(before(text, mark)) + len(mark) + 1)

    def before(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, 1)

    rest = F.substr(output, F.lit(len(PREFIX) + 1))
    psm = F.concat(before(rest, SUFFIX), after(after(rest, SUFFIX), MIDDLE), before(after(rest, SUFFIX), MIDDLE))
    spm = F.concat(before(after(rest, PREFIX), MIDDLE), after(after(rest, PREFIX), MIDDLE), before(rest, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(filled: DataFrame) -> DataFrame:
    """Counts, the output's digest and that of the text restored from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return filled.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256")
    )
