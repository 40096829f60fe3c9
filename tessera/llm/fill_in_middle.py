"""Fill-in-the-middle texts by escaped marker injection, in built-in functions alone.

A text is cut into units (a run of ASCII letters, or one other character).  A delimiter
that the text does not hold, as its own occurrences are escaped, is appended after each
unit; then the number of units is the number of delimiters, and the first, last and
middle units are what substring_index gives for their ranks.  Every step is one pass
over one text within a projection: no shuffle, no Python, memory for one text at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the delimiter, the escape character, and the marks of the three parts
DELIMITER, ESCAPE = "\x1e", "\x1f"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = "<[PSM]>"


def marked(text: Column) -> Column:
    """``text`` escaped, with the delimiter after each unit."""
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))
    return F.regexp_replace(escaped, f"[A-Za-z]+|{ESCAPE}[01]|[^A-Za-z]", f"$0{DELIMITER}")


def unmarked(part: Column) -> Column:
    """The text of a part of ``marked``."""
    bare = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def ranked(units: Column, start: Column, end: Column) -> Column:
    """Units ``start`` to ``end`` (not included) of a marked text, still marked."""
    head = F.call_function("substring_index", units, F.lit(DELIMITER), end.cast("int"))
    return F.call_function("substring_index", head, F.lit(DELIMITER), (start - end).cast("int"))


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of ``<seed>:<key>``; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``(<id_col>, n, form, output, prefix_chars, middle_chars)`` for each row of ``docs``.

    Two cuts are drawn from the id among the n + 1 places between units; they part the text
    in prefix, middle and suffix.  ``form`` is ``psm`` (prefix, suffix, middle), ``spm``
    (suffix, prefix, middle; ``spm_percent`` of those that are changed) or ``plain``: the text
    as it is, for ``plain_percent`` of the rows, for empty texts and for those that hold a mark
    themselves, so that a mark in an output other than a plain one is always ours.
    ``prefix_chars`` and ``middle_chars`` count code points and are null for plain rows.
    A null text is empty; a null id draws as an empty one; rows with the same id and text get
    the same output, each its own row; other columns are not read; no rows give none."""
    h = draws(F.col(id_col), seed)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[x.alias(f"h{i}") for i, x in enumerate(h, 1)])
    rows = rows.withColumn("units", marked(F.col("text")))
    n = F.length("units") - F.length(F.replace("units", F.lit(DELIMITER), F.lit("")))
    rows = rows.withColumn("n", n.cast("long"))
    plain = (F.col("n") == 0) | F.col("text").rlike(MARKS) | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    cuts = [F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)]
    rows = rows.select("id", "text", "units", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    split = F.col("form") != "plain"
    part = lambda start, end: F.when(split, unmarked(ranked(F.col("units"), start, end)))
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    rows = rows.select("id", "text", "n", "form", part(F.lit(0), a).alias("p"), part(a, b).alias("m"), part(b, n).alias("s"))
    psm = F.concat(F.lit(PREFIX), "p", F.lit(SUFFIX), "s", F.lit(MIDDLE), "m")
    spm = F.concat(F.lit(SUFFIX), "s", F.lit(PREFIX), "p", F.lit(MIDDLE), "m")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select(F.col("id").alias(id_col), "n", "form", output.alias("output"), F.length("p").cast("long").alias("prefix_chars"), F.length("m").cast("long").alias("middle_chars"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of, from it and its form alone."""
    at = lambda i: F.get(F.split(output, MARKS, -1), F.lit(i))
    psm, spm = F.concat(at(1), at(3), at(2)), F.concat(at(2), at(3), at(1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
