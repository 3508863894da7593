"""Plain text to chapters and paragraphs: blank lines by lag and lead, chapters by running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed pattern: words that open a chapter heading.
CHAPTER_WORD = r"^(?:глава|часть|книга|том|письмо|раздел|отдел|chapter|part|book)(?:$|[\s:.–—-])"
NUMERAL = r"^(?:[0-9]+|[IVXLCivxlc]+)$"
NUMBERED = r"^(?:[0-9]{1,3}|[IVXLC]{1,6})\s*[.:–—-]?\s*(?:.{0,59}[^.?!])?$"


def is_heading(line: Column, prev_blank: Column, next_blank: Column) -> Column:
    """A short line that names a chapter, or a numeral alone between blank lines."""
    t = F.trim(line)
    numeral = t.rlike(NUMERAL) | (t.rlike(NUMBERED) & t.rlike(r"^(?:[0-9]|[IVXLC]{1,6}(?:$|[\s.:–—-]))"))
    return (t != "") & (F.length(t) <= 80) & (F.lower(t).rlike(CHAPTER_WORD) | (prev_blank & next_blank & numeral))


def plain_text(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, chapter, title, paragraph, text): lines between blank ones join with a space, runs of blanks in them collapse; headings open chapters.

    What precedes the first heading is chapter 0 without a title."""
    raw = F.regexp_replace(F.regexp_replace(F.col(text), "^\\x{FEFF}", ""), "\r\n?", "\n")
    lines = docs.select(key, F.posexplode(F.split(raw, "\n")).alias("no", "line"))
    w = Window.partitionBy(key).orderBy("no")
    blank = F.trim("line") == ""
    flagged = lines.select(key, "no", "line", blank.alias("blank"), F.coalesce(F.lag(blank).over(w), F.lit(True)).alias("before"), F.coalesce(F.lead(blank).over(w), F.lit(True)).alias("after"))
    flagged = flagged.withColumn("heading", is_heading(F.col("line"), F.col("before"), F.col("after")))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    flagged = flagged.withColumn("prev_heading", F.coalesce(F.lag("heading").over(w), F.lit(False)))
    numbered = flagged.select(
        key, "no", "line", "blank", "heading", F.sum(F.col("heading").cast("int")).over(upto).alias("chapter"),
        F.sum((F.col("blank") | F.col("heading") | F.col("prev_heading")).cast("int")).over(upto).alias("para"),
        F.last(F.when(F.col("heading"), F.trim("line")), ignorenulls=True).over(upto).alias("title"),
    )
    body = numbered.where("not blank and not heading").groupBy(key, "chapter", "title", "para")
    joined = body.agg(F.array_join(F.array_sort(F.collect_list(F.struct("no", F.regexp_replace(F.trim("line"), r"[ \t\f\r]+", " ").alias("t")))).getField("t"), " ").alias("text"))
    order = F.row_number().over(Window.partitionBy(key, "chapter").orderBy("para")) - 1
    return joined.select(key, "chapter", "title", order.alias("paragraph"), "text")
