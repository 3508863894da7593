"""Chapters of plain English books: headings flagged per line, running sums, and the cut where a second work restarts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.corpus import restart_cut

#: Words that open a part's heading, headings of one word, endings of ordinals, Roman digits.
PART_WORDS, ALONE, ORDINALS, ROMAN = ["PART", "BOOK", "VOLUME"], ["EPILOGUE", "PROLOGUE"], ["st", "nd", "rd", "th"], "IVXLCDM"
#: What a distributor prints before and after a book, between stars.
BEFORE, AFTER = [[f"***{gap}{edge} OF {this} PROJECT GUTENBERG EBOOK" for gap in (" ", "") for this in ("THE", "THIS")] for edge in ("START", "END")]
STARS = "***"


def _capitals(c: Column) -> Column:
    """a-z as capitals; lengths stay."""
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _place(text: Column, marks: list[str]) -> Column:
    """Where the first of `marks` stands in a text (from 1), null if none does."""
    found = [F.instr(_capitals(text), F.lit(m)) for m in marks]
    return F.least(*[F.when(at > 0, at) for at in found])


def strip_licence(text: Column) -> Column:
    """The text between the header and the footer that a distributor puts around it."""

    def opened(start: Column) -> Column:
        behind = lambda rest: F.when(F.instr(rest, F.lit(STARS)) > 0, F.ltrim(F.substr(rest, F.instr(rest, F.lit(STARS))), F.lit("*")))
        return F.coalesce(T.let(F.substr(text, start + len(STARS)), behind), text)  # behind the stars that open the mark

    def closed(body: Column) -> Column:
        ends = lambda end: F.when(F.instr(F.substr(body, end + len(STARS)), F.lit(STARS)) > 0, F.left(body, end - 1)).otherwise(body)
        return T.let(_place(body, AFTER), ends)

    return T.let(T.let(_place(text, BEFORE), opened), closed)


def _without(word: Column, *ends: str) -> Column:
    """A word without the first of `ends` that it has."""
    cut = F.when(F.lit(False), word)
    for e in ends:
        cut = cut.when(word.endswith(e), F.left(word, F.length(word) - len(e)))
    return cut.otherwise(word)


def _roman(word: Column) -> Column:
    return (word != "") & (F.translate(_capitals(word), ROMAN, "") == "")


def heading_kind(line: Column) -> Column:
    """part, chapter, dated or titled for a line that is a heading of its own, else null.

    A part's heading opens with one of PART_WORDS and goes on, or is a word of ALONE. A chapter is a Roman numeral,
    CHAPTER in front or not; titled is a numeral, two dashes and a title; dated a capitalised word and a day of a month."""

    def kind(words: Column) -> Column:
        word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
        size, first = F.size(words), _capitals(word(0))
        number = F.when(first == "CHAPTER", word(1)).otherwise(word(0))
        named = lambda m: F.substring(m, 1, 1).between("A", "Z") & (F.length(m) > 1) & (F.translate(F.substr(m, F.lit(2)), "abcdefghijklmnopqrstuvwxyz", "") == "")
        numbered = lambda d: F.length(d).between(1, 2) & (F.translate(d, "0123456789", "") == "")
        dated = T.let(_without(word(0), "."), named) & T.let(T.let(T.let(word(1), lambda x: _without(x, ",")), lambda x: _without(x, ".")), lambda x: T.let(_without(x, *ORDINALS), numbered))
        return (
            F.when((size > 1) & first.isin(PART_WORDS) | _without(_capitals(line), ".").isin(ALONE), "part")
            .when((size == F.when(first == "CHAPTER", 2).otherwise(1)) & T.let(_without(number, "."), _roman), "chapter").when((size == 2) & dated, "dated")
            .when((size > 2) & _roman(word(0)) & (word(1) == "--"), "titled")
        )

    return T.let(F.split(line, r"\s+"), kind)


def english_chapters(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, idx, part, title, paragraph, text): chapters by headings alone on their lines.

    What comes before the first heading, and between a part's heading and its first chapter, is left out;
    chapters without text fall away. In a book without parts, a chapter number no higher than one seen before
    begins another work, and the rest is cut."""
    lines = docs.select(key, F.posexplode(F.split(strip_licence(F.col(text)), "\r?\n")).alias("no", "raw"))
    lines = lines.select(key, "no", F.trim("raw").alias("line"))
    n = F.length("line")
    what = F.coalesce(heading_kind(F.col("line")), F.lit(""))
    part = what == "part"
    head = (n <= 20) & what.isin("chapter", "dated") | (n <= 80) & (what == "titled")
    w = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    flagged = lines.select(key, "no", "line", part.alias("is_part"), head.alias("is_head"))
    placed = flagged.select(
        key, "no", "line", "is_part", "is_head", F.sum(F.col("is_head").cast("int")).over(w).alias("chapter"),
        F.last(F.when(F.col("is_part"), F.col("line")), ignorenulls=True).over(w).alias("part_now"), F.sum((F.col("line") == "").cast("int")).over(w).alias("gap"),
        F.last(F.when(F.col("is_part") | F.col("is_head"), F.col("is_head")), ignorenulls=True).over(w).alias("inside"),
    )
    heads = placed.where("is_head").select(key, "chapter", F.col("line").alias("title"), F.col("part_now").alias("part"))
    body = placed.where("line <> '' and not is_part and not is_head and inside").groupBy(key, "chapter", "gap").agg(
        F.array_sort(F.collect_list(F.struct("no", "line"))).alias("x")
    )
    body = body.select(key, "chapter", "gap", F.regexp_replace(F.array_join("x.line", " "), r"\s+", " ").alias("text"))
    full = heads.join(body.select(key, "chapter").distinct(), [key, "chapter"], "left_semi")
    numbered = full.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy("chapter")) - 1)
    parted = flagged.groupBy(key).agg(F.max("is_part").alias("parted"))
    first = restart_cut(numbered.join(parted, key).where("not parted").drop("parted"), key)
    kept = first.unionByName(numbered.join(parted, key).where("parted").drop("parted"))
    order = F.row_number().over(Window.partitionBy(key, "chapter").orderBy("gap")) - 1
    return kept.join(body, [key, "chapter"]).withColumn("paragraph", order).select(key, "idx", "part", "title", "paragraph", "text")
