"""Texts to tokens and sentences, inside their rows: offsets by running sums, sentence ends by a pattern over token classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def tokenize(df: DataFrame, keys: list[str], text: Column | str = "text") -> DataFrame:
    """One row per token: keys, pos (order among pieces), kind, surface, start, end, key.

    Offsets count code points, end exclusive: running sums over all pieces of a text, white space included, inside its row."""
    text = F.col(text) if isinstance(text, str) else text
    ends = lambda p: T.let(F.transform(p, lambda x: F.length(x).cast("long")), T.running_sums)
    placed = T.let(T.pieces(text), lambda p: F.zip_with(p, ends(p), lambda s, e: F.struct(s.alias("surface"), e.alias("end"))))
    exploded = df.select(*keys, F.posexplode(placed).alias("pos", "t")).select(*keys, "pos", T.kind(F.col("t.surface")).alias("kind"), "t.surface", "t.end")
    out = exploded.where("kind <> 'space'").withColumn("start", F.col("end") - F.length("surface"))
    word = F.col("kind").isin("word", "latin")
    return out.withColumn("key", F.when(word, T.loose_key(F.col("surface"))).otherwise(F.col("surface")))


def tokens(df: DataFrame, keys: list[str], text: Column | str = "text") -> DataFrame:
    """Tokens without offsets: a narrow projection, for counting. keys, pos, kind, surface."""
    text = F.col(text) if isinstance(text, str) else text
    exploded = df.select(*keys, F.posexplode(T.pieces(text)).alias("pos", "surface"))
    return exploded.select(*keys, "pos", T.kind(F.col("surface")).alias("kind"), "surface").where("kind <> 'space'")


def surface_counts(df: DataFrame, keys: list[str], text: Column | str = "text", **more: Column) -> DataFrame:
    """Counts n of distinct surfaces: keys, surface, kind, n and what `more` aggregates. For counting over a corpus.

    Pieces are grouped as they are, combined before the shuffle; kinds and keys are then found for the vocabulary and not for
    each token: a surface is taken from where it was counted, so that no later filter or key is moved below the counting."""
    text = F.col(text) if isinstance(text, str) else text
    exploded = df.select("*", F.explode(T.pieces(text)).alias("surface")).where("surface <> ' '")
    counted = exploded.groupBy(*keys, "surface").agg(F.count("*").alias("n"), *[c.alias(name) for name, c in more.items()])
    counted = counted.withColumn("surface", F.when(F.col("n") > 0, F.col("surface")))
    return counted.withColumn("kind", T.kind(F.col("surface"))).where("kind <> 'space'")


CLOSERS, OPENERS = "[»\"”’)]", "[«\"“„(—–]|-+"
#: The longest run of punctuation that a look ahead goes through; longer ones are marked run by run.
LOOK = 64


def _code(surface: Column) -> Column:
    """One letter per token: W a number or a word with a capital, w another word, t a run of . ! ? or …, c a closer, o an opener,
    b both, p other punctuation; '' for white space. The first character decides, as pieces of punctuation are runs of one."""
    first = lambda *ranges: T.begins(surface, *ranges)
    one = lambda chars: first(*chars)
    punct = F.when(one(".!?…"), "t").when(one('"'), "b").when(one("»”’)"), "c").when(one("-«“„(—–"), "o").otherwise("p")
    marked = F.when(surface.rlike(r"^\p{Lu}"), "W").otherwise("w")  # beyond the letters below
    return (
        F.when(first("az", "\u0430\u045f"), "w").when(one(" "), "").when(first("AZ", "09", "\u0400\u042f"), "W").when(surface < "\x80", F.when(first("\t\r"), "").otherwise(punct))
        .when(first("\u00c0\u024f", "\u0400\u052f", "\u0300\u0301"), marked).when(T.is_space(surface), "").otherwise(punct)
    )


def _marked(codes: Column) -> Column:
    """`codes` with a bar after each end, run by run: linear also in runs of punctuation of any length."""
    runs = F.regexp_extract_all(codes, F.lit("[cbotp]+|[Ww]+"), F.lit(0))
    marked = T.let(runs, lambda rs: F.array_join(F.transform(rs, lambda r, i: F.when(~F.lower(r).startswith("w") & F.coalesce(F.get(rs, i + 1).startswith("W"), F.lit(True)), F.upper(r)).otherwise(r)), ""))
    return F.lower(F.regexp_replace(marked, "(T[CB]*+)(?=.)|(t[cb]*+)(?=o)", "$1$2|"))


def sentence_rows(df: DataFrame, keys: list[str], text: Column | str = "text") -> DataFrame:
    """One row per sentence: keys, sentence (from 0), toks (pos, surface, code).

    A run of . ! ? or … ends a sentence at the closers after it, if what follows starts a new one: an opener or a
    dash, a number, or a word with a capital; or if no word follows at all. A text is cut inside its row: its tokens
    become one letter each, and sentences are split by a pattern over these letters. No exchange and no sort, however long a text is."""
    text = F.col(text) if isinstance(text, str) else text
    coded = F.filter(F.transform(T.pieces(text), lambda s, i: F.struct(i.alias("pos"), s.alias("surface"), _code(s).alias("code"))), lambda t: t["code"] != "")

    def cut(toks: Column) -> Column:
        joined = F.array_join(F.transform(toks, lambda t: t["code"]), "")
        ahead = f"(t[cb]*+)(?=o|[cbotp]{{0,{LOOK}}}+W|[cbotp]{{1,{LOOK}}}+$)"
        ended = T.let(joined, lambda c: F.when(c.rlike(f"[cbotp]{{{LOOK}}}"), _marked(c)).otherwise(F.regexp_replace(c, ahead, "$1|")))
        sized = lambda cs: F.transform(cs, lambda c: F.length(c).cast("long"))
        piece = lambda n, e: F.slice(toks, (e - n + 1).cast("int"), n.cast("int"))
        return T.let(sized(F.split(ended, r"\|")), lambda ns: F.zip_with(ns, T.running_sums(ns), piece))

    # tokens are found once: a text named twice in a plan is cut twice
    split = df.select(*keys, F.posexplode(T.let(coded, lambda toks: F.when(F.size(toks) > 0, cut(toks)))).alias("sentence", "toks"))
    return split.select(*keys, F.col("sentence").cast("long").alias("sentence"), "toks")


def sentences(df: DataFrame, keys: list[str], text: Column | str = "text") -> DataFrame:
    """One row per token of `sentence_rows`: keys, pos, kind, surface, sentence and index within it."""
    out = sentence_rows(df, keys, text).select(*keys, "sentence", F.posexplode("toks").alias("index", "t"))
    kind = F.when(F.col("t.code").isin("w", "W"), T.kind(F.col("t.surface"))).otherwise("punct")
    return out.select(*keys, "t.pos", kind.alias("kind"), "t.surface", "sentence", "index")
