"""Lexemes from word tables by part of speech, and declensions from stems and tables of endings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexicon import paradigm_cells

CASES = ["nom", "gen", "dat", "acc", "inst", "prep"]
#: Endings by declension, gender or plural, in the order of CASES; = is the nominative, or the genitive of an animate noun.
ENDINGS = {
    "hard": {"m": "ый ого ому = ым ом", "f": "ая ой ой ую ой ой", "n": "ое ого ому ое ым ом", "pl": "ые ых ым = ыми ых"},
    "stressed": {"m": "ой ого ому = ым ом", "f": "ая ой ой ую ой ой", "n": "ое ого ому ое ым ом", "pl": "ые ых ым = ыми ых"},
    "velar": {"m": "ий ого ому = им ом", "f": "ая ой ой ую ой ой", "n": "ое ого ому ое им ом", "pl": "ие их им = ими их"},
    "мой": {"m": "й его ему = им ём", "f": "я ей ей ю ей ей", "n": "ё его ему ё им ём", "pl": "и их им = ими их"},
    "наш": {"m": "- его ему = им ем", "f": "а ей ей у ей ей", "n": "е его ему е им ем", "pl": "и их им = ими их"},
    "мамин": {"m": "- ого ому = ым ом", "f": "а ой ой у ой ой", "n": "о ого ому о ым ом", "pl": "ы ых ым = ыми ых"},
}
ENDING_SCHEMA = "declension string, gender string, case_ string, ending string, of_animate string"


def ending_rows() -> list[tuple]:
    out = []
    for declension, columns in ENDINGS.items():
        for gender, row in columns.items():
            ends = ["" if e == "-" else e for e in row.split(" ")]
            for case, end in zip(CASES, ends, strict=True):
                out.append((declension, gender, case, ends[0] if end == "=" else end, ends[1] if end == "=" else end))
    return out


def declined(stems: DataFrame) -> DataFrame:
    """(stem, declension, animate) to (stem, gender, case_, form): a join with the constant table of endings."""
    table = stems.sparkSession.createDataFrame(ending_rows(), ENDING_SCHEMA)
    joined = stems.join(F.broadcast(table), "declension")  # 144 rows
    return joined.select("stem", "gender", "case_", F.concat("stem", F.when(F.col("animate"), F.col("of_animate")).otherwise(F.col("ending"))).alias("form"))


def _senses(text: str):
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), F.trim), lambda s: s != "")


def _lexemes(rows: DataFrame, pos) -> DataFrame:
    senses = _senses("translations")
    return rows.withColumn("pos", pos).select(
        F.concat("pos", F.lit(":"), "bare").alias("lexeme_id"), F.col("bare").alias("lemma"), F.coalesce("accented", "bare").alias("acc"), "pos",
        F.coalesce(F.get(senses, F.lit(0)), F.col("bare")).alias("gloss"), senses.alias("senses"), *[c for c in rows.columns if c not in ("bare", "accented", "translations")],
    )


#: Cells of a verb besides its infinitive, and of an adjective.
VERB_SLOTS = ["imperative_sg", "imperative_pl", "past_m", "past_f", "past_n", "past_pl", "presfut_sg1", "presfut_sg2", "presfut_sg3", "presfut_pl1", "presfut_pl2", "presfut_pl3"]
ADJECTIVE_SLOTS = [f"decl_{g}_{c}" for g in ("m", "f", "n", "pl") for c in CASES] + [f"short_{g}" for g in ("m", "f", "n", "pl")] + ["comparative", "superlative"]


def verbs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lexemes and (lexeme_id, slot, cell) of verbs; an unknown aspect is none, -ся and -сь are reflexive."""
    aspect = F.when(F.col("aspect").isin("imperfective", "perfective", "biaspectual"), F.col("aspect"))
    lexemes = _lexemes(rows, F.lit("verb")).withColumns({"aspect": aspect, "reflexive": F.col("lemma").rlike("с[яь]$"), "infinitive": F.col("acc")})
    slots = ["infinitive", *[s for s in VERB_SLOTS if s in rows.columns]]
    return lexemes.drop(*slots), paradigm_cells(lexemes, ["lexeme_id"], slots)


def adjectives(rows: DataFrame, pronouns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lexemes and cells of adjectives; lemmas that `pronouns` (lemma) lists are pronouns, determinative ones."""
    listed = rows.join(F.broadcast(pronouns.select(F.col("lemma").alias("bare"), F.lit(True).alias("listed"))), "bare", "left")  # a closed class
    lexemes = _lexemes(listed, F.when(F.col("listed"), "pronoun").otherwise("adjective")).withColumn("pronoun_type", F.when(F.col("listed"), "determinative")).drop("listed")
    slots = [s for s in ADJECTIVE_SLOTS if s in rows.columns]
    return lexemes.drop(*slots), paradigm_cells(lexemes, ["lexeme_id"], slots)


def others(rows: DataFrame, closed: DataFrame, skipped: DataFrame) -> DataFrame:
    """Lexemes of words without a part of speech: that of the first closed class that lists them, else adverb by ending or particle, guessed.

    `closed` has form, pos, ord; `skipped` lists forms that are no lexemes of their own."""
    first = closed.groupBy(F.col("form").alias("bare")).agg(F.min_by("pos", "ord").alias("known"))
    kept = rows.join(skipped.select(F.col("form").alias("bare")), "bare", "left_anti").join(first, "bare", "left")
    guess = F.when(F.col("bare").rlike("[оеи]$"), "adverb").otherwise("particle")
    return _lexemes(kept.withColumn("guessed", F.col("known").isNull()), F.coalesce("known", guess)).drop("known")
