"""Views over stored books, analyses, corrections and learner records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def version_of(old: DataFrame, scope: list[str], tag: Column) -> DataFrame:
    """(scope, version): the last version if its tag is the same, else the next number."""
    last = old.groupBy(*scope).agg(F.max("version").alias("last"), F.max_by("tag", "version").alias("last_tag"))
    return last.select(*scope, F.when(F.col("last_tag") == tag, F.col("last")).otherwise(F.col("last") + 1).alias("version"))


def corrections(log: DataFrame) -> DataFrame:
    """The log (id, target_type, target_id, revokes) with active: a correction is so until one of its target follows or one revokes it."""
    later = Window.partitionBy("target_type", "target_id").orderBy("id").rowsBetween(1, Window.unboundedFollowing)
    made = log.where("revokes is null")
    revoked = log.where("revokes is not null").select(F.col("revokes").alias("id"), F.lit(True).alias("revoked")).distinct()
    marked = made.withColumn("followed", F.count("*").over(later) > 0).join(revoked, "id", "left")
    return marked.withColumn("active", ~F.col("followed") & ~F.coalesce("revoked", F.lit(False))).drop("followed", "revoked", "revokes")


def without_title_repeats(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Paragraphs (keys, i, kind, text, title, part) without the headings at the beginning that repeat the title or part, in any case and spacing."""
    same = lambda a, b: F.lower(T.collapse_space(a)) == F.lower(T.collapse_space(b))
    repeats = (F.col("kind") == "heading") & F.coalesce(same(F.col("text"), F.col("title")) | same(F.col("text"), F.coalesce("part", F.lit(""))), F.lit(False))
    before = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return paragraphs.withColumn("goes", F.min(repeats).over(before)).where(~F.col("goes")).drop("goes")


def core_lexemes(lexemes: DataFrame, senses: int = 6) -> DataFrame:
    """What a reader needs of a lexeme: no paradigm, the first few senses."""
    return lexemes.select("lexeme_id", "lemma", "pos", "gloss", F.slice("senses", 1, senses).alias("senses"))


def bundle(index: DataFrame, lexemes: DataFrame, work_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The form index of the keys of a work, and the lexemes it names, capped to their first senses."""
    forms = index.join(work_keys.select("key").distinct(), "key", "left_semi")
    return forms, core_lexemes(lexemes.join(forms.select("lexeme_id").distinct(), "lexeme_id", "left_semi"))


def parallels(chapters: DataFrame, parallel: DataFrame, existing: DataFrame, work: str) -> DataFrame:
    """Parallel chapters to add: by position in the work, of some confidence, and not there yet."""
    joined = chapters.join(parallel.where("confidence > 0"), [work, "idx"]).select(work, "idx", "chapter_id", "confidence", "body")
    return joined.join(existing.select("chapter_id").distinct(), "chapter_id", "left_anti")


def resolved_shares(tokens: DataFrame, group: str) -> DataFrame:
    """tokens, resolved and the share of guesses per group, of words outside notes; a guess has a key with `?` in front."""
    words = tokens.where("kind <> 'note'")
    out = words.groupBy(group).agg(F.count("*").alias("tokens"), F.count_if(~F.col("key").startswith("?")).alias("resolved"))
    return out.withColumn("guess_share", F.round(1 - F.col("resolved") / F.col("tokens"), 6))


def mastery(skills: DataFrame, known_from: float = 0.8) -> DataFrame:
    """percent and mastered per letter: the mean of its core skills, and whether all of them reach `known_from`."""
    core = F.array("reading", "hearing", "writing", "recall")
    mean = F.aggregate(core, F.lit(0.0), lambda s, x: s + x) / F.size(core)
    return skills.select("symbol", F.round(100 * mean).cast("int").alias("percent"), F.forall(core, lambda x: x >= known_from).alias("mastered"))


def exposures(calls: DataFrame, introduced: DataFrame, gain: float = 0.05) -> DataFrame:
    """symbol, context: introduced letters gain once per call in which they appear, whatever the number of times, up to 1."""
    letters = calls.select("call", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\p{L}"), F.lit(0)), F.upper))).alias("symbol"))
    met = letters.join(introduced.select("symbol").distinct(), "symbol", "left_semi").groupBy("symbol").agg(F.count_distinct("call").alias("n"))
    return met.select("symbol", F.round(F.least(F.lit(1.0), F.col("n") * gain), 6).alias("context"))


def introductions(log: DataFrame) -> DataFrame:
    """symbol, day: when a letter was introduced first; later introductions change nothing."""
    return log.groupBy("symbol").agg(F.min("day").alias("day"))


def manual_status(computed: DataFrame, manual: DataFrame) -> DataFrame:
    """Statuses with the last one set by hand in front of the computed one."""
    last = manual.groupBy("key").agg(F.max_by("status", "event_id").alias("by_hand"))
    return computed.join(last, "key", "full").select("key", F.coalesce("by_hand", "status").alias("status"))


def reading_progress(passed: DataFrame, sizes: DataFrame) -> DataFrame:
    """chapter, read, furthest, percent of the paragraphs scrolled past, each counted once."""
    seen = passed.groupBy("chapter").agg(F.count_distinct("paragraph").alias("read"), F.max("paragraph").alias("furthest"))
    return seen.join(sizes, "chapter").select("chapter", "read", "furthest", F.round(100 * F.col("read") / F.col("paragraphs")).cast("int").alias("percent"))


def orthographic_variants(pairs: DataFrame) -> DataFrame:
    """Whether two spellings differ but have one loose key and one length."""
    same = (T.loose_key(F.col("a")) == T.loose_key(F.col("b"))) & (F.length("a") == F.length("b")) & (F.col("a") != F.col("b"))
    return pairs.select("a", "b", same.alias("variant"))


#: The words for features.
FEATURE_WORDS = {
    "case=nom": "nominative", "case=gen": "genitive", "case=dat": "dative", "case=acc": "accusative", "case=inst": "instrumental", "case=prep": "prepositional", "gender=m": "masculine", "gender=f": "feminine", "gender=n": "neuter",
    "number=sg": "singular", "number=pl": "plural", "person=1": "1st person", "person=2": "2nd person", "person=3": "3rd person", "aspect=perfective": "perfective", "aspect=imperfective": "imperfective", "degree=comparative": "comparative",
    "degree=superlative": "superlative", "degree=short": "short", "verb_form=infinitive": "infinitive", "verb_form=past": "past", "reflexive=true": "reflexive", "voice=passive": "passive", "voice=active": "active",
}


def described(features: Column) -> Column:
    """Features in words, in their order; what has no word falls away."""
    words = F.create_map(*[F.lit(x) for kv in FEATURE_WORDS.items() for x in kv])
    return F.array_join(F.filter(F.transform(F.split(features, ";"), lambda f: F.try_element_at(words, f)), lambda w: w.isNotNull()), ", ")


def with_stress_mark(form: Column, stress: Column) -> Column:
    """The form with an acute behind the stressed letter; a form of one vowel, with ё or without a known stress stays."""
    marked = F.concat(F.left(form, stress + 1), F.lit("́"), F.substr(form, stress + 2))
    vowels = F.length(F.regexp_replace(F.lower(form), "[^аеёиоуыэюя]", ""))
    return F.when((stress >= 0) & (vowels > 1) & ~F.lower(form).contains("ё"), marked).otherwise(form)


def with_yo(printed: Column, known: Column) -> Column:
    """A printed form with ё where the known spelling has it and the printed one е; other spellings stay."""
    fits = (F.length(printed) == F.length(known)) & (F.translate(F.lower(known), "ё", "е") == F.translate(F.lower(printed), "ё", "е"))
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    put = F.zip_with(letters(printed), letters(known), lambda p, k: F.when((F.lower(k) == "ё") & (p == "е"), "ё").when((F.lower(k) == "ё") & (p == "Е"), "Ё").otherwise(p))
    return F.when(fits, F.array_join(put, "")).otherwise(printed)


def without_apparatus(paragraphs: DataFrame, keys: list[str], mark: str = r"^Стр\. \d+, строка") -> DataFrame:
    """Paragraphs (keys, i, kind, text) before the heading that opens the list of variants: the last one before the first line like `mark`."""
    whole = Window.partitionBy(*keys)
    first = F.min(F.when(F.col("text").rlike(mark), F.col("i"))).over(whole)
    seen = paragraphs.withColumn("hit", first)
    seen = seen.withColumn("cut", F.max(F.when((F.col("kind") == "heading") & (F.col("i") <= F.col("hit")), F.col("i"))).over(whole))
    return seen.where("hit is null or i < coalesce(cut, hit)").drop("hit", "cut")
