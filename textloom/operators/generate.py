"""Readings of unknown words by rules: generate base forms from rule tables, join the form index, pick by priority.

A rule strips a suffix from a word, or from what is left of it without an adjective or noun ending, and puts endings on
the stem to reach base forms. The tables are small constants; the lexicon is only met in joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lexicon import ADJECTIVE_ENDINGS
from .stored import kept

#: Order in which the generators are asked; the first that has a reading wins.
GENERATORS = [
    "archaic-instrumental", "archaic-infinitive", "manner-adverb", "short-passive", "past", "superlative", "comparative", "adjective", "participle",
    "gerund-past", "gerund-present", "prefixed-verb", "possessive", "diminutive", "adverb", "ending",
]
RULE_SCHEMA = (
    "generator string, gen_order int, rule_order int, alt int, part string, suffix string, least_stem int, stem_like string, puts array<string>, "
    "code string, pos string, reading string, guess_put string, features string, confidence double, guess_confidence double"
)


def feats(**f: str | None) -> str:
    """Features in one canonical string."""
    return ";".join(f"{k}={v}" for k, v in sorted(f.items()) if v)


def _rule(generator: str, order: int, part: str, suffix: str, puts: list[str], pos: str, *, alt: int = 0, least: int = 1, like: str = "", code: str = "",
          reading: str | None = None, guess: str | None = None, features: str = "", sure: float = 0.85, unsure: float | None = None) -> tuple:
    return (generator, GENERATORS.index(generator), order, alt, part, suffix, least, like, puts, code, pos, reading or pos, guess if guess is not None else (puts or [""])[0], features, sure, unsure)


def rules() -> list[tuple]:
    """All suffix rules, derived from the fixed values below."""
    out = []
    add = lambda *a, **k: out.append(_rule(*a, **k))
    for i, (old, new) in enumerate((("ою", "ой"), ("ею", "ей"))):
        for pos in ("noun", "adjective", "pronoun", "numeral"):
            add("archaic-instrumental", i, "word", old, [new], pos, least=2, code="inst", features=feats(case="inst", gender="f", number="sg"), sure=0.95)
    add("archaic-infinitive", 0, "word", "ти", ["ть"], "verb", least=2, code="inf", features=feats(verb_form="infinitive"), sure=0.9)
    # fixed values: short passive participles in the neuter
    for i, (suffix, puts) in enumerate((("ано", ["ать"]), ("яно", ["ять"]), ("ено", ["ить", "еть"]), ("ёно", ["ить", "еть"]), ("то", ["ть"]))):
        add("short-passive", i, "word", suffix, puts, "verb", least=2, features=feats(verb_form="participle-short", voice="passive", gender="n", degree="short"))
    for end, gender, number in (("л", "m", "sg"), ("ла", "f", "sg"), ("ло", "n", "sg"), ("ли", None, "pl")):
        for postfix in ("", "ся", "сь"):
            f = feats(verb_form="past", gender=gender, number=number, reflexive="true" if postfix else None)
            add("past", 0, "word", end + postfix, ["ться" if postfix else "ть"], "verb", least=1, like="[аяоуыи]$", features=f, unsure=0.45)
    for i, suffix in enumerate(("ейш", "айш")):
        add("superlative", i, "adjective", suffix, ["ый", "ий"], "adjective", features=feats(degree="superlative"), unsure=0.5)
    for i, suffix in enumerate(("ее", "ей")):
        add("comparative", i, "word", suffix, ["ый", "ий", "ой"], "adjective", least=3, features=feats(degree="comparative"), unsure=0.5)
    add("adjective", 0, "adjective", "", ["ий", "ый", "ой"], "adjective", sure=0.9)
    # fixed values: participle suffixes in the order they are tried, their form, voice and tense, and the infinitives they come from
    participles = [
        ("ющ", "participle-act-pres", "active", "present", ["ть"]), ("ущ", "participle-act-pres", "active", "present", ["ть"]),
        ("ящ", "participle-act-pres", "active", "present", ["ить", "ать", "еть"]), ("ащ", "participle-act-pres", "active", "present", ["ить", "ать", "еть"]),
        ("вш", "participle-act-past", "active", "past", ["ть"]), ("ш", "participle-act-past", "active", "past", ["ти", "чь"]),
        ("енн", "participle-pass-past", "passive", "past", ["ить", "ать", "еть", "ть"]), ("нн", "participle-pass-past", "passive", "past", ["ить", "ать", "еть", "ть"]),
        ("т", "participle-pass-past", "passive", "past", ["ть"]), ("ем", "participle-pass-pres", "passive", "present", ["ть"]),
        ("ом", "participle-pass-pres", "passive", "present", ["ть"]), ("им", "participle-pass-pres", "passive", "present", ["ить"]),
    ]
    for i, (suffix, form, voice, tense, puts) in enumerate(participles):
        f = {"verb_form": form, "voice": voice, "tense": tense}
        add("participle", i, "adjective", suffix, puts, "verb", features=feats(**f), unsure=0.5)
        add("participle", i, "reflexive", suffix, [p + "ся" if p.endswith("ть") else p for p in puts], "verb", features=feats(**f, reflexive="true"), unsure=0.5)
    for i, (suffix, put) in enumerate((("вшись", "ться"), ("вши", "ть"), ("в", "ть"))):
        f = feats(verb_form="gerund-past", tense="past", reflexive="true" if put == "ться" else None)
        add("gerund-past", i, "word", suffix, [put], "verb", least=2, features=f, unsure=0.5)
    vowels = ["", "а", "я", "е", "и"]
    for i, suffix in enumerate(("ясь", "ась", "я", "а")):
        end, third = ("ться", ["ются", "утся", "ятся", "атся"]) if i < 2 else ("ть", ["ют", "ут", "ят", "ат"])
        f = feats(verb_form="gerund-pres", tense="present", reflexive="true" if i < 2 else None)
        add("gerund-present", i, "word", suffix, [v + end for v in vowels] + third, "verb", least=2, features=f, sure=0.8)
    # fixed values: endings of possessive adjectives in the order they are tried, with gender, number and case of each reading
    endings = [
        ("ого", ["m sg gen"]), ("ому", ["m sg dat"]), ("ыми", ["- pl inst"]), ("ых", ["- pl gen", "- pl prep"]), ("ым", ["m sg inst", "- pl dat"]), ("ом", ["m sg prep"]),
        ("ой", ["f sg gen", "f sg dat", "f sg inst", "f sg prep"]), ("у", ["f sg acc"]), ("ы", ["- pl nom"]), ("а", ["f sg nom"]), ("о", ["n sg nom"]), ("", ["m sg nom"]),
    ]
    for i, (end, cells) in enumerate(endings):
        for j, suffix in enumerate(("ин", "ов", "ев")):
            for alt, cell in enumerate(cells):
                gender, number, case = cell.replace("-", "").split(" ")
                add("possessive", 3 * i + j, "word", suffix + end, ["а", "я"] if suffix == "ин" else [""], "noun", reading="adjective", guess=suffix, alt=alt,
                    features=feats(gender=gender, number=number, case=case), sure=0.8, unsure=0.5)
    # fixed values: diminutive suffixes in the order they are tried
    small = [
        ("очк", ["ка", "а"], "noun", "f"), ("ечк", ["ка", "а"], "noun", "f"), ("еньк", ["ый", "ий"], "adjective", None), ("ушк", ["а", ""], "noun", None),
        ("чик", [""], "noun", "m"), ("ик", [""], "noun", "m"),
    ]
    for i, (suffix, puts, pos, gender) in enumerate(small):
        for k, part in enumerate(("adjective", "stripped", "noun")):
            add("diminutive", 10 * (k == 2) + i, part, suffix, puts, pos, features=feats(gender=gender), sure=0.75, unsure=0.5)
    for i, suffix in enumerate("ое"):
        add("adverb", i, "word", suffix, ["ый", "ий", "ой"], "adjective", reading="adverb", least=2, unsure=0.4)
    # what an ending alone tells
    abstract = [("остью", 0, "inst"), ("ости", 0, "gen"), ("ости", 1, "dat"), ("ости", 2, "prep"), ("ость", 0, "nom")]
    for suffix, alt, case in abstract:
        add("ending", 0, "word", suffix, [], "noun", guess="ость", alt=alt, least=1, features=feats(gender="f", number="sg", case=case), unsure=0.55)
    for suffix in ("ть", "сти", "зти", "йти"):
        add("ending", 1, "word", suffix, [], "verb", guess=suffix, least=0, features=feats(verb_form="infinitive"), unsure=0.5)
    add("ending", 2, "adjective", "", [], "adjective", guess="ый", unsure=0.5)
    for suffix in "ое":
        add("ending", 3, "word", suffix, [], "adverb", guess="ый", least=0, unsure=0.4)
        add("ending", 3, "word", suffix, [], "noun", guess=suffix, alt=1, least=0, features=feats(gender="n", number="sg"), unsure=0.35)
    for suffix in "ая":
        add("ending", 4, "word", suffix, [], "noun", guess=suffix, least=0, features=feats(gender="f", number="sg"), unsure=0.4)
    add("ending", 5, "word", "", [], "noun", features=feats(gender="m", number="sg"), unsure=0.4)
    return out


#: Verb prefixes, the longest first.
VERB_PREFIXES = ["через", "пере", "пред", "воз", "раз", "под", "над", "при", "про", "вз", "из", "по", "вы", "за", "на", "от", "до", "об", "у", "с", "в", "о"]
#: Dative forms that make an adverb of manner with по-.
MANNER = ["своему", "нашему", "вашему", "моему", "твоему", "ихнему", "прежнему"]
#: Particles that follow a hyphen.
CLITICS = ["то", "таки", "ка", "с", "де", "тка"]
NOUN_END = "(?:ой|ей|ом|ем|[аяыиеую])$"


def word_parts(words: DataFrame) -> DataFrame:
    """(surface, w, part, body, given): the word, and what is left of it without an ending, with the features that ending gives."""
    w = F.col("w")
    table = {e: feats(gender=g, number=n, case=c) for e, g, n, c in ADJECTIVE_ENDINGS}
    end = lambda c: F.coalesce(*[F.when(c.endswith(e) & (F.length(c) > len(e) + 1), F.lit(e)) for e in table])
    given = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    core = F.when(w.endswith("ся") & (F.length(w) > 4), F.left(w, F.length(w) - 2))
    cut = words.select("surface", F.lower("surface").alias("w")).distinct().withColumn("e", end(w)).withColumn("core", core).withColumn("ce", end(F.col("core")))
    part = lambda name, body, f: F.struct(F.lit(name).alias("part"), body.alias("body"), f.alias("given"))
    none = F.lit("")
    parts = [
        part("word", w, none), part("adjective", F.when(F.col("e").isNotNull(), F.left(w, F.length(w) - F.length("e"))), F.element_at(given, F.col("e"))),
        part("reflexive", F.when(F.col("ce").isNotNull(), F.left("core", F.length("core") - F.length("ce"))), F.element_at(given, F.col("ce"))),
        part("stripped", F.when(F.col("e").isNull(), F.when(F.length(w) > 2, F.regexp_replace(w, "[ауыоеийя]$", "")).otherwise(w)), none),
        part("noun", F.when(w.rlike(f".{NOUN_END}"), F.regexp_replace(w, NOUN_END, "")), none),
    ]
    return cut.select("surface", "w", F.explode(F.array(*parts)).alias("p")).select("surface", "w", "p.*").where("body is not null")


def merged(a: Column, b: Column) -> Column:
    """Two feature strings as one in canonical order; what `b` says of a feature wins."""
    fa, fb = (F.filter(F.split(c, ";"), lambda x: x != "") for c in (a, b))
    name = lambda x: F.substring_index(x, "=", 1)
    return F.array_join(F.array_sort(F.concat(F.filter(fa, lambda x: ~F.exists(fb, lambda y: name(x) == name(y))), fb)), ";")


def rule_readings(words: DataFrame, index: DataFrame, lexemes: DataFrame) -> DataFrame:
    """(surface, generator, key, lemma, pos, features, source, confidence, alt) for each distinct surface of `words`.

    `index` has key, lexeme_id and code, `lexemes` has lexeme_id, lemma, pos and aspect. A reading whose base form the index
    knows is a rule's, else a guess whose key begins with `?`. The first generator with a reading wins, then its first rule;
    several readings of one rule all stay. Every word gets one, from its ending at the last."""
    spark = words.sparkSession
    table = F.broadcast(spark.createDataFrame(rules(), RULE_SCHEMA))  # a constant of under 200 rows
    # what several steps read is kept: else each of them holds the plan of all before it, down to the texts, and the plan doubles step by step
    known = kept(index.select("key", "lexeme_id", "code").join(lexemes.select("lexeme_id", "lemma", "pos", "aspect"), "lexeme_id"))
    parts = kept(word_parts(words))
    ends = F.transform(F.sequence(F.lit(0), F.least(F.length("body"), F.lit(7))), lambda i: F.struct(F.right("body", i).alias("suffix"), F.left("body", F.length("body") - i).alias("stem")))
    made = parts.select("surface", "w", "part", "given", F.explode(ends).alias("x")).select("surface", "w", "part", "given", "x.suffix", "x.stem").join(table, ["part", "suffix"])
    fits = (F.length("stem") >= F.col("least_stem")) & ((F.col("stem_like") == "") | F.regexp_like("stem", "stem_like"))
    made = kept(made.where(fits))
    bases = made.where("size(puts) > 0").select("surface", "gen_order", "rule_order", F.col("pos").alias("want"), F.col("code").alias("want_code"), "stem", F.posexplode("puts").alias("put_order", "put"))
    bases = bases.withColumn("base", F.concat("stem", "put"))
    right = F.when(F.col("want_code") == "inst", F.col("code").rlike("^n:sg:inst$|:f:sg:inst$")).when(F.col("want_code") == "inf", F.col("code") == "v:inf").otherwise(True)
    hits = bases.join(known, (F.col("base") == F.col("key")) & (F.col("pos") == F.col("want"))).where(right)
    first = hits.groupBy("surface", "gen_order", "rule_order", F.col("want").alias("pos"), "stem").agg(F.min(F.struct("put_order", "lexeme_id", "lemma", "aspect")).alias("hit"))
    both = made.join(first, ["surface", "gen_order", "rule_order", "pos", "stem"], "left").where("hit is not null or guess_confidence is not null")
    capital = F.col("surface").rlike(r"^\p{Lu}")
    lemma = F.coalesce("hit.lemma", F.concat("stem", "guess_put"))
    sure = F.when((F.col("generator") == "possessive") & capital, F.least("confidence", F.lit(0.55))).otherwise(F.col("confidence"))
    aspect = F.when(F.col("hit.aspect").isNotNull(), F.concat(F.lit("aspect="), "hit.aspect")).otherwise("")
    nu = F.when((F.col("generator") == "past") & F.col("stem").endswith("ну"), "aspect=perfective").otherwise("")
    from_table = both.select(
        "surface", "generator", "gen_order", "rule_order", "alt", F.coalesce("hit.lexeme_id", F.concat(F.lit("?"), "reading", F.lit(":"), lemma)).alias("key"), lemma.alias("lemma"),
        F.col("reading").alias("pos"), merged(merged(F.col("given"), F.col("features")), merged(nu, aspect)).alias("features"),
        F.when(F.col("hit").isNotNull(), "rule").otherwise("statistical").alias("source"), F.when(F.col("hit").isNotNull(), sure).otherwise(F.col("guess_confidence")).alias("confidence"),
    )
    found = kept(from_table.unionByName(_prefixed(parts, known)).unionByName(_manner(parts)))
    best = found.groupBy("surface").agg(F.min(F.struct("gen_order", "rule_order")).alias("best"))
    return found.join(best, "surface").where(F.struct("gen_order", "rule_order") == F.col("best")).drop("best", "gen_order", "rule_order").distinct()


def _prefixed(parts: DataFrame, known: DataFrame) -> DataFrame:
    """Verbs with a prefix whose rest is a form of a known verb; the longest prefix first."""
    order = {p: i for i, p in enumerate(VERB_PREFIXES)}
    heads = F.filter(F.array(*[F.when(F.col("w").startswith(p) & (F.length("w") >= len(p) + 3), F.struct(F.lit(i).alias("rule_order"), F.lit(p).alias("prefix"))) for p, i in order.items()]), lambda x: x.isNotNull())
    cut = parts.where("part = 'word'").select("surface", "w", F.explode(heads).alias("h")).select("surface", "h.*", F.substring("w", F.length("h.prefix") + 1, F.lit(99)).alias("rest"))
    hits = cut.join(known.where("pos = 'verb'"), F.col("rest") == F.col("key")).groupBy("surface", "rule_order", "prefix").agg(F.min_by("lemma", "lexeme_id").alias("base"))
    lemma = F.concat("prefix", "base")
    return hits.select(
        "surface", F.lit("prefixed-verb").alias("generator"), F.lit(GENERATORS.index("prefixed-verb")).alias("gen_order"), "rule_order", F.lit(0).alias("alt"),
        F.concat(F.lit("?verb:"), lemma).alias("key"), lemma.alias("lemma"), F.lit("verb").alias("pos"), F.lit("aspect=perfective").alias("features"), F.lit("rule").alias("source"), F.lit(0.6).alias("confidence"),
    )


def _manner(parts: DataFrame) -> DataFrame:
    """Adverbs of manner: по- with -ски or a dative."""
    rest = F.substring("w", F.lit(4), F.lit(99))
    is_manner = F.col("w").startswith("по-") & ((F.length("w") > 6) & F.col("w").endswith("ски") | rest.isin(MANNER))
    return parts.where(F.col("part") == "word").where(is_manner).select(
        "surface", F.lit("manner-adverb").alias("generator"), F.lit(GENERATORS.index("manner-adverb")).alias("gen_order"), F.lit(0).alias("rule_order"), F.lit(0).alias("alt"),
        F.concat(F.lit("adverb:"), "w").alias("key"), F.col("w").alias("lemma"), F.lit("adverb").alias("pos"), F.lit("").alias("features"), F.lit("rule").alias("source"), F.lit(0.95).alias("confidence"),
    )


def analyse(words: DataFrame, index: DataFrame, lexemes: DataFrame, closed: DataFrame, names: DataFrame) -> DataFrame:
    """Ranked readings of each distinct surface: (surface, rank, key, lemma, pos, features, source, confidence, clitic).

    Closed classes first, then the dictionary, rules only where neither knows the word; a name of a known character is one
    reading more. A particle after the last hyphen is cut off where the whole word is unknown. Ranked by confidence, ties by
    source, frequency and key. Only the vocabulary meets the lexicon.

    `closed` has form, key, lemma, pos, features; `names` form, canonical; the other two as in `rule_readings`, with features
    in `index` and the frequency rank in `lexemes`."""
    index, lexemes = kept(index), kept(lexemes)  # read by several steps, as are the kept ones below: the plan of each would hold those before it
    s = kept(words.select("surface").distinct().withColumn("w", T.loose_key(F.col("surface"))))
    listed = lambda df, key: closed_or_known(df, key, index, lexemes, closed)
    direct = kept(listed(s, "w"))
    rest = s.join(direct.select("surface").distinct(), "surface", "left_anti")
    tail = F.substring_index("surface", "-", -1)
    dashed = rest.withColumn("clitic", F.when(F.col("surface").contains("-") & F.lower(tail).isin(CLITICS) & (F.length("surface") > F.length(tail) + 1), tail))
    bare = dashed.withColumn("bare", F.when(F.col("clitic").isNotNull(), F.left("surface", F.length("surface") - F.length("clitic") - 1)).otherwise(F.col("surface")))
    manner = F.lower("surface").startswith("по-")
    bare = kept(bare.withColumn("bare", F.when(manner, F.col("surface")).otherwise(F.col("bare"))).withColumn("clitic", F.when(~manner, F.col("clitic"))))
    cut = kept(listed(bare.where("clitic is not null").select(F.col("bare").alias("surface"), T.loose_key(F.col("bare")).alias("w")).distinct(), "w"))
    unknown = bare.join(cut.select(F.col("surface").alias("bare")).distinct(), "bare", "left_anti").select(F.col("bare").alias("surface"))
    made = rule_readings(unknown, index, lexemes).select("surface", "key", "lemma", "pos", "features", "source", "confidence", (F.col("alt") + 100).alias("source_order"), F.lit(None).cast("int").alias("rank"))
    of_bare = cut.unionByName(made).withColumnRenamed("surface", "bare").join(bare.select("bare", "surface", "clitic"), "bare").drop("bare")
    called = s.join(names.groupBy(F.lower("form").alias("form")).agg(F.min("canonical").alias("canonical")), F.lower("surface") == F.col("form")).select(
        "surface", F.concat(F.lit("proper:"), "canonical").alias("key"), F.col("canonical").alias("lemma"), F.lit("proper").alias("pos"), F.lit("").alias("features"),
        F.lit("dictionary").alias("source"), F.lit(0.95).alias("confidence"), F.lit(500).alias("source_order"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("clitic"),
    )
    every = direct.withColumn("clitic", F.lit(None).cast("string")).unionByName(of_bare).unionByName(called)
    order = F.struct(-F.col("confidence"), "source_order", F.coalesce("rank", F.lit(1_000_000_000)), "key", "features", "lemma", "pos", "source", "confidence", "clitic")
    ranked = every.groupBy("surface").agg(F.array_sort(F.collect_set(order)).alias("r"))  # a word has a few dozen readings
    out = ranked.select("surface", F.posexplode("r").alias("rank", "x"))
    return out.select("surface", "rank", *[F.col(f"x.{c}").alias(c) for c in ("key", "lemma", "pos", "features", "source", "confidence", "clitic")])


def closed_or_known(words: DataFrame, key: str, index: DataFrame, lexemes: DataFrame, closed: DataFrame) -> DataFrame:
    """Readings from the closed-class tables and the form index, by loose key."""
    none = F.lit(None).cast("int")
    table = closed.select(F.col("form").alias("_f"), F.col("key").alias("_k"), "lemma", "pos", "features")
    a = words.join(table, F.col(key) == F.col("_f")).select(
        "surface", F.col("_k").alias("key"), "lemma", "pos", "features", F.lit("closed").alias("source"), F.lit(1.0).alias("confidence"), F.lit(0).alias("source_order"), none.alias("rank")
    )
    forms = index.select(F.col("key").alias("_f"), "lexeme_id", "features").join(lexemes.select("lexeme_id", "lemma", "pos", "rank"), "lexeme_id")
    b = words.join(forms, F.col(key) == F.col("_f")).select(
        "surface", F.col("lexeme_id").alias("key"), "lemma", "pos", "features", F.lit("dictionary").alias("source"), F.lit(1.0).alias("confidence"), F.lit(1).alias("source_order"), "rank"
    )
    return a.unionByName(b)
