"""Choice among a token's readings by its neighbours: each rule is a pass of windows over the sentence.

Tokens have sentence_id, i (0, 1, 2 ... in a sentence), kind, text, cands (array of readings, best first), chosen (index of the
reading), decided and why. A rule never touches a decided token. Passes keep the partitioning by sentence, so all of them need one
exchange. A pass carries the one neighbour that its rule asks for, found by running or short frames, and no lists of neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

READING = (
    "struct<key:string,lemma:string,pos:string,case:string,number:string,gender:string,degree:string,type:string,motion:boolean,confidence:double,"
    "verb_form:string,tense:string,aspect:string,person:string,reflexive:boolean,motion_kind:string>"
)
#: Prepositions and the cases they govern, the usual one first.
GOVERNED = {
    "в": "prep acc", "во": "prep acc", "на": "prep acc", "с": "inst gen", "со": "inst gen", "за": "inst acc", "под": "inst acc", "между": "inst gen", "у": "gen", "для": "gen", "без": "gen",
    "из": "gen", "из-за": "gen", "из-под": "gen", "от": "gen", "до": "gen", "к": "dat", "ко": "dat", "о": "prep", "об": "prep", "обо": "prep", "про": "acc", "через": "acc", "чрез": "acc", "при": "prep", "над": "inst", "перед": "inst",
}
#: Nouns that name a point in time, and the prepositions that take them in the accusative.
TIME_NOUNS = "время час минута секунда день неделя вечер утро ночь среда четверг пятница суббота воскресенье понедельник вторник".split()
TIME_PREPOSITIONS = "в во на под за через про".split()
#: Verbs whose object stands in another case than the accusative.
VERB_CASE = {
    "gen": "избегать избегнуть бояться достигать лишиться ждать искать хотеть требовать", "dat": "помогать мешать верить радоваться",
    "inst": "управлять владеть пользоваться заниматься интересоваться гордиться",
}
NOUNS, HEADS = ["noun", "proper"], ["noun", "proper", "pronoun"]


def _order():
    return Window.partitionBy("sentence_id").orderBy("i")


#: What the rules ask of a neighbour: its chosen reading without keys and verb features.
SEEN = ["lemma", "pos", "case", "number", "gender", "degree", "type", "motion"]
#: Tokens that a rule looks back or ahead.
REACH = 8


def _seen() -> Column:
    now = F.get("cands", F.col("chosen"))
    return F.struct(*[now[c].alias(c) for c in SEEN]).alias("now")


def _no() -> Column:
    return F.lit(False)


def _low() -> Column:
    return F.lower("text")


def _now() -> Column:
    return F.get("cands", F.col("chosen"))


def _cases() -> Column:
    """Cases that the token governs as a preposition."""
    return F.split(F.try_element_at(_map(GOVERNED), _low()), " ")


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def picked(t: Column) -> Column:
    return t["now"]


def modifies(c: Column) -> Column:
    return (c["pos"] == "pronoun") & F.coalesce(c["type"].isin("possessive", "demonstrative", "determinative"), _no())


def place(cands: Column, good: Callable[[Column], Column]) -> Column:
    """Index of the first good reading, null if there is none."""
    at = F.filter(F.transform(cands, lambda c, k: F.when(good(c), k)), lambda k: k.isNotNull())
    return F.get(at, F.lit(0))


def _last_word(df: DataFrame, name: str, *of: Column | str) -> DataFrame:
    """`df` with `of` of the nearest word before, and its place i."""
    told = df.select("*", F.when(F.col("kind") == "word", F.struct("i", *of)).alias("told"))
    return told.select("*", F.last("told", ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1)).alias(name)).drop("told")


def _near(t: Column) -> Column:
    """The token before, if it is within reach."""
    return F.when(t["i"] >= F.col("i") - REACH, t)


def _sees(df: DataFrame, *more: str) -> DataFrame:
    """`df` with prev, the word before: i, text, now and `more` of its columns."""
    return _last_word(df, "prev", "text", _seen(), *more).withColumn("prev", _near(F.col("prev")))


def moves(c: Column) -> Column:
    return F.coalesce((c["pos"] == "verb") & c["motion"], _no())


def _heads(df: DataFrame) -> DataFrame:
    """`df` with head (i, text, now, next): the token within five that heads the phrase, a noun, a name or a pronoun of its own, past
    adjectives, numerals, adverbs and pronouns that modify. A noun that could be an adjective is passed if a noun follows it within
    three. next is the word after a token and whether it moves.

    What a token does to those before it (it is their head, it ends their search, it is passed) follows from itself and three more, so
    the head is the first token that isn't passed."""
    c, word = _now(), F.col("kind") == "word"
    can = lambda *pos: F.exists("cands", lambda x: x["pos"].isin(*pos))
    told = df.select("*", (word & F.coalesce(c["pos"].isin(NOUNS), _no())).alias("noun"), F.when(word, F.struct("i", moves(c).alias("moves"))).alias("told"))
    ahead = told.select("*", F.coalesce(F.max("noun").over(_order().rowsBetween(1, 3)), _no()).alias("later"), F.first("told", ignorenulls=True).over(_order().rowsBetween(1, REACH)).alias("next"))
    found = F.when(c["pos"].isin(NOUNS), ~(F.col("later") & can("adjective"))).when((c["pos"] == "pronoun") & ~modifies(c), True).when(c["pos"] == "adverb", can(*NOUNS)).otherwise(False)
    passed = c["pos"].isin("noun", "proper", "adverb", "adjective", "numeral") | modifies(c)
    marked = ahead.select("*", F.when(word, F.coalesce(found, _no())).alias("found")).withColumn("ends", F.when(F.col("found") | word & ~F.coalesce(passed, _no()), F.struct("i", "text", _seen(), "next", "found")))
    first = marked.select("*", F.first("ends", ignorenulls=True).over(_order().rowsBetween(1, 5)).alias("head"))
    return first.withColumn("head", F.when(F.col("head.found"), F.col("head"))).drop("noun", "told", "later", "ends", "found")


def _choose(df: DataFrame, at: Column, why: Column, *, only: Column | bool = True, even_decided: bool = False) -> DataFrame:
    """Takes reading `at` where it is not null and the token is open."""
    open_ = F.coalesce((F.col("kind") == "word") & (F.lit(True) if only is True else only) & (F.lit(even_decided) | ~F.col("decided")), _no())
    # a reading is looked for only where one may be taken
    placed = df.select("*", F.when(open_, at).alias("at"))
    updated = placed.select("*", F.col("at").isNotNull().alias("take"), F.when(F.col("at").isNotNull(), why).alias("because"))
    return updated.withColumns({
        "chosen": F.when(F.col("take"), F.col("at")).otherwise(F.col("chosen")), "decided": F.col("decided") | F.col("take"), "why": F.when(F.col("take"), F.col("because")).otherwise(F.col("why")),
    }).drop("take", "at", "because", "prev", "head", "next")


def preposition_government(df: DataFrame) -> DataFrame:
    """A preposition's case, by time nouns and verbs of motion where it has several, and that of the noun it governs, never a nominative."""
    is_preposition = (F.col("kind") == "word") & (_now()["pos"] == "preposition") & _cases().isNotNull()
    seen = _heads(_sees(df)).withColumn("head", F.when(is_preposition, F.col("head")))
    head = F.col("head")
    after = F.when(head.isNotNull(), head["next"]).otherwise(F.col("next"))
    after_moves = F.coalesce(after["moves"] & (after["i"] <= F.col("i") + REACH), _no())
    timed = _low().isin(TIME_PREPOSITIONS) & F.coalesce(picked(head)["lemma"].isin(TIME_NOUNS), _no())
    goes = _low().isin("в", "во", "на") & (moves(picked(F.col("prev"))) | after_moves)
    want = F.when(is_preposition, F.when(F.size(_cases()) == 1, F.get(_cases(), F.lit(0))).when(timed | goes, F.lit("acc")).otherwise(F.get(_cases(), F.lit(0))))
    pointed = seen.select("*", want.alias("want"), F.when(is_preposition, head["i"]).alias("head_at"), F.array_distinct(F.concat(F.array(want), _cases())).alias("order"))
    pointed = pointed.withColumn("points", F.when(F.col("head_at").isNotNull(), F.struct("head_at", "order", "text")))
    pointing = F.collect_list("points").over(_order().rowsBetween(-5, -1))
    governed = pointed.select("*", pointing.alias("pointing")).withColumn("by", F.get(F.filter("pointing", lambda p: p["head_at"] == F.col("i")), F.lit(0)))
    of_case = lambda case: place(F.col("cands"), lambda c: c["pos"].isin(HEADS) & (c["case"] == case))
    tried = F.filter(F.transform(F.col("by.order"), of_case), lambda k: k.isNotNull())
    oblique = F.when(_now()["case"] == "nom", place(F.col("cands"), lambda c: c["pos"].isin(HEADS) & (c["lemma"] == _now()["lemma"]) & (c["case"] != "nom")))
    own = place(F.col("cands"), lambda c: (c["pos"] == "preposition") & (c["case"] == F.col("want")))
    at = F.when(F.col("want").isNotNull(), own).when(F.col("by").isNotNull(), F.coalesce(F.get(tried, F.lit(0)), oblique))
    done = _choose(governed, at, F.when(F.col("want").isNotNull(), F.concat(F.lit("governs "), "want")).otherwise(F.concat(F.lit("governed by "), "by.text")))
    # the preposition shows the case that its noun took
    done = done.withColumn("takes", F.when(F.col("by").isNotNull(), F.struct("i", F.get("cands", F.col("chosen"))["case"].alias("case"))))
    taken = F.collect_list("takes").over(_order().rowsBetween(1, 5))
    follow = done.select("*", taken.alias("taken")).withColumn("took", F.get(F.filter("taken", lambda t: t["i"] == F.col("head_at")), F.lit(0))["case"])
    follow = follow.withColumn("took", F.when(F.col("took") != F.col("want"), F.col("took")))
    out = _choose(follow, place(F.col("cands"), lambda c: (c["pos"] == "preposition") & (c["case"] == F.col("took"))), F.concat(F.lit("governs "), "took"), only=F.col("want").isNotNull(), even_decided=True)
    return out.drop("want", "head_at", "order", "points", "pointing", "by", "takes", "taken", "took")


def _agrees(x: Column, h: Column) -> Column:
    return (x["case"] == h["case"]) & F.when(F.coalesce(x["number"] == "pl", _no()), h["number"] == "pl").otherwise((x["gender"] == h["gender"]) & ~F.coalesce(h["number"] == "pl", _no()))


def modifier_agreement(df: DataFrame) -> DataFrame:
    """An adjective or modifying pronoun takes the reading that agrees with the noun it comes before."""
    able = lambda x: (x["pos"] == "adjective") | modifies(x)
    seen = _heads(df).withColumn("head", F.when(~F.col("decided") & F.exists("cands", able), F.col("head")))
    head = F.col("head")
    only = F.coalesce(picked(head)["pos"].isin(HEADS), _no())
    return _choose(seen, place(F.col("cands"), lambda x: able(x) & _agrees(x, picked(head))), F.concat(F.lit("agrees with "), head["text"]), only=only)


def noun_after_adjective(df: DataFrame) -> DataFrame:
    """A word takes the noun reading that agrees with the adjective right before it."""
    before = F.col("prev")
    return _choose(_sees(df), place(F.col("cands"), lambda x: x["pos"].isin(NOUNS) & _agrees(picked(before), x)), F.concat(F.lit("agrees with "), before["text"]), only=F.coalesce(picked(before)["pos"] == "adjective", _no()))


def all_or_everything(df: DataFrame) -> DataFrame:
    """всё is a neuter singular, все a plural."""
    neuter = _low().contains("ё")
    at = place(F.col("cands"), lambda x: (x["lemma"] == "весь") & F.when(neuter, x["gender"] == "n").otherwise(x["number"] == "pl"))
    return _choose(df, at, F.when(neuter, "neuter with ё").otherwise("plural without ё"), only=_low().isin("все", "всё"), even_decided=True)


def that_or_what(df: DataFrame) -> DataFrame:
    """что is a conjunction after a verb and a comma, else a pronoun; чем is one after a comparative."""
    comma = F.col("comma")
    reports = F.coalesce((comma["kind"] == "punct") & (comma["text"] == ",") & (picked(F.col("prev"))["pos"] == "verb"), _no())
    at = F.when(reports, place(F.col("cands"), lambda x: x["pos"] == "conjunction")).otherwise(place(F.col("cands"), lambda x: x["pos"] == "pronoun"))
    seen = _sees(df).withColumn("comma", F.lag(F.struct("kind", "text")).over(_order()))
    out = _choose(seen, at, F.when(reports, "reported clause").otherwise("pronoun"), only=_low() == "что", even_decided=True)
    compares = F.coalesce((_now()["degree"] == "comparative") | _low().isin("более", "менее"), _no())
    near = out.drop("comma").withColumn("compares", compares).withColumn("near", F.max("compares").over(_order().rowsBetween(-6, -1)))
    return _choose(near, place(F.col("cands"), lambda x: x["pos"] == "conjunction"), F.lit("than"), only=(_low() == "чем") & F.col("near"), even_decided=True).drop("compares", "near")


def _object(df: DataFrame, case: Column, why: Column, pos: list[str]) -> DataFrame:
    same = place(F.col("cands"), lambda x: (x["lemma"] == _now()["lemma"]) & (x["case"] == case))
    return _choose(df, same, why, only=F.coalesce(_now()["pos"].isin(pos), _no()))


def negated_object(df: DataFrame) -> DataFrame:
    """The word after a negated verb is a genitive."""
    verb, no = F.col("prev"), _near(F.col("prev.word"))
    negated = F.coalesce((picked(verb)["pos"] == "verb") & (F.lower(no["text"]) == "не"), _no())
    return _object(_sees(_last_word(df, "word", "text"), "word").drop("word"), F.when(negated, "gen"), F.concat(F.lit("negated "), verb["text"]), ["noun", "pronoun"])


def verb_government(df: DataFrame) -> DataFrame:
    """The word after a verb that governs another case than the accusative stands in it."""
    verb = F.col("prev")
    table = _map({v: case for case, verbs in VERB_CASE.items() for v in verbs.split()})
    case = F.when(picked(verb)["pos"] == "verb", F.try_element_at(table, picked(verb)["lemma"]))
    return _object(_sees(df), case, F.concat(F.lit("governed by "), verb["text"]), HEADS)


def numeral_government(df: DataFrame) -> DataFrame:
    """A counted noun is a genitive: singular after 2 to 4, plural from 5 on."""
    numeral = picked(F.col("prev"))
    few = numeral["lemma"].isin("два", "три", "четыре") & ~F.coalesce(numeral["case"] == "gen", _no())
    counts = F.coalesce((numeral["pos"] == "numeral") & (numeral["lemma"] != "один") & (_now()["pos"] == "noun"), _no())
    at = place(F.col("cands"), lambda x: (x["lemma"] == _now()["lemma"]) & (x["case"] == "gen") & (x["number"] == F.when(few, "sg").otherwise("pl")))
    return _choose(_sees(df), at, F.concat(F.lit("counted by "), F.col("prev.text")), only=counts)


def made_names(text: Column, guessed: Column) -> Column:
    """Readings of `text` as a name: one whose nominative the case `guessed` suggests, then the word as it stands."""
    cut = lambda n: F.left(text, F.length(text) - n)
    name = lambda lemma, case: F.struct(
        F.concat(F.lit("proper:"), lemma).alias("key"), lemma.alias("lemma"), F.lit("proper").alias("pos"), F.lit(case).alias("case"), *[F.lit(None).cast("string").alias(c) for c in ("number", "gender", "degree", "type")],
        F.lit(None).cast("boolean").alias("motion"), F.lit(0.7).alias("confidence"), *[F.lit(None).cast("string").alias(c) for c in ("verb_form", "tense", "aspect", "person")],
        F.lit(None).cast("boolean").alias("reflexive"), F.lit(None).cast("string").alias("motion_kind"),
    )
    plain, low = name(text, "nom"), F.lower(text)
    made = (
        F.when((guessed == "gen") & low.rlike("[ая]$"), F.array(name(cut(1), "gen"), plain)).when((guessed == "dat") & low.rlike("[ую]$"), F.array(name(cut(1), "dat"), plain))
        .when((guessed == "inst") & low.rlike("ым$"), F.array(name(cut(2), "inst"), plain))
        .when((guessed == "prep") & low.rlike("е$"), F.array(name(F.concat(cut(1), F.lit("а")), "prep"), name(cut(1), "prep"), plain)).otherwise(F.array(plain))
    )
    return made.cast(f"array<{READING}>")


def capitalised_names(df: DataFrame) -> DataFrame:
    """A capitalised word without a sure reading is a name: a known one, else one whose nominative the governed case suggests."""
    before = picked(F.col("prev"))
    table = _map({v: case for case, verbs in VERB_CASE.items() for v in verbs.split()})
    first = F.get(F.split(F.try_element_at(_map(GOVERNED), F.lower(F.col("prev.text"))), " "), F.lit(0))
    guessed = F.when(before["pos"] == "preposition", first).when(before["pos"] == "verb", F.try_element_at(table, before["lemma"]))
    made = made_names(F.col("text"), guessed)
    sure = F.coalesce(~_now()["key"].startswith("?") & (_now()["confidence"] >= 0.6), _no())
    only = (F.col("kind") == "word") & F.col("text").rlike(r"^\p{Lu}") & ~F.coalesce(_now()["pos"] == "proper", _no()) & ~sure
    known = place(F.col("cands"), lambda x: x["pos"] == "proper")
    seen = _sees(df).select("*", only.alias("named"), known.alias("known"), F.size("cands").alias("had"), made.alias("made"))
    seen = seen.withColumn("cands", F.when(F.col("named") & F.col("known").isNull(), F.concat("cands", "made")).otherwise(F.col("cands")))
    return _choose(seen, F.coalesce("known", "had"), F.lit("capitalised"), only=F.col("named"), even_decided=True).drop("named", "known", "had", "made")


#: What word_order says of its choices, which stay open to doubt.
BY_ORDER = ["after the verb", "before the verb"]


def word_order(df: DataFrame) -> DataFrame:
    """A noun whose nominative and accusative look alike is the subject before the verb and the object after it."""
    is_verb = (F.col("kind") == "word") & (_now()["pos"] == "verb")
    all_of_it = _order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    verbs = df.select("*", F.when(is_verb, F.col("i")).alias("verb"))
    ends = verbs.select("*", F.min("verb").over(all_of_it).alias("first_verb"), F.max("verb").over(all_of_it).alias("last_verb")).drop("verb")
    of_case = lambda case: place(F.col("cands"), lambda x: (x["lemma"] == _now()["lemma"]) & (x["case"] == case))
    nom, acc = of_case("nom"), of_case("acc")
    only = F.coalesce(_now()["pos"].isin(NOUNS), _no()) & nom.isNotNull() & acc.isNotNull()
    before = F.col("first_verb") < F.col("i")
    at = F.when(before, acc).when(F.col("last_verb") > F.col("i"), nom)
    return _choose(ends, at, F.when(before, BY_ORDER[0]).otherwise(BY_ORDER[1]), only=only).drop("first_verb", "last_verb")


RULES = [
    preposition_government, modifier_agreement, noun_after_adjective, all_or_everything, that_or_what, negated_object, verb_government, numeral_government, capitalised_names, word_order,
]


def in_context(tokens: DataFrame, rules: list = RULES) -> DataFrame:
    """`tokens` (sentence_id, i, kind, text, cands) with the reading chosen for each: chosen, decided and why."""
    df = tokens.select("sentence_id", "i", "kind", "text", F.col("cands").cast(f"array<{READING}>").alias("cands"), F.lit(0).alias("chosen"), _no().alias("decided"), F.lit("").alias("why"))
    for rule in rules:
        df = rule(df)
    return df


# ---- the same rules where a sentence is one row: neighbours are looked at only where a rule asks for them, and nothing is exchanged


class Sentence:
    """Columns of a sentence's row and what a rule sees at token k: kind, text, cands, chosen and why are arrays by token; prev and next
    are the places of the nearest words within reach. why is null while a token is open."""

    def word(self, k: Column) -> Column:
        return F.get("kind", k) == "word"

    def text(self, k: Column) -> Column:
        return F.get("text", k)

    def low(self, k: Column) -> Column:
        return F.lower(F.get("text", k))

    def cands(self, k: Column) -> Column:
        return F.get("cands", k)

    def now(self, k: Column) -> Column:
        return F.get(F.get("cands", k), F.get("chosen", k))

    def prev(self, k: Column) -> Column:
        return F.get("prev", k)

    def next(self, k: Column) -> Column:
        return F.get("next", k)

    def open(self, k: Column) -> Column:
        return F.get("why", k).isNull()

    def cases(self, k: Column) -> Column:
        return F.split(F.try_element_at(_map(GOVERNED), self.low(k)), " ")


_S = Sentence()


def _each(f: Callable[[Column], Column]) -> Column:
    """f(k) for each token, as an array."""
    return F.transform("kind", lambda _, k: f(k))


def _nearest(k: Column, places: list[int], test: Callable[[Column], Column], what: Callable[[Column], Column] = lambda j: j) -> Column:
    """what(j) of the first j = k + place with `test`; those after it are not looked at."""
    return F.coalesce(*[F.when(test(k + p), what(k + p)) for p in places])


def _take(rows: DataFrame, only: Callable[[Column], Column], at: Callable[[Column], Column], why: Callable[[Column], Column], *, even_decided: bool = False) -> DataFrame:
    """Takes reading at(k) where it is not null, for words with only(k) that are open."""
    able = lambda k: _S.word(k) & only(k) if even_decided else _S.word(k) & _S.open(k) & only(k)
    picked = rows.select("*", _each(lambda k: F.when(able(k), F.struct(at(k).alias("at"), why(k).alias("why")))).alias("pick"))
    pick = lambda k: F.get("pick", k)
    return picked.withColumns({
        "chosen": _each(lambda k: F.coalesce(pick(k)["at"], F.get("chosen", k))), "why": _each(lambda k: F.when(pick(k)["at"].isNotNull(), pick(k)["why"]).otherwise(F.get("why", k))),
    }).drop("pick")


def _with_heads(rows: DataFrame) -> DataFrame:
    """`rows` with ends by token, as in `_heads`: true for a token that heads a phrase, false for one that ends the search, null for one passed."""
    def ends(k: Column) -> Column:
        c = _S.now(k)
        can = lambda *pos: F.exists(_S.cands(k), lambda x: x["pos"].isin(*pos))
        later = F.coalesce(_nearest(k, [1, 2, 3], lambda j: _S.word(j) & _S.now(j)["pos"].isin(NOUNS), lambda j: F.lit(True)), _no())
        found = F.when(c["pos"].isin(NOUNS), ~(later & can("adjective"))).when(c["pos"] == "pronoun", ~modifies(c)).when(c["pos"] == "adverb", can(*NOUNS)).otherwise(False)
        passed = c["pos"].isin("noun", "proper", "adverb", "adjective", "numeral") | modifies(c)
        return F.when(_S.word(k), F.when(F.coalesce(found, _no()), True).when(~F.coalesce(passed, _no()), False))

    return rows.withColumn("ends", _each(ends))


def _head(k: Column) -> Column:
    """Place of the token within five that heads the phrase after token k."""
    ends = lambda j: F.get("ends", j)
    j = _nearest(k, [1, 2, 3, 4, 5], lambda j: ends(j).isNotNull(), lambda j: F.when(ends(j), j).otherwise(-1))
    return F.when(j >= 0, j)


def _preposition_government(rows: DataFrame) -> DataFrame:
    is_preposition = lambda k: _S.word(k) & (_S.now(k)["pos"] == "preposition") & _S.cases(k).isNotNull()
    headed = _with_heads(rows)
    headed = headed.withColumn("head", _each(lambda k: F.when(is_preposition(k), F.struct(_head(k).alias("at"))))).drop("ends")
    head = lambda k: F.get("head", k)["at"]

    def want(k: Column) -> Column:
        cases, after = _S.cases(k), _S.next(F.coalesce(head(k), k))
        timed = _S.low(k).isin(TIME_PREPOSITIONS) & F.coalesce(_S.now(head(k))["lemma"].isin(TIME_NOUNS), _no())
        goes = _S.low(k).isin("в", "во", "на") & (moves(_S.now(_S.prev(k))) | F.coalesce((after <= k + REACH) & moves(_S.now(after)), _no()))
        return F.when(F.get("head", k).isNotNull(), F.when((F.size(cases) > 1) & (timed | goes), "acc").otherwise(F.get(cases, F.lit(0))))

    wanted = headed.withColumn("want", _each(want))
    w = lambda k: F.get("want", k)
    by = wanted.withColumn("by", _each(lambda k: _nearest(k, [-5, -4, -3, -2, -1], lambda j: head(j) == k)))
    of = lambda k: F.get("by", k)

    def at(k: Column) -> Column:
        noun = lambda test: place(_S.cands(k), lambda c: c["pos"].isin(HEADS) & test(c))
        order = F.array_distinct(F.concat(F.array(w(of(k))), _S.cases(of(k))))
        tried = F.filter(F.transform(order, lambda case: noun(lambda c: c["case"] == case)), lambda x: x.isNotNull())
        oblique = F.when(_S.now(k)["case"] == "nom", noun(lambda c: (c["lemma"] == _S.now(k)["lemma"]) & (c["case"] != "nom")))
        return F.when(w(k).isNotNull(), _own(k, w(k))).otherwise(F.coalesce(F.get(tried, F.lit(0)), oblique))

    why = lambda k: F.when(w(k).isNotNull(), F.concat(F.lit("governs "), w(k))).otherwise(F.concat(F.lit("governed by "), _S.text(of(k))))
    done = _take(by, lambda k: w(k).isNotNull() | of(k).isNotNull(), at, why).drop("by")
    # the preposition shows the case that its noun took
    took = lambda k: F.nullif(_S.now(head(k))["case"], w(k))
    return _take(done, lambda k: w(k).isNotNull(), lambda k: _own(k, took(k)), lambda k: F.concat(F.lit("governs "), took(k)), even_decided=True).drop("head", "want")


def _own(k: Column, case: Column) -> Column:
    return place(_S.cands(k), lambda c: (c["pos"] == "preposition") & (c["case"] == case))


def _modifier_agreement(rows: DataFrame) -> DataFrame:
    able = lambda x: (x["pos"] == "adjective") | modifies(x)
    headed = _with_heads(rows).withColumn("head", _each(lambda k: F.when(_S.word(k) & _S.open(k) & F.exists(_S.cands(k), able), _head(k)))).drop("ends")
    head = lambda k: F.get("head", k)
    only = lambda k: head(k).isNotNull() & _S.now(head(k))["pos"].isin(HEADS)
    return _take(headed, only, lambda k: place(_S.cands(k), lambda x: able(x) & _agrees(x, _S.now(head(k)))), lambda k: F.concat(F.lit("agrees with "), _S.text(head(k)))).drop("head")


def _noun_after_adjective(rows: DataFrame) -> DataFrame:
    before = lambda k: _S.now(_S.prev(k))
    at = lambda k: place(_S.cands(k), lambda x: x["pos"].isin(NOUNS) & _agrees(before(k), x))
    return _take(rows, lambda k: before(k)["pos"] == "adjective", at, lambda k: F.concat(F.lit("agrees with "), _S.text(_S.prev(k))))


def _all_or_everything(rows: DataFrame) -> DataFrame:
    neuter = lambda k: _S.low(k).contains("ё")
    at = lambda k: place(_S.cands(k), lambda x: (x["lemma"] == "весь") & F.when(neuter(k), x["gender"] == "n").otherwise(x["number"] == "pl"))
    return _take(rows, lambda k: _S.low(k).isin("все", "всё"), at, lambda k: F.when(neuter(k), "neuter with ё").otherwise("plural without ё"), even_decided=True)


def _that_or_what(rows: DataFrame) -> DataFrame:
    of_pos = lambda k, pos: place(_S.cands(k), lambda x: x["pos"] == pos)
    reports = lambda k: F.coalesce((F.get("kind", k - 1) == "punct") & (_S.text(k - 1) == ",") & (_S.now(_S.prev(k))["pos"] == "verb"), _no())
    out = _take(rows, lambda k: _S.low(k) == "что", lambda k: F.when(reports(k), of_pos(k, "conjunction")).otherwise(of_pos(k, "pronoun")), lambda k: F.when(reports(k), "reported clause").otherwise("pronoun"), even_decided=True)
    compares = lambda j: F.coalesce((_S.now(j)["degree"] == "comparative") | _S.low(j).isin("более", "менее"), _no())
    near = lambda k: _nearest(k, [-1, -2, -3, -4, -5, -6], compares).isNotNull()
    return _take(out, lambda k: (_S.low(k) == "чем") & near(k), lambda k: of_pos(k, "conjunction"), lambda k: F.lit("than"), even_decided=True)


def _same(k: Column, case: Column | str) -> Column:
    """Place of the reading with the lemma of the present one in another case."""
    return place(_S.cands(k), lambda x: (x["lemma"] == _S.now(k)["lemma"]) & (x["case"] == case))


def _negated_object(rows: DataFrame) -> DataFrame:
    def only(k: Column) -> Column:
        no = _S.prev(_S.prev(k))
        return _S.now(k)["pos"].isin("noun", "pronoun") & (_S.now(_S.prev(k))["pos"] == "verb") & (no >= k - REACH) & (_S.low(no) == "не")

    return _take(rows, only, lambda k: _same(k, "gen"), lambda k: F.concat(F.lit("negated "), _S.text(_S.prev(k))))


def _governed_by_verb(verb: Column) -> Column:
    return F.when(verb["pos"] == "verb", F.try_element_at(_map({v: case for case, verbs in VERB_CASE.items() for v in verbs.split()}), verb["lemma"]))


def _verb_government(rows: DataFrame) -> DataFrame:
    case = lambda k: _governed_by_verb(_S.now(_S.prev(k)))
    return _take(rows, lambda k: _S.now(k)["pos"].isin(HEADS) & case(k).isNotNull(), lambda k: _same(k, case(k)), lambda k: F.concat(F.lit("governed by "), _S.text(_S.prev(k))))


def _numeral_government(rows: DataFrame) -> DataFrame:
    numeral = lambda k: _S.now(_S.prev(k))
    few = lambda k: numeral(k)["lemma"].isin("два", "три", "четыре") & ~F.coalesce(numeral(k)["case"] == "gen", _no())
    at = lambda k: place(_S.cands(k), lambda x: (x["lemma"] == _S.now(k)["lemma"]) & (x["case"] == "gen") & (x["number"] == F.when(few(k), "sg").otherwise("pl")))
    only = lambda k: (_S.now(k)["pos"] == "noun") & (numeral(k)["pos"] == "numeral") & (numeral(k)["lemma"] != "один")
    return _take(rows, only, at, lambda k: F.concat(F.lit("counted by "), _S.text(_S.prev(k))))


def _capitalised_names(rows: DataFrame) -> DataFrame:
    def named(k: Column) -> Column:
        sure = F.coalesce(~_S.now(k)["key"].startswith("?") & (_S.now(k)["confidence"] >= 0.6), _no())
        return _S.word(k) & ~sure & _S.text(k).rlike(r"^\p{Lu}") & ~F.coalesce(_S.now(k)["pos"] == "proper", _no())

    def made(k: Column) -> Column:
        before = _S.now(_S.prev(k))
        first = F.get(_S.cases(_S.prev(k)), F.lit(0))
        return made_names(_S.text(k), F.when(before["pos"] == "preposition", first).otherwise(_governed_by_verb(before)))

    known = lambda k: place(_S.cands(k), lambda x: x["pos"] == "proper")
    seen = rows.withColumn("named", _each(lambda k: F.when(named(k), F.coalesce(known(k), -F.size(_S.cands(k)) - 1))))  # made ones are below zero: -1 - how many readings it had
    at = lambda k: F.get("named", k)
    seen = seen.withColumn("cands", _each(lambda k: F.when(at(k) < 0, F.concat(_S.cands(k), made(k))).otherwise(_S.cands(k))))
    return _take(seen, lambda k: at(k).isNotNull(), lambda k: F.when(at(k) < 0, -at(k) - 1).otherwise(at(k)), lambda k: F.lit("capitalised"), even_decided=True).drop("named")


def _word_order(rows: DataFrame) -> DataFrame:
    verbs = rows.withColumn("verbs", _each(lambda k: F.when(_S.word(k) & (_S.now(k)["pos"] == "verb"), k)))
    ends = verbs.select("*", F.array_min("verbs").alias("first_verb"), F.array_max("verbs").alias("last_verb")).drop("verbs")
    before = lambda k: F.coalesce(F.col("first_verb") < k, _no())
    only = lambda k: F.coalesce(_S.now(k)["pos"].isin(NOUNS), _no()) & (before(k) | (F.col("last_verb") > k)) & _same(k, "nom").isNotNull() & _same(k, "acc").isNotNull()
    return _take(ends, only, lambda k: F.when(before(k), _same(k, "acc")).otherwise(_same(k, "nom")), lambda k: F.when(before(k), BY_ORDER[0]).otherwise(BY_ORDER[1])).drop("first_verb", "last_verb")


def in_sentences(sentences: DataFrame, rules: list = RULES) -> DataFrame:
    """`in_context` of sentences that are one row each: sentence_id, kind, text and cands as arrays by token, to which it adds chosen and
    why (null where no rule decided). `rules` are those of `in_context`. Linear in a sentence, without exchange or sort."""
    word = lambda j: F.get("kind", j) == "word"
    span = range(1, REACH + 1)
    rows = sentences.select(
        "sentence_id", "kind", "text", "cands", F.transform("kind", lambda _: F.lit(0)).alias("chosen"), F.transform("kind", lambda _: F.lit(None).cast("string")).alias("why"),
        _each(lambda k: _nearest(k, [-d for d in span], word)).alias("prev"), _each(lambda k: _nearest(k, [*span], word)).alias("next"),
    )
    for rule in rules:
        rows = globals()[f"_{rule.__name__}"](rows)
    return rows.drop("prev", "next")


def ambiguous(cands: Column, chosen: Column, decided: Column, within: float = 0.05) -> Column:
    """Whether an open token has another lemma or part of speech about as sure as the chosen reading."""
    now = F.get(cands, chosen)
    rival = F.exists(cands, lambda c: ((c["lemma"] != now["lemma"]) | (c["pos"] != now["pos"])) & (F.abs(c["confidence"] - now["confidence"]) < within))
    return ~decided & F.coalesce(rival, _no())
