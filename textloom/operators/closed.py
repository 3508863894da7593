"""Closed word classes as one table: pronouns and numerals declined from stems, the rest listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .context import GOVERNED
from .dictionary import CASES, ENDINGS
from .generate import feats

#: Personal pronouns by person, number and gender, their forms in the order of CASES; forms after prepositions follow a bar.
PERSONAL = {
    "я": ("1 sg -", "я меня мне меня мной,мною мне"), "ты": ("2 sg -", "ты тебя тебе тебя тобой,тобою тебе"), "он": ("3 sg m", "он его|него ему|нему его|него им|ним нём"), "она": ("3 sg f", "она её|неё ей|ней её|неё ей,ею|ней,нею ней"),
    "оно": ("3 sg n", "оно его|него ему|нему его|него им|ним нём"), "мы": ("1 pl -", "мы нас нам нас нами нас"), "вы": ("2 pl -", "вы вас вам вас вами вас"), "они": ("3 pl -", "они их|них им|ним их|них ими|ними них"),
    "себя": ("3 sg -", "- себя себе себя собой,собою себе"),
}
#: Pronouns that decline like the tables of endings: stem, declension, type.
DECLINED = {
    "мой": ("мо", "мой", "possessive"), "твой": ("тво", "мой", "possessive"), "свой": ("сво", "мой", "possessive"), "наш": ("наш", "наш", "possessive"), "ваш": ("ваш", "наш", "possessive"),
    "оный": ("он", "hard", "demonstrative"), "который": ("котор", "hard", "relative"),
}
#: Pronouns with endings of their own, by gender in the order of CASES; the first word of m is whole.
IRREGULAR = {
    "этот": ("эт", "demonstrative", {"m": "этот ого ому - им ом", "f": "а ой ой у ой ой", "n": "о ого ому о им ом", "pl": "и их им и ими их"}),
    "тот": ("т", "demonstrative", {"m": "тот ого ому - ем ом", "f": "а ой ой у ой ой", "n": "о ого ому о ем ом", "pl": "е ех ем е еми ех"}),
    "весь": ("вс", "determinative", {"m": "весь его ему - ем ём", "f": "я ей ей ю ей ей", "n": "ё его ему ё ем ём", "pl": "е ех ем е еми ех"}),
    "чей": ("чь", "demonstrative", {"m": "чей его ему - им ём", "f": "я ей ей ю ей ей", "n": "ё его ему ё им ём", "pl": "и их им и ими их"}),
    "один": ("одн", "", {"m": "один ого ому - им ом", "f": "а ой ой у ой ой", "n": "о ого ому о им ом", "pl": "и их им и ими их"}),
}
#: Pronouns of one number, in the order of CASES, with their type.
SIMPLE = {
    "кто": ("interrogative/relative", "кто кого кому кого кем ком"), "что": ("interrogative/relative", "что чего чему что чем чём"), "никто": ("negative", "никто никого никому никого никем ником"), "ничто": ("negative", "ничто ничего ничему ничто ничем ничём"),
}
#: Small numerals with their cases, and those whose oblique forms follow one rule.
NUMERALS = {"два": "два/nom/m две/nom/f двух/gen/", "три": "три/nom/ трёх/gen/ трём/dat/ тремя/inst/ трёх/prep/", "четыре": "четыре/nom/ четырёх/gen/ четырём/dat/ четырьмя/inst/ четырёх/prep/"}
SOFT_NUMERALS = "пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать двадцать тридцать".split()
IRREGULAR_NUMERALS = {"сорок": "сорока", "девяносто": "девяноста", "сто": "ста"}
#: Conjunctions, particles and predicatives; a form with = stands for another lemma.
CONJUNCTIONS = "и а но или да что чтобы чтоб=чтобы если когда пока хотя как чем будто либо ни али=или ежели=если коли=если дабы=чтобы ибо"
PARTICLES = "не ни ли ль=ли бы же ведь вот вон даже только уже ещё разве неужели таки то нибудь"
PREDICATIVES = "надо нужно нельзя можно жаль пора холодно жарко скучно весело видно слышно стыдно"
#: Forms of быть.
BE = {
    "буду": ("present-future", "future", "1", "sg", None), "будешь": ("present-future", "future", "2", "sg", None), "будет": ("present-future", "future", "3", "sg", None), "будем": ("present-future", "future", "1", "pl", None),
    "будете": ("present-future", "future", "2", "pl", None), "будут": ("present-future", "future", "3", "pl", None), "был": ("past", "past", None, "sg", "m"), "была": ("past", "past", None, "sg", "f"), "было": ("past", "past", None, "sg", "n"),
    "были": ("past", "past", None, "pl", None), "есть": ("present-future", "present", None, None, None), "суть": ("present-future", "present", None, "pl", None), "будь": ("imperative", None, None, "sg", None), "будьте": ("imperative", None, None, "pl", None),
}
SCHEMA = "form string, key string, lemma string, pos string, features string"


def _declension(stem: str, tables: dict[str, str], kind: str) -> list[tuple[str, str]]:
    out = []
    for gender, row in tables.items():
        ends = row.split(" ")
        for k, (case, end) in enumerate(zip(CASES, ends, strict=True)):
            whole = gender == "m" and k == 0 and end.startswith(stem[0]) and len(end) > 2
            end = ends[0] if end == "=" else end
            number = {"gender": None, "number": "pl"} if gender == "pl" else {"gender": gender, "number": "sg"}
            if end != "-" or (gender == "m" and k == 0):
                out.append((end if whole else stem + end.replace("-", ""), feats(case=case, **number, pronoun_type=kind or None)))
    return out


def closed_rows() -> list[tuple]:
    """(form, key, lemma, pos, features) of all classes; forms are loose keys."""
    out: list[tuple] = []

    def add(form: str, lemma: str, pos: str, features: str = "") -> None:
        out.append((form.replace("ё", "е"), f"{pos}:{lemma}", lemma, pos, features))

    for lemma, (who, forms) in PERSONAL.items():
        person, number, gender = who.split(" ")
        for case, cell in zip(CASES, forms.split(" "), strict=True):
            for form in cell.replace("|", ",").split(","):
                if form != "-":
                    add(form, lemma, "pronoun", feats(case=case, number=number, person=person, gender=gender.replace("-", ""), pronoun_type="personal"))
    for lemma, (stem, declension, kind) in DECLINED.items():
        for form, f in _declension(stem, ENDINGS[declension], kind):
            add(form, lemma, "pronoun", f)
    for lemma, (stem, kind, tables) in IRREGULAR.items():
        for form, f in _declension(stem, tables, kind):
            add(form, lemma, "pronoun" if kind else "numeral", f)
    for lemma, (kind, forms) in SIMPLE.items():
        for case, form in zip(CASES, forms.split(" "), strict=True):
            add(form, lemma, "pronoun", feats(case=case, number="sg", person="3" if lemma == "кто" else None, pronoun_type=kind))
    for form in ("его", "её", "их"):
        add(form, form, "pronoun", feats(pronoun_type="possessive"))
    for lemma, forms in NUMERALS.items():
        for cell in forms.split(" "):
            form, case, gender = cell.split("/")
            add(form, lemma, "numeral", feats(case=case, gender=gender))
    for n in SOFT_NUMERALS:
        add(n, n, "numeral", feats(case="nom"))
        for case in ("gen", "dat", "prep"):
            add(n[:-1] + "и", n, "numeral", feats(case=case))
        add(n[:-1] + "ью", n, "numeral", feats(case="inst"))
    for n, oblique in IRREGULAR_NUMERALS.items():
        add(n, n, "numeral", feats(case="nom"))
        for case in ("gen", "dat", "inst", "prep"):
            add(oblique, n, "numeral", feats(case=case))
    for form, cases in GOVERNED.items():
        for case in cases.split(" "):
            add(form, form, "preposition", feats(case=case))
    for pos, words in (("conjunction", CONJUNCTIONS), ("particle", PARTICLES), ("predicative", PREDICATIVES)):
        for word in words.split(" "):
            form, _, lemma = word.partition("=")
            add(form, lemma or form, pos)
    for form, (verb_form, tense, person, number, gender) in BE.items():
        add(form, "быть", "verb", feats(verb_form=verb_form, tense=tense, person=person, number=number, gender=gender, aspect="imperfective"))
    return list(dict.fromkeys(out))


def closed_classes(spark: SparkSession) -> DataFrame:
    """The table as a constant DataFrame, to be joined by loose key."""
    return spark.createDataFrame(closed_rows(), SCHEMA)
