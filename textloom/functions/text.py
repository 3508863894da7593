"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vowels of modern and pre-reform spelling.
VOWELS = "аеёиоуыэюяѣіѵ"
#: The Cyrillic vowel that a marked Latin vowel stands for in printed editions.
MARKED_PAIRS = {"ò": "о", "ó": "о", "à": "а", "á": "а", "è": "е", "é": "е", "ù": "у", "ú": "у", "ì": "и", "í": "и", "ý": "ы"}
#: Latin letters for each Cyrillic one.
TRANSLITERATION = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch",
    "ъ": '"', "ы": "y", "ь": "'", "э": "e", "ю": "yu", "я": "ya", "ѣ": "e", "і": "i", "ѳ": "f", "ѵ": "i",
}
ACUTE, GRAVE = "́", "̀"
_MARKS = ACUTE + GRAVE
_CYR, _LAT = r"\x{0400}-\x{052F}", r"A-Za-z\x{00C0}-\x{024F}"
_START = rf"[{_CYR}\x{{0300}}\x{{0301}}]"
_CONT = rf"[{_CYR}\x{{0300}}\x{{0301}}òóàáèéùúìíý]"
#: White space of the tokenizer.
SPACE = r"[\x{0009}-\x{000D}\x{0020}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: How a word, a Latin word or a number begins.
WRITTEN = rf"{_START}|[{_LAT}0-9]"
WORD = rf"{_START}{_CONT}*(?:[-\x{{2011}}]{_START}{_CONT}*)*"
LATIN = rf"[{_LAT}]+(?:['\x{{2011}}-][{_LAT}]+)*"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
#: Every text is the concatenation of its pieces; the pattern is one that Java and RE2 read alike.
PIECE = rf"{WORD}|{LATIN}|{NUMBER}|{SPACE}+|-+|\.+|!+|\?+|(?s:.)"


#: The same pieces for Java: no two alternatives begin alike, so frequent ones come first and nothing is given back.
_FAST = (
    rf"[{_LAT}]++(?:['\x{{2011}}-][{_LAT}]++)*+|{SPACE}++|{_START}{_CONT}*+(?:[-\x{{2011}}]{_START}{_CONT}*+)*+|[0-9]++(?:[.,][0-9]++)*+|-++|\.++|!++|\?++|(?s:.)"
)


def pieces(text: Column) -> Column:
    """All pieces of a text in order: words, Latin words, numbers, white space, punctuation."""
    return F.regexp_extract_all(text, F.lit(_FAST), F.lit(0))


def begins(piece: Column, *ranges: str) -> Column:
    """Whether the first character lies in one of `ranges` (first and last character): a comparison of bytes, no pattern."""
    out = None
    for r in ranges:
        within = (piece >= r[0]) & (piece < chr(ord(r[-1]) + 1))
        out = within if out is None else out | within
    return out


#: First characters of Latin words, words and white space, as ranges.
_LATIN_FIRST, _WORD_FIRST = ("az", "AZ", "\u00c0\u024f"), ("\u0400\u052f", "\u0300\u0301")
_SPACE_FIRST = ("  ", "\t\r", "\u00a0\u00a0", "\u1680\u1680", "\u2000\u200a", "\u2028\u2029", "\u202f\u202f", "\u205f\u205f", "\u3000\u3000", "\ufeff\ufeff")


def is_space(piece: Column) -> Column:
    return begins(piece, *_SPACE_FIRST)


def kind(piece: Column) -> Column:
    """word, latin, number, space or punct."""
    return (
        F.when(begins(piece, *_LATIN_FIRST), "latin").when(begins(piece, *_WORD_FIRST), "word").when(begins(piece, "09"), "number")
        .when(is_space(piece), "space").otherwise("punct")
    )


def _decomposed(c: Column) -> Column:
    """Marked vowels as vowel and combining mark, for the finite Cyrillic set."""
    for x, y in MARKED_PAIRS.items():
        c = F.replace(c, F.lit(x), F.lit(y + (GRAVE if x in "òàèùì" else ACUTE)))
    for x, y in (("ѐ", "е"), ("ѝ", "и"), ("Ѐ", "Е"), ("Ѝ", "И")):
        c = F.replace(c, F.lit(x), F.lit(y + GRAVE))
    return c


#: What `normalize` maps letter by letter; the marks, last, have nothing to become and go.
_NORMAL = ("".join(MARKED_PAIRS) + "ѐѝЀЍ’ʼ`´" + _MARKS, "".join(MARKED_PAIRS.values()) + "еиЕИ''''")


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def normalize(c: Column) -> Column:
    """Stress marks gone, apostrophes unified, case kept."""
    return F.translate(c, *_NORMAL)


def loose_key(c: Column) -> Column:
    """Dictionary key: lower case, ё as е, pre-reform letters folded, a final hard sign after a consonant dropped."""
    folded = F.translate(F.lower(normalize(c)), "ёѣіѳѵї", "ееифии")
    hard = c.contains("ъ") | c.contains("Ъ")
    return F.when(_ascii(c), F.lower(F.replace(c, F.lit("`"), F.lit("'")))).when(hard, F.regexp_replace(folded, r"([^аеиоуыэюяь])ъ$", "$1")).otherwise(folded)


def source_stress(c: Column) -> Column:
    """Index of the vowel that carries the first printed stress mark, else -1."""
    d = _decomposed(c)
    before = F.regexp_extract(d, f"^([^{_MARKS}]*)[{_MARKS}]", 1)
    return F.when(d.rlike(f"[{_MARKS}]"), F.length(before) - 1).otherwise(F.lit(-1))


def is_pre_reform(c: Column) -> Column:
    return F.lower(c).rlike("[ѣіѳѵ]") | F.lower(c).rlike("[бвгджзклмнпрстфхцчшщ]ъ$")


def letters_of(c: Column) -> Column:
    """Cyrillic letters of a word in order."""
    return F.regexp_extract_all(normalize(c), F.lit(rf"[{_CYR}]"), F.lit(0))


def syllable_count(c: Column) -> Column:
    return F.regexp_count(F.lower(normalize(c)), F.lit(f"[{VOWELS}]"))


def split_accent(c: Column) -> Column:
    """struct(form, stress) of a form whose stressed vowel is followed by an apostrophe; stress -1 without one."""
    at = F.instr(c, "'")
    return F.struct(F.replace(c, F.lit("'"), F.lit("")).alias("form"), F.when(at > 1, at - 2).otherwise(F.lit(-1)).alias("stress"))


def with_acute(form: Column, stress: Column) -> Column:
    """The form with a combining acute after the stressed letter."""
    return F.when(stress >= 0, F.concat(F.substr(form, F.lit(1), stress + 1), F.lit(ACUTE), F.substr(form, stress + 2))).otherwise(form)


def split_list(c: Column, sep: str) -> Column:
    """Alternatives or senses: split, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


def roman_to_int(c: Column) -> Column:
    """Value of a Roman numeral, dots and spaces ignored; null for other text."""
    s = F.lower(F.regexp_replace(c, r"[.\s]", ""))
    value = F.create_map(*[F.lit(x) for kv in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000)) for x in kv])
    digits = F.transform(F.split(s, ""), lambda ch: F.try_element_at(value, ch))
    total = F.aggregate(
        F.zip_with(digits, F.slice(digits, 2, 1000), lambda a, b: F.when(a < b, -a).otherwise(a)), F.lit(0), lambda acc, x: acc + x
    )
    return F.when(s.rlike("^[ivxlcdm]+$"), total)


def transliterate(c: Column) -> Column:
    """Letter by letter into Latin; a capital's first Latin letter is a capital."""
    table = TRANSLITERATION | {x.upper(): y[0].upper() + y[1:] for x, y in TRANSLITERATION.items()}
    kept = dict(zip(*_NORMAL)) | {m: "" for m in _MARKS}
    single = {x: table.get(y, y) for x, y in kept.items()} | {x: y for x, y in table.items() if len(y) == 1}
    out = sorted(single, key=lambda x: not single[x])  # what goes comes last
    c = F.translate(c, "".join(out), "".join(single[x] for x in out))
    for x, y in table.items():
        if len(y) > 1:
            c = F.replace(c, F.lit(x), F.lit(y))
    return c


def decodability(word: Column, known: Column) -> Column:
    """struct(known, total, ratio, category): how much of a word is in `known`, an array of upper-case letters."""
    def of(letters: Column) -> Column:
        hit = F.size(F.filter(letters, lambda x: F.array_contains(known, x)))
        total = F.size(letters)
        ratio = F.when(total == 0, F.lit(1.0)).otherwise(hit / total)
        missing = F.size(F.array_except(letters, known))
        category = F.when(ratio == 1, "fully").when((missing <= 1) & (ratio >= 0.6), "nearly").otherwise("not-yet")
        return F.struct(hit.alias("known"), total.alias("total"), ratio.alias("ratio"), category.alias("category"))

    return let(F.transform(letters_of(word), F.upper), of)


def collapse_space(c: Column) -> Column:
    """Runs of white space, no-break spaces and soft hyphens as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"[\x{0009}-\x{000D} \x{00A0}\x{00AD}]+", " "))


def segment_form(surface: Column, base: Column, reflexive: Column) -> Column:
    """struct(stem, ending, postfix): the common beginning with the lemma's base, the rest, and -ся or -сь.

    A common beginning under two letters means a suppletive form: no stem, the whole is ending."""
    def cut(w: Column) -> Column:
        s, base = w["s"], w["base"]
        post = F.when(reflexive & s.rlike("с[яь]$"), F.substr(s, F.length(s) - 1)).otherwise(F.lit(""))
        return let(F.struct(F.substr(s, F.lit(1), F.length(s) - F.length(post)).alias("body"), base.alias("base"), post.alias("postfix")), ends)

    def ends(w: Column) -> Column:
        body, base = w["body"], w["base"]
        n = F.least(F.length(body), F.length(base))
        same = F.size(F.filter(F.sequence(F.lit(0), n), lambda i: F.substr(body, F.lit(1), i) == F.substr(base, F.lit(1), i))) - 1
        return let(F.when(same >= 2, F.substr(body, F.lit(1), same)).otherwise(F.lit("")), lambda stem: F.struct(stem.alias("stem"), F.substr(body, F.length(stem) + 1).alias("ending"), w["postfix"].alias("postfix")))

    return let(F.struct(F.lower(normalize(surface)).alias("s"), base.alias("base")), cut)


def lemma_base(lemma: Column, pos: Column) -> Column:
    """The part of a lemma that its forms share: no reflexive postfix, no infinitive or adjective ending."""
    s = F.regexp_replace(F.lower(normalize(lemma)), "с[яь]$", "")
    return F.when(pos == "verb", F.regexp_replace(s, "(?:ть|ти|чь)$", "")).when(pos.isin("adjective", "pronoun"), F.regexp_replace(F.lower(normalize(lemma)), "(?:ый|ий|ой)$", "")).otherwise(F.lower(normalize(lemma)))


#: A deterministic projection of Latin text onto Cyrillic letters, for running the Cyrillic path over the test tables.
LATIN_52 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
CYRILLIC_52 = "абцдефгхийклмнопярстувщзыьАБЦДЕФГХИЙКЛМНОПЯРСТУВЩЗЫЬ"


def cyrillic_projection(c: Column) -> Column:
    return F.translate(c, LATIN_52, CYRILLIC_52)


#: Numbers that are summed up in one piece of a running sum.
SUM_PIECE = 256


def let(value: Column, f) -> Column:
    """f(value) with value computed once, also where f uses it inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running_sums(xs: Column) -> Column:
    """Running sums of an array of numbers, piece by piece, as a fold that appends to one long array takes quadratic time."""
    none = lambda kind: F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast(kind).alias("sums"))
    add = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["sums"], F.array(acc["sum"] + x)).alias("sums"))

    def across(acc: Column, piece: Column) -> Column:
        moved = F.array(F.transform(piece["sums"], lambda x: x + acc["sum"]))
        return F.struct((acc["sum"] + piece["sum"]).alias("sum"), F.concat(acc["sums"], moved).alias("sums"))

    at = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(SUM_PIECE))
    pieces_ = F.transform(at, lambda i: F.aggregate(F.slice(xs, i, F.lit(SUM_PIECE)), none("array<bigint>"), add))
    return F.aggregate(pieces_, none("array<array<bigint>>"), across, lambda acc: F.flatten(acc["sums"]))

#: Latin digraphs of the projection that also has hushing and iotated letters.
DIGRAPHS = {"sh": "ш", "ch": "ч", "zh": "ж", "yo": "ё", "yu": "ю", "ee": "э", "tio": "тьо", "cte": "ъе"}


def cyrillic_reading(c: Column) -> Column:
    """The projection with digraphs as one letter, so that every Cyrillic letter class occurs."""
    for latin, cyrillic in DIGRAPHS.items():
        c = F.replace(c, F.lit(latin), F.lit(cyrillic))
    return cyrillic_projection(c)
