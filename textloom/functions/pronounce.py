"""Pronunciation of a written word, as a Column expression: one fold from right to left decides the voicing of consonants,
then every letter is rendered from its neighbours and the stress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Letters by class.
VOWELS, IOTATED, SOFTENING = "аеёиоуыэюя", "еёюя", "еёиюя"
SONORANTS, OBSTRUENTS = "лмнрй", "бпфгкдтжшзсхцчщ"
ALWAYS_SOFT, ALWAYS_HARD, SILENT = "чщй", "жшц", "ьъ"
# Voiced consonants and their voiceless partners.
VOICED, VOICELESS = "бвгджз", "пфктшс"
# Sounds of the consonants, and of vowels under stress, in phonetic and in practical spelling.
CONSONANTS = {
    "б": ("b", "b"), "в": ("v", "v"), "г": ("ɡ", "g"), "д": ("d", "d"), "ж": ("ʐ", "zh"), "з": ("z", "z"), "к": ("k", "k"), "л": ("l", "l"), "м": ("m", "m"), "н": ("n", "n"), "п": ("p", "p"),
    "р": ("r", "r"), "с": ("s", "s"), "т": ("t", "t"), "ф": ("f", "f"), "х": ("x", "kh"), "ц": ("ts", "ts"), "ч": ("tɕ", "ch"), "ш": ("ʂ", "sh"), "щ": ("ɕː", "shch"), "й": ("j", "y"),
}
STRESSED = {
    "а": ("a", "a"), "о": ("o", "o"), "у": ("u", "u"), "ы": ("ɨ", "y"), "э": ("e", "e"), "и": ("i", "i"), "е": ("e", "e"), "ё": ("o", "o"), "ю": ("u", "u"), "я": ("a", "a"),
}
# Words whose ч is said as ш, and those that say -чн- as [ʂn].
SHTO = ["что", "чтобы", "что-то", "что-нибудь", "кое-что", "ничто", "нечто"]
SHN = ["конечно", "скучно", "нарочно", "яичница", "скворечник", "прачечная", "подсвечник"]
# What is said of each rule that fired.
UNKNOWN_STRESS = "stress unknown — vowel reduction not applied"
SHTO_NOTE = " is pronounced [ʂto…]: ч is realised as ш — a fixed exception, not the regular ч sound"
SHN_NOTE = "-чн- → [ʂn]: a fixed exception in this word (most -чн- words keep [tɕn])"
GOD_NOTE = "final г in бог → [x]: an old exception (regular final devoicing would give [k])"
GK_NOTE = "-гк- → [xk]: a fixed exception (лёгкий, мягкий and their forms)"
OGO_NOTE = "-ого/-его → [-əvə]: the adjective/pronoun genitive ending pronounces г as в"
TSA_NOTE = "-ться/-тся → [tsə]: pronounced as one cluster, not [tsʲa]"
V_NOTE = "в devoiced by the following voiceless consonant → [f]"


def _in(c: Column, letters: str) -> Column:
    return c.isin(list(letters))


def _table(pairs: dict[str, tuple[str, str]], which: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v[which])])


def voicing(letters: Column) -> Column:
    """One sign a letter: + voiced, - voiceless, . where voicing has no say. A transducer that reads the letters from the right.

    Its state is the voicing that the sound to the right asks for, and whether any sound was read. An obstruent follows what is
    asked for, else its own voicing unless it ends the word; в follows too but asks for nothing; vowels and sonorants ask for
    nothing; silent letters pass on what is asked."""
    start = F.struct(F.lit("").alias("asked"), F.lit(True).alias("last"), F.lit("").alias("signs"))

    def read(state: Column, ch: Column) -> Column:
        sign = (
            F.when(_in(ch, OBSTRUENTS), F.when(state["asked"] != "", state["asked"]).when(_in(ch, VOICED) & ~state["last"], "+").otherwise("-"))
            .when(ch == "в", F.when(state["asked"] == "-", "-").otherwise("+")).otherwise(".")
        )
        asked = F.when(_in(ch, OBSTRUENTS), sign).when((ch == "в") | _in(ch, VOWELS + SONORANTS), "").otherwise(state["asked"])
        return F.struct(asked.alias("asked"), (state["last"] & _in(ch, SILENT)).alias("last"), F.concat(sign, state["signs"]).alias("signs"))

    return F.aggregate(F.reverse(letters), start, read, lambda s: s["signs"])


def _sounds(word: Column, stress: Column, shn: Column) -> Column:
    """array of struct(ipa, latin, note, shift) by letter; shift marks notes of which only the first is told."""
    letters = F.split(word, "")
    none = F.lit(None).cast("string")
    sound = lambda ipa, latin, note=none, shift=F.lit(False): F.struct(ipa.alias("ipa"), latin.alias("latin"), note.alias("note"), shift.alias("shift"))
    said = lambda ipa, latin, note: sound(F.lit(ipa), F.lit(latin), F.lit(note))
    silence = sound(F.lit(""), F.lit(""))
    last_sound = F.length(F.regexp_replace(word, f"[{SILENT}]+$", "")) - 1
    cluster = F.when(word.endswith("ться"), F.length(word) - 4).when(word.endswith("тся"), F.length(word) - 3)
    before = F.substr(word, F.lit(1), F.greatest(stress, F.lit(0)))
    tonic = _in(F.substr(word, stress + 1, F.lit(1)), VOWELS) & (stress >= 0)
    pretonic = F.when(tonic & before.rlike(f"[{VOWELS}]"), F.length(F.regexp_extract(before, f"^(.*)[{VOWELS}]", 1)))
    ends_ogo = word.rlike("[ое]го$")

    def render(ch: Column, i: Column, signs: Column) -> Column:
        prev, following = F.when(i > 0, F.get(letters, i - 1)), F.coalesce(F.get(letters, i + 1), F.lit(""))
        opens = prev.isNull() | _in(prev, VOWELS + SILENT)
        glide = lambda g: F.when(_in(ch, IOTATED) & opens, g).otherwise("")
        full = sound(F.concat(glide("j"), F.element_at(_table(STRESSED, 0), ch)), F.concat(glide("y"), F.element_at(_table(STRESSED, 1), ch)))
        schwa = sound(F.lit("ə"), F.lit("a"), F.concat(ch, F.lit(" unstressed → [ə]")))
        vowel = (
            F.when((ch == "ё") | (i == stress) | (stress < 0), full)
            .when(_in(ch, "оа"), F.when(i == pretonic, sound(F.lit("ɐ"), F.lit("a"), F.concat(ch, F.lit(" before the stress → [ɐ]")))).otherwise(schwa))
            .when(_in(ch, "ея"), sound(F.concat(glide("j"), F.lit("ɪ")), F.concat(glide("y"), F.lit("e")), F.concat(ch, F.lit(" unstressed → [ɪ]")))).otherwise(full)
        )
        sign = F.substr(signs, i + 1, F.lit(1))
        changes = F.when(_in(ch, "хцчщ"), F.lit(False)).when(_in(ch, VOICED), sign == "-").when(_in(ch, OBSTRUENTS), sign == "+").otherwise(False)
        base = F.when(changes, F.translate(ch, VOICED + VOICELESS, VOICELESS + VOICED)).otherwise(ch)
        soft = ~_in(ch, ALWAYS_SOFT + ALWAYS_HARD) & _in(following, SOFTENING + "ь")
        heard = F.element_at(_table(CONSONANTS, 0), base)
        final = (i == last_sound) & _in(ch, VOICED) & (ch != "в")
        note = (
            F.when(changes & (ch == "в"), F.lit(V_NOTE)).when(changes & final, F.concat(F.lit("final "), ch, F.lit(" devoiced → ["), heard, F.lit("]")))
            .when(changes, F.concat(ch, F.lit(" assimilates in voicing to the next consonant → ["), heard, F.lit("]")))
        )
        consonant = sound(F.concat(heard, F.when(soft, "ʲ").otherwise("")), F.element_at(_table(CONSONANTS, 1), base), note, changes & ~final)
        return (
            F.when(i > F.coalesce(cluster, F.length(word)), silence).when(_in(ch, VOWELS), vowel)
            .when(shn & (ch == "ч") & (following == "н"), said("ʂn", "shn", SHN_NOTE)).when(shn & (ch == "н") & F.coalesce(prev == "ч", F.lit(False)), silence)
            .when((ch == "г") & (word == "бог"), said("x", "kh", GOD_NOTE)).when((ch == "г") & (following == "к"), said("x", "kh", GK_NOTE))
            .when((ch == "г") & ends_ogo & (i == F.length(word) - 2), said("v", "v", OGO_NOTE)).when(i == cluster, said("tsə", "tsa", TSA_NOTE))
            .when(_in(ch, OBSTRUENTS + SONORANTS + "в"), consonant).otherwise(silence)
        )

    return T.let(voicing(letters), lambda signs: F.transform(letters, lambda ch, i: render(ch, i, signs)))


def pronounce(form: Column, stress: Column) -> Column:
    """struct(translit, ipa, confidence, notes) of a word; `stress` is the index of its stressed vowel, -1 if unknown.

    Without a stress no vowel is reduced and the confidence is 0.7; a lexical exception lowers it to 0.9 at most. notes tell the
    rules that fired, in the order of the letters; of changes in voicing before another consonant only the first is told. A null
    form gives null."""
    word = F.lower(T.normalize(form))
    shto = word.isin(SHTO)
    shn = word.isin(SHN)
    known = stress >= 0
    body = F.when(shto, F.substr(word, F.lit(2))).otherwise(word)
    at = F.when(~known, F.lit(-1)).when(shto, F.greatest(stress - 1, F.lit(0))).otherwise(stress)
    lead = lambda latin: F.when(shto, "sh" if latin else "ʂ").otherwise("")

    def told(sounds: Column) -> Column:
        noted = F.filter(sounds, lambda s: s["note"].isNotNull())
        first = T.let(noted, lambda ns: F.filter(ns, lambda s, k: ~s["shift"] | (F.size(F.filter(F.slice(ns, 1, k), lambda x: x["shift"])) == 0)))
        opening = F.filter(F.array(F.when(~known, F.lit(UNKNOWN_STRESS)), F.when(shto, F.concat(word, F.lit(SHTO_NOTE)))), lambda x: x.isNotNull())
        joined = lambda name: F.array_join(F.transform(sounds, lambda s: s[name]), "")
        least = F.when(shto | shn, F.when(known, 0.9).otherwise(0.7)).when(known, 1.0).otherwise(0.7)
        return F.struct(
            F.concat(lead(True), joined("latin")).alias("translit"), F.concat(F.lit("["), lead(False), joined("ipa"), F.lit("]")).alias("ipa"), least.alias("confidence"),
            F.concat(opening, F.transform(first, lambda s: s["note"])).alias("notes"),
        )

    return F.when(form.isNotNull(), T.let(_sounds(body, at, shn), told))
