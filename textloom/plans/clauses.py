"""Queries of clauses, roles and dependencies over authored sentences; the expected rows are typed in."""

from __future__ import annotations

from ..operators import clauses as C
from .lexicon import Fixture

Q: dict = {}
SQL: dict = {}

#: Tokens as text/pos/case/gender/number/person/verb_form/type/role/phrase_head.
SENTENCES = {
    1: "Человек/noun/nom/m/sg вышел/verb//m/sg//past из/preposition////////5 своей/pronoun/gen/f/sg///possessive//5 тёмной/adjective/gen/f/sg/////5 комнаты/noun/gen/f/sg/////5 и/conjunction отправился/verb//m/sg//past ./.",
    2: "Он/pronoun/nom/m/sg/3 знал/verb//m/sg//past ,/, что/conjunction сестра/noun/nom/f/sg пишет/verb///sg/3/present письмо/noun/acc/n/sg ./.",
    3: "Книгу/noun/acc/f/sg читает/verb///sg/3/present мать/noun/nom/f/sg",
    4: "Мне/pronoun/dat//sg/1//personal/experiencer нельзя/predicative спать/verb/////infinitive ;/; пришли/verb///pl//past гости/noun/nom/m/pl",
    5: "не/particle пришла/verb//f/sg//past брат/noun/nom/m/sg и/conjunction тихо/adverb",
    6: "Дом/noun/nom/m/sg",
    7: "Мы/pronoun/nom//pl/1 хотим/verb///pl/1/present купить/verb/////infinitive хлеб/noun/acc/m/sg другу/noun/dat/m/sg",
}


def _rows():
    for n, text in SENTENCES.items():
        for i, spec in enumerate(text.split(" ")):
            f = [x or None for x in spec.split("/")] + [None] * 10
            word = f[0].isalpha()
            yield (n, i, "word" if word else "punct", f[0], *(f[1:5] if word else [None] * 4), int(f[5]) if word and f[5] else None, *(f[6:9] if word else [None] * 3), int(f[9]) if word and f[9] else None, bool(word and f[9]))


def tokens(spark):
    schema = "sentence_id int, i int, kind string, text string, pos string, case string, gender string, number string, person int, verb_form string, type string, role string, phrase_head int, in_phrase boolean"
    return C.clause_numbers(spark.createDataFrame(list(_rows()), schema))


def query(name: str, schema: str, expected: list[tuple]):
    def put(f):
        fixture = Fixture("want", schema, expected)
        Q[name], SQL[name] = f, f"WITH {fixture.sql} SELECT * FROM want"
        return f

    return put


@query("clause_windows", "sentence_id int, clause int, first int, last int, joined boolean", [
    (1, 0, 0, 5, False), (1, 1, 6, 8, True), (2, 0, 0, 2, False), (2, 1, 3, 7, False), (3, 0, 0, 2, False), (4, 0, 0, 2, False), (4, 1, 3, 5, False), (5, 0, 0, 4, False), (6, 0, 0, 0, False), (7, 0, 0, 4, False),
])
def clause_windows(spark, sf_dir):
    from pyspark.sql import functions as F

    return tokens(spark).groupBy("sentence_id", "clause").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.max("joined").alias("joined"))


@query("clause_roles", "sentence_id int, clause int, predicate int, subject int, object int, indirect_object int, experiencer int, possessor int, inherited boolean, word_order string, matches boolean, main boolean", [
    (1, 0, 1, 0, None, None, None, None, False, None, True, False), (1, 1, 7, 0, None, None, None, None, True, None, True, True),
    (2, 0, 1, 0, None, None, None, None, False, None, True, False), (2, 1, 5, 4, 6, None, None, None, False, None, True, True),
    (3, 0, 1, 2, 0, None, None, None, False, "object first", True, True), (4, 0, 2, None, None, None, 0, None, False, None, None, False),
    (4, 1, 4, 5, None, None, None, None, False, "verb first", True, True), (5, 0, 1, 2, None, None, None, None, False, "verb first", False, True),
    (6, 0, None, 0, None, None, None, None, False, None, None, True), (7, 0, 1, 0, 3, 4, None, None, False, None, True, True),
])
def clause_roles(spark, sf_dir):
    return C.clause_roles(tokens(spark))


@query("dependency_sketch", "sentence_id int, dependent int, head int, relation string", [
    (1, 0, 1, "subject"), (1, 1, None, "predicate"), (1, 2, 5, "preposition"), (1, 3, 5, "modifier"), (1, 4, 5, "modifier"), (1, 5, 1, "prepositional-object"), (1, 6, 7, "conjunction"), (1, 7, None, "predicate"),
    (2, 0, 1, "subject"), (2, 1, None, "predicate"), (2, 3, 5, "conjunction"), (2, 4, 5, "subject"), (2, 5, None, "predicate"), (2, 6, 5, "object"), (3, 0, 1, "object"), (3, 1, None, "predicate"), (3, 2, 1, "subject"),
    (4, 0, 2, "experiencer"), (4, 2, None, "predicate"), (4, 4, None, "predicate"), (4, 5, 4, "subject"), (5, 0, 1, "negation"), (5, 1, None, "predicate"), (5, 2, 1, "subject"), (5, 3, 1, "conjunction"), (5, 4, 1, "adverbial"),
    (6, 0, None, "subject"), (7, 0, 1, "subject"), (7, 1, None, "predicate"), (7, 3, 1, "object"), (7, 4, 1, "indirect-object"),
])
def dependency_sketch(spark, sf_dir):
    t = tokens(spark)
    return C.dependencies(t, C.clause_roles(t))
