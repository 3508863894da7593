"""Clauses of a sentence: where they begin, their roles, inherited subjects, and a sketch of dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexicon import agreement, dependency_edges

#: Words that begin a subordinate clause, and words that join clauses.
BREAKERS = "что чтобы чтоб если когда пока хотя как чем будто".split()
JOINERS = "и а но или да либо".split()
#: Relations in the order in which the first one of a dependent wins.
RELATIONS = ["predicate", "subject", "object", "indirect-object", "experiencer", "possessor", "preposition", "prepositional-object", "negation", "modifier", "adverbial", "conjunction", "relative-clause", "vocative"]


def _verbal(tokens: DataFrame) -> Column:
    """Verbs: by constructions where `tokens` say so in a column verbal, else by part of speech."""
    return F.col("verbal") if "verbal" in tokens.columns else (F.col("kind") == "word") & (F.col("pos") == "verb")


def clause_numbers(tokens: DataFrame) -> DataFrame:
    """`tokens` (sentence_id, i, kind, text, pos, verb_form ...) with clause (from 0) and joined, whether a joining word opened it.

    A cut needs verbs on either side of it, the left one since the cut before, so cuts are a fold over the words of one
    sentence; only those that can cut are gathered."""
    w = Window.partitionBy("sentence_id").orderBy("i")
    verb = F.when(_verbal(tokens), F.col("i"))
    low = F.lower("text")
    breaks = (F.col("kind") == "word") & (low.isin(BREAKERS) | low.startswith("котор"))
    joins = (F.col("kind") == "word") & low.isin(JOINERS) & F.coalesce(F.col("pos") == "conjunction", F.lit(False))
    mark = (F.col("kind") == "punct") & F.col("text").isin(";", "—", "–")
    seen = tokens.withColumns({
        "kind_of_cut": F.when(F.col("i") > 0, F.when(mark, "mark").when(breaks, "break").when(joins, "join")),
        "verb_before": F.max(verb).over(w.rowsBetween(Window.unboundedPreceding, -1)), "last_verb": F.max(verb).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    able = F.when(F.col("kind_of_cut").isNotNull() & (F.col("last_verb") > F.col("i")), F.struct("i", "kind_of_cut", "verb_before"))
    gathered = seen.groupBy("sentence_id").agg(F.array_sort(F.collect_list(able)).alias("able"))
    none = F.array().cast("array<struct<i:int,joined:boolean>>")

    def step(cuts: Column, t: Column) -> Column:
        last = F.coalesce(F.try_element_at(cuts, F.lit(-1))["i"], F.lit(0))
        left = F.coalesce(F.when(t["kind_of_cut"] == "mark", t["verb_before"].isNotNull()).otherwise(t["verb_before"] >= last), F.lit(False))
        cuts_here = left | ((t["kind_of_cut"] == "break") & (F.size(cuts) == 0))
        return F.when(cuts_here, F.concat(cuts, F.array(F.struct(t["i"].cast("int").alias("i"), (t["kind_of_cut"] == "join").alias("joined"))))).otherwise(cuts)

    cuts = gathered.select("sentence_id", F.aggregate("able", none, step).alias("cuts"))
    numbered = tokens.join(cuts, "sentence_id")
    passed = F.filter("cuts", lambda c: c["i"] <= F.col("i"))
    return numbered.withColumns({"clause": F.size(passed), "joined": F.coalesce(F.try_element_at(passed, F.lit(-1))["joined"], F.lit(False))}).drop("cuts")


def clause_roles(tokens: DataFrame) -> DataFrame:
    """One row per clause: predicate, subject, object, indirect_object, experiencer, possessor, inherited, word_order, matches, main.

    `tokens` come from `clause_numbers` and have case, gender, number, person, verb_form, in_phrase (inside a prepositional phrase)
    and role (experiencer, possessor or null). The predicate is the last finite verb, else the last infinitive. A clause that a
    joining word opened takes over the nearest earlier subject. matches is three-valued; the main clause is the last with a verb."""
    i, verb = F.col("i"), _verbal(tokens)
    free = (F.col("kind") == "word") & F.col("pos").isin("noun", "proper", "pronoun") & ~F.col("in_phrase") & F.col("role").isNull()
    first = lambda case: F.min(F.when(free & (F.col("case") == case), i))
    features = F.struct("gender", "number", "person", "verb_form", "pos")
    rows = tokens.groupBy("sentence_id", "clause").agg(
        F.max("joined").alias("joined"), F.coalesce(F.max(F.when(verb & (F.col("verb_form") != "infinitive"), i)), F.max(F.when(verb, i))).alias("predicate"),
        first("nom").alias("own_subject"), first("acc").alias("object"), first("dat").alias("indirect_object"),
        F.min(F.when(F.col("role") == "experiencer", i)).alias("experiencer"), F.min(F.when(F.col("role") == "possessor", i)).alias("possessor"),
    )
    earlier = Window.partitionBy("sentence_id").orderBy("clause").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("own_subject", ignorenulls=True).over(earlier)
    takes = F.col("joined") & F.col("own_subject").isNull() & F.col("predicate").isNotNull() & before.isNotNull()
    rows = rows.withColumns({"inherited": takes, "subject": F.when(takes, before).otherwise(F.col("own_subject"))})
    main = Window.partitionBy("sentence_id")
    last = F.coalesce(F.max(F.when(F.col("predicate").isNotNull(), F.col("clause"))).over(main), F.max("clause").over(main))
    rows = rows.withColumn("main", F.col("clause") == last)
    turned = F.when(F.col("object") < F.col("own_subject"), "object first").when(F.col("predicate") < F.col("own_subject"), "verb first")
    rows = rows.withColumn("word_order", turned)
    side = lambda name: tokens.select("sentence_id", F.col("i").alias(name), features.alias(f"{name}_f"))
    both = rows.join(side("subject"), ["sentence_id", "subject"], "left").join(side("predicate"), ["sentence_id", "predicate"], "left")
    past, s = F.col("predicate_f.verb_form") == "past", F.col("subject_f")
    expected = F.when(s["pos"] == "pronoun", s["person"]).when(F.coalesce(s["number"] != "pl", F.lit(True)), F.lit(3))
    compared = both.withColumns({
        "s_gender": F.when(past, s["gender"]), "s_number": s["number"], "s_person": F.when(~past & s.isNotNull(), expected),
        "v_gender": F.col("predicate_f.gender"), "v_number": F.col("predicate_f.number"), "v_person": F.col("predicate_f.person"),
    })
    return agreement(compared).select(
        "sentence_id", "clause", "predicate", "subject", "object", "indirect_object", "experiencer", "possessor", "inherited", "word_order", "matches", "main"
    )


def dependencies(tokens: DataFrame, roles: DataFrame) -> DataFrame:
    """(sentence_id, dependent, head, relation): the clause's roles, then phrases, then single words; the first relation of a dependent wins.

    `tokens` have clause and phrase_head (the head of the prepositional phrase they are in, or null)."""
    named = ["predicate", "subject", "object", "indirect_object", "experiencer", "possessor"]
    edge = lambda dependent, head, relation: F.struct(dependent.cast("int").alias("dependent"), head.cast("int").alias("head"), F.lit(relation).alias("relation"))
    root = F.col("predicate")
    of_roles = roles.select("sentence_id", F.explode(F.array(*[F.when(F.col(n).isNotNull(), edge(F.col(n), F.lit(None) if n == "predicate" else root, n.replace("_", "-"))) for n in named])).alias("e"))
    words = tokens.where("kind = 'word'").join(roles.select("sentence_id", "clause", "predicate"), ["sentence_id", "clause"])
    i, pos, before = F.col("i"), F.col("pos"), F.when(F.col("i") > 0, F.col("i") - 1)
    inside = F.col("phrase_head").isNotNull()
    of_words = words.select("sentence_id", F.array(
        F.when(inside & (pos == "preposition"), edge(i, F.col("phrase_head"), "preposition")), F.when(inside & (i == F.col("phrase_head")), edge(i, root, "prepositional-object")),
        F.when((pos == "particle") & F.lower("text").isin("не", "ни"), edge(i, root, "negation")),
        F.when(inside & (i != F.col("phrase_head")), edge(i, F.col("phrase_head"), "modifier")),
        F.when((pos == "adjective") | (pos == "pronoun") & F.col("type").isin("possessive", "demonstrative"), edge(i, F.coalesce(root, before), "modifier")),
        F.when(pos == "particle", edge(i, before, "modifier")), F.when(pos == "adverb", edge(i, root, "adverbial")), F.when(pos == "conjunction", edge(i, root, "conjunction")),
        F.when((pos == "pronoun") & F.col("type").isin("interrogative/relative", "relative"), edge(i, root, "relative-clause")), F.when(F.col("case") == "voc", edge(i, root, "vocative")),
    ).alias("es")).select("sentence_id", F.posexplode("es").alias("ord", "e"))
    rank = F.create_map(*[F.lit(x) for kv in zip(RELATIONS, range(len(RELATIONS)), strict=True) for x in kv])
    edges = of_roles.withColumn("ord", F.lit(-1)).unionByName(of_words).where("e is not null").select("sentence_id", "ord", "e.*")
    return dependency_edges(edges.withColumn("priority", F.element_at(rank, F.col("relation")))).select("sentence_id", "dependent", "head", "relation")
