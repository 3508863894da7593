"""Pronunciation of the vocabulary of `documents`, read as Cyrillic; the SQL decides voicing by windows instead of a fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pronounce as P
from ..functions import text as T
from ..operators import segment as S
from .corpus import _q, read, sql_tokens

Q: dict = {}
SQL: dict = {}


def _reading_sql() -> str:
    c = "text"
    for latin, cyrillic in T.DIGRAPHS.items():
        c = f"replace({c}, '{latin}', '{cyrillic}')"
    return f"translate({c}, {_q(T.LATIN_52)}, {_q(T.CYRILLIC_52)})"


def sql_normal(c: str) -> str:
    for x, y in T.MARKED_PAIRS.items():
        c = f"replace({c}, '{x}', '{y}')"
    return f"lower(translate(regexp_replace(translate({c}, 'ѐѝЀЍ', 'еиЕИ'), '[{T.ACUTE}{T.GRAVE}]', '', 'g'), '’ʼ`´', ''''''''''))"


def stressed_words(spark, sf_dir):
    """(word, stress) of the distinct words, each without a stress and with one on its middle vowel."""
    docs = read(spark, sf_dir, "documents").select(T.cyrillic_reading(F.col("text")).alias("text"))
    words = S.surface_counts(docs, []).where("kind = 'word'").select(F.lower(T.normalize(F.col("surface"))).alias("word")).distinct()
    places = F.filter(F.transform(F.split("word", ""), lambda ch, i: F.when(ch.isin(list(P.VOWELS)), i)), lambda i: i.isNotNull())
    middle = T.let(places, lambda p: F.coalesce(F.get(p, F.floor(F.size(p) / 2).cast("int")), F.lit(-1)))
    return words.select("word", F.explode(F.array_distinct(F.array(F.lit(-1), middle))).alias("stress"))


def pronunciations(spark, sf_dir):
    said = P.pronounce(F.col("word"), F.col("stress"))
    return stressed_words(spark, sf_dir).select("word", "stress", said.alias("s")).select("word", "stress", "s.translit", "s.ipa", "s.confidence", F.array_join("s.notes", "; ").alias("notes"))


def _of(table: dict[str, tuple[str, str]], which: int, c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v[which]}'" for k, v in table.items()) + " END"


def _any(c: str, letters: str) -> str:
    return f"{c} IN ({', '.join(map(_q, letters))})"


def _listed(words: list[str]) -> str:
    return ", ".join(map(_q, words))


_GLIDE = "CASE WHEN " + _any("ch", P.IOTATED) + " AND opens THEN {} ELSE '' END"
_FULL = f"[{_GLIDE.format(_q('j'))} || {_of(P.STRESSED, 0, 'ch')}, {_GLIDE.format(_q('y'))} || {_of(P.STRESSED, 1, 'ch')}, NULL]"

SQL["pronunciations"] = f"""
WITH {sql_tokens(_reading_sql(), 'doc_id')},
vocab AS (SELECT DISTINCT {sql_normal('surface')} AS word FROM tok WHERE kind = 'word'),
vowels AS (SELECT word, list_filter(range(length(word)), lambda i: {_any('word[i + 1]', P.VOWELS)}) AS p FROM vocab),
asked AS (SELECT word, -1 AS stress FROM vowels UNION SELECT word, coalesce(p[len(p) // 2 + 1], -1) FROM vowels),
bodies AS (SELECT word, stress, word IN ({_listed(P.SHTO)}) AS shto, word IN ({_listed(P.SHN)}) AS shn, CASE WHEN shto THEN substr(word, 2) ELSE word END AS body,
    CASE WHEN stress < 0 THEN -1 WHEN shto THEN greatest(stress - 1, 0) ELSE stress END AS beat FROM asked),
letters AS (SELECT *, body[i + 1] AS ch, CASE WHEN {_any('ch', P.VOWELS)} THEN 'V' WHEN {_any('ch', P.SONORANTS)} THEN 'S' WHEN {_any('ch', P.OBSTRUENTS)} THEN 'O' WHEN ch = 'в' THEN 'B' WHEN {_any('ch', P.SILENT)} THEN 'Q' ELSE 'X' END AS cls,
    length(regexp_replace(body, '[{P.SILENT}]+$', '')) - 1 AS last_sound FROM (SELECT *, unnest(range(length(body))) AS i FROM bodies)),
breaks AS (SELECT *, min(CASE WHEN cls IN ('V', 'S', 'B') THEN i END) OVER (PARTITION BY word, stress ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS brk,
    coalesce(lead(ch) OVER w, '') AS following, lag(ch) OVER w AS prev FROM letters WINDOW w AS (PARTITION BY word, stress ORDER BY i)),
runs AS (SELECT *, max(CASE WHEN cls = 'O' THEN i END) OVER (PARTITION BY word, stress, brk) AS last_o FROM breaks),
signs AS (SELECT *, CASE WHEN last_o IS NULL THEN NULL WHEN {_any('body[last_o + 1]', P.VOICED)} AND last_o < last_sound THEN '+' ELSE '-' END AS run_sign,
    prev IS NULL OR {_any('prev', P.VOWELS + P.SILENT)} AS opens,
    CASE WHEN beat >= 0 AND {_any('body[beat + 1]', P.VOWELS)} THEN (SELECT max(x) FROM unnest(range(beat)) t(x) WHERE {_any('body[x + 1]', P.VOWELS)}) END AS pretonic,
    CASE WHEN ends_with(body, 'ться') THEN length(body) - 4 WHEN ends_with(body, 'тся') THEN length(body) - 3 END AS cluster FROM runs),
changed AS (SELECT *, CASE WHEN {_any('ch', 'хцчщ')} THEN false WHEN cls = 'B' THEN coalesce(run_sign = '-', false) WHEN {_any('ch', P.VOICED)} THEN run_sign = '-' WHEN cls = 'O' THEN run_sign = '+' ELSE false END AS changes,
    CASE WHEN changes THEN translate(ch, {_q(P.VOICED + P.VOICELESS)}, {_q(P.VOICELESS + P.VOICED)}) ELSE ch END AS base, i = last_sound AND cls = 'O' AND {_any('ch', P.VOICED)} AS final FROM signs),
said AS (SELECT *, changes AND NOT final AND NOT (shn AND following = 'н') AS shift, CASE WHEN i > coalesce(cluster, 1000000) THEN ['', '', NULL]
    WHEN cls = 'V' THEN CASE WHEN ch = 'ё' OR i = beat OR beat < 0 THEN {_FULL}
        WHEN ch IN ('о', 'а') THEN CASE WHEN i = pretonic THEN ['ɐ', 'a', ch || ' before the stress → [ɐ]'] ELSE ['ə', 'a', ch || ' unstressed → [ə]'] END
        WHEN ch IN ('е', 'я') THEN [{_GLIDE.format(_q('j'))} || 'ɪ', {_GLIDE.format(_q('y'))} || 'e', ch || ' unstressed → [ɪ]'] ELSE {_FULL} END
    WHEN shn AND ch = 'ч' AND following = 'н' THEN ['ʂn', 'shn', {_q(P.SHN_NOTE)}] WHEN shn AND ch = 'н' AND prev = 'ч' THEN ['', '', NULL]
    WHEN ch = 'г' AND body = 'бог' THEN ['x', 'kh', {_q(P.GOD_NOTE)}] WHEN ch = 'г' AND following = 'к' THEN ['x', 'kh', {_q(P.GK_NOTE)}]
    WHEN ch = 'г' AND regexp_matches(body, '[ое]го$') AND i = length(body) - 2 THEN ['v', 'v', {_q(P.OGO_NOTE)}] WHEN i = cluster THEN ['tsə', 'tsa', {_q(P.TSA_NOTE)}]
    WHEN cls IN ('O', 'S', 'B') THEN [{_of(P.CONSONANTS, 0, 'base')} || CASE WHEN NOT {_any('ch', P.ALWAYS_SOFT + P.ALWAYS_HARD)} AND {_any('following', P.SOFTENING + 'ь')} THEN 'ʲ' ELSE '' END, {_of(P.CONSONANTS, 1, 'base')},
        CASE WHEN changes AND cls = 'B' THEN {_q(P.V_NOTE)} WHEN changes AND final THEN 'final ' || ch || ' devoiced → [' || {_of(P.CONSONANTS, 0, 'base')} || ']'
            WHEN changes THEN ch || ' assimilates in voicing to the next consonant → [' || {_of(P.CONSONANTS, 0, 'base')} || ']' END] ELSE ['', '', NULL] END AS s FROM changed),
told AS (SELECT *, s[3] IS NOT NULL AND (s[3] NOT LIKE '%assimilates%' AND s[3] <> {_q(P.V_NOTE)} OR row_number() OVER (PARTITION BY word, stress, s[3] LIKE '%assimilates%' OR s[3] = {_q(P.V_NOTE)} ORDER BY i) = 1) AS tell FROM said)
SELECT word, stress, CASE WHEN shto THEN 'sh' ELSE '' END || string_agg(s[2], '' ORDER BY i) AS translit, '[' || CASE WHEN shto THEN 'ʂ' ELSE '' END || string_agg(s[1], '' ORDER BY i) || ']' AS ipa,
    CAST(CASE WHEN stress < 0 THEN 0.7 WHEN shto OR shn THEN 0.9 ELSE 1 END AS DOUBLE) AS confidence,
    concat_ws('; ', CASE WHEN stress < 0 THEN {_q(P.UNKNOWN_STRESS)} END, CASE WHEN shto THEN word || {_q(P.SHTO_NOTE)} END, string_agg(s[3], '; ' ORDER BY i) FILTER (WHERE tell)) AS notes
FROM told GROUP BY word, stress, shto, shn
"""
Q["pronunciations"] = pronunciations
