"""Drills of words over the vocabulary of `documents` and of letters for each learner of `events`, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pronounce as P
from ..operators import drills as D
from .corpus import read
from .features import CONFUSABLE, PAIRS
from .lexicon import Fixture
from .sound import SQL as SOUND_SQL
from .sound import stressed_words

Q: dict = {}
SQL: dict = {}

ALPHABET = "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"
#: Names of the letters.
NAMES = "а бэ вэ гэ дэ е ё жэ зэ и и_краткое ка эль эм эн о пэ эр эс тэ у эф ха цэ че ша ща твёрдый_знак ы мягкий_знак э ю я".replace("_", "\xa0").split(" ")


def _sound(letter: str) -> str | None:
    """What a letter says by itself: vowels of е's kind begin with a glide, signs are silent."""
    if letter in P.STRESSED:
        return ("j" if letter in P.IOTATED else "") + P.STRESSED[letter][0]
    return P.CONSONANTS[letter][0] if letter in P.CONSONANTS else None


_KIND = lambda c: "vowel" if c in P.VOWELS else "sign" if c in P.SILENT else "consonant"
INVENTORY = Fixture("letters", "symbol string, kind string, sound string, name string", [(c, _KIND(c.lower()), _sound(c.lower()), n.replace("\xa0", " ")) for c, n in zip(ALPHABET, NAMES, strict=True)])
CONTRASTS = Fixture("pairs", "symbol string, other string", PAIRS)


def word_drills(spark, sf_dir):
    words = stressed_words(spark, sf_dir).where("stress = -1")
    spread = words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")  # few bytes, dear to pronounce: AQE would make one task
    said = spread.select("word", P.pronounce(F.col("word"), F.col("stress"))["translit"].alias("translit"))
    return D.word_drills(said).withColumn("options", F.array_join("options", " "))


Q["word_drills"] = word_drills
SQL["word_drills"] = f"""
WITH said AS (SELECT DISTINCT word, translit FROM ({SOUND_SQL['pronunciations']}) WHERE stress = -1),
sounds AS (SELECT DISTINCT translit AS t, md5(translit) AS h FROM said),
keyed AS (SELECT *, substr(h, 1, (SELECT greatest(0, ceil(log(greatest(count(*), 1) / {D.BUCKET}.0) / log(16) - 1e-9))::INT FROM sounds)) AS bucket FROM sounds),
rings AS (SELECT bucket, list(t ORDER BY h, t) AS ring FROM keyed GROUP BY 1),
near AS (SELECT ring[i] AS translit, [ring[(i + k - 1) % len(ring) + 1] FOR k IN range(0, least(4, len(ring)))] AS o FROM (SELECT ring, unnest(range(1, len(ring) + 1)) AS i FROM rings)),
shown AS (SELECT translit, string_agg(x, ' ' ORDER BY md5(translit || '#' || x)) AS options FROM (SELECT translit, unnest(o) AS x FROM near WHERE len(o) >= 3) GROUP BY 1),
marked AS (SELECT *, array_to_string([c FOR c, i IN string_split(upper(word), '') IF list_position(string_split(upper(word), ''), c) = i], '') AS symbols FROM said)
SELECT word, 'word' AS mode, translit AS answer, options, symbols FROM marked JOIN shown USING (translit)
UNION ALL SELECT word, 'cursive', translit, '', symbols FROM marked"""


def letter_drills(spark, sf_dir):
    """Each learner knows the letters that their events' values point at."""
    at = F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(len(ALPHABET))).cast("int")
    known = read(spark, sf_dir, "events").select(F.col("user_id").alias("learner"), F.substr(F.lit(ALPHABET), at + 1, F.lit(1)).alias("symbol"))
    found = D.letter_drills(known, INVENTORY.df(spark), CONFUSABLE.df(spark), CONTRASTS.df(spark))
    return found.withColumn("options", F.array_join("options", " "))


Q["letter_drills"] = letter_drills
_BY = "string_agg(o, ' ' ORDER BY md5('0#' || o)) AS options"
SQL["letter_drills"] = f"""
WITH {INVENTORY.sql}, {CONFUSABLE.sql}, {CONTRASTS.sql},
known AS (SELECT DISTINCT user_id AS learner, substr('{ALPHABET}', (round(value * 100)::BIGINT % {len(ALPHABET)})::INT + 1, 1) AS symbol FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
held AS (SELECT learner, l.*, count(*) OVER (PARTITION BY learner) AS held FROM known JOIN letters l USING (symbol)),
cand AS (SELECT h.*, o.symbol AS other, o.sound AS osound, k.symbol IS NOT NULL OR held < 4 AS pooled, c.other IS NULL AS later, md5(h.symbol || '|' || o.symbol || '|0') AS m
  FROM held h JOIN letters o ON o.kind = h.kind AND o.symbol <> h.symbol LEFT JOIN known k ON k.learner = h.learner AND k.symbol = o.symbol LEFT JOIN confusable c ON c.symbol = h.symbol AND c.other = o.symbol),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY learner, symbol ORDER BY later, m) AS rn FROM cand WHERE pooled) WHERE rn <= 3),
seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY learner, symbol ORDER BY later, m) AS rn FROM cand) WHERE rn <= 3),
others AS (SELECT DISTINCT learner, 'symbol_to_sound' AS mode, symbol, symbol AS prompt, sound AS answer, osound AS o FROM near WHERE sound IS NOT NULL AND osound IS NOT NULL AND osound <> sound
  UNION ALL SELECT learner, 'sound_to_symbol', symbol, sound, symbol, other FROM near WHERE sound IS NOT NULL UNION ALL SELECT learner, 'visual', symbol, name, symbol, other FROM seen),
enough AS (SELECT *, count(*) OVER (PARTITION BY learner, mode, symbol) AS n FROM others),
listed AS (SELECT learner, mode, symbol, prompt, answer, o FROM enough WHERE n >= 2 UNION ALL SELECT DISTINCT learner, mode, symbol, prompt, answer, answer FROM enough WHERE n >= 2),
target AS (SELECT a.learner, p.symbol, p.other, CASE WHEN md5(a.learner || '|' || p.symbol || '|' || p.other || '|0') < '8' THEN p.symbol ELSE p.other END AS t
  FROM pairs p JOIN held a ON a.symbol = p.symbol JOIN held b ON b.symbol = p.other AND b.learner = a.learner)
SELECT learner, mode, symbol, prompt, answer, {_BY} FROM listed GROUP BY ALL
UNION ALL SELECT learner, 'contrast', t.symbol, coalesce(l.sound, l.name), t, CASE WHEN md5('0#' || t.symbol) < md5('0#' || t.other) THEN t.symbol || ' ' || t.other ELSE t.other || ' ' || t.symbol END
  FROM target t JOIN letters l ON l.symbol = t.t"""
