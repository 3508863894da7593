"""Alphabet drills: distractors confusable first, then by a hash of symbol and seed, so a drill is the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import kept


def distractors(letters: DataFrame, confusable: DataFrame, seed: int = 0, n: int = 3) -> DataFrame:
    """(symbol, options): the symbol and up to `n` others of its kind, in hash order.

    `letters` has symbol and kind, `confusable` symbol and other. Both are closed lists of a few dozen rows."""
    other = letters.select(F.col("symbol").alias("other"), F.col("kind").alias("o_kind"))
    pairs = letters.join(F.broadcast(other), (F.col("kind") == F.col("o_kind")) & (F.col("symbol") != F.col("other")))  # an alphabet
    ranked = pairs.join(F.broadcast(confusable.withColumn("hard", F.lit(0))), ["symbol", "other"], "left")
    w = Window.partitionBy("symbol").orderBy(F.coalesce("hard", F.lit(1)), F.md5(F.concat_ws("|", "symbol", "other", F.lit(seed))), "other")
    top = ranked.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    shuffled = lambda c: F.md5(F.concat_ws("#", F.lit(seed), c))
    made = top.groupBy("symbol").agg(F.collect_list("other").alias("o")).where(F.size("o") >= 2)
    keyed = F.array_sort(F.transform(F.concat("o", F.array("symbol")), lambda c: F.struct(shuffled(c).alias("h"), c.alias("c"))))
    return made.select("symbol", keyed.getField("c").alias("options"))


#: Words of one bucket, on average at most; a word's distractors come from its bucket.
BUCKET = 4096


def word_drills(said: DataFrame, n: int = 3) -> DataFrame:
    """(word, mode, answer, options, symbols): for each word of `said` (word, translit) its sound among `n` of other words, and the
    same word to be read in cursive, which the learner grades.

    Sounds are ordered by their hash in buckets by its first digits, as many as keep a bucket near BUCKET sounds, and a sound's
    distractors are the next ones round its bucket: no pairs are built and no order of the whole vocabulary. Where fewer than two
    others are in the bucket there is no drill of sounds. Repeated rows count once; rows without word or sound are left out."""
    words = kept(said.select("word", "translit").distinct()).where("word is not null and translit is not null")
    h = F.md5("translit")
    sounds = words.select("translit").distinct()
    size = sounds.agg(F.greatest(F.lit(0), F.ceil(F.log(16.0, F.greatest(F.count("*"), F.lit(1)) / BUCKET) - 1e-9)).cast("int").alias("digits"))
    keyed = sounds.join(F.broadcast(size)).select("translit", h.alias("h"), F.substr(h, F.lit(1), F.col("digits")).alias("bucket"))  # one row
    by = Window.partitionBy("bucket")
    ranked = keyed.select("*", F.row_number().over(by.orderBy("h", "translit")).alias("rn"), F.count("*").over(by).alias("cnt"))
    turned = ranked.select("*", F.explode(F.when(F.col("rn") <= n, F.array("rn", F.col("rn") + F.col("cnt"))).otherwise(F.array("rn"))).alias("place"))
    order = by.orderBy("place")
    near = [F.when(F.lit(k) < F.col("cnt"), F.lead("translit", k).over(order)) for k in range(1, n + 1)]
    others = turned.select("translit", "place", "cnt", F.array_compact(F.array(*near)).alias("others")).where("place <= cnt and size(others) >= 2")
    shown = F.array_sort(F.transform(F.concat(F.array("translit"), "others"), lambda o: F.struct(F.md5(F.concat_ws("#", "translit", o)).alias("h"), o.alias("o"))))
    symbols = F.array_join(F.array_distinct(F.transform(F.split("word", ""), F.upper)), "")
    heard = words.join(others.select("translit", shown.getField("o").alias("options")), "translit").select("word", F.lit("word").alias("mode"), F.col("translit").alias("answer"), "options", symbols.alias("symbols"))
    written = words.select("word", F.lit("cursive").alias("mode"), F.col("translit").alias("answer"), F.array().cast("array<string>").alias("options"), symbols.alias("symbols"))
    return heard.unionByName(written)


def letter_drills(known: DataFrame, letters: DataFrame, confusable: DataFrame, pairs: DataFrame, seed: int = 0, n: int = 3) -> DataFrame:
    """(learner, mode, symbol, prompt, answer, options) of each letter that a learner knows: symbol_to_sound, sound_to_symbol and
    visual, and contrast (symbol is the first of the pair) for each pair of which both are known.

    `known` has learner and symbol; `letters` (symbol, kind, sound, name), `confusable` (symbol, other) and `pairs` (symbol, other)
    are closed lists of the alphabet. Distractors are of the letter's kind, confusable ones first, then by a hash; sounds come from
    the known letters, or from all where fewer than four are known, and visual always from all. Where fewer than two distractors
    are left, or the letter has no sound, there is no drill. Unknown symbols and null learners are left out."""
    dim = letters.select("symbol", "kind", "sound", "name")
    held = known.where("learner is not null").select("learner", "symbol").distinct().join(F.broadcast(dim), "symbol")  # an alphabet
    sets = held.groupBy("learner").agg(F.collect_set("symbol").alias("set"))  # at most an alphabet
    hard = confusable.groupBy("symbol").agg(F.collect_set("other").alias("hard"))
    every = dim.agg(F.collect_list(F.struct("symbol", "kind", "sound")).alias("every"))
    asked = held.join(sets, "learner").join(F.broadcast(hard), "symbol", "left").join(F.broadcast(every))
    pool = F.when(F.size("set") >= 4, F.filter("every", lambda x: F.array_contains(F.col("set"), x["symbol"]))).otherwise(F.col("every"))

    def some(of):
        other = F.filter(of, lambda x: (x["kind"] == F.col("kind")) & (x["symbol"] != F.col("symbol")))
        rank = lambda x: F.struct((~F.coalesce(F.array_contains(F.col("hard"), x["symbol"]), F.lit(False))).alias("later"), F.md5(F.concat_ws("|", F.col("symbol"), x["symbol"], F.lit(seed))).alias("h"), x.alias("x"))
        return F.slice(F.array_sort(F.transform(other, rank)), 1, n)

    found = asked.select("learner", "symbol", "sound", "name", some(pool).getField("x").alias("near"), some(F.col("every")).getField("x").alias("seen"))
    heard = F.filter(F.array_distinct(F.col("near.sound")), lambda s: s.isNotNull() & (s != F.col("sound")))
    shuffled = lambda answer, others: F.array_sort(F.transform(F.concat(F.array(answer), others), lambda o: F.struct(F.md5(F.concat_ws("#", F.lit(seed), o)).alias("h"), o.alias("o")))).getField("o")

    def mode(name, prompt, answer, others, sounded):
        item = F.struct(F.lit(name).alias("mode"), prompt.alias("prompt"), answer.alias("answer"), shuffled(answer, others).alias("options"))
        return F.when((F.size(others) >= 2) & (F.col("sound").isNotNull() if sounded else F.lit(True)), item)

    symbol, sound, name = F.col("symbol"), F.col("sound"), F.col("name")
    modes = F.array(
        mode("symbol_to_sound", symbol, sound, heard, True), mode("sound_to_symbol", sound, symbol, F.col("near.symbol"), True), mode("visual", name, symbol, F.col("seen.symbol"), False),
    )
    single = found.select("learner", "symbol", F.explode(F.array_compact(modes)).alias("m")).select("learner", "m.mode", "symbol", "m.prompt", "m.answer", "m.options")
    both = sets.join(F.broadcast(pairs.select("symbol", "other")), F.expr("array_contains(set, symbol) AND array_contains(set, other)"))
    target = F.when(F.substring(F.md5(F.concat_ws("|", F.col("learner").cast("string"), "symbol", "other", F.lit(seed))), 1, 1) < "8", F.col("symbol")).otherwise(F.col("other"))
    which = both.select("learner", F.col("symbol").alias("first"), "other", target.alias("symbol")).join(F.broadcast(dim), "symbol")
    contrast = which.select("learner", F.lit("contrast").alias("mode"), F.col("first").alias("symbol"), F.coalesce("sound", "name").alias("prompt"), symbol.alias("answer"), shuffled(F.col("first"), F.array("other")).alias("options"))
    return single.unionByName(contrast)
