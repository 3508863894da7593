"""Benchmark decontamination by templates: typed placeholders, window join and slot consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, maybe_broadcast

#: Words of a template window, literal words it must hold on the benchmark's side, and the share of an
#: item's windows that a document must hold in order.
WINDOW, MIN_LITERAL, MIN_COVERAGE = 8, 4, 0.5
#: Template words in a row that are a leak by themselves.
LONG_RUN = 13
#: Units of measurement that become placeholders after a number.
UNITS = "mm|cm|dm|km|m|mg|g|kg|t|ml|cl|l|s|sec|min|h|hrs|hours|days|weeks|years|miles|feet|ft|inches|in|lb|lbs|oz|usd|eur|dollars|euros|cents|percent"
#: Start and end of a slot's value in marked text; both and '#' are blanked in the input.
_FROM, _TO = "\u0001", "\u0002"


def _templated(text: Column) -> Column:
    """Text with numbers, names and units replaced by #N, #A and #U, each with its value behind it.

    A number is digits with inner punctuation, a unit one of UNITS right after a number, a name a
    capitalised word that does not begin a sentence (a letter, digit, comma or the like comes before)."""
    put = lambda sign, group: f"#{sign}{_FROM}${group}{_TO}"
    t = F.translate(text, f"#{_FROM}{_TO}\u0130", "   I")  # U+0130 is two characters in lower case
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N},;:'\)] )(\p{Lu}[\p{L}'-]*+)", put("A", 1))
    t = F.regexp_replace(t, r"(?<![#\u0001\p{Lu}])(\d+(?:[.,:/-]\d+)*+)", put("N", 1))
    return F.regexp_replace(t, rf"(#N{_FROM}[^{_TO}]*{_TO}) ?((?i:{UNITS}))(?![\p{{L}}\p{{N}}])", "$1 " + put("U", 2))


def template_words(text: Column) -> Column:
    """Lower-cased words and placeholders of a text; punctuation falls away. They are those of slot_words, one for one."""
    bare = F.regexp_replace(_templated(text), f"{_FROM}[^{_TO}]*{_TO}", " ")
    return F.regexp_extract_all(F.lower(bare), F.lit(r"#[nau]|[\p{L}\p{N}]+"), F.lit(0))


def slot_words(text: Column) -> Column:
    """The same words, with each placeholder followed by the value it stands for."""
    return F.regexp_extract_all(_templated(text), F.lit(f"#[NAU]{_FROM}[^{_TO}]*{_TO}|[\\p{{L}}\\p{{N}}]+"), F.lit(0))


def _item_windows(items: DataFrame, words: Column, window: int, min_literal: int) -> DataFrame:
    """(item_id, item_pos, k, is, literal): the windows of each item as k template words joined by blanks.

    k is `window`, but about half the words of an item of 9 to 2 * window words, so that one changed word leaves
    windows on either side of it, and all the words of a shorter one."""
    n = F.size("words")
    k = F.when(n <= window, n).otherwise(F.least(F.lit(window), F.floor((n - 1) / 2).cast("int")))
    literal = F.size(F.filter("w", lambda x: ~x.startswith("#"))) >= F.ceil(F.col("k") * min_literal / window)
    return (
        items.select("item_id", words.alias("words")).where(n > 0).withColumn("k", k)
        .select("item_id", "k", "words", F.explode(F.sequence(F.lit(0), n - F.col("k"))).alias("item_pos"))
        .withColumn("w", F.slice("words", F.col("item_pos") + 1, F.col("k")))
        .select("item_id", "item_pos", "k", F.concat_ws(" ", "w").alias("is"), literal.alias("literal"), F.slice("w", 1, F.col("k") - (F.col("k") + 1) % 2).alias("head"))
    )


def _hits(base: DataFrame, wanted: DataFrame, words: Column, odd: int) -> DataFrame:
    """(doc_id, key, item_id, item_pos, k, shift): where the windows of `odd` or `odd` + 1 words lie in the documents.

    The first `odd` words are the key of one hash join; the words themselves confirm it."""
    names = [f"w{i}" for i in range(odd + 1)]
    n = F.size("words") - (odd - 1)
    at = (
        base.select("doc_id", "key", words.alias("words")).where(F.size("words") >= odd)
        .select("doc_id", "key", F.posexplode(F.arrays_zip(*[F.slice("words", i + 1, n).alias(w) for i, w in enumerate(names)])).alias("pos", "w"))
        .select("doc_id", "key", "pos", *[F.col(f"w.{w}").alias(w) for w in names])
        .select("doc_id", "key", "pos", F.xxhash64(*names[:-1]).alias("h"), *names)
    )
    seeds = wanted.where(F.col("k").isin(odd, odd + 1)).select("item_id", "item_pos", "k", "is", _hash_of("head", odd).alias("h"))
    same = F.when(F.col("k") == odd, F.concat_ws(" ", *names[:-1])).otherwise(F.concat_ws(" ", *names)) == F.col("is")
    return at.join(maybe_broadcast(checkpointed(seeds)), "h").where(same).select("doc_id", "key", "item_id", "item_pos", "k", (F.col("pos") - F.col("item_pos")).alias("shift"))


def _hash_of(words: str, n: int) -> Column:
    return F.xxhash64(*[F.get(words, F.lit(i)) for i in range(n)])


def _runs(at: Column, k: Column) -> Column:
    """Runs (s, e, at) of item words that the windows at the sorted positions `at` cover without a gap."""
    first = F.filter(at, lambda p, i: (i == 0) | (p - F.get(at, i - 1) > k))
    last = F.filter(at, lambda p, i: (i == F.size(at) - 1) | (F.get(at, i + 1) - p > k))
    return F.zip_with(first, last, lambda s, t: F.struct(s.alias("s"), (t + k - 1).alias("e"), F.filter(at, lambda p: p.between(s, t)).alias("at")))


def _agree(pairs: Column) -> Column:
    """Whether each item value has one counterpart in distinct (item value, document value) pairs."""
    return F.size(pairs) == F.size(F.array_distinct(pairs["a"]))


def _in_order(runs: Column) -> Column:
    """Most item words that runs in the order of both texts cover, with slots that agree; a fold over runs by their end."""
    none = F.array().cast("array<struct<e:int,shift:int,n:int,p:array<struct<a:string,b:string>>>>")

    def after(b: Column, r: Column) -> Column:
        start = F.greatest(r["s"], b["e"] + 1, b["e"] + b["shift"] - r["shift"] + 1)
        return F.struct(r["e"].alias("e"), r["shift"].alias("shift"), (b["n"] + r["e"] - start + 1).alias("n"), F.array_union(b["p"], r["p"]).alias("p"), (start <= r["e"]).alias("more"))

    def step(done: Column, r: Column) -> Column:
        alone = F.struct(r["e"].alias("e"), r["shift"].alias("shift"), (r["e"] - r["s"] + 1).alias("n"), r["p"].alias("p"))
        longer = F.filter(F.transform(done, lambda b: after(b, r)), lambda x: x["more"] & _agree(x["p"]))
        longer = F.transform(longer, lambda x: F.struct(x["e"].alias("e"), x["shift"].alias("shift"), x["n"].alias("n"), x["p"].alias("p")))
        best = F.aggregate(longer, alone, lambda x, y: F.when(y["n"] > x["n"], y).otherwise(x))
        return F.concat(done, F.array(best))

    by_end = F.array_sort(runs, lambda x, y: F.coalesce(F.nullif(F.signum(x["e"] - y["e"]), F.lit(0.0)), F.signum(x["shift"] - y["shift"])).cast("int"))
    return F.coalesce(F.array_max(F.transform(F.aggregate(by_end, none, step), lambda b: b["n"])), F.lit(0))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_literal: int = MIN_LITERAL, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, item_id, matched, windows): documents that hold a benchmark item or much of it, as it is or with other numbers, names or units.

    Texts become templates of typed placeholders. Every window of template words of every whole document
    meets the windows of the items in a hash join; the words themselves confirm it. An item's windows have
    `window` words, those of an item of up to 2 * window words fewer (`_item_windows`), and count if enough
    of their words are literal (`min_literal` of a whole window); where none is, the item is looked for
    with its own numbers, names and units. Windows of one alignment that touch make a run of item words.
    A run counts if the slots in it agree: an item's value always has the same counterpart. A document leaks an item if one run has LONG_RUN words, or if
    runs in the order of both texts, with slots that agree, hold as many words as `min_coverage` of the
    item's windows in line would, at least `window` or all of a shorter item.

    `matched` of an item's `windows` lie in runs that count. Null texts or ids match nothing; repeated rows
    count once, different texts of one doc_id apart; each text of an item_id is looked for and the one of which
    most is found counts; empty tables give no rows."""
    named = benchmark.select(F.col("item_id").cast("long").alias("of_item"), "text").where("of_item is not null and text is not null").distinct()
    named = checkpointed(named.withColumn("item_id", F.xxhash64("of_item", "text")))  # an item with several texts is looked for by each
    items = named.drop("of_item")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text").where("doc_id is not null and text is not null")
    text, hits = F.col("text"), None
    typed = checkpointed(_item_windows(items, template_words(text), window, min_literal).where("literal"))
    plain = items.join(typed.select("item_id").distinct(), "item_id", "left_anti")
    plain = checkpointed(_item_windows(plain, F.transform(slot_words(text), F.lower), window, 0))
    for wanted, words in ((typed, template_words(text)), (plain, F.transform(slot_words(text), F.lower))):
        for odd in sorted({(r.k - 1) // 2 * 2 + 1 for r in wanted.select("k").distinct().collect()}):
            more = _hits(base, wanted, words, odd)
            hits = more if hits is None else hits.unionByName(more)
    if hits is None:
        return base.select("doc_id", F.col("doc_id").alias("item_id"), F.lit(0).alias("matched"), F.lit(0).alias("windows")).limit(0)
    every = typed.unionByName(plain).groupBy("item_id", "k").agg(F.count("*").cast("int").alias("windows"), F.max("item_pos").alias("last"))
    need = F.greatest(F.ceil(min_coverage * F.col("windows")).cast("int") + F.col("k") - 1, F.least(F.lit(window), F.col("last") + F.col("k")))
    every = every.select("item_id", "windows", F.least(need, F.lit(LONG_RUN)).alias("least"), need.alias("need"))

    lined = hits.groupBy("doc_id", "key", "item_id", "k", "shift").agg(F.array_sort(F.collect_set("item_pos")).alias("at"))
    runs = F.transform(_runs(F.col("at"), F.col("k")), lambda r: F.struct(F.col("shift"), r["s"].alias("s"), r["e"].alias("e"), r["at"].alias("at")))
    found = lined.withColumn("runs", runs).groupBy("doc_id", "key", "item_id").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    held = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["s"], r["e"])))))
    found = checkpointed(found.join(maybe_broadcast(every), "item_id").where(held >= F.col("least")))

    slots = items.select("item_id", slot_words(text).alias("item_words")).join(found.select("item_id").distinct(), "item_id", "left_semi")
    texts = base.join(maybe_broadcast(found.select("doc_id", "key").distinct()), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
    both = found.join(texts.select("doc_id", "key", slot_words(text).alias("doc_words")), ["doc_id", "key"]).join(maybe_broadcast(slots), "item_id")

    def with_slots(r: Column) -> Column:
        place = F.transform(F.sequence(r["s"], r["e"]), lambda i: F.struct(F.get("item_words", i).alias("a"), F.get("doc_words", i + r["shift"]).alias("b")))
        pairs = F.array_distinct(F.filter(place, lambda p: p["a"].startswith("#")))
        return F.struct(r["shift"].alias("shift"), r["s"].alias("s"), r["e"].alias("e"), r["at"].alias("at"), pairs.alias("p"))

    kept = F.filter(F.transform("runs", with_slots), lambda r: _agree(r["p"]))
    judged = both.select("doc_id", "item_id", "windows", "least", "need", kept.alias("runs"))
    one = F.exists("runs", lambda r: r["e"] - r["s"] + 1 >= F.col("least"))
    leaks = judged.where(F.when(one, True).otherwise(_in_order(F.col("runs")) >= F.col("need")))
    matched = F.size(F.array_distinct(F.flatten("runs.at"))).cast("long")
    found = leaks.select("doc_id", "item_id", matched.alias("matched"), F.col("windows").cast("long").alias("windows")).join(maybe_broadcast(named.select("item_id", "of_item")), "item_id")
    best = found.groupBy("doc_id", F.col("of_item").alias("item_id")).agg(F.max(F.struct("matched", "windows")).alias("best"))
    return best.select("doc_id", "item_id", "best.matched", "best.windows")
