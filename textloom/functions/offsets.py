"""Texts whose white space is collapsed, with ranges of offsets that move along."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: What collapses: white space, no-break spaces and soft hyphens.
_LOOSE = r"\x{0009}-\x{000D} \x{00A0}\x{00AD}"
_RUN = rf"[{_LOOSE}]+|[^{_LOOSE}]+"


def _moved(text: Column, points: Column) -> Column:
    """New offset of each of `points` (code points from 0, in any order), in their order.

    A run of the text that begins at o and n in the old and new text, and is c long in the new one, moves p to n + min(p - o, c).
    Runs and points are sorted together, and running sums carry each run's three numbers on to the points in it, so the work is
    one sort of a row's runs and points however many there are of both."""

    def of_runs(runs: Column) -> Column:
        loose = lambda r: r.rlike(f"^[{_LOOSE}]")
        new = F.transform(runs, lambda r, i: F.when(loose(r), F.when((i == 0) | (i == F.size(runs) - 1), 0).otherwise(1)).otherwise(F.length(r)).cast("long"))
        old = F.transform(runs, lambda r: F.length(r).cast("long"))
        return T.let(F.struct(old.alias("old"), new.alias("new")), of_lengths)

    def of_lengths(size: Column) -> Column:
        before = lambda xs, i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(xs, i - 1))
        ends = T.let(size["old"], T.running_sums)
        starts = F.zip_with(
            F.transform(size["new"], lambda c, i: F.struct(before(size["old"], i).alias("old"), before(size["new"], i).alias("new"), (c - before(size["new"], i)).alias("cap"))),
            ends,
            lambda d, e: F.struct((e).alias("end"), d.alias("d")),
        )
        runs = F.transform(starts, lambda s, i: F.struct((s["end"] - F.get(size["old"], i)).alias("at"), F.lit(-1).alias("point"), s["d"].alias("d")))
        none = F.struct(*[F.lit(0).cast("long").alias(x) for x in ("old", "new", "cap")])
        asked = F.transform(points, lambda p, i: F.struct(p.cast("long").alias("at"), i.alias("point"), none.alias("d")))
        order = lambda a, b: F.when(a["at"] != b["at"], F.when(a["at"] < b["at"], -1).otherwise(1)).otherwise(F.sign(a["point"] - b["point"]).cast("int"))
        return T.let(F.array_sort(F.concat(runs, asked), order), carried)

    def carried(all_: Column) -> Column:
        sums = [T.let(F.transform(all_, lambda x: x["d"][name]), T.running_sums) for name in ("old", "new", "cap")]  # noqa: B023
        at = F.arrays_zip(all_.alias("x"), *[s.alias(n) for s, n in zip(sums, ("o", "n", "c"), strict=True)])
        hit = F.filter(at, lambda z: z["x"]["point"] >= 0)
        placed = F.transform(hit, lambda z: F.struct(z["x"]["point"].alias("point"), (z["n"] + F.least(z["x"]["at"] - z["o"], z["c"])).alias("new")))
        return F.transform(F.array_sort(placed), lambda z: z["new"])

    return T.let(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)), of_runs)


def collapse_ranges(text: Column, ranges: Column) -> Column:
    """struct(text, ranges): white space collapsed and trimmed, `ranges` (an array of structs with start, end and kind) moved along.

    A range of which nothing is left goes. Null texts give null, an empty text an empty one; without ranges the array is empty."""
    clean = F.regexp_replace(F.regexp_replace(text, f"[{_LOOSE}]+", " "), "^ | $", "")
    points = F.flatten(F.transform(ranges, lambda r: F.array(r["start"], r["end"])))
    new = lambda ps: F.transform(ranges, lambda r, i: F.struct(F.get(ps, 2 * i).cast("int").alias("start"), F.get(ps, 2 * i + 1).cast("int").alias("end"), r["kind"].alias("kind")))
    moved = F.filter(T.let(_moved(text, points), new), lambda r: r["end"] > r["start"])
    return F.when(text.isNotNull(), F.struct(clean.alias("text"), F.when(F.size(ranges) > 0, moved).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>")).alias("ranges")))
