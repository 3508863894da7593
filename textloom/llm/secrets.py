"""Secret scan: fixed patterns, and a battery of randomness tests under false-discovery control. SQL expressions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns by kind; a match counts from this many characters of the group on.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"  # the same matches as runs of any length of which the short ones are dropped
KINDS = ("assign", "access", "hex", "random")
#: Candidates of the battery: runs of 20 or more characters with a digit and a letter in them. One that ends in the
#: keyword of an assignment is no candidate, nor is what an assignment covers; BASE_IN tells a base match within a run.
RUN = (
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+"
    r"""(?!(?<=(?i:password|passwd|secret|token|apikey|api_key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12})"""
)
CANDIDATE, BASE_IN = f"(?:{ASSIGN})|({RUN})", "[0-9a-f]{16}|AKIA[A-Z0-9]{14}"
#: Numbers that are summed up in one piece of a running sum.
PIECE = 256
#: Level of each randomness test, share of the encoding's entropy that structured strings reach, false-discovery rate.
LEVEL, STRUCTURED, FDR = 0.01, 0.6, 0.01
_ALPHABETS = (
    ("^[0-9a-f]+$", "0123456789abcdef"), ("^[0-9A-F]+$", "0123456789ABCDEF"), ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"), ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
)
_WIDEST = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_BINS = 400
_SPAN = "array<struct<start:bigint,end:bigint,rank:int,value:string>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(xs: Column) -> Column:
    """Running sums of an array of numbers, piece by piece, as a fold that appends to one long array takes quadratic time."""

    def within(piece: Column) -> Column:
        none = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("sums"))
        add = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["sums"], F.array(acc["sum"] + x)).alias("sums"))
        return F.aggregate(piece, none, add)

    def across(acc: Column, piece: Column) -> Column:
        moved = F.array(F.transform(piece["sums"], lambda x: x + acc["sum"]))
        return F.struct((acc["sum"] + piece["sum"]).alias("sum"), F.concat(acc["sums"], moved).alias("sums"))

    at = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(PIECE))
    none = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<array<bigint>>").alias("sums"))
    return F.aggregate(F.transform(at, lambda i: within(F.slice(xs, i, F.lit(PIECE)))), none, across, lambda acc: F.flatten(acc["sums"]))


def _find(text: Column, pattern: str, rank: int, good: Callable[[Column], Column] = lambda v: F.lit(True)) -> Column:
    """Spans (start, end, rank, value) of the leftmost non-overlapping matches that are `good`, in code points.

    The pieces between matches give the places."""

    def placed(x: Column) -> Column:  # running sums over piece, match, piece, match ...
        lengths = F.flatten(F.zip_with(F.slice(x["pieces"], F.lit(1), F.size(x["found"])), x["found"], lambda p, v: F.array(F.length(p).cast("long"), F.length(v).cast("long"))))
        span = lambda v, i, sums: F.struct(F.get(sums, 2 * i).alias("start"), F.get(sums, 2 * i + 1).alias("end"), F.lit(rank).alias("rank"), v.alias("value"))
        return _let(_let(lengths, _running), lambda sums: F.filter(F.transform(x["found"], lambda v, i: span(v, i, sums)), lambda s: good(s["value"])))

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(pattern), _let(both, placed).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def candidates(text: Column) -> Column:
    """Spans of the runs that the battery tests: no base match touches them."""
    run = lambda v: v.rlike(f"^(?:{RUN})$") & ~v.rlike(BASE_IN) & ~v.rlike(f"^(?:{ASSIGN})")
    return _find(text, CANDIDATE, 3, run)


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z) by a logistic approximation good to 2e-4."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def battery(value: Column) -> Column:
    """struct(p_random, p_structured) of a string, by the encoding its characters infer.

    p_random is the least of three p-values under randomness, times three: a chi-squared test that its
    alphabet is used uniformly (Wilson-Hilferty), a runs test above and below the alphabet's middle, and
    the lag-1 serial correlation. p_structured bounds the chance that a string of a structured source,
    with STRUCTURED of the encoding's entropy, looks as diverse: 2^-(length x surplus entropy), so a
    short string needs more surplus than a long one."""
    alphabet = F.lit(_WIDEST)
    for pattern, letters in reversed(_ALPHABETS):
        alphabet = F.when(value.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    clean = F.translate(value, "-_", "+/")
    base = F.struct(F.split(clean, "").alias("chars"), alphabet.alias("abc"), F.length(clean).cast("double").alias("n"), F.length(alphabet).cast("double").alias("a"))

    def measured(b: Column) -> Column:
        index = F.transform(F.filter(b["chars"], lambda c: c != ""), lambda c: (F.instr(b["abc"], c) - 1).cast("double"))
        return F.struct(
            b["n"].alias("n"), b["a"].alias("a"), index.alias("i"),
            F.transform(F.array_distinct(index), lambda v: F.size(F.filter(index, lambda w: w == v)).cast("double")).alias("counts"),
            (F.aggregate(index, F.lit(0.0), lambda s, v: s + v) / b["n"]).alias("mean"),
        )

    def tested(m: Column) -> Column:
        n, a = m["n"], m["a"]
        total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
        chi = total(m["counts"], lambda c: c * c) * a / n - n
        k = a - 1
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
        high = total(m["i"], lambda v: F.when(v >= a / 2, 1.0).otherwise(0.0))
        pairs = F.arrays_zip(F.slice(m["i"], F.lit(1), (n - 1).cast("int")).alias("x"), F.slice(m["i"], F.lit(2), (n - 1).cast("int")).alias("y"))
        runs = 1 + total(pairs, lambda p: F.when((p["x"] >= a / 2) != (p["y"] >= a / 2), 1.0).otherwise(0.0))
        mu = 2 * high * (n - high) / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        z_runs = F.when(var > 0, (runs - mu) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(F.lit(12.0))
        spread = total(m["i"], lambda v: (v - m["mean"]) * (v - m["mean"]))
        serial = total(pairs, lambda p: (p["x"] - m["mean"]) * (p["y"] - m["mean"]))
        z_serial = F.when(spread > 0, serial / F.greatest(spread, F.lit(1e-9)) * F.sqrt(n)).otherwise(F.lit(12.0))
        entropy = F.least(total(m["counts"], lambda c: -(c / n) * F.log2(c / n)) + (F.size(m["counts"]) - 1) / (2 * n * math.log(2)), F.log2(a))
        surplus = F.greatest(entropy - STRUCTURED * F.log2(a), F.lit(0.0))
        p = F.least(_upper_tail(z_chi), 2 * _upper_tail(F.abs(z_runs)), 2 * _upper_tail(F.abs(z_serial)))
        return F.struct(F.least(3 * p, F.lit(1.0)).alias("p_random"), F.pow(F.lit(2.0), -F.least(n * surplus, F.lit(900.0))).alias("p_structured"))

    return _let(_let(base, measured), tested)


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for each row of `docs` (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, ordered by start, then kind, comma-joined.
    The patterns give the base spans. Runs of 20 or more characters that no base match touches are random
    when the battery does not reject randomness and when, over the runs of all documents, their
    p_structured passes the Benjamini-Hochberg procedure at `fdr`. That needs one histogram of p-values
    with at most 401 bins; everything else is a narrow projection, so no key can be hot.

    Null texts count as empty: no spans, the digest of ''. Repeated rows give a row each; other columns
    are left out; an empty table gives no rows."""
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    pbin = lambda p: F.least(F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300)))), F.lit(_BINS)).cast("int")
    runs = base.select(F.explode(candidates(F.col("text"))).alias("r")).select(battery(F.col("r.value")).alias("p"))
    bins = runs.groupBy(pbin(F.col("p.p_structured")).alias("bin")).count().collect()  # at most 401 rows
    least, seen, total = _BINS + 1, 0, sum(r["count"] for r in bins)
    for r in sorted(bins, key=lambda r: -r["bin"]):
        seen += r["count"]
        if 10 ** (-r["bin"] / 10) * total <= fdr * seen:
            least = r["bin"]
    passed = lambda p: (p["p_random"] > LEVEL) & (pbin(p["p_structured"]) >= least)
    known = base.select(
        "doc_id",
        _find(F.col("text"), ASSIGN, 0, lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 12).alias("assign"),
        _find(F.col("text"), ACCESS, 1, lambda v: F.length(v) >= 18).alias("access"), _find(F.col("text"), HEX, 2).alias("hex"),
        F.filter(candidates(F.col("text")), lambda r: _let(battery(r["value"]), passed)).alias("random"),
    )
    ordered = lambda xs: F.array_sort(F.transform(xs, lambda s: F.struct(s["start"], s["rank"], s["end"])))
    name = lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda *xs: F.array_join(F.transform(ordered(F.concat(*xs)), name), ",")
    return known.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("assign", "access", "hex"), 256).alias("base_sha256"), joined("assign", "access", "hex", "random").alias("spans"),
    )
