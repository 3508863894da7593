"""Format-preserving pseudonyms for personal data, in Spark SQL expressions only.

A value is validated by its kind's rule, taken apart into two residues, run through a keyed Feistel
network over Z_a x Z_b and put back into its format, with check digits computed anew. The network is a
bijection for each kind, so equal values keep one pseudonym across documents and unequal ones stay apart."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("email", "phone", "card", "ssn", "ip", "iban", "date")
_DATE = r"\d{4}[-/]\d{2}[-/]\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}"
_BARE_PHONE = r"(?:1[ .-])?[2-9]\d{2}[.-]\d{3}[.-]\d{4}"
#: What can be personal data; the kind and its validation follow from the match.
PATTERN = "|".join([
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)",
    r"(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    rf"(?<![\w./+-]){_BARE_PHONE}(?![\w/-]|\.\d)",
    rf"(?<![\w./-])(?:{_DATE}|\d{{3}}-\d{{2}}-\d{{4}}|\d{{1,3}}(?:\.\d{{1,3}}){{3}})(?![\w/-]|\.\d)",
    r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)",
])
#: The dates that are permuted: 1900-01-01 to 2099-12-31, 73049 = 17 x 4297 days.
_FIRST_DAY, _DAYS_A, _DAYS_B = "1900-01-01", 17, 4297


def _number(c: Column) -> Column:
    return F.coalesce(F.when(c != "", c).cast("long"), F.lit(0).cast("long"))


def round_keys(key: str) -> tuple[str, str]:
    """The inner and outer key of the rounds' hashes, derived on the driver, so that `key` itself is in no plan or log."""
    inner, outer = (hmac.new(key.encode(), name, hashlib.sha256).hexdigest() for name in (b"inner", b"outer"))
    return inner, outer


def feistel(left: Column, right: Column, a: Column, b: Column, tweak: Column, key: str) -> Column:
    """struct(l, r): a keyed permutation of Z_a x Z_b. Rounds add a keyed hash of one side to the other in turn.

    The hash is nested like an HMAC, SHA-256(outer, SHA-256(inner, message))."""
    inner, outer = round_keys(key)

    def step(acc: Column, i: Column) -> Column:
        side = F.when(i % 2 == 0, acc["r"]).otherwise(acc["l"])
        message = F.concat_ws("|", F.lit(inner), tweak, a.cast("string"), b.cast("string"), i.cast("string"), side.cast("string"))
        digest = F.sha2(F.concat(F.lit(outer), F.sha2(message, 256)), 256)
        f = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        return F.struct(
            F.when(i % 2 == 0, F.pmod(acc["l"] + F.pmod(f, a), a)).otherwise(acc["l"]).alias("l"),
            F.when(i % 2 == 1, F.pmod(acc["r"] + F.pmod(f, b), b)).otherwise(acc["r"]).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _digits(d: Column, tweak: str, key: str) -> Column:
    """Permutes a string of up to 36 digits among those of its length."""
    u, v = F.floor(F.length(d) / 2).cast("int"), F.ceil(F.length(d) / 2).cast("int")
    power = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
    lr = feistel(_number(F.substr(d, F.lit(1), u)), _number(F.substr(d, u + 1, v)), power(u), power(v), F.lit(tweak), key)
    return _let(lr, lambda x: F.concat(F.when(u > 0, F.lpad(x["l"].cast("string"), u, "0")).otherwise(""), F.lpad(x["r"].cast("string"), v, "0")))


def _put_digits(m: Column, digits: Column) -> Column:
    """`m` with its digits replaced in order."""
    return F.array_join(F.zip_with(F.split(m, "[0-9]", -1), F.concat(F.split(digits, ""), F.array(F.lit(""))), lambda p, d: F.concat(p, d)), "")


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes payload + digit pass the Luhn test."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(payload), ""), lambda c, i: F.when(i % 2 == 0, F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))).otherwise(c.cast("int"))),
        F.lit(0), lambda acc, x: acc + x,
    )
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def iban_rest(country: Column, check: Column, bban: Column) -> Column:
    """Remainder modulo 97 of an IBAN's number; a valid one has 1."""
    return F.aggregate(
        F.split(F.concat(bban, country, check), ""), F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )


def kind_of(m: Column) -> Column:
    """The kind whose rule a match passes; null if it passes none and stays as it is."""
    d = _only_digits(m)
    read = lambda sign, *patterns: F.when(m.contains(sign), F.coalesce(*[F.try_to_timestamp(m, F.lit(p)) for p in patterns]))
    day = F.coalesce(read("-", "yyyy-MM-dd"), read("/", "M/d/yyyy", "d/M/yyyy", "yyyy/MM/dd"), read(".", "d.M.yyyy")).cast("date")
    bare = F.replace(m, F.lit(" "), F.lit(""))
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), F.when(iban_rest(F.substring(bare, 1, 2), F.substring(bare, 3, 2), F.substr(bare, F.lit(5))) == 1, "iban"))
        .when(m.rlike(rf"^(?:{_DATE})$"), F.when(day.between(F.lit(_FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date")), "date"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(m.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"), "ssn"))
        .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), F.when(F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255), "ip"))
        .when(m.rlike(rf"^(?:[+(]|{_BARE_PHONE}$)"), "phone")
        .when(F.length(d).between(13, 19) & (luhn_digit(F.substr(d, F.lit(1), F.length(d) - 1)) == F.substr(d, F.length(d), F.lit(1))), "card")
    )


def pseudonym(kind: Column, m: Column, key: str) -> Column:
    """The pseudonym of a match of a kind; the match itself where kind is null."""
    d = _only_digits(m)

    def letters(s: Column) -> Column:  # chunks of up to 26 letters a-z, each permuted among those of its length
        chars = "abcdefghijklmnopqrstuvwxyz"
        value = lambda x: F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: acc * 26 + F.instr(F.lit(chars), c) - 1)
        text = lambda x, n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.lit(chars), F.pmod(F.floor(x / F.pow(F.lit(26.0), n - i)).cast("long"), F.lit(26)).cast("int") + 1, F.lit(1))), "")

        def chunk(c: Column) -> Column:
            u, v = F.floor(F.length(c) / 2).cast("int"), F.ceil(F.length(c) / 2).cast("int")
            power = lambda n: F.aggregate(F.sequence(F.lit(0), n), F.lit(1).cast("long"), lambda acc, i: F.when(i == 0, acc).otherwise(acc * 26))
            lr = feistel(value(F.substr(c, F.lit(1), u)), value(F.substr(c, u + 1, v)), power(u), power(v), F.lit("letters"), key)
            return _let(lr, lambda x: F.concat(F.when(u > 0, text(x["l"], u)).otherwise(""), text(x["r"], v)))

        return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(".{1,20}"), F.lit(0)), chunk), "")

    def email() -> Column:
        local, domain = F.lower(F.substring_index(m, "@", 1)), F.substring_index(m, "@", -1)
        word = F.regexp_replace(local, "[^a-z]", "")
        named = F.array_join(F.zip_with(F.split(local, "[a-z]", -1), F.concat(F.filter(F.split(letters(word), ""), lambda c: c != ""), F.array(F.lit(""))), lambda p, c: F.concat(p, c)), "")
        number = F.regexp_extract_all(named, F.lit("[0-9]{1,18}"), F.lit(0))
        numbers = F.transform(number, lambda x: _digits(x, "email", key))
        made = F.array_join(F.zip_with(F.split(named, "[0-9]{1,18}", -1), F.concat(numbers, F.array(F.lit(""))), lambda p, x: F.concat(p, x)), "")
        cased = F.zip_with(F.split(F.substring_index(m, "@", 1), ""), F.split(made, ""), lambda old, new: F.when(old.rlike("[A-Z]"), F.upper(new)).otherwise(new))
        return F.concat(F.array_join(cased, ""), F.lit("@"), domain)

    def phone() -> Column:
        """Country code and national number, whatever the notation, are taken first, so that all notations of a number get one
        pseudonym. Without a plus the country is 1; the code and the first digit of ten national ones stay."""
        plus = m.startswith("+")
        code = F.when(plus, F.when(d.startswith("1"), 1).otherwise(2)).when((F.length(d) == 11) & d.startswith("1"), 1).otherwise(0)
        kept = code + F.when((F.length(d) - code == 10) & (~plus | d.startswith("1")), 1).otherwise(0)
        return _let(kept, lambda k: _put_digits(m, F.concat(F.left(d, k), _digits(F.substr(d, k + 1), "phone", key))))

    def card() -> Column:  # the first digit, which tells the scheme, stays
        payload = F.concat(F.substring(d, 1, 1), _digits(F.substr(d, F.lit(2), F.length(d) - 2), "card", key))
        return _let(payload, lambda p: _put_digits(m, F.concat(p, luhn_digit(p))))

    def ssn() -> Column:
        area, group, serial = (F.substr(m, F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
        lr = feistel(F.when(area < 666, area - 1).otherwise(area - 2), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), F.lit("ssn"), key)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return _let(lr, lambda x: F.concat(pad(F.when(x["l"] < 665, x["l"] + 1).otherwise(x["l"] + 2), 3), F.lit("-"), pad(F.floor(x["r"] / 9999) + 1, 2), F.lit("-"), pad(x["r"] % 9999 + 1, 4)))

    def ip() -> Column:
        o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
        lr = feistel(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), F.lit(65536), F.lit(65536), F.lit("ip"), key)
        return _let(lr, lambda x: F.concat_ws(".", F.floor(x["l"] / 256).cast("string"), (x["l"] % 256).cast("string"), F.floor(x["r"] / 256).cast("string"), (x["r"] % 256).cast("string")))

    def iban() -> Column:
        bare = F.replace(m, F.lit(" "), F.lit(""))
        country, bban = F.substring(bare, 1, 2), F.substr(bare, F.lit(5))
        new = F.when(bban.rlike("[0-9]"), _put_digits(bban, _digits(_only_digits(bban), "iban", key))).otherwise(bban)
        full = _let(new, lambda b: F.concat(country, F.lpad((F.lit(98) - iban_rest(country, F.lit("00"), b)).cast("string"), 2, "0"), b))
        return F.array_join(F.zip_with(F.split(m, "[A-Z0-9]", -1), F.concat(F.split(full, ""), F.array(F.lit(""))), lambda p, c: F.concat(p, c)), "")

    def date() -> Column:
        def moved(pattern: str, padded: str) -> Column:
            day = F.try_to_timestamp(m, F.lit(pattern)).cast("date")
            n = F.datediff(day, F.lit(_FIRST_DAY).cast("date"))
            lr = feistel(F.floor(n / _DAYS_B), n % _DAYS_B, F.lit(_DAYS_A), F.lit(_DAYS_B), F.lit("date"), key)
            new = _let(lr, lambda x: F.date_add(F.lit(_FIRST_DAY).cast("date"), (x["l"] * _DAYS_B + x["r"]).cast("int")))
            return F.when(m.rlike(r"^\d\d\D\d\d\D"), F.date_format(new, padded)).otherwise(F.date_format(new, pattern))

        us = F.try_to_timestamp(m, F.lit("M/d/yyyy")).isNotNull()
        slashed = F.when(m.rlike("^[0-9]{4}/"), moved("yyyy/MM/dd", "yyyy/MM/dd")).when(us, moved("M/d/yyyy", "MM/dd/yyyy")).otherwise(moved("d/M/yyyy", "dd/MM/yyyy"))
        return F.when(m.contains("-"), moved("yyyy-MM-dd", "yyyy-MM-dd")).when(m.contains("/"), slashed).otherwise(moved("d.M.yyyy", "dd.MM.yyyy"))

    made = {"email": email(), "phone": phone(), "card": card(), "ssn": ssn(), "ip": ip(), "iban": iban(), "date": date()}
    out = F.when(F.lit(False), m)
    for k in KINDS:
        out = out.when(kind == k, made[k])
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with personal data in `text` replaced by pseudonyms, and n_email ... n_date (long) added.

    Emails keep their domain and the shape and case of the local part, phone numbers their country code, cards
    their first digit and a right check digit, social security numbers and IBANs their validity,
    addresses of the IP kind four octets, dates (1900 to 2099) their notation. What fails its rule, such
    as a card number with a wrong check digit, stays. One `key` gives one pseudonym per value everywhere, a phone number or a
    date in all its notations included. Not looked for: dates with month names or two-digit years, phone numbers with a
    trunk zero in front of them, addresses of IP version 6.

    A narrow projection: no shuffle, no group, so hot sources and repeated rows don't matter. Null and
    empty texts pass with counts 0; columns with the names of the counts are replaced."""
    docs = docs.drop(*[f"n_{k}" for k in KINDS])
    possible = F.col(text).rlike("[0-9@]")
    found = F.when(possible, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # the columns of docs stay inside a struct, so that none clashes with a helper
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(found, F.array().cast("array<string>")).alias("found"))
    base = base.select("row", "found", F.transform("found", kind_of).alias("kinds"))
    new = F.zip_with("kinds", "found", lambda k, m: pseudonym(k, m, key))
    whole = F.col("row")[text]
    joined = F.array_join(F.zip_with(F.split(whole, PATTERN, -1), F.concat(new, F.array(F.lit(""))), lambda p, x: F.concat(p, x)), "")
    changed = F.when(F.exists("kinds", lambda k: k.isNotNull()), joined).otherwise(whole)
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long")
    return base.select(*[(changed if c == text else F.col("row")[c]).alias(c) for c in docs.columns], *[count(k).alias(f"n_{k}") for k in KINDS])
