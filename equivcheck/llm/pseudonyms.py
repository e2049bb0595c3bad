"""Format-preserving Feistel pseudonyms for personal numbers, dates and addresses in texts.

Only built-in expressions; a document passes through one projection.  A value that is valid for
its kind is replaced by a keyed permutation of the *valid* values of its format.  So equal values
have equal pseudonyms in all documents, and different values of a kind different ones, those included
that are not valid and stay as they are; the key undoes it:

* cards: 13 to 19 digits that pass the Luhn check, also in groups of four; the check digit is made
  anew, so the pseudonym passes as well;
* IBANs with or without blanks that pass the check modulo 97; country and letters stay, the check
  digits are made anew;
* dates: real dates from 1800 to 2199 as yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, dd/mm/yyyy, the latter
  two also with one digit for day and month; the pseudonym is a real date of that range in the same
  form, and a date keeps its pseudonym across forms (mm/dd/yyyy is read only where dd/mm/yyyy is no
  date; its pseudonym can be read day first and then be that of another date);
* IPv4 addresses with numbers up to 255; IPv6 addresses, shortened ones too, from 2000::/3, fc00::/7 and
  fe80::/10: the first group stays, the pseudonym is written in full;
* phone numbers with a country code, which stays, with and without separators (a number has one
  pseudonym in both); national ones with a leading zero, or as (555) 123-4567;
* social security numbers; e-mail addresses (letters and digits before the @); hexadecimal keys of 32
  to 64 digits in either case (capitals come out in capitals, mixed case in lower case; a key has one
  pseudonym in all cases).

Digits outside these kinds, and values that are not valid, stay as they are.  A null text stays
null; rows repeat as they come in; other columns pass through, whatever their names.

The key is the caller's, or the session's setting ``equivcheck.pseudonyms.key``; without one the session
draws a key of its own.  Spark writes expressions into plans and event logs, and the key is part of them.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equivcheck.llm.common import let, unused

ROUNDS = 10
DIGITS, HEX, ALNUM = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789"
SETTING = "equivcheck.pseudonyms.key"
# Days from 1800-01-01 to 2199-12-31: one cycle of the calendar, 189 x 773.
DATE_A, DATE_B = 189, 773

# Country codes of telephone numbers, of one and two digits; all others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

_V6 = r"(?:[23][0-9A-Fa-f]{3}|[Ff][CcDd][0-9A-Fa-f]{2}|[Ff][Ee][89ABab][0-9A-Fa-f])"

KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![0-9A-Za-z])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9A-Za-z/-])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "ip6": rf"(?<![0-9A-Za-z:.]){_V6}(?:(?::[0-9A-Fa-f]{{1,4}}){{7}}|(?::[0-9A-Fa-f]{{1,4}}){{0,6}}::(?:[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}}){{0,5}})?)(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9A-Za-z])\+(?:[1-9][0-9]{7,14}|[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,8}){1,4})(?![0-9A-Za-z])",
    "trunk": r"(?<![0-9A-Za-z+.,-])0[1-9](?:(?: [0-9]{2}){4}|[0-9]{1,4}[ /-][0-9]{3,8}(?:[ -][0-9]{2,8}){0,2})(?![0-9A-Za-z])",
    "area": r"(?<![0-9A-Za-z])\([2-9][0-9]{2}\) ?[0-9]{3}-[0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7})(?![0-9A-Za-z-])",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 256)


def _shifted(text: Column, digest: Column, alphabet: str) -> Column:
    """Each character moved on in its alphabet by two digits of the digest; up to 32 characters."""

    def move(i: Column) -> Column:
        at = F.position(F.substring(text, i, F.lit(1)), F.lit(alphabet)) - 1
        by = F.conv(F.substring(digest, i * 2 - 1, F.lit(2)), 16, 10).cast("int")
        return F.substring(F.lit(alphabet), (at + by) % len(alphabet) + 1, F.lit(1))

    n = F.length(text)
    moved = F.array_join(F.transform(F.sequence(F.lit(1), n), move), "")
    return F.when(n == 0, F.lit("")).otherwise(moved)


def permuted(text: Column, alphabet: str, key: str, kind: str) -> Column:
    """Keyed permutation of the strings of one length over an alphabet, up to 64 characters."""
    n = F.length(text)
    half = (n / 2).cast("int")
    first = F.struct(
        F.substring(text, F.lit(1), half).alias("a"),
        F.substring(text, half + 1, n).alias("b"),
    )

    def step(s: Column, r: Column) -> Column:
        digest = _hash(key, F.lit(kind), n, r, s["b"])
        return let(
            digest,
            lambda d: F.struct(s["b"].alias("a"), _shifted(s["a"], d, alphabet).alias("b")),
        )

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    mixed = F.aggregate(rounds, first, step, lambda s: F.concat(s["a"], s["b"]))
    single = _shifted(text, _hash(key, F.lit(kind), F.lit(1)), alphabet)
    return F.when(n < 2, single).otherwise(mixed)


def permuted_pair(a: Column, b: Column, sizes: tuple, key: str, kind: str) -> Column:
    """Keyed permutation of the pairs of whole numbers below two sizes, as a struct (a, b)."""
    size_a, size_b = (F.lit(x).cast("long") for x in sizes)

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        other = F.when(even, s["b"]).otherwise(s["a"])
        by = F.conv(F.substring(_hash(key, F.lit(kind), size_b, r, other), 1, 12), 16, 10).cast("long")
        return F.struct(
            F.when(even, (s["a"] + by) % size_a).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise((s["b"] + by) % size_b).alias("b"),
        )

    first = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, step)


def _padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _refilled(template: Column, values: Column) -> Column:
    """The template with its letters and digits replaced, in order, by the characters of ``values``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, i: Column) -> Column:
        here = F.substring(template, i, F.lit(1))
        fills = here.rlike("[A-Za-z0-9]")
        put = F.when(fills, F.substring(values, s["k"], F.lit(1))).otherwise(here)
        return F.struct(
            F.concat(s["out"], put).alias("out"), (s["k"] + fills.cast("int")).alias("k")
        )

    return F.aggregate(F.sequence(F.lit(1), F.length(template)), start, step, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _in_place(value: Column, alphabet: str, key: str, kind: str) -> Column:
    flat = F.regexp_replace(F.lower(value), "[^a-z0-9]", "")
    return let(permuted(flat, alphabet, key, kind), lambda p: _refilled(value, p))


def _card(value: Column, key: str) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)

    def closed(p: Column) -> Column:
        ends = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(p, d.cast("string")))
        return _refilled(value, F.filter(ends, lambda x: _luhn(x)).getItem(0))

    # Zeros all over pass the check and are no number of anyone: what would become zeros is permuted again.
    once = permuted(body, DIGITS, key, "card")
    whole = let(once, lambda p: F.when(p.rlike("^0+$"), permuted(p, DIGITS, key, "card")).otherwise(p))
    made = let(whole, closed)
    return F.when(_luhn(digits) & ~digits.rlike("^0+$"), made).otherwise(value)


def _ip(value: Column, key: str) -> Column:
    part = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))

    def mixed(p: Column) -> Column:
        first = F.struct(
            (p[0] * 256 + p[1]).cast("long").alias("a"), (p[2] * 256 + p[3]).cast("long").alias("b")
        )

        def step(s: Column, r: Column) -> Column:
            by = F.conv(F.substring(_hash(key, F.lit("ip"), r, s["b"]), 1, 12), 16, 10).cast("long")
            return F.struct(s["b"].alias("a"), ((s["a"] + by) % 65536).alias("b"))

        def shown(s: Column) -> Column:
            numbers = [s["a"] / 256, s["a"] % 256, s["b"] / 256, s["b"] % 256]
            return F.concat_ws(".", *[F.floor(x).cast("string") for x in numbers])

        out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, step, shown)
        good = ~F.exists(p, lambda x: x > 255) & ~value.rlike(r"(?:^|\.)0[0-9]")
        return F.when(good, out).otherwise(value)

    return let(part, mixed)


def _number(value: Column, at: int, size: int) -> Column:
    return F.substring(value, at, size).cast("int")


def _is_date(y: Column, m: Column, d: Column) -> Column:
    month = F.when(m.between(1, 12), m).otherwise(1)
    year = F.when(y.between(1800, 2199), y).otherwise(2000)
    last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    return y.between(1800, 2199) & m.between(1, 12) & (d >= 1) & (d <= last)


def _date(value: Column, key: str) -> Column:
    def moved(y: Column, m: Column, d: Column, form: str) -> Column:
        origin = F.to_date(F.lit("1800-01-01"))
        index = F.date_diff(F.make_date(y, m, d), origin)
        first = F.struct(F.floor(index / DATE_B).alias("a"), (index % DATE_B).cast("long").alias("b"))

        def step(s: Column, r: Column) -> Column:
            even = r % 2 == 0
            other = F.when(even, s["b"]).otherwise(s["a"])
            by = F.conv(F.substring(_hash(key, F.lit("date"), r, other), 1, 12), 16, 10).cast("long")
            return F.struct(
                F.when(even, (s["a"] + by) % DATE_A).otherwise(s["a"]).alias("a"),
                F.when(even, s["b"]).otherwise((s["b"] + by) % DATE_B).alias("b"),
            )

        def shown(s: Column) -> Column:
            return F.date_format(F.date_add(origin, (s["a"] * DATE_B + s["b"]).cast("int")), form)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, step, shown)

    def parsed(part: Column) -> Column:
        number = F.transform(part, lambda x: x.cast("int"))

        def chosen(n: Column) -> Column:
            year_first, day_first, month_first = (n[0], n[1], n[2]), (n[2], n[1], n[0]), (n[2], n[0], n[1])
            single = (F.length(part[0]) == 1) | (F.length(part[1]) == 1)
            dashes, dots = value.contains("-"), value.contains(".")
            return (
                F.when(F.length(part[0]) == 4, F.when(~_is_date(*year_first), value)
                    .when(dashes, moved(*year_first, "yyyy-MM-dd")).otherwise(moved(*year_first, "yyyy/MM/dd")))
                .when(dots, F.when(~_is_date(*day_first), value)
                    .when(single, moved(*day_first, "d.M.yyyy")).otherwise(moved(*day_first, "dd.MM.yyyy")))
                .when(_is_date(*day_first), F.when(single, moved(*day_first, "d/M/yyyy")).otherwise(moved(*day_first, "dd/MM/yyyy")))
                .when(_is_date(*month_first), F.when(single, moved(*month_first, "M/d/yyyy")).otherwise(moved(*month_first, "MM/dd/yyyy")))
                .otherwise(value)
            )

        return let(number, chosen)

    return let(F.split(value, "[./-]"), parsed)


def _ssn(value: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, numbers 0001 to 9999."""
    area, group, number = _number(value, 1, 3), _number(value, 5, 2), _number(value, 8, 4)
    index = area - 1 - (area > 666).cast("int")

    def shown(s: Column) -> Column:
        at = F.floor(s["a"] / 99)
        back = at + 1 + (at >= 665).cast("int")
        return F.concat_ws("-", _padded(back, 3), _padded(s["a"] % 99 + 1, 2), _padded(s["b"] + 1, 4))

    made = let(permuted_pair(index * 99 + group - 1, number - 1, (898 * 99, 9999), key, "ssn"), shown)
    good = ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.when(good, made).otherwise(value)


def _national(value: Column, key: str) -> Column:
    """Numbers after a zero, 7 to 13 digits of which the first is not zero; others stay."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    rest = F.length(digits) - 5
    size = F.pow(F.lit(10.0), rest).cast("long")

    def shown(s: Column) -> Column:
        return _refilled(value, F.concat(F.lit("0"), _padded(s["a"] + 1000, 4), _padded(s["b"], rest)))

    tail = F.substring(digits, F.lit(6), rest).cast("long")
    made = let(permuted_pair(_number(digits, 2, 4) - 1000, tail, (9000, size), key, "trunk"), shown)
    return F.when(rest.between(3, 9), made).otherwise(value)


def _area(value: Column, key: str) -> Column:
    """Three, three and four digits, the first of them 2 or more."""
    digits = F.regexp_replace(value, "[^0-9]", "")

    def shown(s: Column) -> Column:
        return _refilled(value, F.concat((s["a"] + 200_000).cast("string"), _padded(s["b"], 4)))

    return let(permuted_pair(_number(digits, 1, 6) - 200_000, _number(digits, 7, 4), (800_000, 10_000), key, "area"), shown)


def _modulo_97(text: Column) -> Column:
    """Remainder of digits and letters (A is 10) read as one number."""

    def step(rest: Column, i: Column) -> Column:
        at = F.position(F.substring(text, i, F.lit(1)), F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1
        return F.when(at < 10, (rest * 10 + at) % 97).otherwise((rest * 100 + at) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)


def _iban(value: Column, key: str) -> Column:
    flat = F.regexp_replace(value, " ", "")
    country, account = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))
    digits = F.regexp_replace(account, "[^0-9]", "")

    def closed(mixed: Column) -> Column:
        # Letters keep their places, the digits in between are replaced in order.
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

        def step(s: Column, i: Column) -> Column:
            here = F.substring(account, i, F.lit(1))
            digit = here.rlike("[0-9]")
            put = F.when(digit, F.substring(mixed, s["k"], F.lit(1))).otherwise(here)
            return F.struct(F.concat(s["out"], put).alias("out"), (s["k"] + digit.cast("int")).alias("k"))

        body = F.aggregate(F.sequence(F.lit(1), F.length(account)), start, step, lambda s: s["out"])
        return let(
            body,
            lambda b: _refilled(
                value, F.concat(country, _padded(98 - _modulo_97(F.concat(b, country, F.lit("00"))), 2), b)
            ),
        )

    made = let(permuted(digits, DIGITS, key, "iban"), closed)
    good = (_modulo_97(F.concat(account, F.substring(flat, 1, 4))) == 1) & _number(flat, 3, 2).between(2, 98)
    return F.when(good & (digits != ""), made).otherwise(value)


def _ip6(value: Column, key: str) -> Column:
    low = F.lower(value)

    def filled(side: Column) -> Column:
        return F.filter(F.split(side, ":"), lambda x: x != "")

    head, tail = filled(F.substring_index(low, "::", 1)), F.when(low.contains("::"), filled(F.substring_index(low, "::", -1)))
    tail = F.coalesce(tail, F.array().cast("array<string>"))
    missing = F.lit(8) - F.size(head) - F.size(tail)

    def shown(groups: Column) -> Column:
        wide = F.transform(groups, lambda x: F.lpad(x, 4, "0"))
        rest = F.array_join(F.slice(wide, 2, 7), "")
        return let(
            permuted(rest, HEX, key, "ip6"),
            lambda p: F.concat(wide[0], F.regexp_replace(p, "(.{4})", ":$1")),
        )

    every = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), tail)
    good = F.when(low.contains("::"), missing >= 1).otherwise(missing == 0)
    return F.when(good, let(every, shown)).otherwise(value)


def _phone(value: Column, key: str) -> Column:
    parted = r"^\+[0-9]{1,3}(?=[^0-9])"
    country = F.when(value.rlike(parted), F.regexp_extract(value, parted, 0)).otherwise(F.regexp_extract(value, COUNTRY, 0))
    number = F.substring(value, F.length(country) + 1, F.length(value))
    numeric = F.length(F.regexp_replace(number, "[^0-9]", ""))
    return F.when(numeric.between(6, 14), F.concat(country, _in_place(number, DIGITS, key, "phone"))).otherwise(value)


def _secret(value: Column, key: str) -> Column:
    capitals = value.rlike("[A-F]") & ~value.rlike("[a-f]")
    return let(_in_place(value, HEX, key, "secret"), lambda p: F.when(capitals, F.upper(p)).otherwise(p))


def _split_at(value: Column, pattern: str) -> tuple[Column, Column]:
    head = F.regexp_extract(value, pattern, 0)
    return head, F.substring(value, F.length(head) + 1, F.length(value))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value, or the value if it is not valid."""
    local, domain = _split_at(value, "^[^@]*")
    forms = {name: f"^(?:{pattern})$" for name, pattern in KINDS.items()}
    made = {
        "iban": _iban, "date": _date, "ip": _ip, "ip6": _ip6, "trunk": _national,
        "area": _area, "ssn": _ssn, "card": _card, "secret": _secret,
    }
    out = F.when(value.contains("@"), F.concat(_in_place(local, ALNUM, key, "email"), domain))
    out = out.when(value.startswith("+"), _phone(value, key))
    for name, made_of in made.items():
        out = out.when(value.rlike(forms[name]), made_of(value, key))
    return out.otherwise(value)


def session_key(spark: SparkSession) -> str:
    """The session's key; one that has none draws it and keeps it."""
    key = spark.conf.get(SETTING, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(SETTING, key)
    return key


def replace(
    docs: DataFrame, text: str = "text", key: str | None = None, count: str = "n_pii"
) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``count`` (long), the values replaced in it.

    A column of the name of ``count`` is replaced.
    """
    key = key or session_key(docs.sparkSession)
    found_name, made_name = unused(docs, "found", "made")
    whole = F.col(f"`{text}`")
    # Most texts hold no digit and no address: they are not taken apart.
    some = whole.rlike("[0-9@]")
    found = F.when(some, F.regexp_extract_all(whole, F.lit(PATTERN), F.lit(0)))
    values = docs.withColumn(found_name, F.coalesce(found, F.array().cast("array<string>")))
    values = values.withColumn(made_name, F.transform(found_name, lambda v: pseudonym(v, key)))
    changed = F.size(F.filter(F.zip_with(found_name, made_name, lambda a, b: a != b), lambda x: x))
    between = F.split(whole, PATTERN, -1)
    glued = F.array_join(
        F.zip_with(
            between,
            made_name,
            lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))),
        ),
        "",
    )
    made = F.when(F.size(made_name) > 0, glued).otherwise(whole)
    return values.select(
        *[made.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c != count],
        changed.cast("long").alias(count),
    )
