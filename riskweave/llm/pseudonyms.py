"""Personal data under format-preserving pseudonyms.

One regular expression finds candidates, validators decide: cards by prefix, length and the Luhn sum, US phone and
social security numbers by the ranges of their parts, IPv4 by its octets, dates by the calendar.  A validated number
or date becomes its place in the list of all valid values of its format; a Feistel network with keyed SHA-256 rounds,
adding in turn modulo a and modulo b for a list of a*b values, permutes the places; the new place is written in the old
format, separators and all.  So equal values get equal pseudonyms in every document, different values different ones,
and a card stays a card of its issuer (its check digit is computed anew, its first four digits stay).  Formats that are no such list,
e-mail addresses and secrets, get keyed hashes in their own alphabet and length.

All of it is DataFrame functions: the text is split at the matches, the matches are mapped, both are joined again; no
shuffle.  Null text stays null, empty text empty; candidates that are not valid stay as they are; texts are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# Formats.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
ISO_DATE = r"(?<![0-9-])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9-])"
SLASH_DATE = r"(?<![0-9/])[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2}(?![0-9/])"
DOT_DATE = r"(?<![0-9.])[0-9]{1,2}\.[0-9]{1,2}\.(?:19|20)[0-9]{2}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z])[3-6](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
# Card numbers by first digits and length.
ISSUERS = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11,16}|(?:35|6[0-9])[0-9]{14,17}|5[06-9][0-9]{10,17})$"
CLOUD_KEY = r"(?<![0-9A-Za-z])A(?:KI|SI)A[A-Z2-7]{16}(?![0-9A-Za-z])"
HEX_KEY = r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])"
PASSWORD = r"(?<=[=: \"'])(?<=(?:password|passwd|secret|token|api_key)[\"']?[ ]{0,2}[=:][ ]{0,2}[\"']?)[A-Za-z0-9!#$%&*+./=?^_~-]{7,}[A-Za-z0-9]"

KINDS = (
    ("email", EMAIL), ("ipv4", IPV4), ("date", f"{ISO_DATE}|{SLASH_DATE}|{DOT_DATE}"), ("ssn", SSN), ("phone", PHONE), ("card", CARD),
    ("secret", f"{CLOUD_KEY}|{HEX_KEY}|{PASSWORD}"),
)
ANY = "|".join(f"(?:{p})" for _, p in KINDS)

FIRST_DAY = "1900-01-01"
LAST_DAY = "2099-12-31"
DAYS_A, DAYS_B = 17, 4297  # 17 * 4297 days from FIRST_DAY to LAST_DAY

#: What every match holds at least: a digit, an @ or the mark of a secret; hexadecimal keys may be letters alone.
SOME = "[0-9@]|A(?:KI|SI)A|password|passwd|secret|token|api_key|[a-f]{32}"


def _long(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("long")


def _div(x: Column, by: Column) -> Column:
    return F.call_function("div", x, by)


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _keyed(key: str, *what: Column) -> Column:
    """A number below 2^60 from the key and what."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[w.cast("string") for w in what]).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def permute(x: Column, a: Column, b: Column, key: str, kind: str | Column) -> Column:
    """The place of x, of a*b places, under the keyed permutation of this kind."""

    name = kind if isinstance(kind, Column) else F.lit(kind)

    def turn(s: Column, i: Column) -> Column:
        left, right = s["l"], s["r"]
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(
            F.when(even, F.pmod(left + F.pmod(_keyed(key, name, i, right), a), a)).otherwise(left).alias("l"),
            F.when(even, right).otherwise(F.pmod(right + F.pmod(_keyed(key, name, i, left), b), b)).alias("r"),
        )

    start = F.struct(_div(x, b).alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _zeros(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _refill(m: Column, digits: Column) -> Column:
    """m with its digits replaced in turn."""
    places = F.sequence(F.lit(1), F.length(m))
    return F.array_join(F.transform(places, lambda p: F.when(F.substr(m, p, F.lit(1)).rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(m, F.lit(1), p))), F.lit(1))).otherwise(F.substr(m, p, F.lit(1)))), "")


def _part(digits: Column, start: int, n: int) -> Column:
    return F.substring(digits, start, n).cast("long")


def _power(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n.cast("int"))).cast("long")


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    n = F.length(d) - 5
    left, right = F.floor(n / 2), n - F.floor(n / 2)
    place = permute(F.substr(d, F.lit(5), n).cast("long"), _power(left), _power(right), key, "card")
    body = F.concat(F.substring(d, 1, 4), _zeros(place, n))
    check = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(body, c.cast("string"))), lambda c: _luhn(c))
    return _refill(m, F.element_at(check, 1))


def _phone(m: Column, key: str) -> Column:
    d = F.substring(_digits(m), -10, 10)
    place = permute((_part(d, 1, 3) - 200) * 8_000_000 + (_part(d, 4, 3) - 200) * 10_000 + _part(d, 7, 4), _long(800), _long(8_000_000), key, "phone")
    rest = F.pmod(place, _long(8_000_000))
    new = F.concat(_zeros(_div(place, _long(8_000_000)) + 200, 3), _zeros(_div(rest, _long(10_000)) + 200, 3), _zeros(F.pmod(rest, _long(10_000)), 4))
    return _refill(m, F.concat(F.substring(_digits(m), 1, 1).substr(F.lit(1), F.length(_digits(m)) - 10), new))


def _ssn(m: Column, key: str) -> Column:
    d = _digits(m)
    area = _part(d, 1, 3)
    small = 99 * 9999
    place = permute((area - F.when(area > 666, 2).otherwise(1)) * small + (_part(d, 4, 2) - 1) * 9999 + _part(d, 6, 4) - 1, _long(898), _long(small), key, "ssn")
    rest = F.pmod(place, _long(small))
    first = _div(place, _long(small)) + 1
    last = F.pmod(rest, _long(9999))
    return F.concat_ws("-", _zeros(F.when(first >= 666, first + 1).otherwise(first), 3), _zeros(_div(rest, _long(9999)) + 1, 2), _zeros(last + 1, 4))


def _ipv4(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    x = ((F.get(o, 0) * 256 + F.get(o, 1)) * 256 + F.get(o, 2)) * 256 + F.get(o, 3)
    place = permute(x, _long(65536), _long(65536), key, "ipv4")
    return F.concat_ws(".", *[F.shiftright(place, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def _day(m: Column) -> Column:
    """The date that m names, else null."""
    y, rest = F.regexp_extract(m, "(?:19|20)[0-9]{2}", 0), F.split(F.regexp_replace(m, "^[0-9]{4}-|[/.](?:19|20)[0-9]{2}$", ""), "[-/.]")
    one, two = F.get(rest, 0), F.get(rest, 1)
    date = lambda month, day: F.try_to_date(F.concat_ws("-", y, _zeros(month, 2), _zeros(day, 2)), "yyyy-MM-dd")
    return F.when(F.contains(m, F.lit(".")), date(two, one)).when(F.contains(m, F.lit("-")), date(one, two)).otherwise(F.coalesce(date(one, two), date(two, one)))


def _walk(x: Column, a: Column, b: Column, key: str, kind: str, valid) -> Column:
    """permute() within the valid places: what lands on another goes on.  Less than one place in ten is not valid, so 24 steps always do."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(23)), permute(x, a, b, key, kind), lambda s, _: F.when(valid(s), s).otherwise(permute(s, a, b, key, kind)))


def _date(m: Column, key: str) -> Column:
    """Order, separators and the number of digits of each part stay.

    Dates with two digits for day and month are places in the list of all days, the same one however they are written;
    others, and those with a slash whose day comes first and so is above 12, are places in year x month x day.
    """
    first = F.lit(FIRST_DAY).cast("date")
    place = permute(F.datediff(_day(m), first).cast("long"), _long(DAYS_A), _long(DAYS_B), key, "date")
    new = F.date_add(first, place.cast("int"))
    dot, slash = F.contains(m, F.lit(".")), F.contains(m, F.lit("/"))
    parts = F.split(m, "[./-]")
    one, two = F.get(parts, F.when(dot | slash, 0).otherwise(1)), F.get(parts, F.when(dot | slash, 1).otherwise(2))
    turned = slash & ((one.cast("int") > 12) | F.try_to_date(F.concat_ws("-", F.get(parts, 2), _zeros(one, 2), _zeros(two, 2)), "yyyy-MM-dd").isNull())
    day_first = dot | turned
    month, day = F.when(day_first, two).otherwise(one), F.when(day_first, one).otherwise(two)
    low, days = F.when(turned, 13).otherwise(1).cast("long"), F.when(turned, 19).when(F.length(day) == 1, 9).otherwise(31).cast("long")
    months = F.when(F.length(month) == 1, 9).otherwise(12).cast("long")

    def split(x: Column) -> tuple[Column, Column, Column]:
        rest = _div(x, days)
        return _div(rest, months) + 1900, F.pmod(rest, months) + 1, F.pmod(x, days) + low

    def valid(x: Column) -> Column:
        y, mo, d = split(x)
        leap = (F.pmod(y, F.lit(4)) == 0) & ((F.pmod(y, F.lit(100)) != 0) | (F.pmod(y, F.lit(400)) == 0))
        return d <= F.when(mo == 2, F.when(leap, 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)

    at = ((F.get(parts, 2).cast("long") - 1900) * months + month.cast("long") - 1) * days + day.cast("long") - low
    kind = F.concat_ws("-", F.lit("date"), low.cast("string"), days.cast("string"), months.cast("string"))
    y, mo, d = split(_walk(at, 200 * months, days, key, kind, valid))
    mo, d = _zeros(mo, F.length(month)), _zeros(d, F.length(day))
    odd = F.concat(F.when(day_first, d).otherwise(mo), F.when(dot, ".").otherwise("/"), F.when(day_first, mo).otherwise(d), F.when(dot, ".").otherwise("/"), y.cast("string"))
    plain = ~turned & (F.length(month) == 2) & (F.length(day) == 2)
    return F.when(~dot & ~slash, F.date_format(new, "yyyy-MM-dd")).when(~plain, odd).when(dot, F.date_format(new, "dd.MM.yyyy")).otherwise(F.date_format(new, "MM/dd/yyyy"))


def _letters(m: Column, key: str, kind: str, alphabet: str, n) -> Column:
    """n letters of an alphabet of 16 or fewer, keyed by m."""
    block = lambda k: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), k.cast("string"), m).cast("binary"), 256)
    hexes = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / 64)), block), "")
    return F.translate(F.substr(hexes, F.lit(1), n), "0123456789abcdef", alphabet)


def _email(m: Column, key: str) -> Column:
    low = F.lower(m)
    local, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    return F.concat(_letters(low, key, "email", "bcdfghjklmnpqrst", F.greatest(F.length(local), F.lit(24))), F.lit("@"), _letters(domain, key, "domain", "bcdfghjklmnpqrst", F.lit(12)), F.lit(".example"))


def _secret(m: Column, key: str) -> Column:
    return (
        F.when(m.rlike("^A(?:KI|SI)A[A-Z2-7]{16}$"), F.concat(F.substring(m, 1, 4), _letters(m, key, "secret", "ABCDEFGHJKMNPQRS", F.lit(16))))
        .otherwise(_letters(m, key, "secret", "0123456789abcdef", F.length(m)))
    )


def _kind(m: Column) -> Column:
    """Which kind m is, if valid."""
    in_range = lambda d: d.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date"))
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(whole(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), "ipv4")
        .when(whole(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"), F.when(in_range(_day(m)), "date"))
        .when(whole(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), "ssn")
        .when(whole(r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"), "phone")
        .when(whole(r"[3-6](?:[ -]?[0-9]){12,18}"), F.when(_luhn(_digits(m)) & _digits(m).rlike(ISSUERS), "card"))
        .when(whole("[A-Za-z0-9!#$%&*+./=?^_~-]+"), "secret")
    )


def replacement(kind: Column, m: Column, key: str) -> Column:
    out = F.when(kind == "email", _email(m, key))
    for name, f in (("ipv4", _ipv4), ("date", _date), ("ssn", _ssn), ("phone", _phone), ("card", _card), ("secret", _secret)):
        out = out.when(kind == name, f(m, key))
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the text under pseudonyms and `found`, an array of struct(kind, old, new) in text order."""
    column = F.col(text)
    some = column.rlike(SOME)
    matches = F.when(some, F.regexp_extract_all(column, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = F.transform(matches, lambda m: F.struct(m.alias("old"), _kind(m).alias("kind")))
    found = F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), x["old"].alias("old"), replacement(x["kind"], x["old"], key).alias("new")))
    pieces = F.split(column, ANY, -1)
    joined = F.array_join(F.transform(F.arrays_zip(pieces.alias("piece"), F.transform("_rw_found", lambda x: x["new"]).alias("new")), lambda z: F.concat(z["piece"], F.coalesce(z["new"], F.lit("")))), "")
    rows = docs.drop("found", "_rw_found").withColumn("_rw_found", found)
    return rows.withColumn(text, F.when(F.size("_rw_found") > 0, joined).otherwise(column)).withColumn("found", F.filter("_rw_found", lambda x: x["kind"].isNotNull())).drop("_rw_found")
