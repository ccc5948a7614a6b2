"""Checksums and format validators as Column expressions; all stay in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import BooleanType


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _alnum(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", ""))


def _place(alphabet: str, x: Column) -> Column:
    return F.call_function("instr", F.lit(alphabet), x) - 1


def _numbers(c: Column, alphabet: str = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#") -> Column:
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: _place(alphabet, x))


def _weighted(numbers: Column, weights: list[int]) -> Column:
    products = F.zip_with(numbers, F.array(*[F.lit(w) for w in weights]), lambda a, b: F.coalesce(a * b, F.lit(0)))
    return F.aggregate(products, F.lit(0), lambda s, x: s + x)


def _mod(expanded: Column, by: int) -> Column:
    """A decimal string of any length modulo `by`."""
    return F.aggregate(F.transform(F.filter(F.split(expanded, ""), lambda x: x != ""), lambda x: x.cast("int")), F.lit(0), lambda s, x: (s * 10 + x) % by)


def _expanded(c: Column) -> Column:
    """Letters as numbers from 10."""
    return F.array_join(F.transform(_numbers(c), lambda x: x.cast("string")), "")


def luhn(c: Column) -> Column:
    return (F.length(digits(c)) >= 2) & F.call_function("luhn_check", digits(c))


def ssn_confidence(c: Column) -> Column:
    """0.99; 0.85 for areas never issued; 0.80 for a zero group or serial; null unless nine digits."""
    d = digits(c)
    area = F.substring(d, 1, 3)
    return F.when(F.length(d) == 9, F.when(area.isin("000", "666") | area.startswith("9"), 0.85).when((F.substring(d, 4, 2) == "00") | (F.substring(d, 6, 4) == "0000"), 0.80).otherwise(0.99))


def card_confidence(c: Column) -> Column:
    """0.99 with a valid Luhn sum, else 0.87; null unless 13-19 digits with a card prefix."""
    d = digits(c)
    return F.when(F.length(d).between(13, 19) & d.rlike("^(4|5[1-5]|2[2-7]|3[0-9]|6)"), F.when(luhn(c), 0.99).otherwise(0.87))


def npi(c: Column) -> Column:
    d = digits(c)
    return (F.length(d) == 10) & d.rlike("^[12]") & F.call_function("luhn_check", F.concat(F.lit("80840"), d))


def dea(c: Column) -> Column:
    x = _alnum(c)
    n = lambda k: F.try_element_at(F.split(x, ""), F.lit(k)).cast("int")
    return F.coalesce(x.rlike("^[A-Z]{2}[0-9]{7}$") & ((n(3) + n(5) + n(7) + 2 * (n(4) + n(6) + n(8))) % 10 == n(9)), F.lit(False))


def iban(c: Column) -> Column:
    x = _alnum(c)
    return x.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (_mod(_expanded(F.concat(F.substr(x, F.lit(5)), F.substring(x, 1, 4))), 97) == 1)


def lei(c: Column) -> Column:
    x = _alnum(c)
    return x.rlike("^[A-Z0-9]{18}[0-9]{2}$") & (_mod(_expanded(x), 97) == 1)


def vin(c: Column) -> Column:
    x = _alnum(c)
    value = F.translate(x, "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789")
    rest = _weighted(_numbers(value), [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]) % 11
    return x.rlike("^[A-HJ-NPR-Z0-9]{17}$") & (F.substring(x, 9, 1) == F.when(rest == 10, "X").otherwise(rest.cast("string")))


def aba_routing(c: Column) -> Column:
    d = digits(c)
    return (F.length(d) == 9) & d.rlike("^(0[0-9]|1[0-2]|2[1-9]|3[0-2]|6[1-9]|7[0-2]|80)") & (_weighted(_numbers(d), [3, 7, 1] * 3) % 10 == 0)


def cusip(c: Column) -> Column:
    x = F.upper(F.trim(c))
    doubled = F.transform(F.slice(_numbers(x), 1, 8), lambda v, k: F.when(k % 2 == 1, v * 2).otherwise(v))
    total = F.aggregate(doubled, F.lit(0), lambda s, v: s + F.floor(v / 10).cast("int") + v % 10)
    return x.rlike("^[0-9A-Z*@#]{8}[0-9]$") & (((10 - total % 10) % 10).cast("string") == F.substring(x, 9, 1))


def isin(c: Column) -> Column:
    x = _alnum(c)
    return x.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$") & F.call_function("luhn_check", _expanded(x))


def sedol(c: Column) -> Column:
    x = _alnum(c)
    return x.rlike("^[0-9BCDFGHJ-NP-TV-Z]{6}[0-9]$") & (_weighted(_numbers(x), [1, 3, 1, 7, 3, 9, 1]) % 10 == 0)


def swift(c: Column) -> Column:
    return F.upper(F.trim(c)).rlike("^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?$")


def figi(c: Column) -> Column:
    return F.upper(F.trim(c)).rlike("^BBG[0-9A-Z]{9}$")


def ethereum(c: Column) -> Column:
    return F.trim(c).rlike("^0x[0-9a-fA-F]{40}$")


def bech32(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike("^bc1[qpzry9x8gf2tvdw0s3jn54khce6mua7l]{11,71}$")


def ipv4(c: Column) -> Column:
    return c.rlike(r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$")


def us_phone(c: Column) -> Column:
    d = F.regexp_replace(digits(c), "^1(?=[0-9]{10}$)", "")
    return (F.length(d) == 10) & ~F.substring(d, 1, 1).isin("0", "1") & ~F.substring(d, 1, 3).isin("555", "911", "411") | ~F.length(d).isin(10)


def calendar_date(month: Column, day: Column, year: Column) -> Column:
    return year.between(1900, 2100) & F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd").isNotNull()


def age(c: Column) -> Column:
    return F.coalesce(c.try_cast("int").between(0, 125), F.lit(False))


def seed_phrase(c: Column, words: list[str]) -> Column:
    """12, 15, 18, 21 or 24 words, four fifths of them in the list (a parameter)."""
    w = F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda x: x != "")
    return F.size(w).isin(12, 15, 18, 21, 24) & (F.size(F.filter(w, lambda x: x.isin(*words))) >= 0.8 * F.size(w))


def _check10(d: Column, weights: list[int]) -> Column:
    """The last digit makes the weighted sum of those before it a multiple of ten."""
    n = len(weights)
    total = _weighted(F.slice(_numbers(d), 1, n), weights)
    return (10 - total % 10) % 10 == F.substring(d, n + 1, 1).cast("int")


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def ups_tracking(c: Column) -> Column:
    """1Z, 15 letters or digits, a check digit; letters count as A=2, B=3 and so on, modulo ten; I and O are not used."""
    x = F.upper(F.replace(c, F.lit(" ")))
    plain = F.translate(F.substring(x, 3, 16), "ABCDEFGHJKLMNPQRSTUVWXYZ", "234567891234578912345678")
    return _sure(x.rlike("^1Z[0-9A-HJ-NP-Z]{15}[0-9A-HJ-NP-Z]$") & _check10(plain, [1, 2] * 7 + [1]))


def fedex_tracking(c: Column) -> Column:
    """12 digits (modulo 11), 15 from 96, 20, or 22 from 92 (modulo 10)."""
    d = digits(c)
    express = _weighted(F.slice(_numbers(d), 1, 11), [1, 7, 3] * 3 + [1, 7]) % 11 % 10 == F.substring(d, 12, 1).cast("int")
    return _sure(F.when(F.length(d) == 12, express).when(d.rlike("^96[0-9]{13}$"), _check10(d, [1] * 14)).when(F.length(d) == 20, _check10(d, [3, 1] * 9 + [3])).when(d.rlike("^92[0-9]{20}$"), _check10(d, [3, 1] * 10 + [3])))


def usps_tracking(c: Column) -> Column:
    """20 or 22 digits (modulo 10), or two letters, nine digits (modulo 11) and two letters."""
    x, d = F.upper(F.replace(c, F.lit(" "))), digits(c)
    rest = 11 - _weighted(F.slice(_numbers(F.substring(x, 3, 8)), 1, 8), [8, 6, 4, 2, 3, 5, 9, 7]) % 11
    abroad = F.when(rest == 10, 0).when(rest == 11, 5).otherwise(rest) == F.substring(x, 11, 1).cast("int")
    return _sure(F.when(x.rlike("^[A-Z]{2}[0-9]{9}[A-Z]{2}$"), abroad).when(F.length(d) == 20, _check10(d, [3, 1] * 9 + [3])).when(F.length(d) == 22, _check10(d, [3, 1] * 10 + [3])))


BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


@pandas_udf(BooleanType())
def _base58check(values: pd.Series) -> pd.Series:
    import hashlib

    place = {c: k for k, c in enumerate(BASE58)}

    def ok(v: str | None) -> bool | None:
        if v is None:
            return None
        n = 0
        for c in v:
            if c not in place:
                return False
            n = n * 58 + place[c]
        if n >= 1 << 200:
            return False
        data = n.to_bytes(25, "big")
        return hashlib.sha256(hashlib.sha256(data[:21]).digest()).digest()[:4] == data[21:]

    return values.map(ok).astype("object")


def bitcoin_base58(c: Column) -> Column:
    """A legacy address: 25 bytes in base 58, the last four a double SHA-256 of the others.  Numbers this long need Python; only what has the form goes there."""
    return F.when(c.rlike("^[13][1-9A-HJ-NP-Za-km-z]{24,34}$"), _base58check(c)).otherwise(F.lit(False))
