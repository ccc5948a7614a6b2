"""Text functions: normal forms, hashes, display."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

# Invisible, bidirectional and control characters; look-alikes of ASCII letters.
ZERO_WIDTH = "​‌‍⁠﻿­"
BIDI = "‎‏‪‫‬‭‮⁦⁧⁨⁩"
LOOKALIKES = ("АВЕКМНОРСТХаеорсухіѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEKMHOPCTXaeopcyxisABEZHIKMNOPTYX")


def strip_invisible(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH + BIDI, "")


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def fold_lookalikes(c: Column) -> Column:
    return F.translate(c, *LOOKALIKES)


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode normal form; Spark has none built in."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalised(c: Column) -> Column:
    return fold_lookalikes(strip_control(strip_invisible(nfkc(c))))


def normal_value(value: Column, entity_type: Column) -> Column:
    """The form of a value that is hashed."""
    return (
        F.when(entity_type.isin("SSN", "CREDIT_CARD"), F.regexp_replace(value, r"[-\s]", ""))
        .when(entity_type == "PHONE", F.regexp_replace(value, r"[^0-9+]", ""))
        .when(entity_type == "IBAN", F.upper(F.regexp_replace(value, r"\s", "")))
        .when(entity_type == "EMAIL", F.lower(F.trim(value)))
        .otherwise(value)
    )


def value_hash(value: Column, entity_type: Column) -> Column:
    return F.substring(F.sha2(normal_value(value, entity_type).cast("binary"), 256), 1, 6)


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 12)


def label_id(*what: Column) -> Column:
    """A stable label id of what it names."""
    return F.concat(F.lit("ol_"), F.substring(F.sha2(F.concat_ws("|", *what).cast("binary"), 256), 1, 12))


def redacted(value: Column) -> Column:
    return F.when(F.length(value) <= 4, F.repeat(F.lit("*"), F.length(value))).otherwise(F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), F.length(value) - 4), F.substring(value, -2, 2)))


def readable_size(n: Column) -> Column:
    out = F.concat(F.format_number(n / float(1 << 40), 1), F.lit(" TB"))
    for power, unit in ((30, "GB"), (20, "MB"), (10, "KB")):
        out = F.when(n < float(1 << (power + 10)), F.concat(F.format_number(n / float(1 << power), 1), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def safe_filename(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"[\x00-\x1F<>:\"|?*]", "_"), r"^\.+|[. ]+$", ""), 1, 255)


def is_binary(content: Column) -> Column:
    """Among the first 8 KiB a NUL; or more than half of the bytes are no UTF-8; or 30 % of the characters cannot be printed."""
    head = F.substring(content, 1, 8192)
    read = F.regexp_replace(F.make_valid_utf8(head.cast("string")), "\uFFFD", "")
    odd = F.length(read) - F.length(F.regexp_replace(read, r"[\p{C}\p{Zl}\p{Zp}&&[^\n\r\t]]", ""))
    n = F.length(head)
    return F.coalesce((n > 0) & (F.contains(head, F.lit(b"\x00")) | (F.octet_length(read) < 0.5 * n) | (odd > 0.3 * F.length(read))), F.lit(False))


# Letters that scans show for digits.
SCANNED = ("lIOoSsBGZz", "1100558622")
_LOOKS_NUMERIC = (
    r"[0-9lIOS]{3}[-.\s][0-9lIOS]{2}[-.\s][0-9lIOS]{4}", r"\(?[0-9lIOSB]{3}\)?[-.\s]?[0-9lIOSB]{3}[-.\s]?[0-9lIOSB]{4}",
    r"[0-9lIOSB]{1,2}[/.-][0-9lIOSB]{1,2}[/.-][0-9lIOSB]{2,4}", r"[0-9lIOSB]{6,}", r"[0-9lIOSB]{5}(?:[-][0-9lIOSB]{4})?",
)


def repaired_digits(c: Column) -> Column:
    """Text in which letters that stand for digits are digits, inside what looks like a number, a date or an id."""
    runs = "|".join(_LOOKS_NUMERIC)
    pieces, found = F.split(c, runs, -1), F.transform(F.regexp_extract_all(c, F.lit(runs), F.lit(0)), lambda m: F.translate(m, *SCANNED))
    return F.when(c.rlike(runs), F.array_join(F.zip_with(pieces, found, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")).otherwise(c)


def score_bar(score: Column, width: int = 20) -> Column:
    filled = F.least(F.lit(width), F.greatest(F.lit(0), (score.cast("double") / 100 * width).cast("int")))
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def normal_label(c: Column) -> Column:
    """A field's label as it is looked up: upper-cased, no punctuation behind, single blanks."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.upper(c)), r"[:\-\s]+$", ""), r"\s+", " ")


@pandas_udf(StringType())
def _blake(content: pd.Series, size: pd.Series) -> pd.Series:
    block = 1 << 16

    def one(data, n) -> str | None:
        if data is None:
            return None
        h = hashlib.blake2b(digest_size=16)
        h.update(str(int(n)).encode())
        h.update(data[:block])
        if n > block:
            h.update(data[-block:])
        return h.hexdigest()

    return pd.Series([one(d, n) for d, n in zip(content, size)], dtype="object")


def quick_hash(content: Column) -> Column:
    """A hash of size, first and last 64 KiB: only these are sent to Python."""
    ends = F.when(F.length(content) <= 1 << 17, content).otherwise(F.concat(F.substring(content, 1, 1 << 16), F.substring(content, -(1 << 16), 1 << 16)))
    return _blake(ends, F.length(content))


def is_archive(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(?:zip|tar|tgz|gz|bz2|xz|7z|rar|tar\.gz|tar\.bz2|tar\.xz)$")
