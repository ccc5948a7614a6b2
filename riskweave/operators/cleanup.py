"""Span clean-up: boundaries and types of single spans, as Column expressions and, in cleaned(), as a step of refine.refine().

Every step takes and returns spans with start, end, text, entity_type and whatever else they carry; null texts stay as
they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types whose spans end without punctuation.
BARE = ("EMAIL", "PHONE", "FAX", "SSN", "MRN", "NPI", "DEA", "HEALTH_PLAN_ID", "MEMBER_ID", "ACCOUNT_NUMBER", "ID_NUMBER", "CREDIT_CARD", "DRIVER_LICENSE", "PASSPORT")
PUNCTUATION = ".,;:!?"
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
SHORTEST_NAME, SHORTEST_LINE = 3, 2

_SPACE = r"[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]"


def is_name() -> Column:
    return (F.col("entity_type") == "NAME") | F.col("entity_type").startswith("NAME_")


def _shortened(spans: DataFrame, when: Column, text: Column) -> DataFrame:
    """Where `when` holds, the text is cut at its end to `text`."""
    new = F.when(when, text).otherwise(F.col("text"))
    return spans.withColumn("_text", new).withColumn("end", F.when(F.col("_text").isNull() | (F.col("_text") == F.col("text")), F.col("end")).otherwise((F.col("start") + F.length("_text")).cast("int"))).withColumn("text", F.col("_text")).drop("_text")


def _bare(text: Column) -> Column:
    return F.rtrim(text, F.lit(PUNCTUATION))


def trim_space(spans: DataFrame) -> DataFrame:
    """Spans without white space at their ends; those of nothing else go."""
    left = F.regexp_replace("text", f"^{_SPACE}+", "")
    moved = spans.withColumn("_left", left).withColumn("start", F.when(F.col("text").isNull(), F.col("start")).otherwise((F.col("start") + F.length("text") - F.length("_left")).cast("int")))
    cut = _shortened(moved.withColumn("text", F.col("_left")).drop("_left"), F.lit(True), F.regexp_replace("text", f"{_SPACE}+$", ""))
    return cut.where("text is null or text <> ''")


def trim_punctuation(spans: DataFrame) -> DataFrame:
    """Identifiers without punctuation behind them."""
    return _shortened(spans, F.col("entity_type").isin(*BARE), _bare(F.col("text")))


def names_to_emails(spans: DataFrame) -> DataFrame:
    """Names that are an e-mail address become one."""
    mail = F.coalesce(is_name() & _bare(F.col("text")).rlike(EMAIL), F.lit(False))
    marked = _shortened(spans.withColumn("_mail", mail), F.col("_mail"), _bare(F.col("text")))
    return marked.withColumn("entity_type", F.when(F.col("_mail"), "EMAIL").otherwise(F.col("entity_type"))).drop("_mail")


def names_to_line_end(spans: DataFrame) -> DataFrame:
    """Names end where their line does; what is then shorter than SHORTEST_LINE goes."""
    broken = F.coalesce(is_name() & F.contains(F.col("text"), F.lit("\n")), F.lit(False))
    cut = _shortened(spans.withColumn("_broken", broken), F.col("_broken"), F.regexp_replace(F.substring_index("text", "\n", 1), f"{_SPACE}+$", ""))
    return cut.where(~F.col("_broken") | (F.length("text") >= SHORTEST_LINE)).drop("_broken")


def drop_short_names(spans: DataFrame) -> DataFrame:
    """Without names of fewer than SHORTEST_NAME letters, full stops behind them not counted."""
    return spans.where(~F.coalesce(is_name() & (F.length(F.rtrim(F.col("text"), F.lit("."))) < SHORTEST_NAME), F.lit(False)))


def clean(spans: DataFrame) -> DataFrame:
    """All steps, in one projection and filter for Catalyst."""
    return drop_short_names(names_to_line_end(trim_punctuation(names_to_emails(trim_space(spans)))))


#: What the patterns above say to Java, for Python: white space; an address, before whose end a line may end.
_SPACES = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x3000)))
_EMAIL = re.compile(EMAIL.removesuffix("$") + r"(?:\r\n|[\n\r\x85\u2028\u2029])?\Z")


def cleaned(text: str, spans: list[dict]) -> list[dict]:
    """What clean() does, to the spans of one text, for passes that have them in Python."""
    out = []
    for s in spans:
        value, kind, start = s["text"], s["entity_type"], s["start"]
        left = value.lstrip(_SPACES)
        start, value = start + len(value) - len(left), left.rstrip(_SPACES)
        if not value:
            continue
        if kind == "NAME" or kind.startswith("NAME_"):
            bare = value.rstrip(PUNCTUATION)
            if _EMAIL.match(bare):
                value, kind = bare, "EMAIL"
        if kind in BARE:
            value = value.rstrip(PUNCTUATION)
        if kind == "NAME" or kind.startswith("NAME_"):
            if "\n" in value:
                value = value.partition("\n")[0].rstrip(_SPACES)
                if len(value) < SHORTEST_LINE:
                    continue
            if len(value.rstrip(".")) < SHORTEST_NAME:
                continue
        out.append(s if value == s["text"] and kind == s["entity_type"] else s | {"start": start, "end": start + len(value), "text": value, "entity_type": kind})
    return out
