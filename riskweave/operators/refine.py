"""Span clean-up that needs the text: containment, word edges, address parts, name types, repeats, label fields.

Every step works on the spans of one document, in plain Python; refine() runs steps in turn over (text, spans) rows in
one Arrow pass, so a document is one unit of work and nothing is shuffled.  A span is a dict with the columns of
detect.SPAN.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .detect import SPAN

_KIND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("entity_type", pa.string()), ("confidence", pa.float64()), ("detector", pa.string()), ("tier", pa.int32()), ("rule_ord", pa.int32())])

# Groups of types that are compatible with each other.
GROUPS = (
    ("NAME", "NAME_PATIENT", "NAME_PROVIDER", "NAME_RELATIVE", "NAME_FAMILY"), ("ADDRESS", "STREET", "STREET_ADDRESS", "CITY", "STATE", "ZIP", "LOCATION"),
    ("DATE", "DOB", "DATE_DOB", "DATE_ADMISSION", "DATE_DISCHARGE"), ("PHONE", "FAX", "PHONE_MOBILE", "PHONE_HOME", "PHONE_WORK"), ("SSN", "SSN_PARTIAL"),
    ("MRN", "PATIENT_ID", "MEDICAL_RECORD"), ("HEALTH_PLAN_ID", "MEMBER_ID", "INSURANCE_ID"), ("EMPLOYER", "ORGANIZATION", "COMPANY", "COMPANYNAME"),
)
# Types whose values are looked for again in a text; how specific name types are.
REPEATED = frozenset(
    "NAME NAME_PATIENT NAME_PROVIDER NAME_RELATIVE PHONE FAX EMAIL PAGER SSN SSN_PARTIAL MRN ENCOUNTER_ID ACCESSION_ID MEMBER_ID MEDICARE_ID HEALTH_PLAN_ID PHARMACY_ID NPI DEA MEDICAL_LICENSE "
    "DRIVER_LICENSE PASSPORT CREDIT_CARD ACCOUNT_NUMBER IBAN ABA_ROUTING IP_ADDRESS MAC_ADDRESS IMEI DEVICE_ID URL USERNAME".split())
SPECIFIC = {"NAME_PATIENT": 3, "NAME_PROVIDER": 3, "NAME_RELATIVE": 3, "NAME": 1}
ML = 1
DECAY, LEAST_REPEATED, MOST_REPEATS = 0.95, 0.70, 50
MOST_SNAP, MOST_GAP = 10, 20

_GROUP_OF = {t: k for k, g in enumerate(GROUPS) for t in g}


def compatible(a: str, b: str) -> bool:
    """Equal, one the start of the other, or of one group."""
    return a.startswith(b) or b.startswith(a) or a in _GROUP_OF and _GROUP_OF[a] == _GROUP_OF.get(b)


class Cover:
    """Intervals by the blocks of text they touch, so that looking one up costs what lies near it."""

    def __init__(self, block: int = 256):
        self.block, self.at = block, defaultdict(list)

    def add(self, start: int, end: int, what=None) -> None:
        for b in range(start // self.block, (max(start, end - 1)) // self.block + 1):
            self.at[b].append((start, end, what))

    def touching(self, start: int, end: int) -> Iterator[tuple]:
        for b in range(start // self.block, (max(start, end - 1)) // self.block + 1):
            yield from (x for x in self.at[b] if x[0] < end and x[1] > start)

    def around(self, start: int, end: int) -> Iterator[tuple]:
        """Those that hold the whole of start to end: all of them touch its first block."""
        return (x for x in self.at[start // self.block] if x[0] <= start and x[1] >= end)


def without_contained(text: str, spans: list[dict]) -> list[dict]:
    """Without spans that lie in a longer, or equal and better, one of a compatible type."""
    cover, out = Cover(), []
    for s in sorted(spans, key=lambda s: (s["start"] - s["end"], -s["tier"], -s["confidence"])):
        if not any(compatible(s["entity_type"], t) for _, _, t in cover.around(s["start"], s["end"])):
            cover.add(s["start"], s["end"], s["entity_type"])
            out.append(s)
    return sorted(out, key=lambda s: (s["start"], s["end"]))


def _in_word(text: str, at: int) -> bool:
    return 0 < at < len(text) and all(c.isalnum() or c == "_" for c in text[at - 1: at + 1])


def snapped(text: str, spans: list[dict]) -> list[dict]:
    """Spans that begin or end inside a word take in the word, if that is at most MOST_SNAP characters on each side."""
    out = []
    for s in spans:
        if not 0 <= s["start"] < s["end"] <= len(text):
            continue
        start, end = s["start"], s["end"]
        while _in_word(text, start):
            start -= 1
        while _in_word(text, end):
            end += 1
        moved = max(s["start"] - start, end - s["end"])
        out.append(s if moved == 0 or moved > MOST_SNAP else s | {"start": start, "end": end, "text": text[start:end], "confidence": s["confidence"] * DECAY})
    return out


_BETWEEN_PARTS = re.compile(r"[\s,-]*(?:apt\.?|unit|suite|ste\.?|#)?[\s,-]*", re.I)


def joined_addresses(text: str, spans: list[dict]) -> list[dict]:
    """Address parts with nothing but a connector between them are one address: the weaker confidence, the stronger tier."""
    out: list[dict] = [s for s in spans if s["entity_type"] != "ADDRESS"]
    last = None
    for s in sorted((s for s in spans if s["entity_type"] == "ADDRESS"), key=lambda s: s["start"]):
        gap = s["start"] - last["end"] if last else -1
        if 0 <= gap <= MOST_GAP and _BETWEEN_PARTS.fullmatch(text, last["end"], s["start"]):
            last |= {"end": s["end"], "text": text[last["start"]: s["end"]], "confidence": min(last["confidence"], s["confidence"]), "tier": max(last["tier"], s["tier"])}
        else:
            last = dict(s)
            out.append(last)
    return out


def unified_names(text: str, spans: list[dict]) -> list[dict]:
    """Spans of one text that are names all take the most specific of their types, the first of equals."""
    best: dict[str, str] = {}
    for s in spans:
        t = s["entity_type"]
        if t in SPECIFIC and SPECIFIC[t] > SPECIFIC.get(best.get(s["text"], ""), 0):
            best[s["text"]] = t
    return [s | {"entity_type": best[s["text"]]} if s["entity_type"] in SPECIFIC else s for s in spans]


def repeated(text: str, spans: list[dict], least: float = LEAST_REPEATED, most: int = MOST_REPEATS) -> list[dict]:
    """With the other places, as whole words and free of spans, of the values found; longer values first."""
    cover = Cover()
    for s in spans:
        cover.add(s["start"], s["end"])
    seen, more = set(), []
    for s in sorted((s for s in spans if s["entity_type"] in REPEATED and s["confidence"] >= least and len(s["text"]) >= 3), key=lambda s: -len(s["text"])):
        if s["text"] in seen:
            continue
        seen.add(s["text"])
        found, start = 0, text.find(s["text"])  # a pattern of each value would be compiled for each text
        while start >= 0 and found < most:
            end = start + len(s["text"])
            if not (text[start - 1: start].isalnum() or text[end: end + 1].isalnum()) and not any(cover.touching(start, end)):
                cover.add(start, end)
                found += 1
                more.append(s | {"start": start, "end": end, "confidence": s["confidence"] * DECAY, "detector": "repeat_finder", "tier": ML})
            start = text.find(s["text"], start + 1)
    return unified_names(text, sorted([*spans, *more], key=lambda s: s["start"]))


# Labels of fields -> types; None is known and not sensitive.
LABELS = {
    "NAME": "NAME", "FULL NAME": "NAME", "PATIENT": "NAME_PATIENT", "PATIENT NAME": "NAME_PATIENT", "PROVIDER": "NAME_PROVIDER", "PHYSICIAN": "NAME_PROVIDER", "DOB": "DATE_DOB", "DATE OF BIRTH": "DATE_DOB",
    "BIRTH DATE": "DATE_DOB", "DATE": "DATE", "ADDRESS": "ADDRESS", "HOME ADDRESS": "ADDRESS", "PHONE": "PHONE", "TEL": "PHONE", "MOBILE": "PHONE", "FAX": "FAX", "EMAIL": "EMAIL", "E-MAIL": "EMAIL", "SSN": "SSN",
    "SOCIAL SECURITY NUMBER": "SSN", "MRN": "MRN", "MEDICAL RECORD NUMBER": "MRN", "MEMBER ID": "HEALTH_PLAN_ID", "POLICY NUMBER": "HEALTH_PLAN_ID", "GROUP NUMBER": "HEALTH_PLAN_ID", "PASSPORT": "PASSPORT",
    "PASSPORT NUMBER": "PASSPORT", "DL": "DRIVER_LICENSE", "DLN": "DRIVER_LICENSE", "ACCOUNT": "ACCOUNT_NUMBER", "ACCOUNT NUMBER": "ACCOUNT_NUMBER", "EMPLOYER": "EMPLOYER", "NPI": "NPI", "DEA": "DEA", "AGE": "AGE",
    "SEX": None, "CLASS": None, "NOTES": None, "STATUS": None, "DIAGNOSIS": None, "PAGE": None,
}
_LABEL = re.compile(r"(?<!\w)([A-Za-z][A-Za-z0-9 '#-]{0,30}?)[ \t]*[:][ \t]*(?=\S)")
_END = re.compile(r"\n|\s{3,}|;|\|")
_PROSE = re.compile(r"\b(?:the|and|that|which|was|were|has|have|is|are|with|this|from|been|will|would)\b", re.I)
MOST_VALUE = 100


def looks_like_prose(value: str) -> bool:
    """More words than a field holds, or function words among them."""
    n = len(value.split())
    return n > 12 or n >= 4 and len(_PROSE.findall(value)) >= 2


def fields(text: str, spans: list[dict], labels: dict = LABELS) -> list[dict]:
    """With the values behind known labels, each label's value ending where the next one starts."""
    found = []
    for m in _LABEL.finditer(text):
        parts = m[1].split(" ")
        for k in range(len(parts)):  # the longest known label that the words before the colon end with
            name = re.sub(r"\s+", " ", " ".join(parts[k:]).strip(" -").upper())
            if name in labels:
                found.append((m.end(1) - len(" ".join(parts[k:])), m.end(), labels[name]))
                break
    out = list(spans)
    for k, (_, start, kind) in enumerate(found):
        end = found[k + 1][0] if k + 1 < len(found) else min(len(text), start + MOST_VALUE)
        stop = _END.search(text, start, end)
        value = text[start: stop.start() if stop else end].strip(" \t,.-")
        if kind and value and not looks_like_prose(value):
            start = text.index(value, start)
            out.append({"start": start, "end": start + len(value), "text": value, "entity_type": kind, "confidence": 0.95, "detector": "structured", "tier": 3, "rule_ord": -1})
    return out


def in_order(text: str, spans: list[dict]) -> list[dict]:
    """By place, those of one place by rule: the order in which the other steps take spans."""
    return sorted(spans, key=lambda s: (s["start"], s["end"], s["rule_ord"]))


Step = Callable[[str, list[dict]], list[dict]]
STEPS: dict[str, Step] = {"fields": fields, "contained": without_contained, "snap": snapped, "addresses": joined_addresses, "repeats": repeated, "names": unified_names}


def refine(docs: DataFrame, spans: DataFrame | None, steps: Iterable[str | Step], key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs and their spans -> the spans after the steps; without spans the steps start from none."""
    chosen = [STEPS[x] if isinstance(x, str) else x for x in steps]
    names = [x.split(" ")[0] for x in SPAN.split(", ")]
    plain = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    if spans is None:
        rows = plain.withColumn("_spans", F.array().cast(T.ArrayType(T.StructType.fromDDL(SPAN))))
    else:
        gathered = spans.groupBy(key).agg(F.collect_list(F.struct(*names)).alias("_spans"))
        rows = plain.join(gathered, key, "left").withColumn("_spans", F.coalesce("_spans", F.array().cast(gathered.schema["_spans"].dataType)))
    schema = T.StructType([rows.schema[key], T.StructField("s", T.ArrayType(T.StructType.fromDDL(SPAN)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                t = t or ""
                s = in_order(t, s or [])
                for step in chosen:
                    s = step(t, s)
                out.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(_KIND))], names=[key, "s"])

    return rows.select(key, "_text", "_spans").mapInArrow(run, schema).select(key, F.explode("s").alias("s")).select(key, "s.*")
