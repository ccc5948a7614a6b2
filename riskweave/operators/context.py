"""Decisions that look at the text around a span: vetoes, reclassifications, calibration, the allowlist.

Each is a step of refine.refine(): (text, spans) -> spans.  Word lists that are long belong to the caller and come as a
parameter; the short fixed ones are here.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from .refine import Step

# Least confidence of a detector, whatever it says itself.
FLOORS = {"checksum": 0.85, "structured": 0.90, "known_entity": 0.95, "secrets": 0.80}
# Words before nine digits that are no social security number.
NO_SSN = (
    "page pg room rm order ref reference invoice confirmation tracking case ticket claim check acct record file document doc no num code pin serial model part item sku upc isbn version ver "
    "batch lot catalog product unit id make type series").split()
# What stands near a real classification.
CLASSIFIED = ("//", "classified", "clearance", "noforn", "sci", "fouo", "dissem", "caveat", "portion", "marking", "unclassified")
# Signs of an identity card, two of which make one; carriers; what a tracking number looks like.
CARD_SIGNS = (r"driver'?s?\s*license", r"\bdln[:\s]", r"\bstate\s+id\b", r"\bdups:\s*\d", r"\bclass:\s*[a-z]", r"\brestr:", r"\b\d+[a-z]?(?:exp|iss):", r"\borgan\s+donor\b")
CARRIERS = ("usps", "ups", "fedex", "dhl")
TRACKING = re.compile(r"94\d{18,20}|\d{20,22}|\d{12,15}|DT\d{12}|1Z[A-Z0-9]{16}|\d{9,11}", re.I)
_SHIPPED = re.compile(r"usps|ups|fedex|dhl|tracking|shipment|package|\btrack\s*(?:number|#|no\.?)?\s*[:#]?\s*$|\bdelivery\s*[:#]?\s*$", re.I)
CITY_ENDINGS = ("field", "burgh", "burg", "ville", "town", "port", "ford", "dale", "wood", "brook", "haven", "ridge")
MODELS = frozenset(("phi_bert", "pii_bert", "phi_bert_onnx", "pii_bert_onnx", "ml"))
NEAR = 30

_SIGNS = [re.compile(x, re.I) for x in CARD_SIGNS]
_NO_SSN = re.compile(r"(?<!\w)(?:" + "|".join(NO_SSN) + r"|#)(?!\w)", re.I)
_CITY_STATE = re.compile(r"[A-Z][A-Za-z .]+,\s*[A-Z]{2}")
_TITLES = re.compile(r"\b(?:dr|doctor|prof|ordered by|attending|signed by|provider|physician|nurse)\b[.:]?\s*$", re.I)
_DEGREES = re.compile(r"^\s*,?\s*(?:MD|DO|NP|RN|PA|DNP|DDS|PhD)\b")
_PATIENT = re.compile(r"\b(?:patient|pt|admitted|mr|mrs|ms|miss)\b[.:]?(?:\s+name)?[:]?\s*$", re.I)
_RELATIVE = re.compile(r"\b(?:mother|father|wife|husband|spouse|son|daughter|brother|sister|partner|guardian|next of kin)\b[,:]?\s*$", re.I)


def _before(text: str, s: dict, n: int = NEAR) -> str:
    return text[max(0, s["start"] - n): s["start"]]


def is_id_card(text: str) -> bool:
    return sum(bool(p.search(text)) for p in _SIGNS) >= 2


def is_tracking_number(value: str, before: str) -> bool:
    """The form of a tracking number, and a carrier or a word of shipping before it."""
    return bool(TRACKING.fullmatch(re.sub(r"[\s-]", "", value)) and _SHIPPED.search(before))


def no_false_ssn(text: str, spans: list[dict]) -> list[dict]:
    """Doubtful social security numbers behind words that number other things go."""
    return [s for s in spans if s["entity_type"] != "SSN" or s["confidence"] > 0.75 or not _NO_SSN.search(_before(text, s))]


def no_plain_secret(text: str, spans: list[dict]) -> list[dict]:
    """`secret` is a classification only among signs of one."""
    def plain(s: dict) -> bool:
        low = s["text"].lower()
        near = text[max(0, s["start"] - 50): s["end"] + 50].lower()
        return s["entity_type"] == "CLASSIFICATION_LEVEL" and "secret" in low and "top" not in low and not any(x in near for x in CLASSIFIED)

    return [s for s in spans if not plain(s)]


def no_model_record_numbers(text: str, spans: list[dict]) -> list[dict]:
    """Record numbers that a model claims go on identity cards and where they are tracking numbers or a carrier's name."""
    claimed = [s for s in spans if s["entity_type"] == "MRN" and s["detector"] in MODELS]
    card = bool(claimed) and is_id_card(text)

    def wrong(s: dict) -> bool:
        return card or s["text"].strip().rstrip(":").lower() in CARRIERS or is_tracking_number(s["text"], _before(text, s))

    return [s for s in spans if not (s in claimed and wrong(s))] if claimed else spans


def cities_not_names(text: str, spans: list[dict]) -> list[dict]:
    """Names that are a city with its state, or end as cities do, are addresses, the latter a little less surely."""
    out = []
    for s in spans:
        value = s["text"].strip()
        if s["entity_type"].startswith("NAME"):
            if _CITY_STATE.fullmatch(value):
                s = s | {"entity_type": "ADDRESS"}
            elif any(value.lower().endswith(x) and len(value) > len(x) + 2 for x in CITY_ENDINGS):
                s = s | {"entity_type": "ADDRESS", "confidence": s["confidence"] * 0.9}
        out.append(s)
    return out


def names_by_context(text: str, spans: list[dict]) -> list[dict]:
    """Provider, patient and relative are names only, unless the words beside them say what they are."""
    def shown(s: dict) -> bool:
        before, after = _before(text, s, 50), text[s["end"]: s["end"] + 50]
        return {"NAME_PROVIDER": lambda: _TITLES.search(before) or _DEGREES.search(after), "NAME_PATIENT": lambda: _PATIENT.search(before), "NAME_RELATIVE": lambda: _RELATIVE.search(before)}[s["entity_type"]]() is not None

    return [s | {"entity_type": "NAME"} if s["entity_type"] in ("NAME_PROVIDER", "NAME_PATIENT", "NAME_RELATIVE") and not shown(s) else s for s in spans]


def trimmed_names(words: Iterable[str]) -> Step:
    """Names end before the first word, past their first, that is none."""
    known = frozenset(w.lower() for w in words)

    def step(text: str, spans: list[dict]) -> list[dict]:
        out = []
        for s in spans:
            if s["entity_type"].startswith("NAME"):
                places = [m for m in re.finditer(r"\S+", s["text"])]
                cut = next((m.start() for m in places[1:] if m[0].strip(".,;:").lower() in known), None)
                if cut is not None:
                    value = s["text"][:cut].rstrip(" ,;:\n\t")
                    s = s | {"text": value, "end": s["start"] + len(value)}
            out.append(s)
        return out

    return step


_STREET = re.compile(r"\b\d{1,6}\s+(?:[NSEW]\.?\s+)?(?:[A-Z][A-Za-z]+\s+){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl|Highway|Hwy)\b\.?(?:,?\s+(?:Apt|Unit|Suite|Ste)\.?\s*#?\w+)?(?:,\s*[A-Z][A-Za-z ]+,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?)?")


def unlabelled_addresses(text: str, spans: list[dict]) -> list[dict]:
    """With street addresses that no span touches."""
    taken = sorted((s["start"], s["end"]) for s in spans)
    more = [{"start": m.start(), "end": m.end(), "text": m[0], "entity_type": "ADDRESS", "confidence": 0.85, "detector": "structured", "tier": 2, "rule_ord": -1}
            for m in _STREET.finditer(text) if not any(a < m.end() and b > m.start() for a, b in taken)]
    return [*spans, *more]


def allowed(words: Iterable[str] = (), by_type: dict[str, Iterable[str]] | None = None, weak: dict[str, str] | None = None) -> Step:
    """Spans go whose text is one of the words, or one of those of its type; those before which a pattern of `weak` (type -> pattern) matches count for 0.3 of their confidence."""
    known = frozenset(w.lower() for w in words)
    typed = {t: frozenset(w.lower() for w in ws) for t, ws in (by_type or {}).items()}
    doubt = {t: re.compile(p + r"\s*$", re.I) for t, p in (weak or {}).items()}

    def step(text: str, spans: list[dict]) -> list[dict]:
        out = []
        for s in spans:
            low = s["text"].strip().lower()
            if low in known or low in typed.get(s["entity_type"], ()):
                continue
            if s["entity_type"] in doubt and doubt[s["entity_type"]].search(_before(text, s)):
                s = s | {"confidence": s["confidence"] * 0.3}
            out.append(s)
        return out

    return step


def calibrated(raw: float, detector: str, scale: float = 1.0, offset: float = 0.0, ceiling: float = 1.0) -> float:
    """A detector's confidence between its floor and the ceiling; what is no number is the floor."""
    floor = FLOORS.get(detector, 0.0)
    return floor if math.isnan(raw) else max(floor, min(ceiling, raw * scale + offset))


def calibration(text: str, spans: list[dict]) -> list[dict]:
    return [s | {"confidence": calibrated(s["confidence"], s["detector"])} for s in spans]


def sure(least: float = 0.5) -> Step:
    return lambda text, spans: [s for s in spans if s["confidence"] >= least]


def isolated(step: Step) -> Step:
    """A step that leaves the spans as they are where it fails."""
    def run(text: str, spans: list[dict]) -> list[dict]:
        try:
            return step(text, spans)
        except Exception:  # noqa: BLE001  a plug-in's fault must not lose the other detectors' spans
            return spans

    return run


#: What a whole detection does after the detectors, in this order.
AFTER: tuple[str | Step, ...] = (
    no_false_ssn, no_plain_secret, no_model_record_numbers, unlabelled_addresses, "snap", calibration, "contained", cities_not_names, "addresses", "repeats", sure(),
)
