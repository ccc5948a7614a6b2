"""What users add: rules, validators, detectors, text extractors.

A detector is a step of refine.refine(): (text, spans) -> spans with its own added.  An extractor gives the text of a
file's bytes for its extensions.  Validators are used by rules under their name, on the value as it was found.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps

from .operators.context import AFTER, isolated
from .operators.refine import Step
from .operators.rules import RULES, Rule


def checked(length: int | None = None, least: int | None = None, most: int | None = None, normal: bool = True) -> Callable:
    """Decorates a check of a value: it gets the value upper-cased without blanks and dashes, and only if its length is right; a fault in it is a no."""
    def around(f: Callable[[str], bool]) -> Callable[[str], bool]:
        @wraps(f)
        def check(value: str) -> bool:
            value = re.sub(r"[\s-]", "", value).upper() if normal else value
            n = len(value)
            if not value or length is not None and n != length or least is not None and n < least or most is not None and n > most:
                return False
            try:
                return bool(f(value))
            except (ValueError, IndexError, KeyError):
                return False

        return check

    return around


@dataclass
class Plugins:
    rules: list[Rule] = field(default_factory=lambda: list(RULES))
    validators: dict[str, Callable[[str], bool]] = field(default_factory=dict)
    detectors: dict[str, Step] = field(default_factory=dict)
    extractors: dict[str, Callable[[bytes], str]] = field(default_factory=dict)

    def rule(self, entity_type: str, pattern: str, confidence: float = 0.9, group: int = 0, tier: int = 2, validator: str | None = None) -> Rule:
        """Add a rule; its pattern must compile, its validator, if it has one of here, raises the confidence by 0.02 to 0.99 at most."""
        re.compile(pattern)
        new = Rule(entity_type.strip().upper(), pattern, group, min(0.99, confidence + 0.02) if validator in self.validators else confidence, tier, validator)
        self.rules.append(new)
        return new

    def validator(self, name: str, **limits) -> Callable:
        def add(f: Callable[[str], bool]) -> Callable[[str], bool]:
            self.validators[name] = checked(**limits)(f)
            return self.validators[name]

        return add

    def detector(self, name: str) -> Callable[[Step], Step]:
        def add(step: Step) -> Step:
            self.detectors[name] = step
            return step

        return add

    def extractor(self, *extensions: str) -> Callable:
        def add(f: Callable[[bytes], str]) -> Callable[[bytes], str]:
            self.extractors.update({e.lower().lstrip("."): f for e in extensions})
            return f

        return add

    def steps(self) -> list[str | Step]:
        """The added detectors, each by itself so that one's fault loses nothing of the others, and then the usual steps."""
        return [isolated(x) for x in self.detectors.values()] + [self._checks] + list(AFTER)

    def _checks(self, text: str, spans: list[dict]) -> list[dict]:
        names = {r.type: r.validator for r in self.rules if r.validator in self.validators}
        return [s for s in spans if s["entity_type"] not in names or s["detector"] == "checksum" or self.validators[names[s["entity_type"]]](s["text"])]
