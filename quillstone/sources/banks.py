"""Dictionaries of personal surfaces: value banks (surfaces with generalisations) and pattern banks (age, income)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass
class Bank:
    """surface (lower case) -> (attribute, replacement), and (attribute, pattern) pairs. A matter of the driver: banks are
    files of a few hundred entries."""

    surfaces: dict[str, tuple[str, str]] = field(default_factory=dict)
    patterns: list[tuple[str, str]] = field(default_factory=list)

    def add(self, attribute: str, surfaces: list[str], generalisations: list[str]) -> None:
        first = generalisations[0] if generalisations else ""
        head, _, rest = first.partition(" ")
        for s in filter(None, (x.strip().lower() for x in surfaces)):
            self.surfaces.setdefault(s, (attribute, rest if head.lower() in ("a", "an", "the") and rest else first))


def read_bank(*paths: str) -> Bank:
    """Bank files, each an object with attribute, generalizations and entries (value, variants, generalizations, or
    pattern); institutions and degrees are read as entries of education."""
    bank = Bank()
    for path in paths:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        attribute, common = data.get("attribute", Path(path).stem), data.get("generalizations", [])
        for entry in [*data.get("entries", []), *data.get("institutions", [])]:
            if "pattern" in entry:
                bank.patterns.append((attribute, entry["pattern"]))
            elif "value" in entry:
                bank.add(attribute, [entry["value"], *entry.get("variants", [])], entry.get("generalizations") or common)
        for degree in data.get("degrees", []):
            bank.add("education", [degree], ["degree"])
    return bank
