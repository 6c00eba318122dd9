"""Scanning texts for bank surfaces, and neutral texts made by replacing them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.operators.spans import longest_first, spliced, without_overlaps
from quillstone.sources.banks import Bank

MATCH = "struct<attribute:string,start:int,end:int,surface:string,token:string,kept:boolean>"


def matches(text: Column, bank: Bank) -> Column:
    """array of matches: whole phrases, any case, the longest first where they meet, by start. token is the replacement;
    kept tells that the context shows the match is not about the author. One pass finds all surfaces at once."""

    @F.pandas_udf(f"array<{MATCH}>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()  # once for a worker's task, not for each batch
        for surface in bank.surfaces:
            automaton.add_word(surface, surface)
        if len(automaton):
            automaton.make_automaton()
        compiled = [(a, re.compile(p, re.I)) for a, p in bank.patterns]
        for texts in batches:
            yield pd.Series([_found(t or "", bank, automaton, compiled) for t in texts])

    return without_overlaps(find(text), longest_first)


_WORD, _STATUTE = re.compile(r"\w"), re.compile(P.STATUTE_AFTER)
_OTHER, _TARGET = re.compile(P.OTHER_PERSON_AFTER, re.I), re.compile(P.SCHOOL_TARGET_BEFORE, re.I)


def _found(t: str, bank: Bank, automaton, compiled) -> list[dict]:
    low = t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    found = []
    for last, surface in automaton.iter(low) if len(automaton) else ():
        a, b = last + 1 - len(surface), last + 1
        if not (a and _WORD.match(t[a - 1])) and not (b < len(t) and _WORD.match(t[b])):
            found.append((*bank.surfaces[surface], a, b))
    found += [(attribute, "", *m.span()) for attribute, p in compiled for m in p.finditer(t) if m.end() > m.start()]
    rows = []
    for attribute, token, a, b in found:
        after, before = t[b : b + 40], t[max(0, a - 50) : a]
        aside = _STATUTE.match(after) or (attribute in ("age", "income") and _OTHER.match(after)) or (attribute == "education" and _TARGET.search(before))
        rows.append({"attribute": attribute, "start": a, "end": b, "surface": t[a:b], "token": token, "kept": bool(aside)})
    return rows


def neutral(text: Column, found: Column) -> Column:
    """The text with its matches replaced, but for those that are kept, and repaired. found: the column of matches, already
    made (it is read several times)."""
    puts = F.transform(F.filter(found, lambda m: ~m["kept"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["token"].alias("token")))
    out = spliced(text, puts)
    for pattern, by in P.REPAIRS:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)
