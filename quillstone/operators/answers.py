"""Cleaning of a rewriting model's answers: what is no rewrite goes, step by step, and what is left is tried.

Every step sees what the one before it left. Thinking is taken out by one walk over its tags: text outside all tags
stays, a closing tag without an opening one drops all before it, an opening one without a closing one all behind it.
Wrappers (fences and quotes) are taken off one after the other, up to LAYERS of them. Patterns have no repeated groups,
so that very long answers do not exhaust the stack.

An answer that is empty or says nothing, and one that only echoes a text that tells something, is given up for a
fallback. Pruning, the fallback and the test of telling are the caller's columns, as a model's answer is the caller's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions.text import let

LAYERS = 64
_SPACE = r"(?U)\s"


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, rf"{_SPACE}+\z", ""), rf"\A(?U)\s+", "")


def without_thinking(text: Column) -> Column:
    parts, tags = F.split(text, r"(?i)</?think>", -1), F.regexp_extract_all(text, F.lit(r"(?i)</?think>"), F.lit(0))

    def step(s: Column, x: Column) -> Column:
        """x is a tag and the text behind it."""
        closes = x["tag"].startswith("</")
        depth = F.when(~closes, s["depth"] + 1).otherwise(F.greatest(s["depth"] - 1, F.lit(0)))
        kept = F.when(closes & (s["depth"] == 0), F.lit("")).otherwise(s["out"])
        return F.struct(depth.alias("depth"), F.when(depth == 0, F.concat(kept, x["text"])).otherwise(kept).alias("out"))

    rest = F.zip_with(tags, F.slice(parts, 2, F.size(parts)), lambda t, x: F.struct(t.alias("tag"), x.alias("text")))
    return F.aggregate(rest, F.struct(F.lit(0).alias("depth"), F.get(parts, F.lit(0)).alias("out")), step, lambda s: s["out"])


def last_turn(text: Column) -> Column:
    """What follows the last mark of the assistant's turn, unless thinking is open there."""
    head = F.substring(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, P.ANSWER_TURN, -1)) - len(P.ANSWER_TURN))
    still_open = F.regexp_count(head, F.lit(r"(?i)<think>")) > F.regexp_count(head, F.lit(r"(?i)</think>"))
    return F.when(F.contains(text, F.lit(P.ANSWER_TURN)) & ~still_open, F.substring_index(text, P.ANSWER_TURN, -1)).otherwise(text)


def cut(text: Column) -> Column:
    """Up to the first match of each stop pattern, one after the other."""
    for p in P.ANSWER_STOPS:
        text = F.regexp_replace(text, rf"(?i)(?:{p})(?s:.*)", "")
    return text


def unwrapped(text: Column) -> Column:
    """Without the fences and quotes around all of it, the outermost first, fences before quotes."""

    def peel(t: Column, _: Column) -> Column:
        t = stripped(t)
        inner = lambda n: F.substring(t, F.lit(n + 1), F.length(t) - 2 * n)
        lines = F.split(t, "\n", -1)
        fenced = F.when(F.size(lines) >= 2, F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")).otherwise(inner(3))
        out = F.when(t.startswith("```") & t.endswith("```") & (F.length(t) >= 6), fenced)
        for first, last in P.ANSWER_QUOTES:
            out = out.when(t.startswith(first) & t.endswith(last) & (F.length(t) >= 2), inner(1))
        return stripped(out.otherwise(t))

    # Each layer takes a mark from the front, and so there are no more layers than marks.
    marks = F.least(F.regexp_count(text, F.lit("[\"'“‘«`]")), F.lit(LAYERS))
    return F.aggregate(F.sequence(F.lit(0), marks), stripped(text), peel)


def without_tail(text: Column) -> Column:
    """Without hashtags and bursts of emoji at the end."""
    e = P.EMOJI
    text = F.regexp_replace(text, r"(?dU)\s*#\w.*$", "")
    text = F.regexp_replace(text, rf"(?dU)\s*[{e}][\s{e}]*[{e}].*$", "")
    return F.regexp_replace(text, rf"(?dU)([.!?]\s*)[{e}\s.!?]+$", "$1")


def cleaned(raw: Column) -> Column:
    """The rewrite in a model's answer; empty if there is none. Null is empty."""
    steps = (
        lambda t: F.regexp_replace(t, f"(?is){P.ANSWER_ROLE_BLOCK}", ""), last_turn, lambda t: F.regexp_replace(t, f"(?i){P.ANSWER_ROLE}", ""), without_thinking, cut,
        lambda t: F.regexp_replace(t, r"<\|.*?\|>", ""), lambda t: F.regexp_replace(stripped(t), f"(?i){P.ANSWER_ECHO}", ""), lambda t: F.regexp_replace(stripped(t), f"(?iU){P.ANSWER_FILLER}", ""),
        unwrapped, without_tail, lambda t: F.trim(F.regexp_replace(t, rf"{_SPACE}+", " ")),
    )
    out = F.coalesce(raw, F.lit(""))
    for step in steps:
        out = let(out, step)
    return out


def says_nothing(text: Column) -> Column:
    return (F.length(text) < 3) | F.lower(text).isin(*P.ANSWER_NOTHING)


def accepted(clean: Column, pruned: Column, original: Column, fallback: Column, tells: Column) -> Column:
    """What is served for a cleaned answer: the fallback if it says nothing (itself, if there is no original to fall back
    from), or if it is the original unchanged and that tells something; else its pruned form, if that is long enough."""
    given = F.coalesce(F.trim(original) != "", F.lit(False))
    served = F.when(F.length(pruned) >= 5, pruned).otherwise(clean)
    echo = given & (F.lower(F.trim(served)) == F.lower(F.trim(original))) & tells
    return F.when(says_nothing(clean), F.when(given, fallback).otherwise(clean)).when(echo, fallback).otherwise(served)


def finished(rows, raw: str, original: str, prune: Callable[[Column], Column], fallback: Callable[[Column], Column], tells: Callable[[Column], Column]):
    """rows with `answer`: each step's column is made once."""
    out = rows.withColumn("__clean", cleaned(F.col(raw)))
    out = out.withColumn("__pruned", prune(F.col("__clean")))
    return out.withColumn("answer", accepted(F.col("__clean"), F.col("__pruned"), F.col(original), fallback(F.col(original)), tells(F.col(original)))).drop("__clean", "__pruned")
