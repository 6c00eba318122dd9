"""Cleaning of answers against a plain version, on answers put together at random."""

import random
import re

from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.operators import answers as A

EMOJI = "[\U0001F000-\U0001FAFF\U00002700-\U000027BF\U00002600-\U000026FF]"


def plain_thinking(t):
    """Innermost pairs first; then what stray tags leave."""
    while m := re.search(r"<think>((?!</?think>).)*</think>", t, re.S | re.I):
        t = t[: m.start()] + t[m.end() :]
    if closes := list(re.finditer("</think>", t, re.I)):
        t = t[closes[-1].end() :]
    return re.split("<think>", t, flags=re.I)[0]


def plain(t):
    t = re.sub(P.ANSWER_ROLE_BLOCK, "", t or "", flags=re.S | re.I)
    if P.ANSWER_TURN in t:
        head, tail = t.rsplit(P.ANSWER_TURN, 1)
        if len(re.findall("<think>", head, re.I)) <= len(re.findall("</think>", head, re.I)):
            t = tail
    t = plain_thinking(re.sub(P.ANSWER_ROLE, "", t, flags=re.I))
    for p in P.ANSWER_STOPS:
        if m := re.search(p, t, re.I):
            t = t[: m.start()]
    t = re.sub(r"<\|.*?\|>", "", t)
    t = re.sub(P.ANSWER_ECHO, "", t.strip(), flags=re.I)
    t = re.sub(P.ANSWER_FILLER, "", t.strip(), flags=re.I).strip()
    for _ in range(200):
        if len(t) >= 6 and t.startswith("```") and t.endswith("```"):
            lines = t.split("\n")
            t = ("\n".join(lines[1:-1]) if len(lines) > 1 else t[3:-3]).strip()
        elif len(t) >= 2 and (t[0], t[-1]) in P.ANSWER_QUOTES:
            t = t[1:-1].strip()
        else:
            break
    t = re.sub(r"(\s*#\w+.*)$", "", t)
    t = re.sub(rf"(\s*{EMOJI}){{2,}}.*$", "", t)
    t = re.sub(rf"([.!?]\s*)(?:{EMOJI[:-1]}\s.!?]+)$", r"\1", t)
    return re.sub(r"\s+", " ", t).strip()


def test_cleaned_equals_a_plain_version(spark):
    rng = random.Random(8)
    parts = ["<think>", "</think>", "<THINK>", "word", "Two words.", "\n", " ", "```", "```text\n", "\n```", '"', "'", "“", "”", "`", "#tag", "# x", "😀", "☀ ", "Note:", "**Note**: This rewrite", "Sure!", "Okay,", "Rewritten: ", "**Output** - ", "<|im_start|>assistant", "<|im_start|>user\nhi<|im_end|>", "<|im_end|>", "<|odd|>", "[REDACTED]", "assistant\n", "Here is it: ", "none", "...", "!", "é"]
    rows = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(3000)]
    rows += [a + "text of it" + b for a, b in ((x, y) for x in parts for y in parts)]
    rows += ["", None, "   ", "<think>a <think>b</think> c</think>d", "a</think>b</think>c", "x<think>y", "````a````", "'\"`x`\"'", '"a" and "b"', "a #b\nc #d", "😀\n😀 a"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", A.cleaned(F.col("t")).alias("c")).collect()
    bad = [(rows[r["i"]], r["c"], plain(rows[r["i"]])) for r in got if r["c"] != plain(rows[r["i"]])]
    assert not bad, bad[:5]


def test_long_answers(spark):
    n = 200_000
    rows = ["<think>" * 2000 + "x" + "</think>" * 2000 + "left over", "<think>" + "a" * n + "</think>rest of it", "[REDACTED]" * 20_000, "😀" * n, "word " * n, '"' * 100 + "in many quotes" + '"' * 100]
    got = [r["c"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", A.cleaned(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got[:4] == ["left over", "rest of it", "", ""] and got[4] == " ".join(["word"] * n)
    assert got[5] == '"' * 35 + "in many quotes" + '"' * 35  # LAYERS and the first peel


def test_accepted(spark):
    rows = [("ok text", "orig", "ok text"), ("", "orig", "FALL"), ("N/A", "orig", "FALL"), ("n/a", " ", "n/a"), ("Orig I am 5", "orig i am 5 ", "FALL"), ("Same", "same", "Same"), ("", None, "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, orig string, want string")
    out = A.finished(df, "raw", "orig", lambda c: c, lambda c: F.lit("FALL"), lambda c: c.contains("5")).orderBy("i").collect()
    assert [r["answer"] for r in out] == [r["want"] for r in out]
