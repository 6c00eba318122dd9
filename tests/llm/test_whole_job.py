"""Cases that an operator must do whole: near copies at the threshold, short lines, doubled passages under hot anchors."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quillstone.llm import lines, repeats, shingles, simhash
from quillstone.llm.common import ship, words


def _shingle_set(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def _near_copies():
    """Texts with copies of a Jaccard similarity from about 0.7 to 1 of five-word shingles, and chains of them."""
    r = random.Random(8)
    texts = [None, "", " \n", "one two", "One  TWO", "two one", "a b c d e", "a b c d\ne", "a b c d e f"]
    for size in (12, 40, 200, 400):
        for edits in (0, 1, 2, 3, 4, 5, 6, 8, 10):
            base = [f"w{r.randrange(5000)}" for _ in range(size)]
            texts.append(" ".join(base))
            for _ in range(2):
                for _ in range(edits * size // 400 + (edits > 0)):
                    base[r.randrange(size)] = f"new{r.randrange(5000)}"
                texts.append("\n".join(base))
    return texts


def test_near_duplicates_at_the_threshold(spark):
    ship(spark)
    texts = _near_copies()
    sets = [_shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if 5 * len(a & b) >= 4 * len(a | b) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(x["doc_id"] for x in corpus_pipeline.stage_near_duplicates(spark, docs, "").collect())
    assert kept == sorted(set(root))


def test_near_duplicates_by_fingerprint(spark, monkeypatch):
    """Fingerprints alone find copies that differ little, and the sets have the last word."""
    ship(spark)
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(1000)]
    texts = [" ".join(base), " ".join([*base[:500], "new", *base[501:]]), " ".join(base[::-1]), None]
    a, b, c = (simhash.fingerprint(t, 5) for t in texts[:3])
    assert 0 < (a ^ b).bit_count() <= 3 < (a ^ c).bit_count()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(shingles, "candidates", lambda index, threshold: index.sparkSession.createDataFrame([], "cluster long, set long"))
    kept = lambda threshold: sorted(x["doc_id"] for x in shingles.representatives(docs, shingle=5, threshold=threshold).collect())
    assert kept(0.8) == [0, 2, 3]
    assert kept(0.995) == [0, 1, 2, 3]


@pytest.mark.parametrize("common", [0, 20_000])
def test_short_lines_go_too(spark, common, monkeypatch):
    ship(spark)
    monkeypatch.setattr(lines, "COMMON", common)
    texts = ["Home\nAbout us\n\na b c d\n\u4e00\u4e01\u4e02", None, "about  US\nHOME\n \nus\n\u4e00\u4e01\u4e02", "a b c d e\nd c b a\nhome\na b c\n\nnew", "home page\na b c e"]
    seen, want = [], {}
    for i, text in enumerate(texts):
        kept = []
        for line in (text or "").split("\n"):
            s = set(words(line))
            if not any(s and 5 * len(s & o) >= 4 * len(s | o) for o in seen):
                kept.append(line)
            seen.append(s)
        want[i] = None if text is None else "\n".join(kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.stage_lines(spark, docs, "").collect()} == want


@pytest.mark.parametrize("hot", [2, 20_000])
def test_doubled_passages_under_hot_anchors(spark, hot, monkeypatch):
    ship(spark)
    monkeypatch.setattr(repeats, "HOT", hot)
    r = random.Random(4)

    def some(n):
        return bytes(r.choice(b"abcdefgh ") for _ in range(n)).decode()

    texts = ["-" * 450, "-" * 300 + some(50), "ab" * 150 + some(80), "c" + "ab" * 120]
    for size in (85, 95, 105, 115, 120):
        for _ in range(4):
            x, passage = some(150), some(size)
            texts += [x + passage * 2 + some(150), x + passage + some(150), some(150) + passage + some(150), some(90) + passage * 3 + some(90), x[40:] + passage + some(60)]
    data = [t.encode() for t in texts]
    count = {}
    for b in data:
        for p in range(len(b) - 199):
            count[b[p : p + 200]] = count.get(b[p : p + 200], 0) + 1
    want = {}
    for i, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        want[i] = (int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in repeats.digests(docs).collect()} == want
