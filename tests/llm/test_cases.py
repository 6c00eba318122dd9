"""Edge cases with defined results, and parts of the models against independent computations."""

import collections

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from quillstone.llm import bpe, flac, langid, lines, lm, quality, topk
from quillstone.llm.common import crc_mod, ship, words

JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, score double, n_lines int"


def test_empty_tables(spark):
    ship(spark)
    docs = spark.createDataFrame([], SCHEMA)
    assert lm.score(docs, crc_mod("doc_id", 7) != 2).count() == 0
    assert flac.stored_and_read(docs).count() == 0
    assert langid.predict(docs, langid.fit(docs, PIECES), PIECES).count() == 0
    assert bpe.round_trip_digests(docs, JSON).count() == 0
    assert quality.score(docs, quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.search(vectors, vectors, k=3, dim=16, width=8).count() == 0
    some = spark.createDataFrame([(1, "a text", None, 0.0, 1)], SCHEMA)
    assert [r["lang_pred"] for r in langid.predict(some, langid.fit(docs, PIECES), PIECES).collect()] == ["und"]


def test_clashing_columns(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "one two three four five\nsix", "en", 7.0, 9), (2, "one two three four five", "en", 7.0, 9)], SCHEMA)
    scored = quality.score(docs, quality.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")))
    assert scored.columns == ["doc_id", "text", "lang", "n_lines", "score"] and all(0 <= r["score"] <= 1 for r in scored.collect())
    kept = lines.dedup_lines(docs)
    assert kept.columns == ["doc_id", "text", "lang", "score", "n_lines", "n_removed"]
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in kept.collect()} == {1: ("one two three four five\nsix", 2, 0), 2: ("", 1, 1)}


@pytest.mark.parametrize("block", [2, 20_000])
def test_lines_with_null_and_repeated_ids(spark, monkeypatch, block):
    """Null ids come first and ids may repeat: lines at the same place are not earlier than each other. Clusters may be cut."""
    ship(spark)
    monkeypatch.setattr(lines, "CLUSTER_ROWS", block)
    base = [f"w{i}" for i in range(30)]
    variants = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(12)]
    rows = [(None, "a b c d e"), (5, "a b c d e\nx"), (5, "a b c d e\ny"), (7, "q r s t u"), (7, "q r s t u"), (7, None), (9, "q r s t u v"), *[(20 + k, v) for k, v in enumerate(variants)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r["doc_id"], r["text"]) for r in lines.dedup_lines(docs).collect())
    place = lambda i, n: (-(1 << 63) if i is None else i, n)
    seen = [(place(i, n), set(words(x))) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if len(set(words(x))) >= 5]
    want = collections.Counter()
    for i, t in rows:
        kept = None if t is None else [x for n, x in enumerate(t.split("\n")) if not any(len(s := set(words(x))) >= 5 and p < place(i, n) and 5 * len(s & o) >= 4 * len(s | o) for p, o in seen)]
        want[i, None if kept is None else "\n".join(kept)] += 1
    assert got == want


def test_long_words_teach(spark):
    """However long a word is, the expected pieces of its segmentations add up to its bytes."""
    t = langid.trie(PIECES)
    for word, n in (("abc", 3.0), ("lorem" * 40, 2.0), ("ä" * 900, 1.0)):
        p = np.full(t.size, 1.0 / t.size)
        used = langid._expected(t, p, [word], np.array([n]))
        lengths = np.zeros(t.size)
        for i, piece in enumerate(_pieces(t)):
            lengths[i] = piece
        assert (used * lengths).sum() == pytest.approx(n * len((langid.START + word).encode()))


def _pieces(t):
    """Lengths of the trie's pieces, by walking it."""
    length, out, depth = {0: 0}, np.zeros(t.size, int), [0]
    nodes = [0]
    for node in nodes:
        for byte in range(256):
            to = int(t.step(np.array([node], np.int32), np.array([byte]))[0])
            if to:
                length[to] = length[node] + 1
                nodes.append(to)
                if t.piece_of[to] >= 0:
                    out[t.piece_of[to]] = length[to]
    return out


def test_sample_is_bounded_for_each_language(spark):
    ship(spark)
    rows = [(1, "gleiche Zeile", "de")] * 500 + [(i, f"word{i} of english", "en") for i in range(500)] + [(7, "une phrase", "fr")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES, max_rows=50)
    assert model[0] == ["de", "en", "fr"] or model[0] == ["en", "fr"]
    assert np.isfinite(model[1]).all() and model[1].sum(axis=0) == pytest.approx(1)


def test_noise_contrastive_gradient():
    """The step of train_texts against finite differences of the noise-contrastive loss."""
    rng = np.random.default_rng(1)
    ids = np.r_[0, rng.integers(0, lm.CLASSES, 40)]
    first = np.r_[0, np.repeat([1, 16], [15, 25])]
    share = rng.random(lm.CLASSES)
    share /= share.sum()
    flat = rng.normal(0, 0.3, lm.Parameters.size())

    def loss(x):
        p = lm.Parameters(x)
        q = lm._vectors(p, ids, first)[0][1:].astype(float)
        noise = np.random.default_rng(5).choice(lm.CLASSES, lm.NOISE, p=share)
        log_noise = np.log(lm.NOISE * share)
        own = (q * p.output[ids[1:]]).sum(axis=1) + p.bias[ids[1:]] - log_noise[ids[1:]]
        other = q @ p.output[noise].T + p.bias[noise] - log_noise[noise]
        return -(np.log(1 / (1 + np.exp(-own))).sum() + np.log(1 / (1 + np.exp(other))).sum()) / (len(ids) - 1)

    moved, much = lm.Parameters(flat.copy()), 1e6
    lm.train_texts(moved, ids, first, share, np.random.default_rng(5), np.full(len(flat), much**2), rate=1.0)
    gradient = -(moved.flat - flat) * much
    for i in rng.choice(len(flat), 60, replace=False):
        step = np.zeros(len(flat))
        step[i] = 1e-3
        assert gradient[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-3, abs=2e-3)


def test_dual_coordinate_descent_meets_its_optimum():
    """The hinge-loss solution: no other weights found by subgradient steps have a smaller primal objective."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(20, 6, replace=False)) for _ in range(60)]
    y = np.array([1.0 if s.sum() + rng.normal(0, 8) > 57 else -1.0 for s in rows])
    values = [np.ones(6) / np.sqrt(6)] * 60
    cost = np.full(60, 0.7)
    w, b = quality.dual_coordinate_descent(rows, values, y, cost, 20)

    def primal(w, b):
        m = np.array([w[s] @ v + b for s, v in zip(rows, values, strict=True)])
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - y * m)).sum()

    best = primal(w, b)
    for _ in range(300):
        assert primal(w + rng.normal(0, 0.02, 20), b + rng.normal(0, 0.02)) >= best - 0.02


def test_pipeline_stages_against_plain_python(spark, tmp_path):
    """Every stage on what the one before it kept: the quality scores decide who stays, lines, near copies and repeats go as a
    plain loop over all of them says, and the packed pieces cover exactly what is left."""
    ship(spark)
    rng = np.random.default_rng(4)
    vocabulary = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary, 40)) for _ in range(30)]
    passage = " ".join(rng.choice(vocabulary, 60))
    texts += [texts[3], texts[3] + " more", f"{texts[4]} {passage}", f"{texts[5]} {passage} end", *(f"$$$ %%% {k} @@@ !!! ###" for k in range(8)), "\n".join([texts[6], "short line", texts[7]]), None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("$$$" not in (t or ""))) for i, t in enumerate(texts)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    step, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, step, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = step.collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    assert {r["doc_id"] for r in out["quality"]} == {r["doc_id"] for r in scores.collect() if r["score"] >= 0.3}
    assert not any("$$$" in (r["text"] or "") for r in out["quality"])
    seen, after_lines = [], {}
    for r in sorted(out["quality"], key=lambda r: r["doc_id"]):
        kept = []
        for line in (r["text"] or "").split("\n"):
            s = set(words(line))
            if not s or not any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        after_lines[r["doc_id"]] = None if r["text"] is None else "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in out["lines"]} == after_lines
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, words(t)) for i, t in after_lines.items())}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert {r["doc_id"] for r in out["near_duplicates"]} == set(root.values())
    data = {i: (after_lines[i] or "").encode() for i in root.values()}
    count = collections.Counter(b[p : p + 200] for b in data.values() for p in range(len(b) - 199))
    for r in out["repeats"]:
        b = data[r["doc_id"]]
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        assert (r["text"] or "").encode() == bytes(x for x, g in zip(b, gone, strict=True) if not g)
    encode = bpe.encoder(JSON)
    want = {r["doc_id"]: len(np.frombuffer(encode.encode_packed(r["text"] or ""), np.uint32)) + 1 for r in out["repeats"]}
    got = collections.Counter()
    for r in out["packing"]:
        got[r["doc_id"]] += r["length"]
    assert got == want
