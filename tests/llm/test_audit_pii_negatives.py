"""Source divergence, personal data and hard negatives against plain versions, and their edge cases."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from quillstone.llm import divergence, negatives, pii
from quillstone.llm.common import ship
from quillstone.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_divergence", "op13_negatives"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    rows = lambda f: sorted(map(str, f[sorted(f.columns)].itertuples(index=False, name=None)))
    assert len(got) and rows(got) == rows(want)


# Source divergence


def plain_audit(docs, least, top):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))) for text, lang, source in docs]
    out = []
    for lang in {x for x, _, _ in terms}:
        df = collections.Counter(t for x, _, found in terms if x == lang for t in set(found))
        kept = sorted(t for t, n in df.items() if n >= least)
        count = {s: collections.Counter() for x, s, _ in terms if x == lang}
        for x, s, found in terms:
            if x == lang:
                count[s].update(t for t in found if t in kept)
        whole = sum(count.values(), collections.Counter())
        share = lambda c: {t: 1 + (1_000_000_000 * (c[t] + 5)) // (c.total() + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            found = {"pair": [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in count if o != s], "term": [(q[t] - p[s][t], t.encode()) for t in kept if count[s][t] and p[s][t] > q[t]]}
            for part, items in found.items():
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(sorted(items), 1) if part == "pair" or r <= top]
    return out


def test_audit_equals_a_plain_version(spark):
    ship(spark)
    rng = random.Random(3)
    pool = ["Haus", "haus", "Éa", "éa", "été", "x", "日本", "straße", "don't", "a-b", "😀z", "Q1Q"]
    docs = [(" ".join(rng.choices(pool, k=rng.randint(0, 30))), rng.choice(["de", "fr", None]), rng.choice(["a", "b", "é", None])) for _ in range(120)]
    docs += [(None, "it", "a"), ("12 34 --", "it", "b"), ("", None, "only"), ("word " * 20_000, "de", "a"), *[("same text here", "de", "hot")] * 60, ("rare", "pt", "z")]
    frame = spark.createDataFrame([(*d, 1, "n") for d in docs], "text string, lang string, source string, n int, term string").repartition(5)
    for least, top in ((30, 50), (3, 2)):
        got = divergence.audit(frame, least=least, top=top)
        assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
        assert sorted(map(tuple, got.collect())) == sorted(plain_audit(docs, least, top))


def test_audit_of_nothing(spark):
    ship(spark)
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and sum(doubled) % 10 == 0) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


def base_of(text):
    return [f"{k}:{a}:{b}" for k, a, b, _, base in pii.spans_of(text or "") if base]


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    alphabet = ["@", ".", "-", "+", " ", "(", ")", "a", "Z", "9", "1", "0", "255", "256", "4111111111111111", "x@y.zz", "+1 (555) 123-4567", "é", "😀", "1.2.3.4", "\n", "%"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 24))) for _ in range(20_000)]
    texts += ["@a.b@c.d x@foo.com-bar@baz.org a@b@c.d", "1.2.3.4.5.6.7.8.9 1.2.3 001.002.0255.4 300.1.1.1.1", "+" * 40 + "1 23456789012", "4111 1111 1111 1111 4111-1111-1111-1112", "a@b.c.", "é@b.c", "１.2.3.4.5"]
    for text in texts:
        assert base_of(text) == plain_base(text), text


def test_spans_of_long_runs_take_linear_time():
    n = 400_000
    for text in ("a" * n, "1" * n, "1." * n, "1 " * n, "a@" * n, "a.b" * n, "+1(" + "(" * n, "+1" * n, "AB12 " * n, "9-" * n, "@" * n, "1" * n + ".1.1.1"):
        pii.spans_of(text)
    assert [k for k, *_ in pii.spans_of("0" * n + "1.2.3.4")] == ["ip"]


def test_added_kinds_are_confirmed_and_follow_their_context():
    kinds = lambda text: [(k, text[a:b]) for k, a, b, _, base in pii.spans_of(text) if not base]
    assert kinds("Konto DE89 3704 0044 0532 0130 00 BITTE ZAHLEN") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("GB82WEST12345698765432") == [("iban", "GB82WEST12345698765432")]
    assert kinds("DE89 3704 0044 0532 0130 01") == [] and kinds("xGB82WEST12345698765432") == []
    assert kinds("build GB82WEST12345698765432") == []  # a word against it
    assert kinds("SSN: 219-09-9999") == [("ssn", "219-09-9999")] and kinds("on 219-09-9999") == [] and kinds("SSN 666-09-9999") == []
    assert kinds("call (555) 123-4567 now") == [("local_phone", "(555) 123-4567")] and kinds("sum 555 123 4567") == []
    assert kinds("tel +1 555 123 4567") == []  # within a base span
    score = {k: s for k, _, _, s, _ in pii.spans_of("mail a@b.cc")}
    assert score["email"] == 1.0 and {k: s for k, _, _, s, _ in pii.spans_of("x a@b.cc")}["email"] == 0.9


def test_pii_query_against_the_patterns(spark):
    ship(spark)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_pii"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in BASE] == [sum(x.startswith(k) for x in want) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(","))
    docs = spark.createDataFrame([(None, "a@b.cc"), (1, None), (1, ""), (2, "a@b.cc 1.1.1.1")], "doc_id long, text string").withColumn("spans", pytest.importorskip("pyspark.sql.functions").lit(1))
    assert sorted((r["doc_id"] or 0, r["spans"]) for r in pii.digests(docs).collect()) == [(0, "email:0:6"), (1, ""), (1, ""), (2, "email:0:6,ip:7:14")]
    assert pii.digests(docs.limit(0)).count() == 0


# Hard negatives


def plain_negatives(rows, is_anchor, positives=5, k=5, low=80, high=100):
    rows = {i: min((y, v) for j, y, v in rows if j == i) for i in {r[0] for r in rows}}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i in filter(is_anchor, rows):
        y, v = rows[i]
        scores = sorted((-dot(v, w), j, z == y) for j, (z, w) in rows.items() if j != i)
        for s, j, _ in [x for x in scores if x[2]][:positives]:
            found = [(-n, m) for n, m, same in scores if not same and low * -s <= 100 * -n <= high * -s][:k]
            out += [(i, j, r, m, -s, n) for r, (n, m) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed, sizes", [(1, {}), (2, {"leaf_rows": 16, "block_rows": 5}), (3, {"leaf_rows": 4, "sample_rows": 40})])
def test_negatives_equal_brute_force(spark, seed, sizes):
    ship(spark)
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 40, (6, 8))
    rows = [(i, int(rng.integers(0, 3)), [int(x) for x in centres[rng.integers(0, 6)] + rng.normal(0, 8, 8)]) for i in range(400)]
    rows += [(1000 + i, i % 2, rows[0][2]) for i in range(80)]  # one vector, many rows: ties by id
    rows += [(5, 1, [1] * 8), (5, 0, [2] * 8), (2000, 0, [0] * 8), (2001, 1, [3, 4]), (2010, 2, [])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "id long, label int, v array<long>, score string").repartition(6)
    import pyspark.sql.functions as F

    got = negatives.mine(frame, F.col("id") % 10 == 0, **sizes)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_points_that_take_no_part(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, 0, [0.5, -0.001]), (2, None, [1.0]), (None, 1, [1.0]), (3, 1, None), (4, 1, [None, 1.0]), (5, 1, [nan]), (6, 1, [inf]), (7, 1, [-inf, 1.0]), (8, 2, [])]
    got = negatives.points(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    assert sorted((r["id"], r["label"], list(r["v"])) for r in got.collect()) == [(1, 0, [128, -1]), (8, 2, [])]
    empty = negatives.points(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"))
    assert negatives.mine(empty, empty["id"] % 100 == 0).count() == 0


def test_products_are_exact():
    big = np.array([[1 << 30, 3]]), np.array([[(1 << 30) + 1, 5]])
    assert negatives.products(*big)[0, 0] == (1 << 30) * ((1 << 30) + 1) + 15
    with pytest.raises(OverflowError):
        negatives.products(np.array([[1 << 40]]), np.array([[1 << 40]]))
