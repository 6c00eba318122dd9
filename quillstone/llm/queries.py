"""The queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from quillstone.llm import bpe, divergence, flac, langid, lines, lm, negatives, packing, pii, quality, repeats, simhash, topk
from quillstone.llm.common import crc_mod, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, size=2048, end_id=1)


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("is_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"), length=200)


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.stored_and_read(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod("doc_id", 3) != 1), PIECE_BPE)
    held_out = (crc_mod("doc_id", 3) == 1).alias("held_out")
    return langid.predict(docs, model, PIECE_BPE).select("doc_id", held_out, "lang_pred", "score")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=0.8, min_words=1)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), k=10, dim=64, width=16)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", predicted)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=3)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), BYTE_BPE)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=30, top=50)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.points(vectors.select("vec_id", label.alias("label"), "embedding"))
    return negatives.mine(rows, F.col("id") % 100 == 0, positives=5, negatives=5, low=80, high=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_lm": op2_lm,
    "op3_repeats": op3_repeats,
    "op4_flac": op4_flac,
    "op5_langid": op5_langid,
    "op6_lines": op6_lines,
    "op7_topk": op7_topk,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_bpe": op10_bpe,
    "op11_divergence": op11_divergence,
    "op12_pii": op12_pii,
    "op13_negatives": op13_negatives,
}

_WORDS = "list_filter(string_split(translate(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op6_lines": f"""
        WITH doc AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
        line AS (SELECT doc_id, i, parts[i + 1] AS line FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM doc)),
        word AS (SELECT doc_id, i, line, list_sort(list_distinct({_WORDS.format("line")})) AS s FROM line),
        uniq AS (SELECT s, len(s) AS n, min(doc_id::HUGEINT * 1000000000000 + i) AS p, row_number() OVER () AS sid FROM word WHERE len(s) >= 1 GROUP BY s),
        tok AS (SELECT sid, n, p, unnest(s) AS w FROM uniq),
        freq AS (SELECT w, count(*) AS c FROM tok GROUP BY w HAVING count(*) > 1),
        rare AS (SELECT sid, n, p, tok.w, coalesce(c, 1) AS c, row_number() OVER (PARTITION BY sid ORDER BY coalesce(c, 1), tok.w) AS k FROM tok LEFT JOIN freq ON freq.w = tok.w),
        pre AS (SELECT * FROM rare WHERE c > 1 AND k <= n - ceil(0.8 * n) + 1),
        pair AS (SELECT DISTINCT a.sid AS a, b.sid AS b FROM pre a JOIN pre b ON a.w = b.w AND a.p < b.p AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)),
        hit AS (SELECT pair.b AS sid, min(x.p) AS p FROM pair JOIN uniq x ON x.sid = pair.a JOIN uniq y ON y.sid = pair.b
                WHERE 1.8 * len(list_intersect(x.s, y.s)) >= 0.8 * (x.n + y.n) GROUP BY pair.b),
        first AS (SELECT s, least(uniq.p, coalesce(hit.p, uniq.p)) AS p FROM uniq LEFT JOIN hit ON hit.sid = uniq.sid),
        marked AS (SELECT doc_id, i, line, coalesce(first.p < doc_id::HUGEINT * 1000000000000 + i, false) AS gone FROM word LEFT JOIN first ON first.s = word.s)
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL""",
    "op7_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
        d AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
                     CAST(list_sum(list_transform(list_zip(q.b, v.b), lambda z: abs(z[1] - z[2]))) AS INTEGER) AS distance
              FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d)
        SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10""",
    "op11_divergence": r"""
        WITH doc AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        tok AS (SELECT d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM doc),
        per AS (SELECT d, lang, source, term, count(*) AS n FROM tok GROUP BY ALL),
        kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS lang_n FROM per GROUP BY ALL HAVING count(*) >= 30),
        size AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
        known AS (SELECT per.lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM per JOIN kept USING (lang, term) GROUP BY ALL),
        total AS (SELECT lang, source, sum(n) AS total FROM known GROUP BY ALL),
        grp AS (SELECT g.lang, g.source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total
                FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN total USING (lang, source) LEFT JOIN size USING (lang)),
        dense AS (SELECT grp.lang, grp.source, term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p,
                         1 + (1000000000 * (lang_n + 5)) // (lang_total + 5 * v) AS q
                  FROM grp JOIN kept USING (lang) LEFT JOIN known USING (lang, source, term)),
        apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        out AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source
                LEFT JOIN apart ON apart.lang = g.lang AND apart.source = g.source AND apart.item = h.source
                UNION ALL SELECT lang, source, 'term', term, p - q FROM dense WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM out)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 50""",
    "op13_negatives": """
        WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS score
              FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
        p AS (SELECT anchor, id AS positive, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
        n AS (SELECT p.anchor, positive, p.score AS ps, s.id, s.score, row_number() OVER (PARTITION BY p.anchor, positive ORDER BY s.score DESC, s.id) AS r
              FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
        SELECT anchor AS anchor_id, positive AS positive_id, CAST(r AS INTEGER) AS rank, id AS negative_id, CAST(ps AS BIGINT) AS positive_score, CAST(score AS BIGINT) AS negative_score FROM n WHERE r <= 5""",
}
