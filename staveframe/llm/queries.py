"""The queries of this subpackage, by name, and DuckDB's SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from staveframe.llm import ann, bpe, divergence, fingerprints, hnsw, html_text, jaccard, line_dedup, negatives, packing, quality, secrets, url_filter
from staveframe.llm._batches import table


def op1_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_secrets(spark, sf_dir):
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op4_quality(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "posterior", "score", "keep")


def op5_fingerprints(spark, sf_dir):
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_html(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_hnsw(spark, sf_dir):
    return hnsw.join(table(spark, sf_dir, "embeddings"))


def op10_jaccard(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "component_id", "kept")


def op11_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark, sf_dir):
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_url_filter, op3_secrets, op4_quality, op5_fingerprints, op6_line_dedup, op7_packing, op8_html, op9_hnsw, op10_jaccard, op11_ann, op12_hard_negatives, op13_divergence)}


#: Lines by key, the keys of three documents or more, and each document's lines without them.
OP6_SQL = r"""
WITH lines AS (
    SELECT doc_id, u.pos, u.line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS pos) AS u
), keyed AS (
    SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), gone AS (
    SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT keyed.*, gone.k IS NOT NULL AND keyed.doc_id <> gone.keeper AS lost FROM keyed LEFT JOIN gone USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


#: All pairs of usable vectors by their cosine, and what each vector reaches by links.
OP9_SQL = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), usable AS MATERIALIZED (
    SELECT vec_id, list_transform(x, lambda a: coalesce(a, 0)) AS x FROM vectors WHERE x IS NOT NULL AND len(list_filter(x, lambda a: a IS NULL OR NOT isfinite(a))) = 0 AND len(list_filter(x, lambda a: a <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95
), reached AS (
    SELECT vec_id AS id, vec_id AS other FROM vectors UNION SELECT reached.id, links.b FROM reached JOIN links ON links.a = reached.other
), least AS (
    SELECT id, min(other) AS component_id FROM reached GROUP BY id
), counted AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vectors.vec_id, coalesce(counted.n, 0) AS n_links, least.component_id, vectors.vec_id = least.component_id AS kept
FROM vectors JOIN least ON least.id = vectors.vec_id LEFT JOIN counted ON counted.a = vectors.vec_id
"""


#: All queries against all rows.
OP11_SQL = """
WITH vectors AS (
    SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), usable AS MATERIALIZED (
    SELECT vec_id, x FROM vectors WHERE len(list_filter(x, lambda a: a IS NULL OR NOT isfinite(a))) = 0 AND len(list_filter(x, lambda a: a <> 0)) > 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x) AS score FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: All anchors against all rows.
OP12_SQL = """
WITH vectors AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL
), usable AS MATERIALIZED (
    SELECT vec_id, label, list_transform(v, lambda a: floor(256 * a)) AS x FROM vectors WHERE len(list_filter(v, lambda a: a IS NULL OR NOT isfinite(a))) = 0
), scored AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM scored WHERE same) WHERE nth <= 5
), windows AS (
    SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM windows WHERE rank <= 5
"""

#: Every group with every kept term of its language.
OP13_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x60\x7B-\x7F]+', ' ', 'g'), ' ') AS words FROM documents
), words AS (
    SELECT id, lang, source, term FROM (SELECT id, lang, source, unnest(words) AS term FROM docs) WHERE term <> ''
), kept AS (
    SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), sizes AS (
    SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), found AS (
    SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term
), parts AS (
    SELECT DISTINCT lang, source FROM docs
), wholes AS (
    SELECT p.lang, p.source, coalesce(max(s.v), 0) AS v, coalesce(sum(f.n), 0) AS n FROM parts p LEFT JOIN sizes s ON s.lang = p.lang LEFT JOIN found f ON f.lang = p.lang AND f.source = p.source GROUP BY p.lang, p.source
), shares AS MATERIALIZED (
    SELECT w.lang, w.source, k.term, coalesce(f.n, 0) AS n, 1 + CAST(1000000000 * CAST(coalesce(f.n, 0) + 5 AS HUGEINT) // (w.n + 5 * w.v) AS BIGINT) AS p,
        1 + CAST(1000000000 * CAST(k.n + 5 AS HUGEINT) // (s.total + 5 * s.v) AS BIGINT) AS q
    FROM wholes w JOIN kept k ON k.lang = w.lang JOIN sizes s ON s.lang = w.lang LEFT JOIN found f ON f.lang = w.lang AND f.source = w.source AND f.term = k.term
), apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
    FROM parts a JOIN parts b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), everything AS (
    SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM everything
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL, "op9_hnsw": OP9_SQL, "op11_ann": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_divergence": OP13_SQL}
