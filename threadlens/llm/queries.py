"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, covering, langid, mixing, pivots, prefixtrie, quality, residues, rlindex, secrets, suffixtree,
               tensored, toxicity)
from .common import crc_bucket, read

VOCABULARY = "word_bpe_49k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    trees = langid.fit(docs.filter(crc_bucket("doc_id", 4) != 2))
    return langid.predict(docs, trees, keep=("doc_id",)).select(
        "row.doc_id", F.coalesce(crc_bucket("row.doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "lang_pred", "score", "bits_per_byte")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic").filter(crc_bucket("doc_id", 5) != 0)
    found = toxicity.score(docs, toxicity.fit(docs, labels), keep=("doc_id",))
    return found.select("row.doc_id", F.coalesce(crc_bucket("row.doc_id", 5) == 0, F.lit(False)).alias("held_out"),
                        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "flagged")


def op3_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return pivots.top_k(vectors.select("vec_id", pivots.whole("embedding").alias("v")), every=50, k=5)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY), keep=("doc_id",)) \
        .select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    mixed = mixing.mix(docs.select(F.col("doc_id").alias("id"), "source", mixing.size_of().alias("size")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", F.col("target").cast("double"),
                        (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.dedup(read(spark, sf_dir, "documents", "doc_id", "text"), with_text=False)


def op8_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlindex.dedup(read(spark, sf_dir, "documents", "doc_id", "text"), with_text=False)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = secrets.scan(docs, public_tokenizers.path(VOCABULARY), keep=("doc_id",), with_text=False)
    return found.select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("written").alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return quality.judge(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))


def op11_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return residues.mine(rows.select("vec_id", label.alias("label"), pivots.whole("embedding").alias("v")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op13_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensored.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_pivots": op3_pivots,
    "op4_bpe": op4_bpe,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_suffix_tree": op7_suffix_tree,
    "op8_run_length_index": op8_run_length_index,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
    "op11_residues": op11_residues,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_tensored": op13_tensored,
}
ORACLE: dict[str, str] = {
    "op3_pivots": """
        WITH whole AS (
            SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
            FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op7_suffix_tree": r"""
        WITH split AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        windows AS (
            SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k
            FROM split, unnest(range(1, len(ws) - 48)) AS t(i) WHERE doc_id IS NOT NULL),
        late AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM windows)
            WHERE least < doc_id),
        placed AS (
            SELECT s.doc_id, j, s.ws[j] AS word FROM split s, unnest(range(1, len(s.ws) + 1)) AS t(j)),
        marked AS (
            SELECT p.doc_id, p.j, p.word,
                   coalesce(max(l.i) OVER (PARTITION BY p.doc_id ORDER BY p.j) > p.j - 50, false) AS gone
            FROM placed p LEFT JOIN late l ON l.doc_id = p.doc_id AND l.i = p.j),
        kept AS (
            SELECT doc_id, count_if(gone)::BIGINT AS n_removed,
                   sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '')) AS h
            FROM marked GROUP BY doc_id)
        SELECT s.doc_id, len(s.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0) AS n_removed,
               coalesce(k.h, sha256('')) AS kept_sha256
        FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id""",
    "op11_residues": """
        WITH whole AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                   list_inner_product(a.v, c.v)::BIGINT AS score
            FROM whole a JOIN whole c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
        FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
          AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
        QUALIFY rank <= 5""",
    "op12_prefix_trie": """
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                       md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT DISTINCT conv_id FROM turns),
        steps AS (  -- a byte, then eight shifts
            SELECT conv_id, flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]
                                     FOR c IN string_split(conv_id::VARCHAR, '')]) AS ops FROM ids),
        convs AS (
            SELECT conv_id, xor(4294967295, list_reduce(list_concat([4294967295]::BIGINT[], ops), lambda crc, op:
                CASE WHEN op >= 0 THEN xor(crc, op) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384)
                     ELSE crc // 2 END)) % 9 AS h FROM steps),
        rebuilt AS (
            SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t
                ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos <= h
            UNION ALL
            SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > h),
        paths AS (
            SELECT conv_id, row_number() OVER w AS d, strlen(text) AS bytes,
                   string_agg(md5(length(role) || ':' || role || text), '') OVER w AS k
            FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
            UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
        ended AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS last FROM paths),
        nodes AS (
            SELECT k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                   CASE WHEN d > 0 THEN left(k, length(k) - 32) END AS above,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
            FROM ended GROUP BY k, d),
        kids AS (SELECT above, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above),
        below AS (  -- each node counts for all nodes on its own path
            SELECT p.k, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((n_convs - 1) * n.bytes) AS saved
            FROM nodes n LEFT JOIN kids ON kids.above = n.k
            JOIN paths p ON p.conv_id = n.conv_id AND p.d <= n.depth GROUP BY p.k)
        SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs,
               coalesce(kids.n, 0) AS n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN below b ON b.k = n.k LEFT JOIN kids ON kids.above = n.k
        LEFT JOIN nodes up ON up.k = n.above""",
    "op13_tensored": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                   ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)])
                   END AS items FROM split),
        shingles AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM sets),
        linked AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.item = b.item AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
        reached AS (
            SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reached r JOIN linked l ON l.x = r.y),
        least AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x)
        SELECT s.doc_id, len(s.items)::BIGINT AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
        FROM sets s JOIN least l ON l.x = s.doc_id""",
}
