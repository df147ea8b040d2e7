"""Queries of the training-data operators, one for each, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborix.llm import decontaminate, embedding_dedup, host_reputation, lm, ngram_join, packing, quality, sharding, substring_dedup, token_file
from arborix.llm._spark import scratch, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op7_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.by_bytes(table(spark, sf_dir, "documents"))


def op8_rans_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-file")
    token_file.write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_file.read(spark, path)


def op9_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bm25_decontamination,
        op2_quality_ftrl,
        op3_cross_polytope,
        op4_context_tree,
        op5_fingerprint_index,
        op6_host_reputation,
        op7_prefix_sum_shards,
        op8_rans_token_file,
        op9_nnls_packing,
        op10_ngram_jaccard,
    )
}

_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
# nodes(id) and links(a, b) in; reach(id, c) out: every node with each node it can reach
_REACH = """
    e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT id, id AS c FROM nodes UNION SELECT e.b, r.c FROM reach r JOIN e ON e.a = r.id)
"""

ORACLES: dict[str, str] = {
    "op3_cross_polytope": f"""
        WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
        links AS (SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.id < y.id AND list_cosine_similarity(x.v, y.v) >= 0.95),
        {_REACH}, n AS (SELECT a AS id, count(*) AS n FROM e GROUP BY ALL), c AS (SELECT id, min(c) AS c FROM reach GROUP BY ALL)
        SELECT c.id AS vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, c.id = c.c AS kept FROM c LEFT JOIN n USING (id)
    """,
    "op5_fingerprint_index": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
        word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM w),
        kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS k, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.k, '')) AS kept_sha256
        FROM w LEFT JOIN kept k USING (doc_id)
    """,
    "op6_host_reputation": rf"""
        WITH p AS (
            SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages
        ), h AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
        ), known AS (
            SELECT doc_id, min((quality = 1 AND coalesce(toxic, 0) = 0)::INT) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL
        ), seen AS (
            SELECT host, coalesce(sum(good), 0) AS good, count(good) AS n, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS d
            FROM h LEFT JOIN known ON doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:\.[a-z]+)?/?$', 1) AS BIGINT) GROUP BY ALL
        ), lev AS (
            SELECT *, CASE WHEN regexp_matches(host, '^[0-9.]+(:[0-9]*)?$') THEN len(d) WHEN len(d) >= 3 AND len(d[-1]) = 2 AND d[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS k FROM seen
        ), hosts AS (
            SELECT host, good, n, array_to_string(d[greatest(len(d) - k + 1, 1):], '.') AS suffix, array_to_string(d[greatest(len(d) - k, 1):], '.') AS domain FROM lev
        ), s0 AS (
            SELECT suffix, sum(good) AS good, sum(n) AS n, (SELECT (sum(good) + 1) / (sum(n) + 2) FROM hosts) AS prior FROM hosts GROUP BY suffix
        ), s1 AS (SELECT CASE WHEN sum(prior * (1 - prior) * (n - 1)) > 0 THEN (sum((good / n - prior) ** 2 * n) - sum(prior * (1 - prior))) / sum(prior * (1 - prior) * (n - 1)) ELSE 0.1 END AS rho FROM s0 WHERE n > 0
        ), s2 AS (SELECT suffix, (prior * m + good) / (m + n) AS up FROM s0, (SELECT least(greatest(1 / greatest(coalesce(rho, 0.1), 1e-6) - 1, 2), 200) AS m FROM s1)
        ), d0 AS (
            SELECT suffix, domain, sum(good) AS good, sum(n) AS n, any_value(up) AS prior FROM hosts JOIN s2 USING (suffix) GROUP BY suffix, domain
        ), d1 AS (SELECT CASE WHEN sum(prior * (1 - prior) * (n - 1)) > 0 THEN (sum((good / n - prior) ** 2 * n) - sum(prior * (1 - prior))) / sum(prior * (1 - prior) * (n - 1)) ELSE 0.1 END AS rho FROM d0 WHERE n > 0
        ), d2 AS (SELECT suffix, domain, (prior * m + good) / (m + n) AS up FROM d0, (SELECT least(greatest(1 / greatest(coalesce(rho, 0.1), 1e-6) - 1, 2), 200) AS m FROM d1)
        ), h0 AS (
            SELECT host, good, n, up AS prior FROM hosts JOIN d2 USING (suffix, domain)
        ), h1 AS (SELECT CASE WHEN sum(prior * (1 - prior) * (n - 1)) > 0 THEN (sum((good / n - prior) ** 2 * n) - sum(prior * (1 - prior))) / sum(prior * (1 - prior) * (n - 1)) ELSE 0.1 END AS rho FROM h0 WHERE n > 0
        ), ab AS (SELECT host, prior * m + good AS a, (1 - prior) * m + n - good AS b FROM h0, (SELECT least(greatest(1 / greatest(coalesce(rho, 0.1), 1e-6) - 1, 2), 200) AS m FROM h1)
        ), bound AS (
            SELECT host, least(a / (a + b) + 1.645 * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))), 1) AS bound FROM ab
        ), rules AS (
            SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(kind, name, prefix)
        ), fit AS (
            SELECT h.page_id, h.host, h.path, r.kind, r.name || r.prefix AS rule, row_number() OVER (PARTITION BY h.page_id ORDER BY len(r.name || r.prefix) DESC NULLS LAST, r.name || r.prefix) AS k
            FROM h LEFT JOIN rules r ON (h.host = r.name OR h.host LIKE '%.' || r.name) AND starts_with(h.path, r.prefix)
        )
        SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict FROM fit JOIN bound USING (host) WHERE k = 1
    """,
    # crc32 byte by byte, its table from the polynomial
    "op7_prefix_sum_shards": """
        WITH tab AS (
            SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)
        ), b AS (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents
        ), d AS (
            SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM b, tab
        ), r AS (
            SELECT *, row_number() OVER o AS place, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total
            FROM d WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)
        ), s AS (SELECT *, least(7, (2 * upto - size) * 8 // (2 * total))::INT AS shard FROM r)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INT AS grown_shard FROM s
    """,
    "op10_ngram_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_WORDS}) AS w FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w
        ), nodes AS (SELECT doc_id AS id FROM s), t AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), {_REACH}, c AS (SELECT id, min(c) AS c FROM reach GROUP BY ALL)
        SELECT s.doc_id, len(s.g) AS n_shingles, c.c AS component_id FROM s JOIN c ON c.id = s.doc_id
    """,
}
