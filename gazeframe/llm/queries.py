"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe.llm import (
    centroids,
    context_tree,
    exact,
    fingerprint,
    jaccard,
    language,
    mixing,
    packing,
    private,
    quality,
    token_rows,
    trie,
    urls,
)
from gazeframe.llm.tokens import default_path
from gazeframe.session import prepare

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under its name, with SQL for the same rows where there is some."""

    def register(build: Builder) -> Builder:
        QUERIES[build.__name__] = lambda spark, sf_dir: build(prepare(spark), sf_dir.rstrip("/"))
        if sql is not None:
            SQL[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )


@query()
def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.labelled_urls(spark)).select(
        "page_id", "host", "path", "rule", "verdict", "probability"
    )


@query()
def op7_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.protect(table(spark, sf_dir, "documents"), private.configured_key(spark)).select("doc_id", "text")


@query()
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprint.edited(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprint.printed(F.col("sketch")).alias("fingerprint"),
        fingerprint.printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query()
def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "n_tokens", "epoch", "block", "weight", "mix_key"
    )


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_path()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query()
def op10_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows.packed_rows(table(spark, sf_dir, "documents"), default_path())


_OP3_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE
        WHEN w IS NULL OR len(w) = 0 THEN []
        WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
    FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), both_in AS (
    SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
    FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT x, y FROM both_in WHERE 100 * c >= 85 * (nx + ny - c)
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least USING (doc_id)
"""


@query(_OP3_SQL)
def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def _folded(rest: int, by: int):
    """crc32 of the id as text leaves ``rest`` by ``by``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(by)) == rest


@query()
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_folded(1, 3), F.lit(False)))
    return language.identify(docs, language.sample(docs.where("NOT held_out")), ["doc_id", "held_out"])


@query()
def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("trains", ~_folded(0, 10))
    return context_tree.score_running(docs, "trains").select(
        "doc_id",
        (~F.col("trains")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


@query(
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
)
def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def _rounds_sql(rounds: int) -> str:
    """One table of centroids per round, each made from the assignment to the one before."""
    steps = [
        """kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
        """c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, v AS c FROM kept
            ORDER BY sha256('3:' || vec_id) LIMIT 8)""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
            SELECT vec_id, any_value(v) AS v, min(d) AS distance, arg_min(cluster, (d, cluster)) AS cluster FROM (
                SELECT vec_id, v, cluster,
                    CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d
                FROM kept, c{i}) GROUP BY vec_id)"""
        )
        steps.append(
            f"""c{i + 1} AS MATERIALIZED (
            SELECT cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN (
                SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
                    SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (
                        SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY cluster, i)
                GROUP BY cluster) m USING (cluster))"""
        )
    return f"""WITH {', '.join(steps[:-1])}
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
        CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} USING (cluster)"""


@query(_rounds_sql(10))
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


_OP11_SQL = """
WITH own AS (
    SELECT conv_id, list(md5(strlen(role) || ':' || role || text) ORDER BY turn NULLS FIRST, role, text) AS ids,
        list(strlen(text) ORDER BY turn NULLS FIRST, role, text) AS sizes
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
    GROUP BY conv_id
), heads AS (
    SELECT *, xor(list_reduce(
        list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
            lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda c, s: xor(xor(c, s) >> 1, CASE WHEN xor(c, s) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 9 AS h
    FROM own
), rebuilt AS (
    SELECT o.conv_id, list_concat(coalesce(b.ids, [])[1:h], o.ids[h + 1:]) AS ids,
        list_concat(coalesce(b.sizes, [])[1:h], o.sizes[h + 1:]) AS sizes
    FROM heads o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), members AS (
    SELECT conv_id, d, len(ids) = d AS ends, array_to_string(ids[1:d], '') AS key, coalesce(sizes[d], 0) AS size
    FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM members GROUP BY key, d
), linked AS (
    SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children
    FROM nodes n LEFT JOIN nodes p ON n.depth = p.depth + 1 AND p.key = left(n.key, 32 * p.depth)
        LEFT JOIN (SELECT left(key, 32 * (depth - 1)) AS key, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL) c
            ON c.key = n.key AND c.depth = n.depth
), subtrees AS (
    SELECT key, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (
        SELECT left(key, 32 * unnest(range(0, depth + 1))) AS key, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * size AS saved
        FROM linked) GROUP BY key
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM linked JOIN subtrees USING (key)
"""


@query(_OP11_SQL)
def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))
