"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstrata.llm import exact_dedup, fingerprints, line_dedup, mixing, ngram_join, packing, pii, quality, sharding, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_documents(spark, sf_dir))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(_documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(_documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.clean(_documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


QUERIES = {f.__name__: f for f in (op1_pii, op2_token_counts, op3_sharding, op4_quality, op5_fingerprints, op6_exact_dedup, op7_packing, op8_mixing, op9_line_dedup, op10_ngram_join)}

ORACLES = {
    "op6_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)""",
    "op8_mixing": r"""
        WITH t AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
        s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM t GROUP BY k),
        w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS INT)] AS weight FROM s),
        l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER f, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS DOUBLE) AS lev
              FROM w WINDOW f AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        g AS (SELECT k, source_size, least(CAST(3 * source_size AS DOUBLE), max(lev) OVER () * weight) AS target FROM l),
        r AS (SELECT t.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                CAST(CAST('0x' || substr(md5(k), 1, 5) AS BIGINT) AS DOUBLE) / 1048576 AS u,
                row_number() OVER (PARTITION BY k ORDER BY length(bin(size)) * 8 + ((size * 8) >> (length(bin(size)) - 1)) % 8, md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) AS rank FROM t JOIN g USING (k))
        SELECT doc_id, size, source_size, target, CAST(floor(rank * rate + u) - floor((rank - 1) * rate + u) AS BIGINT) * size AS taken FROM r""",
    "op9_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
        h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 4) AS BIGINT) AS d, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
        p AS (SELECT *, lead(i) OVER w IS NULL OR (coalesce(lag(d) OVER w, 0) * 31 + d) % 101 % 2 = 0 AS ends,
                greatest(words, 1) AS least, sum(greatest(words, 1)) OVER w AS upto FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        n AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM p),
        x AS (SELECT a.doc_id, a.i AS s, b.i AS e FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49 AND b.upto - a.upto + a.least >= 50),
        u AS (SELECT doc_id, min(i) AS s, max(i) AS e FROM n GROUP BY doc_id, k HAVING count(*) > 1
              UNION SELECT doc_id, s, min(e) FROM x GROUP BY doc_id, s UNION SELECT doc_id, max(s), e FROM x GROUP BY doc_id, e),
        c AS (SELECT u.doc_id, s, e, string_agg(line, chr(10) ORDER BY i) AS chunk FROM u JOIN p ON p.doc_id = u.doc_id AND i BETWEEN s AND e GROUP BY ALL HAVING sum(words) > 0),
        f AS (SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(e) OVER w AS first_end FROM c WINDOW w AS (PARTITION BY chunk ORDER BY doc_id, s)),
        g AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM f WHERE doc_id <> first_doc OR s > first_end)
        SELECT doc_id, count(*) AS n_lines, count(g.i) AS n_removed, sha256(coalesce(string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY p.i), '')) AS text_sha256
        FROM p LEFT JOIN g USING (doc_id, i) GROUP BY doc_id""",
    "op10_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM i),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
        r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d)
        SELECT d AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d""",
}
