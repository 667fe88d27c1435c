"""The registered corpus queries, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as exact
from . import bpe, flac, language, line_dedup, minhash, mixing, negatives, pii, quality, sharding, spelling, toxicity
from .common import documents


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(pii.detect_pii(documents(spark, sf_dir)))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.stratified_shards(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir)).drop("loc_file", "loc_row")


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digests(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir)).drop("loc_file", "loc_row")


def bpe_codec(spark: SparkSession, path: str | None = None) -> bpe.Codec:
    """The codec of a rank file; by default the installed 50k byte-level vocabulary."""
    import public_tokenizers

    return bpe.Codec(spark, path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), bpe_codec(spark))


#: Target weights of op9_mixing: the corpus's size, with four fifths of its tokens from the good domain.
MIX_SHARES = {"good": 0.8, "poor": 0.15, "toxic": 0.05}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = mixing.mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), MIX_SHARES)
    return mixture.drop("loc_file", "loc_row")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(documents(spark, sf_dir))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.drop_shared_lines(documents(spark, sf_dir), min_docs=10, min_chars=1)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: op12's words lose a code point where this divides the checksum of their document and themselves.
ALTERED = 199


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.word_counts(documents(spark, sf_dir), min_chars=6, min_count=5, alter_every=ALTERED), factor=5)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label_col=label)


QUERIES = {f.__name__: f for f in (op1_pii, op2_sharding, op3_minhash, op4_flac, op5_quality, op6_toxicity, op7_exact_dedup, op8_bpe, op9_mixing, op10_language, op11_lines, op12_spelling, op13_negatives)}

ORACLE = {
    "op2_sharding": """
        WITH t AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
                lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END)) AS crc
        ), r AS (
            SELECT doc_id, coalesce('s' || source, '') AS stratum, octet_length(encode(coalesce(text, ''))) + 16 AS size,
                   list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                       lambda x: ('0x' || x)::UBIGINT)),
                       lambda c, b: xor(c // 256, crc[(xor(c, b) % 256)::INTEGER + 1])) AS c
            FROM documents, t
        ), hs AS (
            SELECT *, md5('interleave:' || coalesce(doc_id::VARCHAR, '') || ':' || xor(c, 4294967295::UBIGINT) || ':' || (size - 16)) AS h FROM r
        ), k AS (
            SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id) - 1 AS rank, count(*) OVER (PARTITION BY stratum) AS n FROM hs
        ), p AS (
            SELECT *, row_number() OVER (ORDER BY (2 * rank + 1)::DOUBLE / (2 * n)::DOUBLE, stratum, h, doc_id) - 1 AS pos, count(*) OVER () AS total FROM k
        ), s AS (SELECT *, (pos * 40) // total AS shard FROM p)
        SELECT doc_id, size::BIGINT AS size, xor(c, 4294967295::UBIGINT)::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
               (pos - (shard * total + 39) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard
        FROM s""",
    "op7_exact_dedup": """
        WITH k AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
        FROM k WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)""",
    "op11_lines": r"""
        WITH d AS (SELECT row_number() OVER () AS i, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT i, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM d),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        s AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT i) >= 10),
        m AS (SELECT k.*, s.key IS NOT NULL AS gone FROM k LEFT JOIN s USING (key)),
        g AS (SELECT i, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '') AS kept FROM m GROUP BY i)
        SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN g USING (i)""",
    "op12_spelling": r"""
        WITH RECURSIVE t AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
                lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END)) AS crc
        ), o AS (
            SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
        ), r AS (
            SELECT d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM o GROUP BY ALL
        ), c AS (
            SELECT w, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(d || ':' || w)), '..'), lambda x: ('0x' || x)::UBIGINT)),
                lambda c, b: xor(c // 256, crc[(xor(c, b) % 256)::INTEGER + 1])), 4294967295::UBIGINT) AS h FROM r, t
        ), a AS (
            SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INTEGER) || substring(w, (h % length(w))::INTEGER + 2) ELSE w END AS word, n FROM c
        ), v AS MATERIALIZED (
            SELECT word, sum(n)::BIGINT AS n FROM a WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
        ), cut AS MATERIALIZED (
            SELECT word, i, left(word, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1))::INTEGER AS i FROM v)
        ), pair AS (
            SELECT x.word, y.word AS near FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
            UNION SELECT x.word, v.word FROM cut x JOIN v ON x.rest = v.word
            UNION SELECT v.word, x.word FROM cut x JOIN v ON x.rest = v.word
        ), best AS (
            SELECT pair.word, count(*) AS n_near, arg_min(pair.near, (-y.n, pair.near)) AS near, max(y.n) AS most FROM pair JOIN v y ON y.word = pair.near GROUP BY pair.word
        ), f AS MATERIALIZED (
            SELECT v.word, v.n, CASE WHEN most >= 5 * v.n THEN near END AS form, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * v.n THEN most END AS form_n FROM v LEFT JOIN best USING (word)
        ), walk AS (
            SELECT word, word AS here, 0 AS steps FROM f UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL
        )
        SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY word) r USING (word)""",
    "op13_negatives": """
        WITH e AS MATERIALIZED (
            SELECT row_number() OVER () AS i, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS MATERIALIZED (
            SELECT a.i AS a, a.vec_id AS anchor_id, a.label = b.label AS same, a.i = b.i AS own, b.i AS b, b.vec_id AS other,
                   list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
            FROM e a JOIN e b ON a.vec_id % 100 = 0
        ), p AS (
            SELECT a, b AS p, anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same AND NOT own
            QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other, b) <= 5
        )
        SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, p.p ORDER BY score DESC, other, b)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.a = p.a AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10""",
}

