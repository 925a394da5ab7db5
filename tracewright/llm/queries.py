"""Registered queries of the training-data operators: name -> (function of (spark, sf_dir), SQL or None)."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunks, conversation_trie, fertility, language, lengths, licenses, line_align, mixing, ngram_join, ngram_lm, sharding, whitening
from .common import may_have, shared_dir, table, written

MULTI = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
ENGLISH = "byte_bpe_50k.tiktoken"


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    good = written(table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id").distinct(), "good")
    target = may_have(docs.select("doc_id", "text"), good, "doc_id").join(good, "doc_id", "left_semi")
    out = ngram_lm.score(docs, target)
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "ce_diff")])


def op2_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.withColumns({"cell_share": F.round("cell_share", 9), "p": F.round("p", 9)})


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each table has a map of its own, which later runs edit
    return sharding.shard(table(spark, sf_dir, "documents"), 40, f"{shared_dir(spark)}/slot-maps/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op5_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.dedup(table(spark, sf_dir, "documents"))


def op6_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.measure(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), public_tokenizers.path(MULTI), public_tokenizers.PATTERN)


def op7_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_align.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.array_join("deleted", ",").alias("deleted"))


def op8_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.histogram(table(spark, sf_dir, "documents"), public_tokenizers.path(ENGLISH), public_tokenizers.PATTERN)


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI), public_tokenizers.PATTERN)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def op12_language_duels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op13_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_cross_entropy_difference": op1_cross_entropy_difference,
    "op2_mix_to_weights": op2_mix_to_weights,
    "op3_virtual_slots": op3_virtual_slots,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_chunk_recipes": op5_chunk_recipes,
    "op6_tokeniser_fertility": op6_tokeniser_fertility,
    "op7_line_alignment": op7_line_alignment,
    "op8_length_histogram": op8_length_histogram,
    "op9_license_rules": op9_license_rules,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_language_duels": op12_language_duels,
    "op13_spectrum_whitening": op13_spectrum_whitening,
}

ORACLES: dict[str, str] = {
    "op1_cross_entropy_difference": r"""
        WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
        w AS MATERIALIZED (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev, doc_id IN (SELECT doc_id FROM good) AS target FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM l)),
        v AS MATERIALIZED (SELECT word, count(*) AS nb, count(*) FILTER (target) AS nt FROM w GROUP BY word HAVING count(*) >= 2),
        al AS (SELECT count(*) AS nb, count(*) FILTER (target) AS nt, count(*) FILTER (prev IS NULL) AS tb, count(*) FILTER (prev IS NULL AND target) AS tt FROM w),
        k AS (SELECT count(*) + 1 AS size, coalesce(sum(nb), 0) AS nb, coalesce(sum(nt), 0) AS nt FROM v),
        p AS MATERIALIZED (SELECT prev, word, count(*) AS nb, count(*) FILTER (target) AS nt FROM w GROUP BY prev, word),
        s AS (SELECT p.*, (p.prev IS NULL OR x.word IS NOT NULL) AND y.word IS NOT NULL AS paired, CASE WHEN p.prev IS NULL THEN al.tb ELSE x.nb END AS ab, CASE WHEN p.prev IS NULL THEN al.tt ELSE x.nt END AS ta,
            (coalesce(y.nb, al.nb - k.nb) + 0.5)::DOUBLE / (al.nb + 0.5 * size) AS ub, (coalesce(y.nt, al.nt - k.nt) + 0.5)::DOUBLE / (al.nt + 0.5 * size) AS ut
            FROM p LEFT JOIN v x ON x.word = p.prev LEFT JOIN v y ON y.word = p.word, al, k),
        loss AS MATERIALIZED (SELECT prev, word, -ln(CASE WHEN paired THEN 0.7::DOUBLE * nb / ab + (1 - 0.7::DOUBLE) * ub ELSE ub END) AS lb, -ln(CASE WHEN paired AND ta > 0 THEN 0.7::DOUBLE * nt / ta + (1 - 0.7::DOUBLE) * ut ELSE ut END) AS lt FROM s),
        d AS (SELECT t.doc_id, count(*) AS n, avg(lt) AS tl, avg(lb) AS bl FROM w t JOIN loss ON loss.prev IS NOT DISTINCT FROM t.prev AND loss.word = t.word GROUP BY t.doc_id)
        SELECT x.doc_id, coalesce(d.n, 0) AS n_tokens, round(tl, 6) AS target_loss, round(bl, 6) AS background_loss, round(tl - bl, 6) AS ce_diff FROM documents x LEFT JOIN d ON d.doc_id = x.doc_id
    """,
    "op4_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l
            FROM documents
        ), s AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
                ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS g
            FROM w
        ), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS MATERIALIZED (
            SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
            JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
        ), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
    """,
    "op5_chunk_recipes": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY x ORDER BY doc_id) = 1 AS kept, sha256(x) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY x)
    """,
    "op11_conversation_trie": r"""
        WITH t AS MATERIALIZED (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
            FROM conversations WHERE conv_id IS NOT NULL
        ), k AS MATERIALIZED (  -- crc32, bit by bit: a byte comes in, then eight shifts
            SELECT c, (xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: list_concat([ascii(s)::BIGINT], list_transform(range(8), lambda j: -1::BIGINT))))),
                lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT)) % 6 AS h
            FROM (SELECT DISTINCT c FROM t)
        ), b AS (SELECT k.c, k.h, least(k.h, count(t.c)) AS n FROM k LEFT JOIN t ON t.c = k.c - k.c % 100 GROUP BY k.c, k.h),
        r AS (
            SELECT b.c, t.i AS d, {'r': role, 't': txt} AS x FROM b JOIN t ON t.c = b.c - b.c % 100 AND t.i <= b.h
            UNION ALL SELECT b.c, t.i - b.h + b.n, {'r': role, 't': txt} FROM b JOIN t ON t.c = b.c AND t.i > b.h
        ), p AS MATERIALIZED (
            SELECT c, d, list(x) OVER (PARTITION BY c ORDER BY d) AS path, length(x.t) AS chars, d = max(d) OVER (PARTITION BY c) AS ending FROM r
            UNION ALL SELECT c, 0, [], 0, c NOT IN (SELECT c FROM r) FROM k
        ), n AS MATERIALIZED (
            SELECT d, path, min(c) AS c, count(*) AS n, max(chars) AS chars, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ending), '') AS ends FROM p GROUP BY d, path
        ), ch AS MATERIALIZED (SELECT path[1:d - 1] AS path, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
        s AS (  -- a node's ancestors lie on the way of its smallest member
            SELECT p.path, sum((u.n - 1) * u.chars)::BIGINT AS saved, count(*) FILTER (ch.n IS NULL) AS leaves
            FROM n u LEFT JOIN ch ON ch.path = u.path JOIN p ON p.c = u.c AND p.d <= u.d GROUP BY p.path
        )
        SELECT n.c AS conv_id, n.d AS depth, up.c AS parent_conv_id, n.n AS n_convs, coalesce(ch.n, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM n JOIN s ON s.path = n.path LEFT JOIN ch ON ch.path = n.path LEFT JOIN n up ON n.d > 0 AND up.path = n.path[1:n.d - 1]
    """,
}
