"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaguelens.llm import (
    bpe,
    fingerprints,
    langid,
    packing,
    phrases,
    prefix_trie,
    quality,
    secrets,
    sharding,
    simhash,
    token_counts,
    vectors,
    warc,
)
from leaguelens.llm.common import crc_bucket, table
from leaguelens.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# base32 has no function in SQL: every five hexadecimal digits make four of its digits
ORACLE["op8_warc"] = """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
                      max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
               FROM pages)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               (1 + ((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '')
               AS payload_digest,
           CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = first OR first IS NULL THEN NULL ELSE first END AS refers_to
    FROM p
"""

# the id's CRC-32 is worked out byte by byte and bit by bit; a node's subtree is every node of whose
# smallest member it is a prefix
ORACLE["op11_prefix_trie"] = r"""
    WITH t AS (SELECT conv_id AS c, turn, octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') AS whole,
                      len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
               FROM conversations WHERE conv_id IS NOT NULL),
         own AS (SELECT c, list({'g': sha256(whole), 'w': words} ORDER BY turn NULLS FIRST, sha256(whole)) AS turns FROM t GROUP BY c),
         crc AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                     lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
                         lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 AS h FROM own),
         seq AS (SELECT own.c, list_concat(coalesce(base.turns, [])[1:h], own.turns[h + 1:]) AS s
                 FROM own JOIN crc USING (c) LEFT JOIN own base ON base.c = own.c - own.c % 20),
         every AS (SELECT c, len(s) AS size, unnest(range(0, len(s) + 1)) AS d, s FROM seq),
         n AS (SELECT c, size, d, md5(array_to_string(list_transform(s[1:d], lambda x: x.g), '')) AS node,
                      CASE WHEN d > 0 THEN md5(array_to_string(list_transform(s[1:d - 1], lambda x: x.g), '')) END AS up,
                      CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS w FROM every),
         g AS (SELECT node, min(c) AS c, min(d) AS d, min(up) AS up, min(w) AS w, count(*) AS n_convs,
                      sha256(coalesce(string_agg(CASE WHEN size = d THEN c END, ',' ORDER BY c), '')) AS ends FROM n GROUP BY node),
         k AS (SELECT up AS node, count(*) AS kids FROM g WHERE up IS NOT NULL GROUP BY up),
         sub AS (SELECT n.node, sum((g.n_convs - 1) * g.w)::BIGINT AS saved, count(*) FILTER (k.kids IS NULL) AS leaves
                 FROM g LEFT JOIN k USING (node) JOIN n ON n.c = g.c AND n.d <= g.d GROUP BY n.node)
    SELECT g.c AS conv_id, g.d AS depth, p.c AS parent_conv_id, g.n_convs, coalesce(k.kids, 0) AS n_children, leaves AS n_leaves,
           saved AS saved_tokens, g.ends AS ends_sha256
    FROM g JOIN sub USING (node) LEFT JOIN k USING (node) LEFT JOIN g p ON p.node = g.up
"""

ORACLE["op12_phrases"] = r"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
         w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
         o AS (SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
               UNION ALL SELECT lang, 2, unnest(list_transform(ws[1:-2], lambda x, i: x || ' ' || ws[i + 1])) FROM w
               UNION ALL SELECT lang, 3, unnest(list_transform(ws[1:-3], lambda x, i: x || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
         f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM o GROUP BY ALL),
         n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
         c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
         cut AS (SELECT lang, k, phrase, a, 1 AS c_at, ws[1] AS x, array_to_string(ws[2:], ' ') AS y FROM c
                 UNION ALL SELECT lang, k, phrase, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM c WHERE k = 3),
         s AS (SELECT cut.lang, cut.k, cut.phrase, cut.a, c_at, l.a AS l, r.a AS r, (1000000::HUGEINT * cut.a * cut.a) // (l.a * r.a) AS score
               FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x AND l.k = c_at
                        JOIN f r ON r.lang = cut.lang AND r.phrase = y AND r.k = cut.k - c_at),
         best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c_at) = 1),
         longer AS (SELECT lang, phrase, max(a) AS m FROM (
                        SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE k = 3
                        UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
         kept AS (SELECT best.* FROM best LEFT JOIN longer ON k = 2 AND longer.lang = best.lang AND longer.phrase = best.phrase
                  WHERE m IS NULL OR 100 * m < 50 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
           r::BIGINT AS r, n, score::BIGINT AS score
    FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

# every match is put between two private characters, so that the pieces between tell where it lies
_MATCHES = " UNION ALL ".join(
    rf"""SELECT doc_id, {order} AS ord, '{rule.kind}' AS kind, {rule.least} AS least,
                string_split(regexp_replace(coalesce(text, ''), '{rule.pattern.decode().replace("'", "''")}', chr(57344) || '\0' || chr(57345), 'g'), chr(57344)) AS ps,
                '{rule.pattern.decode().replace("'", "''")}' AS pat, {rule.group} AS grp FROM d"""
    for order, rule in enumerate(secrets.RULES)
)
ORACLE["op13_secrets"] = rf"""
    WITH d AS (SELECT row_number() OVER () AS doc_id, text FROM documents),
         ids AS (SELECT row_number() OVER () AS row, doc_id FROM documents),
         m AS ({_MATCHES}),
         e AS (SELECT doc_id, ord, kind, least, grp, unnest(list_transform(ps, lambda x, i: {{'i': i, 'part': split_part(x, chr(57345), 1),
                   'at': list_sum(list_transform(ps[1:i - 1], lambda y: length(replace(y, chr(57345), '')))),
                   'value': CASE WHEN grp = 2 THEN regexp_extract(split_part(x, chr(57345), 1), pat, 2) ELSE split_part(x, chr(57345), 1) END}})) AS x
               FROM m WHERE len(ps) > 1),
         s AS (SELECT doc_id AS row, ord, kind, coalesce(x.at, 0)::BIGINT AS start, (coalesce(x.at, 0) + length(x.part))::BIGINT AS stop
               FROM e WHERE x.i > 1 AND length(x.value) >= least),
         g AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                      count(*) FILTER (kind = 'hex') AS n_hex,
                      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < {len(secrets.BASE)}) AS base,
                      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans
               FROM s GROUP BY row)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM ids LEFT JOIN g USING (row)
"""


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bucket = crc_bucket(F.col("doc_id"), 4)
    model = langid.fit(docs, bucket != 2)
    marked = docs.withColumn("held_out", F.coalesce(bucket == 2, F.lit(False)))
    return langid.predict(marked, model, ["doc_id", "held_out"])


@_query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bucket = crc_bucket(F.col("doc_id"), 3)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), bucket != 1)
    marked = docs.withColumn("held_out", F.coalesce(bucket == 1, F.lit(False)))
    return quality.score(marked, model, ["doc_id", "held_out"])


@_query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@_query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is the folder in ``leaguelens.llm.token_cache``, else a new one."""
    docs = table(spark, sf_dir, "documents")
    cache = spark.conf.get("leaguelens.llm.token_cache", None) or shared_folder(spark, "token-cache")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), cache)


@_query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


@_query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


@_query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@_query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@_query
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@_query
def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))
