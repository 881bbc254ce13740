"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, licences, media, mixing, ngram_join, pii, quality, sentencepiece_lattice, suffix_dedup, toxicity
from .memory import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Public SentencePiece model; SIFTLINE_PIECES names another file.
PIECES = os.environ.get("SIFTLINE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def piece_model() -> sentencepiece_lattice.Model:
    with open(PIECES, "rb") as file:
        return sentencepiece_lattice.Model.load(file.read())


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the encoding, and of the text that decoding gives."""
    done = sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), piece_model(), decoded=True)
    return done.select("doc_id", "n_bytes", "n_pieces", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def sentencepiece_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same encoding by the Viterbi fold: the pieces of the model with their scores as a unigram model."""
    model = dataclasses.replace(piece_model(), kind=sentencepiece_lattice.UNIGRAM)
    done = sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), model, decoded=True)
    return done.select("doc_id", "n_bytes", "n_pieces", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


#: The key of the surrogates of this query, whose texts are public and made up. Real ones need a secret key: SIFTLINE_PII_KEY, or the operator's parameter.
PII_KEY = os.environ.get("SIFTLINE_PII_KEY", "key for made-up texts only").encode()


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(table(spark, sf_dir, "documents"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("n_points")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


#: Bytes as pairs of hexadecimal digits, so that strings of 400 bytes can be cut, compared by digest, and covered.
OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
t AS (SELECT r, q, substr(h, 800 * q + 1, 1598) AS part FROM (SELECT r, h, unnest(range(length(h) // 800)) AS q FROM d)),
s AS (SELECT r, 400 * q + o AS p, md5(substr(part, 2 * o + 1, 800)) AS g FROM (SELECT r, q, part, unnest(range(length(part) // 2 - 399)) AS o FROM t)),
m AS (SELECT r, p FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
i AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 400 THEN 0 ELSE 1 END AS fresh FROM m),
j AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS k FROM i),
c AS (SELECT r, min(p) AS a, max(p) + 400 AS b FROM j GROUP BY r, k),
e AS (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS from_, b FROM c),
f AS (SELECT e.r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS left_ FROM e JOIN d USING (r) GROUP BY e.r),
k AS (SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(left_, h) AS left_ FROM d LEFT JOIN f USING (r))
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(left_)) AS kept_sha256,
       decode(unhex(array_to_string(list_filter(regexp_extract_all(left_, '[0-7].|[cd].[89ab].|e.[89ab].[89ab].|f.[89ab].[89ab].[89ab].|..'), lambda x: length(x) > 2 OR x < '80'), ''))) AS kept
FROM k
"""

OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), r AS (
  SELECT doc_id, sha256(body) AS text_sha256,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY body) AS group_size
  FROM n WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT DISTINCT x, x FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(reach) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_sentencepiece": op2_sentencepiece,
    "sentencepiece_unigram": sentencepiece_unigram,
    "op3_quality": op3_quality,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_pii": op5_pii,
    "op6_media": op6_media,
    "op7_licences": op7_licences,
    "op8_mixing": op8_mixing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_ngram_join": op10_ngram_join,
}

ORACLE_SQL: dict[str, str] = {"op4_suffix_dedup": OP4_SQL, "op9_exact_dedup": OP9_SQL, "op10_ngram_join": OP10_SQL}
