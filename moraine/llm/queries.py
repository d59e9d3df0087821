"""The queries of this subpackage: name to function of (session, folder of tables)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm import embeddings, html, minhash, mixing, pieces, pii, suffix, tokens, toxicity
from moraine.llm.common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.labelled(documents, labels.where(~held_out("doc_id"))))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL["op3_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op7_near_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS low FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id,
       vec_id <= coalesce(c.low, vec_id) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; MORAINE_TOKENIZERS names another folder."""
    return f"{os.environ.get('MORAINE_TOKENIZERS', '/opt/tokenizers')}/{name}"


#: Splits text before byte-pair merging: contractions, letters, digits, other marks, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@query
def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "lossless", "pieces")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), PATTERN)


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.corpus_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mixed.drop("text", "lang", "source")


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated(table(spark, sf_dir, "documents")).drop("starts", "ends")
