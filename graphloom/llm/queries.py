"""Registered queries of the problems on training text and vectors (1, 5, 6, 7, 8, 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import sql_norm_uid
from graphloom.llm import bpe, chunker, docpairs, knn, leakage, syntax
from graphloom.session import table

#: Radius factors of problem 5; their recall is measured in tests/llm and given in the README.
RELAX_PAIRS, RELAX_ALL = 0.3, 0.15


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.unparsable(table(spark, d, "source_files")).select("path").distinct()


def p1_failures(spark: SparkSession, d: str) -> DataFrame:
    return syntax.unparsable(table(spark, d, "source_files"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "source_files"), table(spark, d, "entities"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.similar_pairs(table(spark, d, "entity_vectors"), relax=RELAX_PAIRS)


def p5_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return knn.most_similar(table(spark, d, "entity_vectors"), relax=RELAX_ALL)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented(table(spark, d, "source_files"), table(spark, d, "entities"), bodies=False).select("uid")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented(table(spark, d, "source_files"), table(spark, d, "entities"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """item_id, n_documents: which items leaked, and into how many documents."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return chunker.split_oversized(table(spark, d, "documents")).select("doc_id").distinct()


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunker.split_oversized(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_failures": p1_failures, "p1_rates": p1_rates, "p5_found": p5_found, "p5_neighbors": p5_neighbors, "p6_found": p6_found, "p6_pairs": p6_pairs, "p7_ids": p7_ids, "p8_found": p8_found, "p8_items": p8_items, "p9_found": p9_found, "p9_pieces": p9_pieces}

_VECTORS = f"""latest AS (
  SELECT uid, provider, vector FROM (
    SELECT {sql_norm_uid('uid')} AS uid, provider, vector, row_number() OVER (PARTITION BY {sql_norm_uid('uid')}, provider ORDER BY updated_at DESC NULLS LAST, vector DESC) AS rn FROM entity_vectors) WHERE rn = 1),
usable AS (SELECT uid, provider, vector::DOUBLE[] AS v FROM latest WHERE len(vector) = 64 AND list_max(list_transform(vector, lambda x: abs(x))) > 0),
pairs AS (SELECT a.uid, b.uid AS neighbor, list_cosine_similarity(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.provider, a.uid ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.uid) AS rk
  FROM usable a JOIN usable b ON a.provider = b.provider AND a.uid <> b.uid)"""

SQL = {"p5_found": f"WITH {_VECTORS} SELECT DISTINCT least(uid, neighbor) AS uid_a, greatest(uid, neighbor) AS uid_b FROM pairs WHERE rk <= 5 AND s >= 0.9"}
