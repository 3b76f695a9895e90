"""Text search: tokens, postings, BM25 candidates, and the hybrid score.

Postings are a term-frequency table, so an index is a group-by and a query is a join on terms;
document frequencies and lengths are aggregates of it. A query's terms are a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.relational import neighbor_slice

FIELDS = ["name", "signature", "description", "docstring"]
#: What the index holds, beside the tags.
INDEXED = ["name", "signature", "path", "description", "docstring"]
K1, B = 1.2, 0.75


def searchable(text: Column) -> Column:
    """camelCase split, everything but ASCII letters and digits to blanks, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "[^a-zA-Z0-9]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.trim(searchable(text)), r"\s+"), lambda t: t != "")


def postings(entities: DataFrame) -> DataFrame:
    """uid, term, tf over the searchable fields and the tags."""
    text = F.concat_ws(" ", *INDEXED, F.array_join("tags", " "))
    return entities.select("uid", F.explode(tokens(text)).alias("term")).groupBy("uid", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(index: DataFrame, query: str, k: int) -> DataFrame:
    """uid, score: the k best documents that hold any of the query's terms."""
    spark = index.sparkSession
    terms = spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(tokens(F.col("q")))).alias("term"))
    lengths = index.groupBy("uid").agg(F.sum("tf").alias("dl"))
    totals = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("avgdl"))
    hits = index.join(F.broadcast(terms), "term")  # the terms of one query
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return (
        hits.join(F.broadcast(df), "term")  # at most one row a term
        .join(lengths, "uid")
        .crossJoin(F.broadcast(totals))  # one row
        .groupBy("uid")
        .agg(F.round(F.sum(idf * tf), 6).alias("score"))
        .orderBy(F.desc("score"), "uid")
        .limit(k)
    )


def lexical_score(query: str, name: Column, path: Column, signature: Column, corpus: Column) -> Column:
    """min(1, .55 x share of query tokens in the text + .35 same name + .2 in the path + .1 in the signature)."""
    q = tokens(F.lit(query))
    flat = F.array_join(q, " ")
    share = F.when(F.size(q) > 0, F.aggregate(q, F.lit(0.0), lambda acc, t: acc + F.when(F.contains(corpus, t), 1.0).otherwise(0.0)) / F.size(q)).otherwise(0.0)
    norm = lambda c: F.trim(searchable(F.coalesce(c, F.lit(""))))
    score = 0.55 * share + F.when(norm(name) == flat, 0.35).otherwise(0.0) + F.when(F.contains(norm(path), flat), 0.2).otherwise(0.0) + F.when(F.contains(norm(signature), flat), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def hybrid_search(entities: DataFrame, relations: DataFrame, query: str, k: int, similarity: DataFrame | None = None) -> DataFrame:
    """uid, score: .65 x (.85 lexical + .15 neighbors) + .35 x vector, over text hits, their neighbors and vector hits.

    similarity has uid and similarity of the query's vector to the entities'; without it the vector part is 0.
    """
    text = searchable(F.concat_ws(" ", *FIELDS))
    q = tokens(F.lit(query))
    index = entities.select("uid", "name", "path", "signature", text.alias("corpus"))
    hit = F.exists(q, lambda t: F.contains(F.col("corpus"), t))
    direct = index.where(hit).select("uid")
    near = neighbor_slice(relations, 5)
    candidates = direct.unionByName(near.join(direct.withColumnRenamed("uid", "neighbor"), "neighbor", "left_semi").select("uid"))
    if similarity is not None:
        candidates = candidates.unionByName(similarity.where("similarity > 0").select("uid"))
    candidates = candidates.distinct()
    scored = index.join(candidates, "uid").select("uid", lexical_score(query, F.col("name"), F.col("path"), F.col("signature"), F.col("corpus")).alias("lexical"))
    around = near.join(index.select(F.col("uid").alias("neighbor"), F.col("corpus").alias("other")), "neighbor").join(candidates, "uid", "left_semi")
    share = F.aggregate(q, F.lit(0.0), lambda acc, t: acc + F.when(F.contains(F.col("other"), t), 1.0).otherwise(0.0)) / F.size(q)
    around = around.groupBy("uid").agg(F.max(share).alias("around"))
    out = scored.join(around, "uid", "left")
    out = out.join(similarity, "uid", "left") if similarity is not None else out.withColumn("similarity", F.lit(0.0))
    score = 0.65 * (0.85 * F.col("lexical") + 0.15 * F.coalesce("around", F.lit(0.0))) + 0.35 * F.greatest(F.lit(0.0), F.coalesce("similarity", F.lit(0.0)))
    return out.select("uid", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "uid").limit(k)
