"""Context packs: search, slice, rerank, files, code, risks, edit order, and the token budget.

Everything up to the ranked entities is DataFrame work; the pack itself is one object of bounded
size, put together and trimmed on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import relational as R
from graphloom.operators import textsearch, traverse


def rerank(search: DataFrame, graph: DataFrame, similarity: DataFrame | None = None) -> DataFrame:
    """uid, rank: .45 search + .20 graph + .35 vector, four decimals, best first."""
    j = search.select("uid", F.col("score").alias("s")).join(graph.select("uid", F.col("score").alias("g")), "uid", "left")
    j = j.join(similarity.select("uid", "similarity"), "uid", "left") if similarity is not None else j.withColumn("similarity", F.lit(0.0))
    rank = 0.45 * F.col("s") + 0.20 * F.coalesce("g", F.lit(0.0)) + 0.35 * F.greatest(F.lit(0.0), F.coalesce("similarity", F.lit(0.0)))
    return j.select("uid", F.round(rank, 4).alias("rank")).orderBy(F.desc("rank"), "uid")


def code_slice(content: Column, first: Column, last: Column) -> Column:
    """The lines first..last of a text, any line ends."""
    return F.array_join(F.slice(F.split(content, "\r\n|\n|\r"), first, F.greatest(F.lit(0), last - first + 1)), "\n")


def slices(sources: DataFrame, entities: DataFrame) -> DataFrame:
    """path, first_line, last_line, code: the span of each file's entities."""
    text = sources.select("path", "content").dropDuplicates(["path"])
    return R.line_ranges(entities).join(text, "path").select("path", "first_line", "last_line", code_slice(F.col("content"), F.col("first_line"), F.col("last_line")).alias("code"))


def estimate(pack: dict) -> int:
    return traverse.tokens_of(pack)


def trim(pack: dict, most: int) -> dict:
    """The pack under a token budget: code shorter, then gone, then fewer edges, tests, entities, files."""
    pack = json.loads(json.dumps(pack, default=str))
    for part in (2000, 800, 200):
        if estimate(pack) <= most:
            return pack
        for c in pack["code"]:
            if len(c["code"]) > part:
                c["code"], c["truncated"] = c["code"][:part], True
    for key, keep in (("code", 0.5), ("relations", 0.5), ("tests", 0.5), ("code", 0), ("relations", 0.1), ("entities", 0.5), ("files", 0.5), ("relations", 0), ("tests", 0)):
        if estimate(pack) <= most:
            return pack
        pack[key] = pack[key][: int(len(pack[key]) * keep)]
        _align(pack)
    while estimate(pack) > most and len(pack["entities"]) > 1:
        pack["entities"] = pack["entities"][:-1]
        _align(pack)
    return pack


def _align(pack: dict) -> None:
    """Only what still has its entities."""
    uids, paths = {e["uid"] for e in pack["entities"]}, {e["path"] for e in pack["entities"]}
    pack["relations"] = [r for r in pack["relations"] if r["from_uid"] in uids and r["to_uid"] in uids]
    pack["files"] = [f for f in pack["files"] if f in paths]
    pack["code"] = [c for c in pack["code"] if c["path"] in paths]
    pack["editOrder"] = [u for u in pack["editOrder"] if u in uids]


def build(entities: DataFrame, relations: DataFrame, sources: DataFrame, query: str, strategy: str = "balanced", max_tokens: int = 8000, similarity: DataFrame | None = None, stop_on_truncation: bool = True) -> dict:
    """The pack of a query: entities with rank, relations, files, tests, code, risks, editOrder, truncated, reason."""
    files, depth, with_tests = schema.STRATEGIES[strategy]
    hits = textsearch.hybrid_search(entities, relations, query, max(25, 2 * files), similarity)
    graph = R.graph_scores(relations.join(hits.select(F.col("uid").alias("from_uid")), "from_uid", "left_semi"))
    ranked = [r.asDict() for r in rerank(hits, graph, similarity).limit(3 * files).join(entities.select("uid", "kind", "name", "path"), "uid").orderBy(F.desc("rank"), "uid").collect()]
    ranked = [r for r in ranked if with_tests or r["kind"] != "test"]
    pack: dict = {"query": query, "entities": [], "relations": [], "truncated": False, "reason": None}
    seen, edges = {}, {}
    for r in ranked[:files]:
        part = traverse.neighborhood(entities, relations, r["uid"], traverse.Budget(depth=depth, nodes=max(48, max_tokens // 40), edges=max(48, max_tokens // 40) - len(edges)), kinds=schema.TRAVERSAL_KINDS)
        seen |= {e["uid"]: e for e in part["entities"] if e["uid"] not in seen}
        edges |= {(e["from_uid"], e["to_uid"], e["kind"]): e for e in part["relations"]}
        if part["truncated"] and part["reason"] != "maxDepth":
            pack |= {"truncated": True, "reason": part["reason"]}
            if stop_on_truncation:
                break
    rank = {r["uid"]: r["rank"] for r in ranked}
    rows = sorted(({**e, "contextRank": rank.get(u, 0.0)} for u, e in ({r["uid"]: r for r in ranked} | seen).items() if with_tests or e["kind"] != "test"), key=lambda e: (-e["contextRank"], e["uid"]))
    pack["entities"], pack["relations"] = rows, list(edges.values())
    pack["tests"] = [e["uid"] for e in rows if e["kind"] == "test"][:20]
    pack["files"] = list(dict.fromkeys(e["path"] for e in rows if e["path"]))[:files]
    want = entities.where(F.col("path").isin(pack["files"])) if pack["files"] else entities.limit(0)
    pack["code"] = [{"path": r["path"], "firstLine": r["first_line"], "lastLine": r["last_line"], "code": r["code"], "truncated": False} for r in slices(sources, want).orderBy("path").collect()]
    pack["editOrder"] = [e["uid"] for e in traverse.edit_order([e for e in rows if e["path"]][:40], pack["relations"])][:10]
    return trim(pack, max_tokens)
