"""Walks over the graph: closures by frontier, paths, trees, cycles, levels, and the budgeted walk.

A closure is a loop over frontiers: join the edges, drop what was seen, cut. The edges are
projected to what the loop needs and cut once, so each round reads two narrow columns. Frontiers
of unknown size are joined by shuffle or by what Catalyst measures; none is collected, but in the
budgeted walk, whose budget bounds it.
"""

from __future__ import annotations

import heapq
import itertools
import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import hierarchy
from graphloom.operators.relational import edge_priority
from graphloom.session import broadcast_if_small, cut


#: Fronts that are kept apart before they are written as one table.
PARTS = 24


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """uid, depth of what src -> dst reaches from the seeds (column uid), seeds at depth 0; without a depth, all of it."""
    e = cut(edges.select("src", "dst").distinct())
    front = cut(seeds.select("uid").distinct().withColumn("depth", F.lit(0)))
    seen = [front]  # the fronts; a node is written once, and once more for every PARTS rounds
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        # Of measured size, so that the edges stay where they are while the front is small.
        step = e.join(broadcast_if_small(front.select(F.col("uid").alias("src"))), "src").select(F.col("dst").alias("uid")).distinct()
        front = cut(step.join(reduce(DataFrame.unionByName, seen), "uid", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen.append(front)
        if len(seen) > PARTS:
            seen = [cut(reduce(DataFrame.unionByName, seen))]
    return reduce(DataFrame.unionByName, seen)


def impact(relations: DataFrame, target: str, max_depth: int | None = None, kinds: list[str] = schema.IMPACT_KINDS) -> DataFrame:
    """uid, depth of everything that depends on the target, against the edges."""
    e = relations.where(F.col("kind").isin(kinds)).select(F.col("to_uid").alias("src"), F.col("from_uid").alias("dst"))
    seed = relations.sparkSession.createDataFrame([(target,)], "uid string")
    return closure(e, seed, max_depth).where("depth > 0")


def impact_summary(relations: DataFrame, entities: DataFrame, target: str, max_depth: int | None = None) -> DataFrame:
    """One row: direct, transitive, tests, public, files, confidence, risk.

    Risk counts four reasons: a public target or one that something exports, tests among the dependents, more than six
    dependents, and a route among them. Three make it high, one or any dependent medium.
    """
    reached = cut(impact(relations, target, max_depth))
    known = reached.join(entities.select("uid", "kind", "path", "is_public"), "uid", "left")
    direct = relations.where((F.col("to_uid") == target) & F.col("kind").isin(schema.IMPACT_KINDS))
    confidence = direct.agg(F.when(F.avg("confidence").isNull(), 0.4).otherwise(F.greatest(F.lit(0.1), F.avg("confidence"))).alias("confidence"))
    s = known.agg(
        F.count_if(F.col("depth") == 1).alias("direct"),
        F.count_if(F.col("depth") > 1).alias("transitive"),
        F.count_if(F.col("kind") == "test").alias("tests"),
        F.count_if(F.col("is_public")).alias("public"),
        F.count_distinct("path").alias("files"),
        F.count_if(F.col("kind") == "route").alias("routes"),
    ).crossJoin(confidence)
    shown = entities.where(F.col("uid") == target).agg(F.coalesce(F.max("is_public"), F.lit(False)).alias("shown"))
    exported = direct.agg(F.count_if(F.col("kind") == "exports").alias("exported"))
    s = s.crossJoin(shown).crossJoin(exported)  # one row each
    wide = F.col("direct") + F.col("transitive")
    reasons = sum((F.when(c, 1).otherwise(0) for c in (F.col("shown") | (F.col("exported") > 0), F.col("tests") > 0, wide > 6, F.col("routes") > 0)), F.lit(0))
    risk = F.when(reasons >= 3, "high").when((reasons >= 1) | (wide > 0), "medium").otherwise("low")
    return s.withColumn("risk", risk).drop("routes", "shown", "exported")


def impact_within(
    relations: DataFrame, target: str, max_depth: float = math.inf, max_nodes: float = math.inf, max_relations: float = math.inf, seconds: float = math.inf, kinds: list[str] = schema.IMPACT_KINDS, clock: Callable[[], float] = time.monotonic
) -> tuple[DataFrame, str | None]:
    """uid, depth of what depends on the target within limits, and the reason it stopped: timeout, maxRelations, maxNodes, maxDepth or None.

    Nodes count with the target. Of the front that passes a limit the links that still fit are followed, least uid first.
    """
    deadline = clock() + seconds
    e = cut(relations.where(F.col("kind").isin(kinds)).select(F.col("to_uid").alias("src"), F.col("from_uid").alias("dst")).distinct())
    front = cut(relations.sparkSession.createDataFrame([(target, 0)], "uid string, depth int"))
    seen, nodes, used, reason = [front], 1, 0, None
    for depth in itertools.count(1):
        step = front.select(F.col("uid").alias("src")).join(e, "src")
        known = reduce(DataFrame.unionByName, seen).select("uid")
        if clock() >= deadline or depth > max_depth:
            more = clock() < deadline and step.join(known, step.dst == known.uid, "left_anti").isEmpty()
            reason = None if more else "timeout" if clock() >= deadline else "maxDepth"
            break
        many = step.count() if max_relations < math.inf else 0
        if used + many > max_relations:
            reason = "maxRelations"
            step = step.orderBy("src", "dst").limit(int(max_relations) - used)
        used += many
        new = cut(step.select(F.col("dst").alias("uid")).distinct().join(known, "uid", "left_anti").withColumn("depth", F.lit(depth)))
        many = new.count()
        if nodes + many > max_nodes:
            reason = reason or "maxNodes"
            new = cut(new.orderBy("uid").limit(int(max_nodes) - nodes))
        nodes += many
        seen.append(new)
        front = new
        if reason or not many:
            break
        if len(seen) > PARTS:
            seen = [cut(reduce(DataFrame.unionByName, seen))]
    return reduce(DataFrame.unionByName, seen).where("depth > 0"), reason


def shortest_path(edges: DataFrame, start: str, goal: str, max_depth: int | None = None) -> list[str]:
    """The uids of a shortest path, the least by uid at each step back; empty if there is none."""
    e = cut(edges.select("src", "dst").distinct())
    spark = edges.sparkSession
    front = cut(spark.createDataFrame([(start, None, 0)], "uid string, parent string, depth int"))
    fronts = [front]
    found = start == goal
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        if found:
            break
        seen = reduce(DataFrame.unionByName, fronts)
        step = front.select(F.col("uid").alias("src")).join(e, "src").groupBy(F.col("dst").alias("uid")).agg(F.min("src").alias("parent"))
        front = cut(step.join(seen, "uid", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return []
        found = not front.where(F.col("uid") == goal).isEmpty()
        fronts.append(front)
    if not found:
        return []
    path = [goal]
    for front in fronts[:0:-1]:  # one lookup a step, in the front that holds it
        path.append(front.where(F.col("uid") == path[-1]).first()["parent"])
    return path[::-1]


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """uid, level: the longest path of src -> dst up to a node; nodes on or behind a cycle have none."""
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    left = cut(nodes.select("uid").distinct())
    done = None
    for level in itertools.count():
        blocked = e.join(left.select(F.col("uid").alias("src")), "src", "left_semi").select(F.col("dst").alias("uid")).distinct()
        free = cut(left.join(blocked, "uid", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        left = cut(left.join(free, "uid", "left_anti"))
    return done if done is not None else left.withColumn("level", F.lit(0)).limit(0)


def two_cycles(relations: DataFrame) -> DataFrame:
    """uid_a < uid_b that point at each other, by kinds of either edge."""
    a = relations.select(F.col("from_uid").alias("uid_a"), F.col("to_uid").alias("uid_b")).distinct()
    b = relations.select(F.col("to_uid").alias("uid_a"), F.col("from_uid").alias("uid_b")).distinct()
    return a.join(b, ["uid_a", "uid_b"], "left_semi").where("uid_a < uid_b")


def cycles(relations: DataFrame, kinds: list[str] = schema.TRAVERSAL_KINDS) -> DataFrame:
    """uid, cycle_uid of every node on a cycle of any length over the kinds; nodes that reach each other share the least uid."""
    link = relations.where(F.col("kind").isin(kinds)).select(F.col("from_uid").alias("parent"), F.col("to_uid").alias("child"))
    return hierarchy.cycle_members(link.where("parent IS NOT NULL AND child IS NOT NULL").distinct())


def reverse_dependents(file_deps: DataFrame, changed: DataFrame, depth: int = schema.INCREMENTAL_DEPTH, most: int = schema.INCREMENTAL_FILES) -> DataFrame:
    """path, depth of the files to do again after changes: at most `most`, nearest first, then by path."""
    edges = file_deps.select(F.col("to_path").alias("src"), F.col("from_path").alias("dst"))
    reached = closure(edges, changed.select(F.col("path").alias("uid")), depth)
    return reached.where("depth > 0").orderBy("depth", "uid").limit(most).select(F.col("uid").alias("path"), "depth")


# ---- the budgeted walk


@dataclass(frozen=True)
class Budget:
    """Limits of a walk; each stops it or, for files and tokens, skips what does not fit."""

    depth: int = 1
    nodes: int = schema.DEFAULT_NODES
    edges: int = schema.DEFAULT_EDGES
    files: float = math.inf
    tokens: float = math.inf
    seconds: float = math.inf


def tokens_of(row: dict) -> int:
    """A quarter of the characters of the row as JSON, in UTF-16 units, rounded up."""
    text = json.dumps(row, ensure_ascii=False, separators=(",", ":"), default=str)
    return -(-(len(text.encode("utf-16-le")) // 2) // 4)


def walk(entities: DataFrame, relations: DataFrame, start: str, budget: Budget, clock: Callable[[], float] = time.monotonic, kinds: list[str] | None = None) -> Iterator[tuple[str, dict]]:
    """Events of a best-first walk along edges in both directions: ('entity' | 'relation' | 'truncated', row).

    The best edge by priority goes first, then the shallower node, then the smaller uid. Edges are
    fetched a frontier at a time: all nodes waiting in the heap are asked for in one job, and of
    each node only as many best edges as the budget could still take.
    """
    deadline = clock() + budget.seconds
    rel = relations if kinds is None else relations.where(F.col("kind").isin(kinds))
    known: dict[str, dict | None] = {}
    near: dict[str, list[dict]] = {}
    spark = entities.sparkSession

    def fetch(uids: list[str]) -> None:
        ask = spark.createDataFrame([(u,) for u in uids if u not in near], "uid string")
        p = edge_priority(F.col("kind"), F.col("weight"), F.col("confidence"))
        r = rel.select("from_uid", "to_uid", "kind", "weight", "confidence", p.alias("priority"))
        both = r.join(F.broadcast(ask.withColumnRenamed("uid", "from_uid")), "from_uid").select(F.col("from_uid").alias("uid"), F.struct("*").alias("e")).unionByName(
            r.join(F.broadcast(ask.withColumnRenamed("uid", "to_uid")), "to_uid").select(F.col("to_uid").alias("uid"), F.struct("from_uid", "to_uid", "kind", "weight", "confidence", "priority").alias("e"))
        )
        order = F.struct((-F.col("e.priority")).alias("a"), F.col("e.from_uid").alias("b"), F.col("e.to_uid").alias("c"), F.col("e.kind").alias("d"))
        # The rank is limited before the rows move, so a hub never gathers more than the budget could take.
        ranked = both.distinct().withColumn("n", F.row_number().over(Window.partitionBy("uid").orderBy(order))).where(F.col("n") <= budget.edges + 1)
        best = ranked.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("es"))
        rows = {x["uid"]: [e["e"].asDict() for e in x["es"]] for x in best.collect()}
        for u in uids:
            near.setdefault(u, rows.get(u, []))
        ends = {e[k] for u in uids for e in near[u] for k in ("from_uid", "to_uid")} | set(uids)
        want = spark.createDataFrame([(u,) for u in ends if u not in known], "uid string") if ends - known.keys() else None
        if want is not None:
            got = {x["uid"]: x.asDict() for x in entities.select("uid", "kind", "name", "path").join(F.broadcast(want), "uid").collect()}
            known.update({u: got.get(u) for u in ends if u not in known})

    if clock() >= deadline:
        yield "truncated", {"reason": "timeout"}
        return
    fetch([start])
    if known.get(start) is None:
        return
    spent, files, seen_edges, seen = tokens_of(known[start]), {known[start]["path"]}, set(), {start}
    if spent > budget.tokens:
        return
    yield "entity", known[start] | {"depth": 0}
    heap: list[tuple] = [(0.0, 0, start)]
    while heap:
        if clock() >= deadline:
            yield "truncated", {"reason": "timeout"}
            return
        _, depth, uid = heapq.heappop(heap)
        if depth >= budget.depth:
            yield "truncated", {"reason": "maxDepth"}
            return
        if uid not in near:
            fetch([uid, *(u for _, d, u in heap if d < budget.depth and u not in near)])
        for e in near[uid]:
            key = (e["from_uid"], e["to_uid"], e["kind"])
            if key in seen_edges:
                continue
            other = e["to_uid"] if e["from_uid"] == uid else e["from_uid"]
            if len(seen_edges) >= budget.edges:
                yield "truncated", {"reason": "maxRelations"}
                return
            entity = known.get(other)
            cost = tokens_of(e) + (tokens_of(entity) if entity and other not in seen else 0)
            if spent + cost > budget.tokens or (entity and entity["path"] not in files and len(files) >= budget.files):
                continue
            if entity and other not in seen:
                if len(seen) >= budget.nodes:
                    yield "truncated", {"reason": "maxNodes"}
                    return
                seen.add(other)
                files.add(entity["path"])
                yield "entity", entity | {"depth": depth + 1}
                heapq.heappush(heap, (-e["priority"], depth + 1, other))
            spent += cost
            seen_edges.add(key)
            yield "relation", e


def neighborhood(entities: DataFrame, relations: DataFrame, start: str, budget: Budget = Budget(), **more) -> dict:
    """The walk collected: entities, relations, truncated, reason."""
    out: dict = {"entities": [], "relations": [], "truncated": False, "reason": None}
    for event, row in walk(entities, relations, start, budget, **more):
        if event == "truncated":
            out |= {"truncated": True, "reason": row["reason"]}
        else:
            out["entities" if event == "entity" else "relations"].append(row)
    return out


def edit_order(rows: list[dict], edges: list[dict]) -> list[dict]:
    """Entities with what they depend on first; ties and cycles keep the given order. Rows fit a context pack."""
    place = {r["uid"]: i for i, r in enumerate(rows)}
    needs = {u: {e["to_uid"] for e in edges if e["from_uid"] == u and e["kind"] in schema.EDIT_ORDER_KINDS and e["to_uid"] in place and e["to_uid"] != u} for u in place}
    out: list[str] = []
    heap = sorted((place[u], u) for u, n in needs.items() if not n)
    while heap:
        _, u = heapq.heappop(heap)
        out.append(u)
        for v, n in needs.items():
            if u in n:
                n.discard(u)
                if not n:
                    heapq.heappush(heap, (place[v], v))
    out += [u for u in place if u not in set(out)]
    return [rows[place[u]] for u in out]
