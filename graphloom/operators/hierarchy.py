"""Parent-child links to full hierarchies (problem 4).

Method. Leaves and roots are peeled round by round; where a round peels little, nodes with one
link in or one link out are folded into the node at its other end, so that chains of any length and
trees of any depth are gone after a number of rounds that grows with its logarithm. What never peels or folds is the
core, whose ways are short for its size, and the strongly connected components of the core are the cycles. With the links into cycle nodes taken out the
rest is a forest. Its Euler tours are built as linked lists of arcs (each node is entered once
and left once) and ranked in parallel: first every range of neighboring nodes contracts the
stretches that lie inside it, then random-mate contraction shortens what runs between ranges,
until a few thousand arcs are left, which one task ranks by pointer jumping; the removed arcs
are ranked in reverse order of removal. The ranks are entry and exit positions: a node's
descendants are the nodes that enter inside its interval, and one sweep in entry order, with the
open ancestors at the start of each range as a halo, gives depth and path.

Why it holds at size: nodes are 64-bit ids in every loop; each round is cut; a parent with a
third of all children is split over range partitions when siblings are chained; only rows whose
interval passes the end of their own range are copied, to the ranges they span and no others;
a single task gets no more than LOCAL_LINKS or LOCAL_ARCS rows, or one range.

Cases. Null endpoints and rows of another kind are left out; repeated links count once; keys
compare after normalization. A node on a cycle (a link to itself included) is reported as
on_cycle and starts a tree of its own, so nothing is followed round. A node with several
parents outside cycles hangs below the smallest parent uid in the forest; n_parents tells the
rest, and pairs_over_further_parents and descendants follow the other links too, exactly.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.keys import normalize_uid, uid_path
from graphloom.session import broadcast_if_small, cut

#: Rows with which a loop hands over to one task: links of a core, arcs of shortened lists.
LOCAL_LINKS = 1 << 12
LOCAL_ARCS = 1 << 13
#: Rows of one range partition.
SWEEP_ROWS = 1 << 16
#: A round that leaves more than this part of the links is followed by a splice.
SLOW = 0.9


def links(relations: DataFrame, kind: str = "contains") -> DataFrame:
    """Distinct normalized links: parent, child."""
    return (
        relations.where((F.col("kind") == kind) & F.col("from_uid").isNotNull() & F.col("to_uid").isNotNull())
        .select(normalize_uid(F.col("from_uid")).alias("parent"), normalize_uid(F.col("to_uid")).alias("child"))
        .distinct()
    )


def encode(link: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, uid) and links as ids (src, dst); the hash seed is raised until no two uids share an id."""
    uids = cut(link.select(F.explode(F.array("parent", "child")).alias("uid")).distinct())
    seed = 0
    while True:
        code = lambda c: F.xxhash64(F.col(c), F.lit(seed))  # noqa: B023,E731
        nodes = uids.select(code("uid").alias("id"), "uid")
        if nodes.groupBy("id").count().where("count > 1").isEmpty():
            return nodes, link.select(code("parent").alias("src"), code("child").alias("dst"))
        seed += 1


def _fold(edges: DataFrame, turn: int, end: str) -> tuple[DataFrame, DataFrame]:
    """The links with some nodes of a single link in (end dst) or out (end src) folded into its other node, and those nodes (id, before, after).

    A folded node hands its further links on, a row of it for each; one to the node it went into is not kept as a link. A
    node goes if its coin is 1, unless the node it would go into goes, so what it is linked to stays.
    """
    other = "src" if end == "dst" else "dst"
    single = edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min(other).alias("to")).where("n = 1").select("id", "to")
    heads = single.where(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 1)
    go = heads.join(heads.select(F.col("id").alias("to")), "to", "left_anti").withColumnRenamed("id", other)
    ends = ("to", "dst") if end == "dst" else ("src", "to")
    out = cut(edges.join(go, other).select(F.col(other).alias("id"), F.col(ends[0]).alias("before"), F.col(ends[1]).alias("after")))
    gone = broadcast_if_small(out.select("id"))
    rest = edges.join(gone, edges.src == gone.id, "left_anti").join(gone, edges.dst == gone.id, "left_anti")
    return cut(rest.unionByName(out.where("before <> after").select(F.col("before").alias("src"), F.col("after").alias("dst"))).distinct()), out


def peel(edges: DataFrame, local: int = LOCAL_LINKS) -> tuple[DataFrame, int, list[DataFrame]]:
    """The links left after peeling nodes without a parent or without a child, their number, and the nodes folded, turn by turn.

    No node may link to itself. Stops when nothing peels or folds any more, or when what is left fits one task.
    """
    edges = cut(edges)
    n, folded = edges.count(), []
    while n > local:
        has_parent = edges.select(F.col("dst").alias("src")).distinct()
        has_child = edges.select(F.col("src").alias("dst")).distinct()
        edges = cut(edges.join(has_parent, "src", "left_semi").join(has_child, "dst", "left_semi"))
        m = edges.count()
        if m > n * SLOW and m > local:
            for end in ("dst", "src"):
                edges, out = _fold(edges, len(folded), end)
                folded.append(out)
            m = edges.count()
        if m == n:
            break
        n = m
    return edges, n, folded


def _with_loops(found: DataFrame, loops: DataFrame) -> DataFrame:
    """id, cycle with the nodes (id) that are a cycle by themselves, unless they lie on a greater one."""
    return found.unionByName(loops.distinct().join(found, "id", "left_anti").select("id", F.col("id").alias("cycle")))


def _rejoin(found: DataFrame, folded: list[DataFrame]) -> DataFrame:
    """id, cycle with the folded nodes put back: one is on a cycle if nodes before and after it are on the same.

    A node that one was folded into and that comes after it as well is on a cycle, at least on that of the two.
    """
    for out in reversed(folded):
        found = _with_loops(found, out.where("before = after").select(F.col("before").alias("id")))
        before = found.select(F.col("id").alias("before"), "cycle")
        after = found.select(F.col("id").alias("after"), "cycle")
        found = cut(found.unionByName(out.join(before, "before").join(after, ["after", "cycle"]).select("id", "cycle").distinct()))
    return found


def _components(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Node and component of every cycle in the links of one task: peels what is left, then Tarjan without recursion."""
    parts = list(frames)
    if not parts:
        return
    links_ = pd.concat(parts)
    src, dst = links_["src"].to_numpy(), links_["dst"].to_numpy()
    while len(src):
        keep = np.isin(src, dst) & np.isin(dst, src)
        if keep.all():
            break
        src, dst = src[keep], dst[keep]
    if not len(src):
        return
    names, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = flat[: len(src)], flat[len(src) :]
    order = np.argsort(a, kind="stable")
    to = b[order].tolist()
    first = np.searchsorted(a[order], np.arange(len(names) + 1)).tolist()
    n = len(names)
    number, low, open_, comp = [0] * n, [0] * n, [], [-1] * n
    clock = 0
    for start in range(n):
        if number[start]:
            continue
        work = [(start, first[start])]
        clock += 1
        number[start] = low[start] = clock
        open_.append(start)
        while work:
            v, at = work.pop()
            if at < first[v + 1]:
                work.append((v, at + 1))
                w = to[at]
                if not number[w]:
                    clock += 1
                    number[w] = low[w] = clock
                    open_.append(w)
                    work.append((w, first[w]))
                elif comp[w] < 0:
                    low[v] = min(low[v], number[w])
                continue
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
            if low[v] == number[v]:
                while True:
                    w = open_.pop()
                    comp[w] = v
                    if w == v:
                        break
    comp_ = np.array(comp)
    size = np.bincount(comp_, minlength=n)
    loop = np.zeros(n, bool)
    loop[a[a == b]] = True
    on = (size[comp_] > 1) | loop
    label = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(label, comp_, names)
    yield pd.DataFrame({"id": names[on], "cycle": label[comp_][on]})


def _color(edges: DataFrame) -> DataFrame:
    """id, color by forward and backward coloring: a color is the least id that reaches a node, and the nodes are those that reach it as well."""
    color = cut(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("color", F.col("id")))
    while True:
        pushed = edges.join(color, edges.src == color.id).select(F.col("dst").alias("id"), "color")
        new = cut(color.unionByName(pushed).groupBy("id").agg(F.min("color").alias("color")))
        still = new.join(color, ["id", "color"], "left_anti").isEmpty()
        color = new
        if still:
            break
    same = cut(
        edges.join(color.select(F.col("id").alias("src"), F.col("color").alias("c1")), "src")
        .join(color.select(F.col("id").alias("dst"), F.col("color").alias("c2")), "dst")
        .where("c1 = c2")
        .select("src", "dst", F.col("c1").alias("color"))
    )
    back = cut(color.where("id = color"))
    fresh = back
    while not fresh.isEmpty():
        step = same.join(fresh.select(F.col("id").alias("dst"), "color"), ["dst", "color"]).select(F.col("src").alias("id"), "color").distinct()
        fresh = cut(step.join(back, ["id", "color"], "left_anti"))
        back = cut(back.unionByName(fresh))
    return back


def cycle_nodes(edges: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """id, cycle (the least id on it) for the nodes on a cycle of src -> dst."""
    rest, found, folded = edges.where("src <> dst"), None, []
    while True:
        rest, n, more = peel(rest, local)
        folded += more
        last = n <= local
        if last:
            part = rest.coalesce(1).mapInPandas(_components, "id bigint, cycle bigint")
        else:
            back = _color(rest)
            many = back.groupBy("color").count().where("count > 1").select("color")
            part = back.join(many, "color", "left_semi").select("id", F.col("color").alias("cycle"))
            rest = rest.join(back, rest.src == back.id, "left_anti").join(back, rest.dst == back.id, "left_anti")
        found = part if found is None else found.unionByName(part)
        if last:
            break
    found = cut(_with_loops(_rejoin(cut(found), folded), edges.where("src = dst").select(F.col("src").alias("id"))))
    if not folded:
        return found
    least = found.groupBy("cycle").agg(F.min("id").alias("least"))
    return found.join(least, "cycle").select("id", F.col("least").alias("cycle"))


def cycle_uids(relations: DataFrame, kind: str = "contains", local: int = LOCAL_LINKS) -> DataFrame:
    """uid, cycle_uid for every node on a cycle."""
    return cycle_members(links(relations, kind), local)


def cycle_members(link: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """cycle_uids of distinct links parent, child."""
    nodes, edges = encode(cut(link))
    on = cut(cycle_nodes(edges, local))
    named = nodes.join(broadcast_if_small(on), "id")
    least = named.groupBy("cycle").agg(F.min("uid").alias("cycle_uid"))
    return named.join(least, "cycle").select("uid", "cycle_uid")


def _next_row(df: DataFrame, keys: list[str], value: str, partitions: int) -> DataFrame:
    """df with at (dense position in key order) and follower (the next row's keys[0] and value), without a group in one task."""
    ranged = cut(df.repartitionByRange(partitions, *keys).withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part").orderBy(*keys)
    heads = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(*keys, value)).alias("head"))
    wp = Window.orderBy("part")  # over the partitions, not over the rows
    heads = cut(heads.select("part", F.coalesce(F.sum("rows").over(wp.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.lead("head").over(wp).alias("after")))
    pair = F.struct(F.col(keys[0]).alias("k"), F.col(value).alias("v"))
    inner = ranged.withColumn("row", F.row_number().over(w)).withColumn("inner_next", F.lead(pair).over(w))
    after = F.when(F.col("after").isNotNull(), F.struct(F.col(f"after.{keys[0]}").alias("k"), F.col(f"after.{value}").alias("v")))
    return inner.join(F.broadcast(heads), "part").select(*df.columns, (F.col("offset") + F.col("row") - 1).alias("at"), F.coalesce("inner_next", after).alias("follower"))


def _chains(x: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the arcs x (ascending) of one range: the last arc of each one's stretch inside it (its place), the steps to that, and whether none leads to it.

    A stretch ends before the end of a list, so ends stay arcs of their own.
    """
    at = np.minimum(np.searchsorted(x, nxt), len(x) - 1)
    inside = (x[at] == nxt) & (nxt[at] >= 0)
    entered = np.zeros(len(x), bool)
    entered[at[inside]] = True
    at = np.where(inside, at, np.arange(len(x)))
    dist = inside.astype(np.int64)
    while True:
        ahead = at[at]
        if (ahead == at).all():
            return at, dist, ~entered
        dist = dist + dist[at]
        at = ahead


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """arc, next, dist, stays: an arc that stays steps to the first arc behind its stretch, and so does each that goes."""
    parts = list(frames)
    if not parts:
        return
    arcs = pd.concat(parts)
    if arcs.empty:
        return
    order = np.argsort(arcs["arc"].to_numpy())
    x, nxt = arcs["arc"].to_numpy()[order], arcs["next"].to_numpy()[order]
    at, dist, first = _chains(x, nxt)
    end = nxt < 0
    yield pd.DataFrame({"arc": x, "next": nxt[at], "dist": np.where(end, 0, dist + 1), "stays": first | end})


def _rank_local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(frames)
    if not parts:
        return
    arcs = pd.concat(parts)
    x, nxt, dist = (arcs[c].to_numpy() for c in ("arc", "next", "dist"))
    order = np.argsort(x)
    x, nxt, dist = x[order], nxt[order], dist[order].copy()
    at = np.searchsorted(x, nxt)
    end = nxt < 0
    at[end] = np.flatnonzero(end)
    dist[end] = 0
    while True:
        ahead = at[at]
        if (ahead == at).all():
            break
        dist = dist + dist[at]
        at = ahead
    yield pd.DataFrame({"arc": x, "rank": dist, "last": x[at]})


def rank_lists(arcs: DataFrame, local: int = LOCAL_ARCS) -> DataFrame:
    """arc, rank (steps to the end of its list), last (the arc at that end); arcs has arc, next (-1 at an end).

    Each partition of arcs is contracted in its task first; partitions of bounded size that hold neighbors make that most of the work.
    """
    stretches = cut(arcs.select("arc", "next").mapInPandas(_contract, "arc bigint, next bigint, dist bigint, stays boolean"))
    live = stretches.where("stays").select("arc", "next", "dist")
    removed: list[DataFrame] = [stretches.where("NOT stays").select("arc", "next", "dist")]
    turn = 0
    while live.count() > local:
        coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(turn)), F.lit(2)) == 1  # noqa: B023,E731
        # An arc goes when its coin is 1, its predecessor's is 0 and it ends no list; the predecessor takes over its step.
        out = live.where(coin("arc") & (F.col("next") >= 0)).select(F.col("arc").alias("next"), F.col("next").alias("next2"), F.col("dist").alias("dist2"))
        kept = live.where(~coin("arc")).join(out, "next", "left")
        spliced = cut(
            kept.select(
                "arc",
                F.when(F.col("next2").isNotNull(), F.col("next2")).otherwise(F.col("next")).alias("next"),
                F.when(F.col("next2").isNotNull(), F.col("dist") + F.col("dist2")).otherwise(F.col("dist")).alias("dist"),
                F.when(F.col("next2").isNotNull(), F.struct(F.col("next").alias("arc"), F.col("next2").alias("next"), F.col("dist2").alias("dist"))).alias("gone"),
            )
        )
        gone = spliced.where(F.col("gone").isNotNull()).select("gone.*")
        removed.append(gone)
        stay = live.where(coin("arc")).join(gone.select("arc"), "arc", "left_anti")
        live = cut(spliced.select("arc", "next", "dist").unionByName(stay))
        turn += 1
    ranks = cut(live.coalesce(1).mapInPandas(_rank_local, "arc bigint, rank bigint, last bigint"))
    for gone in reversed(removed):
        ahead = ranks.select(F.col("arc").alias("next"), F.col("rank").alias("r"), F.col("last").alias("l"))
        back = gone.join(ahead, "next").select(
            "arc",
            (F.col("dist") + F.col("r")).alias("rank"),
            F.col("l").alias("last"),
        )
        ranks = cut(ranks.unionByName(back))
    return ranks


def _sweep(pdf: pd.DataFrame) -> pd.DataFrame:
    """Depth and path of the rows of one range; halo rows are the ancestors open where it starts."""
    pdf = pdf.sort_values(["root", "entry"], kind="stable")
    keep, depth, path = [], [], []
    open_: list[tuple[int, int, str]] = []
    for i, (root, entry, exit_, uid, halo) in enumerate(zip(pdf["root"].tolist(), pdf["entry"].tolist(), pdf["exit"].tolist(), pdf["uid"].tolist(), pdf["halo"].tolist(), strict=True)):
        while open_ and (open_[-1][0] != root or open_[-1][1] < entry):
            open_.pop()
        open_.append((root, exit_, uid))
        if not halo:
            keep.append(i)
            depth.append(len(open_) - 1)
            path.append([u for _, _, u in open_])
    out = pdf.iloc[keep][["id", "uid", "entry", "exit"]].copy()
    out["depth"], out["path"] = depth, path
    return out


def _spanned(heads: pd.DataFrame):
    part, root, head = (heads[c].to_numpy() for c in ("part", "root", "head"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A copy of each row for every later range that starts inside its interval."""
        for pdf in frames:
            low, high = np.searchsorted(root, pdf["root"], "left"), np.searchsorted(root, pdf["root"], "right")
            rows, to = [], []
            for i, (a, b, entry, exit_) in enumerate(zip(low, high, pdf["entry"], pdf["exit"], strict=True)):
                spans = part[a + np.searchsorted(head[a:b], entry, "right") : a + np.searchsorted(head[a:b], exit_, "left")]
                rows += [i] * len(spans)
                to += spans.tolist()
            out = pdf.iloc[rows][["id", "uid", "root", "entry", "exit"]].copy()
            out["part"] = np.array(to, np.int32)
            yield out

    return run


def euler_forest(tree: DataFrame, partitions: int, local: int = LOCAL_ARCS) -> DataFrame:
    """id, uid, root, entry, exit for a forest given as id, uid, parent (null at a root)."""
    rows = _next_row(tree, ["parent", "uid"], "id", partitions)
    rows = cut(rows.select("id", "uid", "parent", "at", F.when(F.col("follower.k") == F.col("parent"), F.col("follower.v")).alias("sibling")))
    place = rows.select("id", "at")
    first = rows.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.min(F.struct("uid", "at")).alias("f")).select(F.col("parent").alias("id"), F.col("f.at").alias("first"))
    sib = place.select(F.col("id").alias("sibling"), F.col("at").alias("sibling_at"))
    up = place.select(F.col("id").alias("parent"), F.col("at").alias("parent_at"))
    full = cut(rows.join(first, "id", "left").join(sib, "sibling", "left").join(up, "parent", "left").select("id", "uid", "at", "first", "sibling_at", "parent_at"))
    enter = F.struct((F.col("at") * 2).alias("arc"), F.coalesce(F.col("first") * 2, F.col("at") * 2 + 1).alias("next"))
    leave = F.struct((F.col("at") * 2 + 1).alias("arc"), F.coalesce(F.col("sibling_at") * 2, F.col("parent_at") * 2 + 1, F.lit(-1)).alias("next"))
    # Where uids are paths, a subtree's nodes lie together in this order; where they are not, more is left to random mates.
    near = full.repartitionByRange(partitions, uid_path(F.col("uid")), "uid")
    ranks = rank_lists(near.select(F.explode(F.array(enter, leave)).alias("a")).select("a.*"), local)
    size = broadcast_if_small(cut(ranks.groupBy("last").agg(F.count(F.lit(1)).alias("arcs"))))
    pos = ranks.join(size, "last").select(F.shiftright("arc", 1).alias("at"), F.shiftright("last", 1).alias("root"), (F.col("arcs") - 1 - F.col("rank")).alias("pos"))
    pos = pos.groupBy("at").agg(F.min("root").alias("root"), F.min("pos").alias("entry"), F.max("pos").alias("exit"))
    return full.select("id", "uid", "at").join(pos, "at").select("id", "uid", "root", "entry", "exit")


def hierarchy(relations: DataFrame, kind: str = "contains", local_arcs: int = LOCAL_ARCS, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """uid, root_uid, depth, path (array from the root), n_descendants, entry, exit, n_parents, status.

    status is tree, on_cycle, or below_cycle.
    """
    link = cut(links(relations, kind))
    nodes, edges = encode(link)
    nodes = cut(nodes)
    on = cut(cycle_nodes(edges).select("id"))
    parents = link.groupBy("child").agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n_parents"))
    n = nodes.count()
    partitions = max(1, -(-n // sweep_rows))
    by_uid = nodes.select(F.col("id").alias("parent_id"), F.col("uid").alias("parent"))
    tree = nodes.join(on.withColumn("on_cycle", F.lit(True)), "id", "left").join(parents.withColumnRenamed("child", "uid"), "uid", "left").join(by_uid, "parent", "left")
    tree = cut(
        tree.select("id", "uid", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"), F.coalesce("n_parents", F.lit(0)).cast("long").alias("n_parents"), F.when(F.col("on_cycle").isNull(), F.col("parent_id")).alias("parent"))
    )
    euler = euler_forest(tree.select("id", "uid", "parent"), partitions, local_arcs)
    ranged = cut(euler.repartitionByRange(partitions, "root", "entry").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.min(F.struct("root", "entry")).alias("h"), F.max(F.struct("root", "entry")).alias("t"))
    ends = cut(ends.select("part", F.col("h.root").alias("root"), F.col("h.entry").alias("head"), F.col("t.root").alias("last_root"), F.col("t.entry").alias("last_entry")))
    # One row a range. A row is open beyond its own range only if it leaves after the range's last entry.
    heads = ends.select("part", "root", "head").toPandas().sort_values(["root", "head"])
    last = F.broadcast(ends.select("part", "last_root", "last_entry"))
    over = ranged.join(last, "part").where((F.col("root") == F.col("last_root")) & (F.col("exit") > F.col("last_entry"))).select(*ranged.columns)
    halo = over.mapInPandas(_spanned(heads), "id bigint, uid string, root bigint, entry bigint, exit bigint, part int").withColumn("halo", F.lit(True))
    swept = ranged.withColumn("halo", F.lit(False)).unionByName(halo).groupBy("part").applyInPandas(_sweep, "id bigint, uid string, entry bigint, exit bigint, depth int, path array<string>")
    flags = tree.select("id", "on_cycle", "n_parents")
    root_on = tree.where("on_cycle").select(F.col("uid").alias("root_uid"), F.lit(True).alias("root_on"))
    out = swept.withColumn("root_uid", F.get("path", F.lit(0))).join(flags, "id").join(broadcast_if_small(cut(root_on)), "root_uid", "left")
    status = F.when(F.col("on_cycle"), "on_cycle").when(F.col("root_on"), "below_cycle").otherwise("tree")
    return out.select("uid", "root_uid", "depth", "path", ((F.col("exit") - F.col("entry") - 1) / 2).cast("long").alias("n_descendants"), "entry", "exit", "n_parents", status.alias("status"))


def pairs_over_further_parents(h: DataFrame, link: DataFrame) -> DataFrame:
    """uid, descendant, distance, in_tree: pairs joined by a way over some link that the forest leaves out.

    distance is the least of such ways; in_tree tells that the forest has the pair as well. h is the
    result of hierarchy, cut; link the distinct links it was made from. Every row of a round is a pair
    of the result's kind, so no round holds more than the closure itself.
    """
    child = h.where("n_parents > 1 AND status <> 'on_cycle'").select(F.col("uid").alias("child"), F.get("path", F.col("depth") - 1).alias("first"))
    extra = cut(link.join(broadcast_if_small(child), "child").where("parent <> first").select("parent", "child"))
    holders = cut(extra.select(F.col("parent").alias("uid")).distinct())
    up = h.join(broadcast_if_small(holders), "uid", "left_semi").select(F.col("uid").alias("parent"), "depth", F.posexplode("path").alias("at", "uid"))
    # A hop goes down the forest, no link or more, and then over one further link.
    hop = cut(up.join(extra, "parent").groupBy("uid", "child").agg(F.min(F.col("depth") - F.col("at") + 1).alias("distance")))
    reach = fresh = hop
    on = hop.select(F.col("uid").alias("child"), F.col("child").alias("next"), F.col("distance").alias("more"))
    while not fresh.isEmpty():
        step = fresh.join(on, "child").groupBy("uid", F.col("next").alias("child")).agg(F.min(F.col("distance") + F.col("more")).alias("distance"))
        known = reach.withColumnRenamed("distance", "known")
        fresh = cut(step.join(known, ["uid", "child"], "left").where("known IS NULL OR distance < known").select("uid", "child", "distance"))
        reach = cut(reach.unionByName(fresh).groupBy("uid", "child").agg(F.min("distance").alias("distance")))
    ends = broadcast_if_small(cut(reach.select("child").distinct()))
    below = h.select(F.col("uid").alias("descendant"), "path", "depth", F.posexplode("path").alias("at", "child")).join(ends, "child", "left_semi")
    pairs = reach.join(below, "child").select("uid", "descendant", (F.col("distance") + F.col("depth") - F.col("at")).alias("distance"), F.array_contains("path", F.col("uid")).alias("in_tree"))
    return pairs.groupBy("uid", "descendant").agg(F.min("distance").alias("distance"), F.max("in_tree").alias("in_tree"))


def descendants(relations: DataFrame, kind: str = "contains", local_arcs: int = LOCAL_ARCS, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """uid, descendant, distance (the fewest links): every pair of a node and a node below it, over all parents."""
    h = cut(hierarchy(relations, kind, local_arcs, sweep_rows))
    further = cut(pairs_over_further_parents(h, cut(links(relations, kind))))
    shorter = further.where("in_tree").select("uid", "descendant", F.col("distance").alias("other"))
    up = h.select(F.col("uid").alias("descendant"), "depth", F.posexplode("path").alias("at", "uid")).where(F.col("at") < F.col("depth"))
    tree = up.join(broadcast_if_small(shorter), ["uid", "descendant"], "left").select("uid", "descendant", F.least(F.col("depth") - F.col("at"), "other").alias("distance"))
    return tree.unionByName(further.where("NOT in_tree").select("uid", "descendant", "distance"))


def full_hierarchy(relations: DataFrame, kind: str = "contains", local_arcs: int = LOCAL_ARCS, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """hierarchy, with n_descendants counted over all parents; root_uid, depth and path stay those of the smallest parent."""
    h = cut(hierarchy(relations, kind, local_arcs, sweep_rows))
    further = pairs_over_further_parents(h, cut(links(relations, kind)))
    more = cut(further.where("NOT in_tree").groupBy("uid").agg(F.count(F.lit(1)).alias("more")))
    return h.join(broadcast_if_small(more), "uid", "left").withColumn("n_descendants", F.col("n_descendants") + F.coalesce("more", F.lit(0))).drop("more")
