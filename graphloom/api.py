"""The façade: one object over a folder of tables, the nine tools, and the command line.

    python -m graphloom.api FOLDER TOOL '{"argument": ...}'
"""

from __future__ import annotations

import json
import os
import sys
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions.keys import short_id
from graphloom.operators import contextpack, textsearch, traverse, validate
from graphloom.operators import relational as R
from graphloom.operators.graphview import Graph
from graphloom.sources import extract, indexer, sinks, tree


@dataclass
class Config:
    """Settings of a workspace; a file of some of them is merged over the defaults."""

    excludes: tuple[str, ...] = tuple(tree.DEFAULT_EXCLUDES)
    max_kb: int = 512
    low_confidence: float = schema.LOW_CONFIDENCE
    strategy: str = "balanced"
    max_tokens: int = 8000

    @classmethod
    def load(cls, path: str) -> Config:
        base = asdict(cls())
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                base |= {k: tuple(v) if isinstance(v, list) else v for k, v in json.load(f).items() if k in base}
        return cls(**base)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)


class Workspace:
    """The operators bound to a folder of tables."""

    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None):
        self.spark, self.graph, self.config = spark, Graph(spark, folder), config or Config()

    def resolve(self, text: str) -> str:
        return self.spark.range(1).select(R.by_uid_or_path(F.lit(text))).first()[0]

    def search(self, query: str, k: int = 20) -> DataFrame:
        return textsearch.hybrid_search(self.graph.entities, self.graph.relations, query, k)

    def entity(self, text: str) -> DataFrame:
        return self.graph.entities.where(F.col("uid") == self.resolve(text))

    def neighbors(self, text: str, **budget) -> dict:
        return traverse.neighborhood(self.graph.entities, self.graph.relations, self.resolve(text), traverse.Budget(**budget))

    def impact(self, text: str, depth: int | None = None) -> DataFrame:
        return traverse.impact(self.graph.relations, self.resolve(text), depth)

    def impact_summary(self, text: str, depth: int | None = None) -> DataFrame:
        return traverse.impact_summary(self.graph.relations, self.graph.entities, self.resolve(text), depth)

    def path(self, start: str, goal: str, typed: bool = False) -> dict:
        r = self.graph.relations.where(F.col("kind").isin(schema.TRAVERSAL_KINDS)) if typed else self.graph.relations
        nodes = traverse.shortest_path(r.select(F.col("from_uid").alias("src"), F.col("to_uid").alias("dst")), self.resolve(start), self.resolve(goal))
        return {"nodes": nodes, "found": bool(nodes)}

    def issues(self, deep: bool = True) -> DataFrame:
        s = self.graph.raw("source_files").where(F.col("content").isNotNull())
        present = s.select("path", F.sha2("content", 256).alias("content_hash")).distinct()
        return validate.issues(self.graph.entities, self.graph.relations, self.graph.unresolved, self.graph.files, present, deep, self.config.low_confidence)

    def repairs(self, opt_in: tuple[str, ...] = ()) -> DataFrame:
        return validate.repair_plan(self.issues(), opt_in)

    def changed(self, root: str, base: str = "HEAD") -> DataFrame:
        """Changed files that are indexed already; new ones are not among them."""
        return tree.git_changes(self.spark, root, base).join(self.graph.files.select("path"), "path", "left_semi")

    def pack(self, query: str, strategy: str | None = None, max_tokens: int | None = None) -> dict:
        return contextpack.build(self.graph.entities, self.graph.relations, self.graph.raw("source_files"), query, strategy or self.config.strategy, max_tokens or self.config.max_tokens)

    def toc(self) -> DataFrame:
        return self.graph.entities.select("uid", short_id(F.col("kind"), F.col("uid")).alias("short_id")).orderBy("uid")

    def stats(self) -> DataFrame:
        return R.counts_by(self.graph.entities, "kind")

    def orphans(self) -> DataFrame:
        return R.orphans(self.graph.entities, self.graph.relations)

    def cycles(self) -> DataFrame:
        return traverse.cycles(self.graph.relations)

    def export(self, root: str, form: str = "jsonl") -> DataFrame:
        if form == "jsonl":
            return sinks.write_jsonl(root, {"entities": self.graph.entities, "relations": self.graph.all_relations, "unresolved": self.graph.unresolved})
        out = sinks.protocol_bodies(self.graph.entities, self.graph.relations) if form == "protocol" else sinks.review_lines(self.graph.entities, self.graph.relations)
        (out.write.json if form == "protocol" else out.orderBy("section", "line").select("line").write.text)(root)
        return out

    def index(self, root: str, store: str | None = None) -> DataFrame:
        """Rows of a working tree, with the targets of imports resolved to files; with a store only what changed since its last run is read."""
        files, _ = tree.scan(self.spark, root, list(self.config.excludes), self.config.max_kb)
        if store:
            index = indexer.Indexer(self.spark, store)
            index.run(files)
            found = index.records()
        else:
            found = extract.extract(files)
        return found.where("record <> 'relation'").unionByName(extract.canonical_relations(found.where("record = 'relation'"), files))


#: Tool -> what it does with its arguments.
TOOLS = {
    "search": lambda w, a: w.search(a["query"], a.get("k", 20)),
    "semantic_search": lambda w, a: w.search(a["query"], a.get("k", 20)),
    "get_entity": lambda w, a: w.entity(a["uid"]),
    "get_neighbors": lambda w, a: w.neighbors(a["uid"], depth=a.get("depth", 1)),
    "impact": lambda w, a: w.impact_summary(a["uid"], a.get("depth")),
    "validate": lambda w, a: w.issues(a.get("deep", False)),
    "explain_path": lambda w, a: w.path(a["from"], a["to"]),
    "list_changed": lambda w, a: w.changed(a["root"], a.get("base", "HEAD")),
    "get_context_pack": lambda w, a: w.pack(a["query"], a.get("strategy", "minimal"), a.get("maxTokens", 8000)),
}
COMMANDS = TOOLS | {
    "toc": lambda w, a: w.toc(),
    "stats": lambda w, a: w.stats(),
    "orphans": lambda w, a: w.orphans(),
    "cycles": lambda w, a: w.cycles(),
    "repair": lambda w, a: w.repairs(tuple(a.get("optIn", ()))),
    "export": lambda w, a: w.export(a["root"], a.get("form", "jsonl")),
    "index": lambda w, a: w.index(a["root"], a.get("store")),
    "path": lambda w, a: w.path(a["from"], a["to"], typed=True),
}


def dispatch(workspace: Workspace, tool: str, arguments: dict) -> dict:
    """A tool call's answer as JSON data; frames become lists of rows."""
    if tool not in COMMANDS:
        return {"error": f"unknown tool {tool}"}
    out = COMMANDS[tool](workspace, arguments)
    if isinstance(out, DataFrame):
        out = {"rows": [json.loads(x) for x in out.toJSON().toLocalIterator()]}
    return out


def main(argv: list[str]) -> int:
    from graphloom.session import get_spark, ship

    if len(argv) < 2:
        print(__doc__, "\nTools:", " ".join(COMMANDS))
        return 2
    spark = get_spark("graphloom")
    ship(spark)
    print(json.dumps(dispatch(Workspace(spark, argv[0]), argv[1], json.loads(argv[2]) if len(argv) > 2 else {}), indent=2, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
