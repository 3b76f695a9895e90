"""Fixed values of the data model: kinds, weights, priorities, limits."""

from __future__ import annotations

#: Source priority of a provenance element.
SOURCE_PRIORITY = {"human": 100, "ast": 80, "lsp": 70, "test": 60, "git": 50, "regex": 40, "llm": 20}
#: Weight of an edge kind in a walk's priority.
EDGE_WEIGHT = {"calls": 90, "routes_to": 85, "tests": 80, "depends_on": 75, "imports": 70, "uses": 60, "exports": 55, "implements": 50, "extends": 50, "annotates": 35, "contains": 20, "similar_to": 10}
#: The kind sets differ on purpose; none is derived from another.
IMPACT_KINDS = ["imports", "depends_on", "calls", "uses", "tests", "routes_to", "exports"]
DEPENDENCY_KINDS = ["imports", "depends_on", "calls", "uses", "tests", "routes_to", "extends", "implements"]
TRAVERSAL_KINDS = ["imports", "depends_on", "calls", "uses", "tests", "routes_to", "exports", "extends", "implements"]
HIGH_SIGNAL_KINDS = [*TRAVERSAL_KINDS, "similar_to"]
EDIT_ORDER_KINDS = ["imports", "depends_on", "calls", "routes_to", "uses"]
CRITICAL_KINDS = ["imports", "depends_on", "calls"]
FUNC_KINDS = ["function", "method", "route", "test"]
STRUCTURE_KINDS = ["repository", "directory", "file"]
ENTITY_KINDS = ["repository", "directory", "file", "module", "class", "interface", "type", "function", "method", "constant", "route", "test", "config"]
#: Confidence below which a critical edge is reported; the summary of an indexing run uses the higher one.
LOW_CONFIDENCE, SUMMARY_LOW_CONFIDENCE = 0.35, 0.40
#: (files, depth, tests) of a context pack.
STRATEGIES = {"minimal": (8, 1, False), "balanced": (20, 2, True), "deep": (40, 3, True), "debug": (30, 2, True)}
CACHE_DAYS, CACHE_ROWS = 30, 20_000
RUN_ABANDONED_HOURS, CHECKPOINT_STALE_HOURS = 1, 24
LSH_BITS, LSH_FAMILIES, LSH_RADIUS = 12, 4, 1
INCREMENTAL_DEPTH, INCREMENTAL_FILES = 3, 256
DEFAULT_NODES, DEFAULT_EDGES = 500, 1000
SEVERITY = {"missing_file": "error", "dangling_relation": "error", "stale_hash": "warning", "orphan_entity": "info", "unresolved_reference": "warning", "low_confidence": "warning", "binary_file": "warning", "invalid_utf8": "warning"}


def sql_list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)
