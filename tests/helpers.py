"""Schemas of the tables, so that small fixtures have the columns and types of the real ones."""

from datetime import datetime

PROV = "array<struct<source:string,tool:string,timestamp:timestamp_ntz,confidence:double,evidence:string>>"
ENTITIES = (
    "uid string, kind string, name string, path string, language string, signature string, start_line int, end_line int, description string, docstring string, tags array<string>, metadata string, is_public boolean, "
    f"provenance {PROV}, confidence double, source_priority int, created_at timestamp_ntz, updated_at timestamp_ntz"
)
RELATIONS = f"id bigint, from_uid string, to_uid string, kind string, reason string, weight double, confidence double, provenance {PROV}, metadata string, is_synthetic boolean, source_priority int"
UNRESOLVED = "path string, from_uid string, symbol string, kind string, reason string, confidence double, created_at timestamp_ntz, resolved boolean"
FILES = "path string, content_hash string, indexed_at timestamp_ntz, mtime_ms bigint, size_bytes bigint, run_id bigint"
RUNS = "run_id bigint, started_at timestamp_ntz, ended_at timestamp_ntz, mode string, status string, metadata string"
SOURCES = "path string, repo string, language string, content string, size_bytes bigint"
VECTORS = "uid string, content_hash string, vector array<float>, provider string, updated_at timestamp_ntz"
T0 = datetime(2025, 1, 1)


def day(n):
    return datetime(2025, 1, n)


def frame(spark, schema, rows):
    """Rows given as dicts; absent columns are null."""
    names = [c.strip().split(" ")[0] for c in _split(schema)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def _split(schema):
    out, depth, cur = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [*out, cur]


def entity(uid, **more):
    kind, _, rest = uid.partition(":")
    path, _, symbol = rest.partition("#")
    return {"uid": uid, "kind": kind, "name": symbol or path.rsplit("/", 1)[-1], "path": path, "confidence": 1.0, "source_priority": 80, "created_at": T0, "updated_at": T0} | more


def edge(a, b, kind, confidence=0.9, **more):
    return {"id": abs(hash((a, b, kind))) % 10**9, "from_uid": a, "to_uid": b, "kind": kind, "confidence": confidence, "source_priority": 80, "provenance": [("ast", None, T0, confidence, None)]} | more
