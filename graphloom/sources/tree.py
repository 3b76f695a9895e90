"""Reading a working tree: files with ignore rules and a size cap, text classes, languages, changes."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.validate import text_class

DEFAULT_EXCLUDES = [".git", "node_modules", "dist", "build", "target", "vendor", "__pycache__", ".venv", "coverage"]


def ignore_pattern(rules: list[str]) -> str:
    """One regular expression for gitignore-like rules: names, paths from the root, '*', '**', a closing slash."""
    parts = []
    for rule in (r.strip() for r in rules):
        if not rule or rule.startswith(("#", "!")):
            continue
        anchored = "/" in rule.rstrip("/")
        body = rule.strip("/")
        rx = "".join(".*" if t == "**" else "[^/]*" if t == "*" else "[^/]" if t == "?" else re.escape(t) for t in re.findall(r"\*\*|\*|\?|[^*?]+", body))
        rx = rx.replace(".*/", "(?:.*/)?")
        parts.append(("^" if anchored else "(?:^|/)") + rx + ("/" if rule.endswith("/") else "(?:/|$)"))
    return "|".join(parts) or r"\A(?!)"


def read_ignore(root: str) -> list[str]:
    """The rules of the root's ignore file."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8") as f:
            return [line.rstrip("\n") for line in f]
    except OSError:
        return []


def repository_root(path: str) -> str:
    """The nearest folder upward that holds a .git, else the path itself."""
    at = os.path.abspath(path)
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return at
        up = os.path.dirname(at)
        if up == at:
            return os.path.abspath(path)
        at = up


def language_of(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(ext.isin("ts", "tsx", "js", "jsx", "mjs", "cjs"), "typescript").when(ext == "py", "python").when((ext == "rs") | (name == "Cargo.toml"), "rust").when((ext == "rb") | name.isin("Gemfile", "Gemfile.lock"), "ruby")
    )


def scan(spark: SparkSession, root: str, excludes: list[str] | None = None, max_kb: int = 512) -> tuple[DataFrame, DataFrame]:
    """files (path, content, size_bytes, mtime_ms, text_class, language, content_hash) and skipped (path, reason)."""
    root = os.path.abspath(root)
    rx = ignore_pattern([*(DEFAULT_EXCLUDES if excludes is None else excludes), *read_ignore(root)])
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.substring(F.regexp_replace("path", "^file:/*", "/"), len(root) + 2, 1 << 20)
    listed = raw.select(rel.alias("path"), "content", F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("mtime_ms")).where(~F.col("path").rlike(rx))
    big = F.col("size_bytes") > max_kb * 1024
    skipped = listed.where(big).select("path", F.lit("tooLarge").alias("reason"))
    kept = listed.where(~big).withColumns({"text_class": text_class(F.col("content")), "language": language_of(F.col("path"))})
    bad = kept.where("text_class <> 'text'").select("path", F.when(F.col("text_class") == "binary", "binary").otherwise("invalidUtf8").alias("reason"))
    good = kept.where("text_class = 'text'").withColumns({"content": F.col("content").cast("string"), "content_hash": F.sha2("content", 256)})
    return good, skipped.unionByName(bad)


def git_changes(spark: SparkSession, root: str, base: str = "HEAD", staged: bool = False) -> DataFrame:
    """status, path, old_path of the working tree against a revision; empty where there is no repository."""
    rows: list[tuple[str, str, str | None]] = []
    if re.fullmatch(r"[\w./~^@{}:-]+", base) and not base.startswith("-"):
        if base.startswith("merge-base:"):
            base = _git(root, "merge-base", base.removeprefix("merge-base:"), "HEAD").strip()
        out = _git(root, "diff", "--name-status", "-z", "-M", *(["--cached"] if staged else []), base, "--")
        parts = out.split("\0")
        i = 0
        while i + 1 < len(parts):
            status = parts[i]
            if status[:1] in ("R", "C"):
                rows.append((status[0], parts[i + 2], parts[i + 1]))
                i += 3
            else:
                rows.append((status[:1], parts[i + 1], None))
                i += 2
    return spark.createDataFrame(rows, "status string, path string, old_path string")


def git_listing(spark: SparkSession, root: str) -> DataFrame | None:
    """path of tracked and untracked, not ignored files; None where there is no repository."""
    out = _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard")
    paths = sorted({p for p in out.split("\0") if p})
    return spark.createDataFrame([(p,) for p in paths], "path string") if paths else None


def _git(root: str, *args: str) -> str:
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, timeout=60).stdout
    except (OSError, subprocess.SubprocessError):
        return ""


def matches(path: str, rules: list[str]) -> bool:
    return bool(re.search(ignore_pattern(rules), path)) or any(fnmatch.fnmatch(path, r) for r in rules if r and not r.startswith(("#", "!")))
