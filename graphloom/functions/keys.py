"""Keys: path and uid normalization, uid construction and splitting, content and short ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    """Backslashes become slashes, then one leading ./ is dropped."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p.startswith("./"), F.substring(p, 3, 2**31 - 1)).otherwise(p)


def normalize_uid(uid: Column) -> Column:
    """The uid with its path part normalized; kind and symbol stay as they are.

    A uid is kind:path or kind:path#symbol. One without a kind is taken as path#symbol.
    Almost every uid is already in normal form, and those never reach the slow branch.
    """
    kind = F.regexp_extract(uid, "^[^:#]*:", 0)
    path = F.regexp_extract(uid, "(?s)^(?:[^:#]*:)?([^#]*)", 1)
    symbol = F.regexp_extract(uid, "(?s)#.*$", 0)
    slow = F.concat(kind, normalize_path(path), symbol)
    dirty = uid.contains("\\") | uid.contains(":./") | uid.startswith("./")
    return F.when(dirty, slow).otherwise(uid)


def uid_path(uid: Column) -> Column:
    """The path part of a normalized uid."""
    return F.regexp_extract(uid, "(?s)^(?:[^:#]*:)?([^#]*)", 1)


def build_uid(kind: Column, path: Column, symbol: Column | None = None) -> Column:
    """kind:path, or kind:path#symbol where symbol is neither null nor empty."""
    base = F.concat(kind, F.lit(":"), normalize_path(path))
    if symbol is None:
        return base
    return F.when(F.coalesce(symbol, F.lit("")) == "", base).otherwise(F.concat(base, F.lit("#"), symbol))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_id(kind: Column, uid: Column) -> Column:
    """func- or obj- and eight hex digits; ids already in that form pass through."""
    prefix = F.when(kind.isin("function", "method", "route", "test"), "func-").otherwise("obj-")
    fresh = F.concat(prefix, F.substring(F.sha1(uid), 1, 8))
    return F.when(uid.rlike("^(obj|func)-[0-9a-f]{8}$"), uid).otherwise(fresh)


def sql_norm_path(c: str) -> str:
    return f"regexp_replace(replace({c}, '\\', '/'), '^\\./', '')"


def sql_norm_uid(c: str) -> str:
    path = sql_norm_path(f"regexp_extract({c}, '(?s)^(?:[^:#]*:)?([^#]*)', 1)")
    return f"(regexp_extract({c}, '^[^:#]*:') || {path} || regexp_extract({c}, '(?s)#.*$'))"
