"""Source files that do not parse (problem 1).

Method. A file's tokens run through the derivatives of its language's grammar, memoised over all
files of a worker. An empty derivative names the failing token; an end that is not nullable means
truncation, as does a literal, comment or bracket that is never closed.

Why it holds at size: a file is parsed where it is read, in one pass, and its content is not moved;
what is open in a text is a plain sequence, so depth costs neither stack nor time; the memo is
bounded at every token. Only the failures are shuffled, to count repeated rows once.

Cases. The language is that of the path's extension (.py, .ts, .rs, .rb); other paths are left
out, as are null paths. Null contents count as empty, and empty files are valid. A leading byte
order mark is skipped. Rows of one path with different contents give the path once if any of
them fails. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.keys import normalize_path
from graphloom.llm import grammars, lexers
from graphloom.llm.derivative import Grammar

LANGUAGES = {"py": "python", "ts": "typescript", "rs": "rust", "rb": "ruby"}
_GRAMMARS: dict[str, Grammar] = {}


def grammar(language: str) -> Grammar:
    if language not in _GRAMMARS:
        _GRAMMARS[language] = Grammar(getattr(grammars, language.upper()), "file")
    return _GRAMMARS[language]


def failure(language: str, text: str) -> tuple[str, int] | None:
    """None for a valid text, else the kind ('token', 'truncated') and the offset of the failure."""
    text = text.removeprefix("﻿")
    soft = None
    try:
        if "\0" in text and language != "ruby":
            raise lexers.Broken(text.index("\0"))
        if language == "typescript":
            kinds, at, soft = lexers.typescript(text)
        else:
            kinds, at = getattr(lexers, language)(text)
    except lexers.Broken as e:
        return "truncated" if e.open else "token", e.at
    where = grammar(language).parse(kinds, soft)
    if where is None:
        return None
    return ("truncated", len(text)) if where == len(kinds) else ("token", at[where])


_OUT = {"path": pa.string(), "repo": pa.string(), "ext": pa.string(), "failure": pa.string(), "failed_at": pa.int32(), "line": pa.int32(), "column": pa.int32()}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, repo, ext, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if text and (found := failure(LANGUAGES[ext], text)):
                body = text.removeprefix("\ufeff")[: found[1]]
                rows.append((path, repo, ext, found[0], found[1], body.count("\n") + 1, len(body) - body.rfind("\n")))
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(_OUT)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _OUT.values(), strict=True)], list(_OUT))


def files(source_files: DataFrame) -> DataFrame:
    """path (normalized), ext, repo, content of the files in a known language."""
    p = normalize_path(F.col("path"))
    return source_files.select(
        p.alias("path"), F.regexp_extract(p, r"\.(py|ts|rs|rb)$", 1).alias("ext"), "repo", F.coalesce("content", F.lit("")).alias("content")
    ).where("ext <> ''")


def unparsable(source_files: DataFrame) -> DataFrame:
    """path, repo, ext, failure, failed_at, line, column: a row for each failing path and content."""
    ddl = "path string, repo string, ext string, failure string, failed_at int, line int, column int"
    return files(source_files).select("path", "repo", "ext", "content").mapInArrow(_parse, ddl).distinct()


def rates(source_files: DataFrame, entities: DataFrame) -> DataFrame:
    """repo, language, n_files, n_failed, n_truncated, rate, hint: failures per repository and language.

    The language is the indexer's for the path (latest row, lower case), else that of the extension;
    hint is the mean of the indexer's confidence over the failing files.
    """
    seen = files(source_files).groupBy("path").agg(F.min("repo").alias("repo"), F.min("ext").alias("ext"))
    bad = unparsable(source_files).groupBy("path").agg(F.max(F.col("failure") == "truncated").alias("truncated"))
    hint = (
        entities.where(F.col("path").isNotNull())
        .groupBy(normalize_path(F.col("path")).alias("path"))
        .agg(F.max_by(F.lower("language"), "updated_at").alias("language"), F.max_by("confidence", "updated_at").alias("confidence"))
    )
    by_ext = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    failed = F.col("truncated").isNotNull()
    return (
        seen.join(bad, "path", "left")
        .join(hint, "path", "left")
        .groupBy("repo", F.coalesce("language", by_ext[F.col("ext")]).alias("language"))
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.count_if(failed).alias("n_failed"),
            F.count_if(F.col("truncated")).alias("n_truncated"),
            F.round(F.count_if(failed) / F.count(F.lit(1)), 6).alias("rate"),
            F.round(F.avg(F.when(failed, F.col("confidence"))), 6).alias("hint"),
        )
    )
