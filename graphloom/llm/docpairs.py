"""Functions paired with their documentation (problem 6).

Method. An island grammar per language: only documentation, annotations, signatures and balanced
bodies are parsed. One pass over a file marks its literals and comments, so that brackets and
words inside them count for nothing; the rest is water, in which a signature is an island. From
a signature the documentation is sought directly above, over annotations and tool comments (in
Python: the string that opens the body), and the body is what its brackets, its indentation or
its `end` encloses. Damaged files give the functions that are still whole enough to be seen.

Documentation is trivial if nothing in it says more than the function's name: see `says_more`.

Why it holds at size: one pass over the files in their own tasks; the pairs are joined to the
entities by path and name, which no single key dominates.

Cases. A file that occurs in several rows gives its functions once. Entities count by their
latest row by updated_at, and not if that row is a tombstone. An entity belongs to the function
of its name that starts on its line, else to one of its qualified name. Null contents and paths,
unknown extensions and entities without a match give nothing. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.keys import normalize_path, normalize_uid
from graphloom.llm.syntax import files

# ------------------------------------------------------------------ literals and comments

_MARKS = {
    "py": re.compile(r"(?P<comment>\#[^\n]*)|(?P<text>[rRbBuUfF]{0,2}(?:'''(?:\\.|[^\\])*?(?:'''|\Z)|\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?))", re.DOTALL),
    "ts": re.compile(
        r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?|`(?:\\.|\$\{(?:[^{}`]|\{[^{}`]*\}|`(?:\\.|[^`\\])*`)*\}|[^`\\])*(?:`|\Z)"
        r"|(?<=[=(,:\[!&|?{};\n])[ \t]*/(?![/*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*)",
        re.DOTALL,
    ),
    "rs": re.compile(r"(?P<comment>//[^\n]*|/\*)|(?P<text>\b(?:br|cr|r)(?P<hash>\#*)\".*?(?:\"(?P=hash)|\Z)|\b[bc]?\"(?:\\.|[^\"\\])*(?:\"|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.)|[^\\'\n])')", re.DOTALL),
    "rb": re.compile(
        r"(?P<comment>(?:\A|(?<=\n))=begin(?=\s).*?(?:\n=end[^\n]*|\Z)|\#[^\n]*)"
        r"|(?P<text>'(?:\\.|[^'\\])*(?:'|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|<<[~-]?(?P<hq>['\"]?)(?P<tag>[A-Z_a-z]\w*)(?P=hq)(?P<rest>[^\n]*)\n.*?(?:\n[ \t]*(?P=tag)(?=\n|\Z)|\Z)"
        r"|%[qQwWiIrs]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|<[^>]*>|!(?:[^!\n])*!|\|(?:[^|\n])*\|)|(?<=[=(,\[!&|?{;\n~])[ \t]*/(?:\\[^\n]|[^/\\\n])+/[a-z]*|\b(?:if|unless|when|and|or|not|return)[ ]+/(?:\\[^\n]|[^/\\\n])+/[a-z]*)",
        re.DOTALL,
    ),
}
_NESTED = re.compile(r"/\*|\*/")
_BLANK = re.compile(r"[^\n]")


def mark(ext: str, text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with literals and comments blanked out, and the places of the comments."""
    out, comments, at = [], [], 0
    pattern = _MARKS[ext]
    while m := pattern.search(text, at):
        end = m.end()
        if m["comment"] is not None:
            if ext == "rs" and m[0] == "/*":
                depth = 1
                for c in _NESTED.finditer(text, end):
                    depth += 1 if c[0] == "/*" else -1
                    if not depth:
                        break
                end = c.end() if not depth else len(text)
            comments.append((m.start(), end))
        out.append(text[at : m.start()])
        body = text[m.start() : end]
        if ext == "rb" and m["tag"] is not None and m["rest"]:
            # What follows the tag on its line is still code.
            a, b = m.start("rest") - m.start(), m.end("rest") - m.start()
            out.append(_BLANK.sub(" ", body[:a]) + (body[a:b] if "'" not in body[a:b] and '"' not in body[a:b] else " " * (b - a)) + _BLANK.sub(" ", body[b:]))
        else:
            blank = _BLANK.sub(" ", body)
            # A string that is a statement still shows where its line is indented.
            out.append('"' + blank[1:] if ext == "py" and m["text"] else blank)
        at = max(end, at + 1)
        if end == m.start():
            out.append(text[end : at])
    out.append(text[at:])
    return "".join(out), comments


# ------------------------------------------------------------------ signatures and bodies

_TS_NOT = "if|for|while|switch|catch|function|return|with|do|else|new|await|typeof|super|constructor_"
_HEADS = {
    "py": re.compile(r"^(?P<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)", re.MULTILINE),
    "ts": re.compile(
        rf"^(?P<indent>[ \t]*)(?:(?:export|default|async|declare)[ \t]+)*(?:function[ \t]*\*?[ \t]*(?P<a>[\w$]+)[ \t]*[<(]"
        rf"|(?:const|let|var)[ \t]+(?P<b>[\w$]+)[ \t]*(?::[^=\n]+)?=[ \t]*(?:async[ \t]*)?(?:function\b|<[^\n>]*>[ \t]*\(|\([^\n]*=>|[\w$]+[ \t]*=>|\([^\n]*$)"
        rf"|(?:(?:public|private|protected|static|readonly|override|declare)[ \t]+)*(?P<d>\#?[\w$]+)[ \t]*[!?]?[ \t]*(?::[^=\n]+)?=(?![=>])[ \t]*(?:async[ \t]*)?(?:function\b|<[^\n>]*>[ \t]*\(|\([^\n]*=>|[\w$]+[ \t]*=>|\([^\n]*$)"
        rf"|(?:(?:public|private|protected|static|abstract|readonly|override|async|get|set)[ \t]+)*\*?[ \t]*(?P<c>(?!(?:{_TS_NOT})\b)\#?[\w$]+)[ \t]*\??[ \t]*(?:<[^\n(]*>)?\()",
        re.MULTILINE,
    ),
    "rs": re.compile(r"^(?P<indent>[ \t]*)(?:(?:pub(?:[ \t]*\([^)\n]*\))?|default|const|async|unsafe|extern(?:[ \t]+[^\n]*?)?)[ \t]+)*fn[ \t]+(?P<name>\w+)", re.MULTILINE),
    "rb": re.compile(r"^(?P<indent>[ \t]*)(?:[a-z_]+[ \t]+)?def[ \t]+(?:(?:self|[A-Za-z_]\w*)[ \t]*\.[ \t]*)?(?P<name>[^\W\d]\w*[?!=]?|\[\]=?|[+\-*/%<>=!~^&|]+)", re.MULTILINE),
}
_OWNERS = {
    "py": re.compile(r"^(?P<indent>[ \t]*)class[ \t]+(?P<name>\w+)", re.MULTILINE),
    "ts": re.compile(r"^(?P<indent>[ \t]*)(?:(?:export|default|abstract|declare)[ \t]+)*class[ \t]+(?P<name>[\w$]+)", re.MULTILINE),
    "rs": re.compile(r"^(?P<indent>[ \t]*)(?:unsafe[ \t]+)?(?:impl\b(?:<[^{\n]*?>)?[ \t]+(?:[^{\n]*\bfor[ \t]+)?&?(?:'\w+[ \t]+)?|(?:pub[ \t]+)?trait[ \t]+)(?:\w+::)*(?P<name>\w+)", re.MULTILINE),
    "rb": re.compile(r"^(?P<indent>[ \t]*)(?:class|module)[ \t]+(?:\w+::)*(?P<name>\w+)", re.MULTILINE),
}
_OPEN, _SHUT = "([{", ")]}"


def _balanced(masked: str, at: int) -> int:
    """The end of the bracket group that opens at `at`; the end of the text if it never closes."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(masked, at):
        depth += 1 if m[0] in _OPEN else -1
        if depth <= 0:
            return m.end()
    return len(masked)


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def _header_end(ext: str, masked: str, at: int) -> tuple[int, bool]:
    """Where the signature that starts before `at` ends, and whether a body follows."""
    n = len(masked)
    if ext == "rb":
        m = re.compile(r"[ \t]*\(").match(masked, at)
        end = _balanced(masked, m.end() - 1) if m else at
        return end, True
    angle = 0
    while at < n:
        c = masked[at]
        if c in "([" or (c == "{" and ext == "ts" and angle):
            at = _balanced(masked, at)
            continue
        if ext == "py":
            if c == ":":
                return at, True
            if c == "\n":
                return at, False
        elif c == ";":
            return at, False
        elif c == "{":
            # An object type after ':' or '|' is part of the signature, not the body.
            if ext == "ts" and re.search(r"[:|&]\s*$", masked[max(0, at - 8) : at]):
                at = _balanced(masked, at)
                continue
            return at, True
        elif c == "}" or c == ")":
            return at, False
        elif c == "<":
            angle += 1
        elif c == ">" and masked[at - 1] not in "=-":
            angle = max(0, angle - 1)
        at += 1
    return n, False


def _body_end(ext: str, masked: str, start: int, header: int, indent: str) -> int:
    if ext in ("ts", "rs"):
        return _balanced(masked, header)
    width = len(indent.expandtabs(8))
    if ext == "rb":
        first = masked[header : _line_end(masked, header)]
        if re.match(r"[ \t]*=(?![=~>])", first) or re.search(r";[ \t]*end\b", first):
            return _line_end(masked, header)
        m = re.compile(rf"^{indent}end\b", re.MULTILINE).search(masked, header)
        return m.end() if m else len(masked)
    rest = masked[header + 1 : _line_end(masked, header)]
    if rest.strip():
        return _line_end(masked, header)
    end = _line_end(masked, header)
    for m in re.compile(r"^([ \t]*)(\S)", re.MULTILINE).finditer(masked, end):
        if len(m[1].expandtabs(8)) <= width:
            break
        end = _line_end(masked, m.start())
    return end


# ------------------------------------------------------------------ documentation

#: How comments for tools begin.
TOOLS = (
    r"eslint|tslint|jshint|jslint|prettier|biome|deno-|@ts-|ts-ignore|ts-expect|istanbul|c8 ignore|v8 ignore|webpack|@vite|#__PURE__|noqa|type:\s*ignore|pylint|pyright|mypy|flake8|pragma|fmt:|isort|yapf|black|"
    r"ruff|nosec|coding[:=]|-\*-|rubocop|standard:|reek|sorbet|typed:|frozen_string_literal|encoding:|warn_indent|:nodoc:|brakeman|steep|rustfmt|clippy|cspell|spell-?check|nolint|nosonar|codecov|coverage:|vim:|region\b|endregion\b|@formatter"
)
_TOOL = re.compile(rf"\s*(?:{TOOLS})", re.IGNORECASE)


def _clean(comment: str) -> str:
    """The words of a comment without its marks."""
    c = comment.strip()
    if c.startswith("/*"):
        c = re.sub(r"\*+/\s*$", "", re.sub(r"^/\*+!?", "", c))
        return "\n".join(re.sub(r"^\s*\*(?!\*)\s?", "", line).rstrip() if i else line.strip() for i, line in enumerate(c.split("\n"))).strip("\n")
    if c.startswith("=begin"):
        return re.sub(r"\n=end.*\Z", "", re.sub(r"\A=begin[^\n]*\n?", "", c), flags=re.DOTALL)
    return re.sub(r"^(?:///?!?|#+)[ ]?", "", c)


def _above(ext: str, text: str, masked: str, comments: list[tuple[int, int]], start: int) -> str | None:
    """Documentation directly above the line that starts at `start`, or before the signature on it; None if there is none."""
    ends = {e: s for s, e in comments}
    found: list[str] = []
    at = start
    header_line = _line_end(masked, start)
    code = start + len(masked[start:header_line]) - len(masked[start:header_line].lstrip())
    lead = text[start:code].rstrip()
    if lead and start + len(lead) in ends and ext != "rb":
        begin = ends[start + len(lead)]
        if text.startswith("/**", begin) and text[begin + 3 : begin + 4] not in ("*", "/"):
            found.append(_clean(text[begin : start + len(lead)]))
            if ext == "ts":
                return found[0]
        at = text.rfind("\n", 0, begin) + 1
    while at > 0:
        line_start = text.rfind("\n", 0, at - 1) + 1
        line = text[line_start : at - 1]
        solid = line.rstrip()
        if not solid:
            break
        stop = line_start + len(solid)
        if stop in ends:
            begin = ends[stop]
            own = text.rfind("\n", 0, begin) + 1
            if masked[own:begin].strip():
                break  # a comment behind code
            comment = text[begin:stop]
            body = _clean(comment)
            if ext == "rb":
                found.append(body)
                at = own
                continue
            doc = (comment.startswith("/**") and comment[3:4] not in ("*", "/")) or (ext == "rs" and comment.startswith("///") and comment[3:4] != "/")
            if doc:
                found.append(body)
                if ext == "ts":
                    break
            elif not _TOOL.match(body):
                break
            at = own
            continue
        code = masked[line_start : at - 1].strip()
        if (ext == "ts" and code.startswith("@")) or (ext == "rs" and code.startswith("#")):
            at = line_start
            continue
        if ext in ("ts", "rs") and code[-1:] in ")]}" and (opens := _annotation(ext, masked, line_start + len(masked[line_start : at - 1].rstrip()))) is not None:
            at = opens
            continue
        break
    return "\n".join(reversed(found)) if found else None


def _annotation(ext: str, masked: str, end: int) -> int | None:
    """The line start of an annotation over several lines that ends at `end`."""
    depth = 0
    for i in range(end - 1, -1, -1):
        c = masked[i]
        if c in _SHUT:
            depth += 1
        elif c in _OPEN:
            depth -= 1
            if depth <= 0:
                own = masked.rfind("\n", 0, i) + 1
                head = masked[own:i].strip()
                ok = re.fullmatch(r"@[\w$.]+", head) if ext == "ts" else head in ("#", "#!")
                return own if ok and "\n" in masked[i:end] else None
    return None


_DOCSTRING = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\n)*[ \t]*(?P<paren>(?:\([ \t\n]*)*)(?=[rRuU]?['\"])")
_STRING = re.compile(r"(?P<prefix>[rRuU]?)(?:\"\"\"(?P<a>(?:\\.|[^\\])*?)\"\"\"|'''(?P<b>(?:\\.|[^\\])*?)'''|\"(?P<c>(?:\\.|[^\\\"\n])*)\"|'(?P<d>(?:\\.|[^\\'\n])*)')", re.DOTALL)
_BETWEEN = re.compile(r"(?:[ \t]|\\\n)*"), re.compile(r"(?:[ \t\n]|\\\n|#[^\n]*)*")
_AFTER = re.compile(r"[ \t]*(?:#[^\n]*)?(?=\n|;|\Z)")


def _docstring(text: str, at: int) -> str | None:
    """The strings, laid end to end, of which the first statement consists."""
    m = _DOCSTRING.match(text, at)
    if not m:
        return None
    at, parts, open_ = m.end(), [], m["paren"].count("(")
    while s := _STRING.match(text, at):
        parts.append(next(s[g] for g in "abcd" if s[g] is not None))
        at = _BETWEEN[open_ > 0].match(text, s.end()).end()
    while open_ and text[at : at + 1] == ")":
        open_ -= 1
        at = _BETWEEN[open_ > 0].match(text, at + 1).end()
    return "".join(parts) if parts and not open_ and _AFTER.match(text, at) else None


# ------------------------------------------------------------------ triviality

_PLACEHOLDER = re.compile(
    r"(?:n/?a|n\.a\.|none|null|nil|nothing|todo|tbd|tba|tbc|fixme|xxx+|hack|wip|undocumented|no (?:docs?|documentation|description|comment)|docs?|documentation|description|summary|comment|placeholder|unknown|untitled|pending|empty|stub|test|"
    r"(?:to be|will be) \w+|fill (?:me |this )?in|coming soon|lorem ipsum.*|write (?:me|docs?|documentation)|add (?:docs?|documentation|description)(?: here)?|missing (?:docs?|documentation)|(?:docs?|documentation) (?:missing|pending|to follow|goes here))[\s.:;!?…-]*",
    re.IGNORECASE,
)
_MARKED = re.compile(r"(?:TODO|FIXME|XXX+|TBD|HACK|WIP)(?:\([^)]*\))?(?![\w])")
_NOTICE = re.compile(
    r"(?:this (?:file|code|method|function) (?:is|was) )?(?:auto[- ]?generated|automatically generated|machine[- ]generated)\b|generated (?:by|from|with|method|code|file|stub|automatically|using)\b|do not (?:edit|modify|change)\b|(?:dual[- ])?licensed (?:to|under)\b|copyright\b|\(c\)\s|©|spdx-|all rights reserved|@(?:license|copyright|author|generated)\b",
    re.IGNORECASE,
)
_REFERENCE = re.compile(r"(?:\(?see(?: also)?|cf\.?|refer to|same as|as above|as below|ditto|idem|inherited(?: from)?|documented (?:in|at|elsewhere)|described (?:in|above|below|elsewhere)|defined (?:in|above|below|elsewhere))\b", re.IGNORECASE)
_INHERIT = re.compile(r"\{?@?inherit[- ]?doc(?:s|umentation)?\}?[\s.]*", re.IGNORECASE)
_TAG = re.compile(r"(?:@|\\|:)(?P<tag>[a-zA-Z][\w-]*)(?P<mid>[^:\n]*:(?=\s|$))?\s*(?P<rest>.*)", re.DOTALL)
_SECTION = re.compile(r"#*\s*(?:args?|arguments|parameters|params|returns?|raises|throws|yields|examples?|notes?|attributes|panics|errors|safety|see also)\s*:?\s*", re.IGNORECASE)
_STOP = frozenset("a an the this that these those it its of to for in on at by with and or from into is are be was as function functions method methods func fn def procedure routine helper does do done will simply just which given some any current".split())
_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def _stem(word: str) -> str:
    for tail in ("ies", "ied"):
        if word.endswith(tail) and len(word) > 4:
            return word[:-3] + "y"
    for tail in ("ing", "ers", "ed", "es", "er", "s"):
        if word.endswith(tail) and len(word) - len(tail) >= 3:
            word = word[: -len(tail)]
            break
    if len(word) > 3 and word[-1] == word[-2] and word[-1] not in "ls":
        word = word[:-1]
    return word.rstrip("e")


def _split(text: str) -> list[str]:
    return [w.casefold() for part in _WORD.findall(text) for w in _CAMEL.split(part)]


def says_more(doc: str | None, name: str) -> bool:
    """Whether documentation says anything beyond the function's name.

    Left out as saying nothing: marks, placeholders and lines that begin with TODO and the like,
    tool directives, notices (generated code, licences), references elsewhere of up to five words,
    and tags without a description. What is left must hold a word that is not the name's.
    """
    if not doc:
        return False
    own = {_stem(w) for w in _split(name)}
    kept = []
    for line in doc.split("\n"):
        s = line.strip().strip("*#=~_|>-–—•·").strip()
        if not _WORD.search(s) or _PLACEHOLDER.fullmatch(s) or _MARKED.match(s) or _TOOL.match(s) or _NOTICE.match(s) or _INHERIT.fullmatch(s) or _SECTION.fullmatch(s):
            continue
        if _REFERENCE.match(s) and len(_WORD.findall(re.sub(r"\{@link|`[^`]*`", "x", s))) <= 5:
            continue
        if (m := _TAG.match(s)) and s[0] in "@:\\":
            tag, mid, rest = m["tag"].lower(), m["mid"], m["rest"]
            if mid is None:
                rest = re.sub(r"^\{[^}]*\}\s*", "", rest)
                if tag in ("param", "parameter", "arg", "argument", "prop", "property", "throws", "exception", "raise", "raises", "template", "typeparam", "option", "yieldparam"):
                    rest = re.sub(r"^(?:\[[^\]]*\]\s*)?\S+\s*(?:\[[^\]]*\]\s*)?[-–:]?\s*", "", rest, count=1)
                elif tag in ("link", "see", "linkcode"):
                    continue
            if not _WORD.search(rest) or _PLACEHOLDER.fullmatch(rest.strip()):
                continue
            s = rest
        kept.append(re.sub(r"\{@\w+\s*([^}]*)\}", r"\1", s))
    content = [w for w in _split(" ".join(kept)) if w not in _STOP]
    return any(_stem(w) not in own for w in content)


# ------------------------------------------------------------------ operator


def functions(ext: str, text: str) -> list[tuple[str, str, int, int, str, str, str | None]]:
    """name, qualified name, first and last line, signature, code and documentation of the functions of a file."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    masked, comments = mark(ext, text)
    owners = [(m.start(), len(m["indent"].expandtabs(8)), m["name"]) for m in _OWNERS[ext].finditer(masked)]
    out = []
    for m in _HEADS[ext].finditer(masked):
        groups = m.groupdict()
        field = groups.get("b") or groups.get("d")
        name = groups.get("name") or groups.get("a") or field or groups.get("c")
        start = m.start()
        header, has_body = _header_end(ext, masked, m.end("name") if "name" in groups else m.end() - 1 if field is None else m.end("b" if groups["b"] else "d"))
        if ext == "ts" and groups["c"] and not has_body and "abstract" not in m[0]:
            continue  # a call
        width = len(re.compile(r"[ \t]*").match(text, start)[0].expandtabs(8))  # of the text: a comment may stand before the signature
        owner = next((n for p, w, n in reversed(owners) if p < start and w < width), None)
        end = _body_end(ext, masked, start, header, m["indent"]) if has_body else header
        if ext == "py":
            doc = _docstring(text, header + 1) if has_body else None
        else:
            doc = _above(ext, text, masked, comments, start)
        line = text.count("\n", 0, start) + 1
        last = line + text.count("\n", start, end)
        signature = text[start : max(header, re.compile(r"[^\n;]*").match(masked, header).end()) if ext == "rb" else header].strip()
        out.append((name, f"{owner}.{name}" if owner else name, line, last, signature, text[start:end], doc))
    return out


_FOUND = {"path": pa.string(), "name": pa.string(), "qualified": pa.string(), "line": pa.int32(), "last_line": pa.int32(), "signature": pa.string(), "code": pa.string(), "documentation": pa.string(), "informative": pa.bool_()}
_KEYS = ["path", "name", "qualified", "line", "informative"]
_KINDS = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean"}


def _extract(columns: list[str]):
    places = [list(_FOUND).index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, ext, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows += [(path, *f, says_more(f[6], f[0])) for f in functions(ext, text)]
            cols = [[r[i] for r in rows] for i in places]
            yield pa.RecordBatch.from_arrays([pa.array(c, _FOUND[n]) for c, n in zip(cols, columns, strict=True)], columns)

    return run


def extracted(source_files: DataFrame, bodies: bool = True) -> DataFrame:
    """Every function of the files, with its documentation and whether that is informative; without bodies only the keys and that."""
    columns = list(_FOUND) if bodies else _KEYS
    ddl = ", ".join(f"{c} {_KINDS[_FOUND[c]]}" for c in columns)
    return files(source_files).select("path", "ext", "content").mapInArrow(_extract(columns), ddl).distinct()


def function_entities(entities: DataFrame) -> DataFrame:
    """uid, path, name, symbol, start_line of the functions and methods whose counting row is no tombstone."""
    row = F.struct(
        F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), "kind", "name", "path", "start_line", F.coalesce(F.get_json_object("metadata", "$.deleted") == "true", F.lit(False)).alias("deleted")
    )
    latest = entities.where(F.col("uid").isNotNull()).groupBy(normalize_uid(F.col("uid")).alias("uid")).agg(F.max(row).alias("r"))
    symbol = F.regexp_extract("uid", "(?s)#(.*)$", 1)
    path = F.coalesce(F.col("r.path"), F.regexp_extract("uid", "(?s)^[^:#]*:([^#]*)", 1))
    return latest.where(~F.col("r.deleted") & F.col("r.kind").isin("function", "method")).select(
        "uid", normalize_path(path).alias("path"), F.coalesce("r.name", F.element_at(F.split(symbol, r"\."), -1)).alias("name"), symbol.alias("symbol"), F.col("r.start_line").alias("start_line")
    )


def documented(source_files: DataFrame, entities: DataFrame, bodies: bool = True) -> DataFrame:
    """uid, path, signature, code, documentation of the functions with informative documentation; without bodies uid and path."""
    code = extracted(source_files, bodies)
    want = function_entities(entities)
    same_line = F.coalesce(F.col("start_line") == F.col("line"), F.lit(False))
    same_name = F.col("symbol").eqNullSafe(F.col("qualified"))
    fit = F.struct(same_line.alias("a"), same_name.alias("b"), (-F.col("line")).alias("c"))
    texts = ["signature", "code", "documentation"] if bodies else []
    pick = F.struct("path", *texts, "informative")
    return (
        want.join(code, ["path", "name"])
        .where(same_line | same_name)
        .groupBy("uid")
        .agg(F.max_by(pick, fit).alias("f"))
        .where("f.informative")
        .select("uid", "f.path", *[f"f.{t}" for t in texts])
    )
