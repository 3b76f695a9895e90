"""Extractors: source files to entities, relations and unresolved names, as one table function for each language.

A file is one call; its rows leave the worker as Arrow. Python is read by the standard parser and,
where that fails, by lines; the other languages by lines. The confidence of a row says how it
was found. Targets that are guesses keep the guessed uid, so dangling relations are expected.
"""

from __future__ import annotations

import ast
import re
import tomllib
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.keys import normalize_path
from graphloom.sources.tree import language_of

ROWS = "record string, path string, uid string, kind string, name string, signature string, line int, is_public boolean, from_uid string, to_uid string, confidence double, source string"
_FIELDS = ["record", "path", "uid", "kind", "name", "signature", "line", "is_public", "from_uid", "to_uid", "confidence", "source"]


class Found:
    """The rows of one file."""

    def __init__(self, path: str, source: str):
        self.path, self.source, self.file = path, source, f"file:{path}"
        self.rows: list[tuple] = [("entity", path, self.file, "file", path.rsplit("/", 1)[-1], None, None, None, None, None, 1.0, source)]
        self.names: dict[str, str] = {}

    def entity(self, kind: str, symbol: str, line: int, confidence: float, signature: str | None = None, public: bool | None = None, parent: str | None = None) -> str:
        uid = f"{kind}:{self.path}#{symbol}"
        self.rows.append(("entity", self.path, uid, kind, symbol.rsplit(".", 1)[-1], signature, line, public, None, None, confidence, self.source))
        self.relation(parent or self.file, uid, "contains", 1.0)
        self.names.setdefault(symbol.rsplit(".", 1)[-1], uid)
        return uid

    def relation(self, a: str, b: str, kind: str, confidence: float) -> None:
        self.rows.append(("relation", self.path, None, kind, None, None, None, None, a, b, confidence, self.source))

    def unresolved(self, name: str, kind: str, line: int | None, confidence: float) -> None:
        self.rows.append(("unresolved", self.path, None, kind, name, None, line, None, self.file, None, confidence, self.source))


def relative_module(path: str, module: str) -> str:
    """The path of a relative Python module; any number of dots means the importing folder."""
    folder = path.rsplit("/", 1)[0] if "/" in path else ""
    rest = module.lstrip(".").replace(".", "/")
    return "/".join(p for p in (folder, rest) if p) + ".py" if rest else folder + "/__init__.py"


def python(path: str, text: str) -> Found:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _python_lines(path, text)
    out = Found(path, "ast")
    calls: list[tuple[str, str]] = []

    def visit(node: ast.AST, scope: list[str], owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                uid = out.entity("class", ".".join([*scope, child.name]), child.lineno, 0.95, f"class {child.name}", not child.name.startswith("_"), owner)
                for base in child.bases:
                    if isinstance(base, ast.Name):
                        out.relation(uid, f"class:{path}#{base.id}", "extends", 0.86)
                visit(child, [*scope, child.name], uid)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "method" if scope and isinstance(node, ast.ClassDef) else "test" if child.name.startswith("test_") else "function"
                uid = out.entity(kind, ".".join([*scope, child.name]), child.lineno, 0.95, f"def {child.name}({ast.unparse(child.args)})", not child.name.startswith("_"), owner)
                visit(child, [*scope, child.name], uid)
            elif isinstance(child, ast.Import):
                for a in child.names:
                    out.relation(out.file, "file:" + a.name.replace(".", "/") + ".py", "imports", 0.65)
                    out.unresolved(a.name, "import", child.lineno, 0.6)
            elif isinstance(child, ast.ImportFrom):
                if child.level:
                    out.relation(out.file, "file:" + relative_module(path, "." * child.level + (child.module or "")), "imports", 0.9)
                else:
                    out.relation(out.file, "file:" + (child.module or "").replace(".", "/") + ".py", "imports", 0.65)
                    out.unresolved(child.module or "", "import", child.lineno, 0.6)
            else:
                if isinstance(child, ast.Call) and isinstance(child.func, ast.Name):
                    calls.append((owner, child.func.id))
                visit(child, scope, owner)

    visit(tree, [], out.file)
    _calls(out, calls, 0.68)
    return out


def _calls(out: Found, calls: list[tuple[str, str]], confidence: float) -> None:
    """Calls of names of the same file, each pair once, none to itself."""
    for owner, name in dict.fromkeys(calls):
        to = out.names.get(name)
        if to and to != owner:
            out.relation(owner, to, "calls", confidence)


def _python_lines(path: str, text: str) -> Found:
    out, cls = Found(path, "regex"), None
    for n, line in enumerate(re.split(r"\r\n|\n|\r", text), 1):
        if not line.strip():
            cls = None
        elif m := re.match(r"class\s+(\w+)", line):
            cls = m[1]
            out.entity("class", cls, n, 0.72, m[0])
        elif m := re.match(r"(\s*)(?:async\s+)?def\s+(\w+)\s*\(([^)]*)", line):
            inner = bool(m[1]) and cls
            out.entity("method" if inner else "function", f"{cls}.{m[2]}" if inner else m[2], n, 0.72, m[0].strip() + ")", not m[2].startswith("_"))
        elif m := re.match(r"from\s+(\.+\w*(?:\.\w+)*)\s+import\b", line):
            out.relation(out.file, "file:" + relative_module(path, m[1]), "imports", 0.6)
        elif m := re.match(r"(?:from|import)\s+(\w+(?:\.\w+)*)", line):
            out.relation(out.file, "file:" + m[1].replace(".", "/") + ".py", "imports", 0.5)
            out.unresolved(m[1], "import", n, 0.6)
    return out


def _lines(text: str) -> Iterator[tuple[int, str]]:
    yield from enumerate(re.split(r"\r\n|\n|\r", text), 1)


def join_path(folder_of: str, target: str) -> str:
    """target relative to the folder of a file, with . and .. resolved."""
    parts = folder_of.split("/")[:-1]
    for p in target.split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in (".", ""):
            parts.append(p)
    return "/".join(parts)


def typescript(path: str, text: str) -> Found:
    out, cls, depth, owner, calls = Found(path, "regex"), None, 0, None, []
    cls_uid = None
    for n, line in _lines(text):
        code = re.sub(r"//.*$|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|/\*.*?\*/", lambda m: m[0] if m[0][0] in "'\"" else "", line)
        bare = re.sub(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"", "''", code)
        if m := re.match(r"\s*(?:import|export)\b.*?\bfrom\s+['\"]([^'\"]+)['\"]|\s*import\s+['\"]([^'\"]+)['\"]", code):
            target = m[1] or m[2]
            if target.startswith("."):
                out.relation(out.file, "file:" + join_path(path, target) + ("" if re.search(r"\.\w+$", target) else ".ts"), "imports", 0.92)
            else:
                out.unresolved(target, "import", n, 0.7)
        public = bool(re.match(r"\s*export\b", code))
        uid = None
        if m := re.match(r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)(?:\s*<[^{]*?>)?(?:\s+extends\s+([\w.]+))?(?:[^{]*?\bimplements\s+([^{]+))?", bare):
            cls, cls_uid = m[1], out.entity("class", m[1], n, 0.9, m[0].strip(), public)
            uid = cls_uid
            if m[2]:
                out.relation(cls_uid, f"class:{path}#{m[2]}", "extends", 0.86)
            for i in (m[3] or "").split(","):
                if i.strip():
                    out.relation(cls_uid, f"interface:{path}#{i.strip().split('<')[0]}", "implements", 0.86)
        elif m := re.match(r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", bare):
            uid = owner = out.entity("function", m[1], n, 0.9, code.strip().rstrip("{").strip(), public)
        elif m := re.match(r"\s*(?:export\s+)?(interface|type|enum)\s+(\w+)", bare):
            uid = out.entity("interface" if m[1] == "interface" else "type", m[2], n, 0.9, m[0].strip(), public)
        elif m := re.match(r"(?:export\s+)?(?:const|let|var)\s+(\w+)", bare):
            uid = out.entity("function" if "=>" in bare else "constant", m[1], n, 0.9, None, public)
        elif (m := re.match(r"\s*(?:test|it|describe)\s*\(\s*['\"]([^'\"]+)", code)) and re.search(r"\.(?:test|spec)\.[jt]sx?$", path):
            test = out.entity("test", m[1], n, 0.88)
            out.relation(test, "file:" + re.sub(r"\.(?:test|spec)(\.[jt]sx?)$", r"\1", path), "tests", 0.88)
        elif cls and depth == 1 and (m := re.match(r"\s+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?(?!if|for|while|switch|catch|return)(\w+)\s*(?:<[^(]*>)?\([^;]*\{\s*$", bare)):
            owner = out.entity("method", f"{cls}.{m[1]}", n, 0.9, code.strip().rstrip("{").strip(), "private" not in bare, cls_uid)
        elif owner:
            calls += [(owner, c) for c in re.findall(r"(?<![.\w])(\w+)\s*\(", bare)]
        if uid and public:
            out.relation(out.file, uid, "exports", 0.98)
        depth += bare.count("{") - bare.count("}")
        if depth <= 0:
            cls = cls_uid = None
            depth = 0
    _calls(out, calls, 0.68)
    return out


def expand_uses(spec: str) -> list[str]:
    """The single paths of a Rust use tree: a::{b, c::{d, self}} -> a::b, a::c::d, a::c."""
    spec = spec.strip()
    if "{" not in spec:
        path = re.sub(r"\s+as\s+\w+$", "", spec).strip()
        return [re.sub(r"::self$", "", path)] if path else []
    head, rest = spec.split("{", 1)
    body, depth, parts, cur = rest[: rest.rfind("}")] if "}" in rest else rest, 0, [], ""
    for c in body:
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += c
    return [p for part in [*parts, cur] for p in expand_uses(head.strip() + part.strip()) if part.strip()]


def cargo(path: str, text: str) -> Found:
    """Package, members and dependencies of a Cargo manifest."""
    out = Found(path, "ast")
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return out
    if name := doc.get("package", {}).get("name"):
        out.entity("module", name, 1, 0.95)
    for member in doc.get("workspace", {}).get("members", []):
        out.relation(out.file, "file:" + join_path(path, member + "/Cargo.toml"), "contains", 0.9)
    for section in ("dependencies", "dev-dependencies", "build-dependencies"):
        for dep in doc.get(section, {}):
            out.unresolved(dep, "dependency", None, 0.9)
    return out


def rust(path: str, text: str) -> Found:
    out, owner, fn, calls, depth, owner_depth = Found(path, "regex"), None, None, [], 0, 0
    is_test = False
    uses = re.sub(r"//[^\n]*", "", text)
    for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", uses, re.MULTILINE):
        for p in expand_uses(re.sub(r"\s+", " ", m[1])):
            seg = [s for s in p.split("::") if s not in ("", "*")]
            if seg and seg[0] in ("crate", "self", "super"):
                out.relation(out.file, "file:" + "/".join(["src", *seg[1:]][: max(2, len(seg))]) + ".rs", "imports", 0.72)
            elif seg:
                out.unresolved(p, "import", None, 0.7)
    for n, line in _lines(text):
        bare = re.sub(r"//.*$|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'", "", line)
        if re.match(r"\s*#\[(?:tokio::)?test\]", bare):
            is_test = True
        if m := re.match(r"\s*(pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(struct|enum|trait|union|type|mod|const|static)\s+(?:mut\s+)?(\w+)", bare):
            kind = {"struct": "class", "enum": "type", "trait": "interface", "union": "class", "type": "type", "mod": "module", "const": "constant", "static": "constant"}[m[2]]
            out.entity(kind, m[3], n, 0.9, m[0].strip(), (m[1] or "").strip() == "pub")
            if m[2] == "mod" and bare.rstrip().endswith(";"):
                out.relation(out.file, "file:" + join_path(path, m[3] + ".rs"), "imports", 0.76)
            if m[2] == "trait":
                owner, owner_depth = m[3], depth
        elif m := re.match(r"\s*(?:unsafe\s+)?impl\b(?:<[^>]*>)?\s+(?:(.+?)\s+for\s+)?(\w+)", bare):
            owner, owner_depth = m[2], depth
            if m[1]:
                out.relation(f"class:{path}#{m[2]}", f"interface:{path}#{re.split(r'[<:]', m[1])[-1].strip()}", "implements", 0.86)
        elif m := re.match(r"\s*(pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern\s*(?:\"\")?)\s+)*fn\s+(\w+)", bare):
            inner = owner and depth > owner_depth
            kind = "test" if is_test else "method" if inner else "function"
            fn = out.entity(kind, f"{owner}.{m[2]}" if inner else m[2], n, 0.9, line.strip().rstrip("{").strip(), (m[1] or "").strip() == "pub")
            is_test = False
        elif m := re.match(r"\s*macro_rules!\s+(\w+)", bare):
            out.entity("function", m[1], n, 0.86)
        elif fn:
            calls += [(fn, c) for c in re.findall(r"(?<![.\w:])(\w+)\s*\(", bare)]
        depth += bare.count("{") - bare.count("}")
        if owner and depth <= owner_depth:
            owner = None
    _calls(out, calls, 0.62)
    return out


#: Constants of the language's core, which name no file of the application.
RUBY_CORE = frozenset("String Integer Array Hash Time Date JSON Object Class Module".split())


#: Folders by the end of a constant's name; all others are models.
RAILS_FOLDERS = {"Controller": "controllers", "Job": "jobs", "Mailer": "mailers"}


def snake(name: str) -> str:
    return re.sub(r"([a-z\d])([A-Z])", r"\1_\2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)).lower()


def rails_path(constant: str) -> str | None:
    """The conventional path of a Rails constant: Admin::UsersController -> app/controllers/admin/users_controller.rb."""
    if not constant or constant in RUBY_CORE:
        return None
    folder = next((f for tail, f in RAILS_FOLDERS.items() if constant.endswith(tail)), "models")
    return f"app/{folder}/" + "/".join(snake(p) for p in constant.split("::")) + ".rb"


def implementation_of(path: str) -> str | None:
    """The file that a test file tests, by layout; None for other files."""
    if m := re.match(r"(.*/)?(?:spec|test)/(.+)_(?:spec|test)\.rb$", path):
        folder = "" if m[2].startswith("lib/") else "app/" if "/" in m[2] else "lib/"
        return f"{m[1] or ''}{folder}{m[2]}.rb"
    if m := re.match(r"(.+)\.(?:test|spec)(\.[jt]sx?)$", path):
        return m[1] + m[2]
    return None


def bundler(path: str, text: str) -> Found:
    """Gems of a Gemfile or lock file, the first mention of each."""
    out, seen = Found(path, "regex"), set()
    for n, line in _lines(text):
        m = re.match(r"\s*gem\s+['\"]([^'\"]+)['\"]", line) or (re.match(r"    ([\w-]+) \(", line) if path.endswith(".lock") else None)
        if m and m[1] not in seen:
            seen.add(m[1])
            out.unresolved(m[1], "dependency", n, 0.9)
    return out


def ruby(path: str, text: str) -> Found:
    out, scope, fn, calls = Found(path, "regex"), [], None, []
    routes = path.endswith("routes.rb")
    text = re.sub(r"(?ms)^=begin\b.*?^=end\b", lambda m: "\n" * m[0].count("\n"), text)
    for n, line in _lines(text):
        bare = re.sub(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"", "''", line)
        bare = re.sub(r"#.*$", "", bare)
        indent = len(bare) - len(bare.lstrip())
        if bare.strip():
            while scope and indent <= scope[-1][1] and not bare.strip().startswith("end"):
                scope.pop()
        if m := re.match(r"\s*(class|module)\s+([A-Z][\w:]*)(?:\s*<\s*([A-Z][\w:]*))?", bare):
            uid = out.entity("class" if m[1] == "class" else "module", "::".join([*(s for s, _ in scope), m[2]]), n, 0.72, m[0].strip(), True)
            scope.append((m[2], indent))
            if m[3] and (target := rails_path(m[3])):
                out.relation(uid, f"class:{target}#{m[3]}", "extends", 0.72)
        elif m := re.match(r"\s*(?:private\s+)?def\s+(self\.)?([\w?!=]+|\[\]=?|[+\-*/<=>!~]+)", bare):
            name = "::".join(s for s, _ in scope)
            fn = out.entity("method" if scope else "function", f"{name}.{m[2]}" if scope else m[2], n, 0.72, line.strip(), not m[2].startswith("_"))
        elif m := re.match(r"\s*(?:include|extend|prepend)\s+([A-Z][\w:]*)", bare):
            if scope:
                out.relation(f"class:{path}#{scope[-1][0]}", f"module:{rails_path(m[1]) or path}#{m[1]}", "uses", 0.72)
        elif m := re.match(r"\s*require_relative\s+['\"]([^'\"]+)", line):
            out.relation(out.file, "file:" + join_path(path, m[1]) + ".rb", "imports", 0.9)
        elif m := re.match(r"\s*require\s+['\"]([^'\"]+)", line):
            out.unresolved(m[1], "import", n, 0.6)
        elif m := re.match(r"\s*(has_many|has_one|belongs_to|has_and_belongs_to_many)\s+:(\w+)", line):
            one = m[2] if m[1] in ("has_one", "belongs_to") else re.sub(r"ies$", "y", m[2]) if m[2].endswith("ies") else m[2].removesuffix("s")
            if scope:
                out.relation(f"class:{path}#{scope[-1][0]}", f"file:app/models/{one}.rb", "depends_on", 0.7)
        elif routes and (m := re.match(r"\s*(get|post|put|patch|delete)\s+['\"]([^'\"]+)['\"](?:.*?(?:to:|=>)\s*['\"](\w[\w/]*)#(\w+))?", line)):
            r = out.entity("route", f"{m[1].upper()} {m[2]}", n, 0.78)
            if m[3]:
                name = "".join(p.title() for p in m[3].split("/")[-1].split("_")) + "Controller"
                out.relation(r, f"method:app/controllers/{m[3]}_controller.rb#{name}.{m[4]}", "routes_to", 0.78)
        elif routes and (m := re.match(r"\s*resources?\s+:(\w+)", line)):
            r = out.entity("route", f"GET /{m[1]}", n, 0.78)
            out.relation(r, f"method:app/controllers/{m[1]}_controller.rb#{m[1].title().replace('_', '')}Controller.index", "routes_to", 0.78)
        elif fn:
            calls += [(fn, c) for c in re.findall(r"(?<![.\w:@])([a-z_]\w*[?!]?)\s*\(", bare)]
    if target := implementation_of(path):
        test = out.entity("test", path.rsplit("/", 1)[-1].removesuffix(".rb"), 1, 0.86)
        out.relation(test, f"file:{target}", "tests", 0.86)
    _calls(out, calls, 0.62)
    return out


READERS = {"python": python, "typescript": typescript, "rust": rust, "ruby": ruby}


def read_file(path: str, language: str, text: str) -> list[tuple]:
    text = text.removeprefix("\ufeff")
    if path.endswith("Cargo.toml"):
        return cargo(path, text).rows
    if re.search(r"(?:^|/)Gemfile(?:\.lock)?$", path):
        return bundler(path, text).rows
    return READERS[language](path, text).rows


def extract(files: DataFrame) -> DataFrame:
    """Entity, relation and unresolved rows of files (path, content); a file that occurs twice is read once."""
    lang = language_of(F.col("path"))
    todo = files.select(normalize_path(F.col("path")).alias("path"), F.coalesce("content", F.lit("")).alias("content")).withColumn("language", lang).where(F.col("language").isNotNull()).dropDuplicates(["path"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for p, t, g in zip(f["path"], f["content"], f["language"], strict=True) for r in read_file(p, g, t)]
            out = pd.DataFrame(rows, columns=_FIELDS)
            yield out.astype({"line": "Int32", "is_public": "boolean"})

    return todo.mapInPandas(run, ROWS)


# ---- path resolution

#: Extensions tried, in order, where an import names none.
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".rs", ".rb"]


def candidates(target: Column, importer: Column) -> Column:
    """Paths that a target may mean, best first: itself, with an extension, an index file, a mod.rs; beside the importer if it has no slash."""
    forms = lambda t: F.array(t, *[F.concat(t, F.lit(e)) for e in EXTENSIONS], *[F.concat(t, F.lit("/index" + e)) for e in EXTENSIONS], F.concat(t, F.lit("/mod.rs")))
    beside = F.concat(F.regexp_replace(importer, "[^/]*$", ""), target)
    return F.when(target.contains("/"), forms(target)).otherwise(F.concat(forms(target), forms(beside)))


def canonical_relations(relations: DataFrame, files: DataFrame) -> DataFrame:
    """Relations to files with the target replaced by the first candidate path that exists (files: path)."""
    target = F.substring("to_uid", 6, 1 << 20)
    is_file = F.col("to_uid").startswith("file:") & ~F.col("to_uid").contains("#")
    base = F.when(target.endswith(".ts"), F.expr("substring(to_uid, 6, length(to_uid) - 8)")).otherwise(target)
    asked = relations.where(is_file).select("path", "to_uid").distinct()
    tries = asked.select("path", "to_uid", F.posexplode(F.concat(F.array(target), candidates(base, F.col("path")))).alias("at", "candidate"))
    hit = tries.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("path", "to_uid").agg(F.min_by("candidate", "at").alias("real"))
    return relations.join(hit, ["path", "to_uid"], "left").withColumn("to_uid", F.coalesce(F.concat(F.lit("file:"), "real"), "to_uid")).drop("real")


# ---- markers


def markers(files: DataFrame, tag: str = "@uid") -> DataFrame:
    """path, line, marker: the stable ids that comments in files name, the first of each line."""
    lines = F.posexplode(F.split("content", "\r\n|\n|\r")).alias("at", "text")
    found = F.regexp_extract("text", tag + r"\s+((?:obj|func)-[0-9a-f]{8})\b", 1)
    return files.where(F.col("content").contains(tag)).select("path", lines).select("path", (F.col("at") + 1).alias("line"), found.alias("marker")).where("marker <> ''")


def apply_markers(marked: DataFrame, entities: DataFrame) -> DataFrame:
    """uid, marker: each marker goes to the first entity below it that has none yet, kind by prefix."""

    def assign(key, m: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        taken, rows = set(), []
        e = e.sort_values(["start_line", "uid"])
        for line, marker in m.sort_values("line")[["line", "marker"]].itertuples(index=False):
            func = marker.startswith("func-")
            for uid, kind, start in e[["uid", "kind", "start_line"]].itertuples(index=False):
                if start > line and uid not in taken and (kind in ("function", "method", "route", "test")) == func:
                    taken.add(uid)
                    rows.append((uid, marker))
                    break
        return pd.DataFrame(rows, columns=["uid", "marker"])

    e = entities.where(F.col("path").isNotNull() & F.col("start_line").isNotNull()).select("path", "uid", "kind", "start_line")
    return marked.groupBy("path").cogroup(e.groupBy("path")).applyInPandas(assign, "uid string, marker string")
