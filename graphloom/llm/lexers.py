"""Token kinds of source text in Python, TypeScript, Rust and Ruby.

Each lexer gives the kinds and start offsets of the tokens, and raises Broken where no token can
start or a literal is never closed. Names, numbers and literals are one kind each; keywords and
marks are their own kinds.
"""

from __future__ import annotations

import re
import sys
import unicodedata


class Broken(Exception):
    """at: the offset; open_: whether a literal or comment runs to the end of the text."""

    def __init__(self, at: int, open_: bool = False):
        super().__init__(at)
        self.at, self.open = at, open_


def _longest(marks: str) -> str:
    return "|".join(re.escape(m) for m in sorted(marks.split(), key=len, reverse=True))


# ---------------------------------------------------------------- Python

#: Reserved words of Python 3.13.
PY_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_PY_MARKS = _longest("** // >> << <= >= == != -> += -= *= /= %= &= |= ^= **= //= >>= <<= @= := ... + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; =")
_PY = re.compile(
    rf"""(?P<space>[ \t\f]+|\\\r?\n|\\\r)|(?P<comment>\#[^\r\n]*)|(?P<line>\r\n|\n|\r)
    |(?P<string>(?P<prefix>[rRbBuUfF]{{0,2}})(?P<quote>'''|\"\"\"|'|"))
    |(?P<number>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+
      |(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?)
    |(?P<name>[^\W\d]\w*)|(?P<mark>{_PY_MARKS})""",
    re.VERBOSE,
)
_PY_PREFIX = frozenset(("", "r", "u", "b", "f", "br", "rb", "fr", "rf"))
_CLOSE = {")": "(", "]": "[", "}": "{"}


def _py_string(text: str, at: int, quote: str, raw: bool) -> int:
    """The end of a string whose body starts at `at`."""
    long_ = len(quote) == 3
    stop = re.compile(rf"\\(?:\r\n|.)|{quote}" + ("" if long_ else r"|[\r\n]"), re.DOTALL)
    while m := stop.search(text, at):
        if m[0] == quote:
            return m.end()
        if m[0][0] in "\r\n":
            raise Broken(m.start())
        at = m.end()
    raise Broken(at, True)


def _py_format(text: str, at: int, quote: str, raw: bool) -> int:
    """The end of an f-string: fields are skipped with their own strings and brackets."""
    long_ = len(quote) == 3
    end = len(text)
    while at < end:
        if text.startswith(quote, at):
            return at + len(quote)
        c = text[at]
        if c in "\r\n" and not long_:
            raise Broken(at)
        if c == "\\":
            if not raw and text.startswith("\\N{", at):
                at = max(at + 2, text.find("}", at) + 1)
            else:
                at += 1 if text[at + 1 : at + 2] in ("{", "}") else 2
        elif c == "{" and text.startswith("{{", at):
            at += 2
        elif c == "{":
            at = _py_field(text, at + 1, quote)
        elif c == "}":
            if not text.startswith("}}", at):
                raise Broken(at)
            at += 2
        else:
            at += 1
    raise Broken(end, True)


def _py_field(text: str, at: int, quote: str) -> int:
    begin, open_ = at, []
    while True:
        m = _PY.match(text, at)
        if text.startswith("!", at) and not text.startswith("!=", at):
            at += 1
            continue
        if not m:
            raise Broken(at, at >= len(text))
        if m["string"]:
            at = _py_literal(text, m)
            continue
        if (m["line"] or m["comment"]) and len(quote) == 1 and not open_:
            raise Broken(at)
        mark = m["mark"]
        at = m.end()
        if mark in ("(", "[", "{"):
            open_.append(mark)
        elif mark in _CLOSE:
            if not open_:
                if mark != "}" or not text[begin : at - 1].strip():
                    raise Broken(at - 1)
                return at
            if open_.pop() != _CLOSE[mark]:
                raise Broken(at - 1)
        elif mark in (":", ":=") and not open_:
            at = m.start() + 1
            while not text.startswith("}", at):  # the format after the colon
                if at >= len(text):
                    raise Broken(at, True)
                if text.startswith("{", at):
                    at = _py_field(text, at + 1, quote)
                elif text.startswith(quote, at) or (text[at] in "\r\n" and len(quote) == 1):
                    raise Broken(at)
                else:
                    at += 1
            return at + 1


def _py_literal(text: str, m: re.Match) -> int:
    prefix = m["prefix"].lower()
    if prefix not in _PY_PREFIX:
        raise Broken(m.start())
    read = _py_format if "f" in prefix else _py_string
    return read(text, m.end(), m["quote"], "r" in prefix)


def python(text: str) -> tuple[list[str], list[int]]:
    kinds: list[str] = []
    at_: list[int] = []
    open_: list[str] = []
    indents, fresh = [(0, 0)], True
    at, end, line_start = 0, len(text), 0
    while at < end:
        if fresh and not open_:
            line_start = at
            m = re.compile(r"[ \t\f]*").match(text, at)
            rest = text[m.end() : m.end() + 1]
            if rest in ("#", "\n", "\r", ""):
                at = m.end()
            else:
                wide, narrow = 0, 0
                for c in m[0]:
                    if c == "\t":
                        wide, narrow = (wide // 8 + 1) * 8, narrow + 1
                    elif c == "\f":
                        wide = narrow = 0
                    else:
                        wide, narrow = wide + 1, narrow + 1
                if wide == indents[-1][0]:
                    if narrow != indents[-1][1]:
                        raise Broken(at)
                elif wide > indents[-1][0]:
                    if narrow <= indents[-1][1]:
                        raise Broken(at)
                    indents.append((wide, narrow))
                    kinds.append("INDENT")
                    at_.append(at)
                else:
                    while wide < indents[-1][0]:
                        indents.pop()
                        kinds.append("DEDENT")
                        at_.append(at)
                    if (wide, narrow) != indents[-1]:
                        raise Broken(at)
                at = m.end()
            fresh = False
            if at >= end:
                break
        if text[at] == " ":  # by far the most frequent token
            at += 1
            continue
        m = _PY.match(text, at)
        if m is None:
            raise Broken(at)
        kind = m.lastgroup
        if kind == "mark":
            k = m["mark"]
            if k in "([{":
                open_.append(k)
            elif k in _CLOSE and (not open_ or open_.pop() != _CLOSE[k]):
                raise Broken(at)
            kinds.append(sys.intern(k))
            at_.append(at)
            at = m.end()
        elif m["string"] is not None:
            kinds.append("FSTRING" if "f" in m["prefix"].lower() else "BYTES" if "b" in m["prefix"].lower() else "STRING")
            at_.append(at)
            at = _py_literal(text, m)
        elif kind == "name":
            word = m["name"]
            if not word.isascii():
                word = unicodedata.normalize("NFKC", word)
            if not word.isidentifier():
                raise Broken(at)
            kinds.append(sys.intern(word) if word in PY_WORDS else "NAME")
            at_.append(at)
            at = m.end()
        elif kind == "number":
            digits = m["number"]
            follow = text[m.end() : m.end() + 1]
            if re.fullmatch(r"0[0_]*[1-9][0-9_]*", digits) or ((follow.isalnum() or follow == "_") and not re.compile(r"(?:and|else|for|if|in|is|not|or)\b").match(text, m.end())):
                raise Broken(at)
            kinds.append("NUMBER")
            at_.append(at)
            at = m.end()
        elif kind == "line":
            at = m.end()
            if not open_:
                if kinds and kinds[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                    kinds.append("NEWLINE")
                    at_.append(m.start())
                fresh = True
        else:
            at = m.end()
            if kind == "space" and m[0][0] == "\\" and at >= end:
                raise Broken(at, True)
    if open_:
        raise Broken(end, True)
    if kinds and kinds[-1] not in ("NEWLINE", "DEDENT"):
        kinds.append("NEWLINE")
        at_.append(end)
    kinds += ["DEDENT"] * (len(indents) - 1)
    at_ += [end] * (len(indents) - 1)
    _py_soft(kinds, at_, text)
    return kinds, at_


def _py_soft(kinds: list[str], at_: list[int], text: str) -> None:
    """match, case and type become keywords where the logical line can only be such a statement."""
    first = True
    for i, k in enumerate(kinds):
        if first and k == "NAME":
            if text.startswith(("match", "case"), at_[i]) and (word := re.compile(r"\w+").match(text, at_[i])[0]) in ("match", "case"):
                j = i
                while kinds[j] != "NEWLINE":
                    j += 1
                if (kinds[j - 1] == ":" or word == "case") and kinds[i + 1] not in ("=", ".", ",", ")", ":", "NEWLINE"):
                    kinds[i] = word
            elif text.startswith("type", at_[i]) and kinds[i + 1] == "NAME" and re.compile(r"type\b").match(text, at_[i]):
                kinds[i] = "type"
        first = k in ("NEWLINE", "INDENT", "DEDENT", ";")


# ---------------------------------------------------------------- TypeScript

#: Reserved words of TypeScript; contextual ones stay names that the grammar knows.
TS_WORDS = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
#: Words that are names or keywords by context.
TS_SOFT = frozenset("abstract accessor any as asserts async await bigint boolean constructor declare from get global implements infer interface is keyof let module namespace never number object of out override package private protected public readonly require satisfies set static string symbol type undefined unique unknown using yield".split())
_TS_MARKS = _longest("{ } ( ) [ ] ; , < > <= == != === !== + - * / % ** ++ -- << & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= => . ... @ >=")
_TS = re.compile(
    rf"""(?P<space>[^\S\r\n\u2028\u2029]+|\ufeff)|(?P<line>[\r\n\u2028\u2029])|(?P<comment>//[^\r\n\u2028\u2029]*)|(?P<block>/\*)
    |(?P<number>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?
      |(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?n?)
    |(?P<name>\#?[\w$\u200c\u200d]+)|(?P<string>["'])|(?P<template>`)|(?P<opt>\?\.(?![0-9]))|(?P<mark>{_TS_MARKS})""",
    re.VERBOSE,
)
_TS_STRING = {q: re.compile(rf"(?:[^{q}\\\r\n]|\\(?:\r\n|[\s\S]))*{q}") for q in "\"'"}
_TS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_TS_VALUE = frozenset(("NAME", "NUMBER", "STRING", "TEMPLATE", "REGEX", "PRIVATE", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--")) | TS_SOFT


def _ts_template(text: str, at: int) -> int:
    while at < len(text):
        c = text[at]
        if c == "`":
            return at + 1
        if c == "\\":
            at += 2
        elif text.startswith("${", at):
            kinds, _, _, at = _typescript(text, at + 2, True)
            if not kinds:
                raise Broken(at)
        else:
            at += 1
    raise Broken(len(text), True)


def _typescript(text: str, at: int, inner: bool) -> tuple[list[str], list[int], list[bool], int]:
    kinds: list[str] = []
    at_: list[int] = []
    soft: list[bool] = []
    depth, broke, parens, after_head = 0, False, [], False
    end = len(text)
    if not inner and text.startswith("#!"):
        at = re.compile(r"[^\r\n]*").match(text).end()

    def put(kind: str, where: int) -> None:
        nonlocal broke
        if broke and kinds and kinds[-1] in ("return", "break", "continue", "throw"):
            kinds.append(";")
            at_.append(where)
            soft.append(False)
        if broke and kind in ("++", "--") and kinds and kinds[-1] in _TS_VALUE:
            kinds.append(";")
            at_.append(where)
            soft.append(False)
        kinds.append(kind)
        at_.append(where)
        soft.append(broke)
        broke = False

    while at < end:
        if text[at] == " ":  # by far the most frequent token
            at += 1
            continue
        m = _TS.match(text, at)
        if m is None:
            raise Broken(at)
        kind = m.lastgroup
        if kind == "line":
            broke = True
        elif kind == "block":
            close = text.find("*/", m.end())
            if close < 0:
                raise Broken(at, True)
            broke = broke or "\n" in text[at:close]
            at = close + 2
            continue
        elif kind == "name":
            word = m["name"]
            if word[0] == "#":
                put("PRIVATE", at)
            elif word[0].isdigit() or not (word.isascii() or word.replace("$", "_").replace("\u200c", "").replace("\u200d", "").isidentifier()):
                raise Broken(at)
            else:
                put(sys.intern(word) if word in TS_WORDS or word in TS_SOFT else "NAME", at)
        elif kind == "number":
            if re.compile(r"[\w$]").match(text, m.end()) or re.fullmatch(r"0[0-9_]+", m["number"]):
                raise Broken(at)
            put("NUMBER", at)
        elif kind == "string":
            s = _TS_STRING[m[0]].match(text, m.end())
            if s is None:
                raise Broken(at, not re.compile(r"[\r\n]").search(text, at))
            put("STRING", at)
            at = s.end()
            continue
        elif kind == "template":
            put("TEMPLATE", at)
            at = _ts_template(text, m.end())
            continue
        elif kind in ("mark", "opt"):
            k = m[0]
            if k[0] == "/" and (not kinds or kinds[-1] not in _TS_VALUE or (kinds[-1] == ")" and after_head)):
                r = _TS_REGEX.match(text, at)
                if r is None:
                    raise Broken(at, "\n" not in text[at:])
                put("REGEX", at)
                at = r.end()
                continue
            if k == "(":
                parens.append(bool(kinds) and kinds[-1] in ("if", "while", "for", "with"))
            elif k == ")":
                after_head = parens.pop() if parens else False
            elif k == "{":
                depth += 1
            elif k == "}":
                if inner and depth == 0:
                    return kinds, at_, soft, m.end()
                depth -= 1
            put(sys.intern(k), at)
        at = m.end()
    if inner:
        raise Broken(end, True)
    return kinds, at_, soft, at


def typescript(text: str) -> tuple[list[str], list[int], list[bool]]:
    return _typescript(text, 0, False)[:3]


# ---------------------------------------------------------------- Rust

#: Reserved words of Rust 2021; union, auto, macro_rules and the like stay names.
RS_WORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split())
_RS_MARKS = _longest("+ - * / % ^ ! & | && || << += -= *= /= %= ^= &= |= <<= = == != > < >= <= @ . .. ... ..= , ; : :: -> => # $ ? ~ ( ) [ ] { }")
_RS = re.compile(
    rf"""(?P<space>\s+|[\u200e\u200f]+)|(?P<comment>//[^\n]*)|(?P<block>/\*)
    |(?P<raw>(?:br|cr|r)(?P<hash>\#*)")|(?P<rawname>r\#[^\W\d]\w*)|(?P<string>[bc]?")|(?P<char>b?'(?:\\(?:x[0-9a-fA-F]{{2}}|u\{{[0-9a-fA-F_]{{1,8}}\}}|[nrt\\0'"])|[^\\'\n\r\t])')
    |(?P<lifetime>'[^\W\d]\w*)
    |(?P<number>0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|[0-9][0-9_]*(?:\.(?![.\w])|(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?))(?P<suffix>[a-zA-Z_]\w*)?
    |(?P<name>[^\W\d]\w*)|(?P<mark>{_RS_MARKS})""",
    re.VERBOSE,
)
_RS_STRING = re.compile(r'(?:[^"\\]|\\[\s\S])*"')
_RS_SUFFIX = frozenset("u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64".split())


#: What follows `union` where it is a keyword.
_RS_UNION = re.compile(r"\s+((?:r#)?[^\W\d]\w*)\s*(?:[<{]|where\b)")


def rust(text: str) -> tuple[list[str], list[int]]:
    kinds: list[str] = []
    at_: list[int] = []
    at, end = 0, len(text)
    if text.startswith("#!") and not re.compile(r"#!\s*\[").match(text):
        at = re.compile(r"[^\n]*").match(text).end()
    while at < end:
        if text[at] == " ":  # by far the most frequent token
            at += 1
            continue
        m = _RS.match(text, at)
        if m is None:
            raise Broken(at)
        kind = m.lastgroup
        if kind == "space" or kind == "comment":
            at = m.end()
            continue
        if kind == "mark":
            at_.append(at)
            kinds.append(sys.intern(m["mark"]))
            at = m.end()
            continue
        if m["block"]:
            depth, at = 1, m.end()
            for c in re.compile(r"/\*|\*/").finditer(text, at):
                depth += 1 if c[0] == "/*" else -1
                if not depth:
                    at = c.end()
                    break
            if depth:
                raise Broken(m.start(), True)
            continue
        at_.append(at)
        if m["raw"]:
            close = text.find('"' + m["hash"], m.end())
            if close < 0:
                raise Broken(at, True)
            kinds.append("STRING")
            at = close + 1 + len(m["hash"])
            continue
        if m["string"]:
            s = _RS_STRING.match(text, m.end())
            if s is None:
                raise Broken(at, True)
            kinds.append("STRING")
            at = s.end()
            continue
        if m["rawname"]:
            kinds.append("NAME")
        elif m["char"]:
            kinds.append("CHAR")
        elif m["lifetime"]:
            kinds.append("LIFETIME")
        elif m["number"]:
            if m["suffix"] and m["suffix"].lstrip("_") not in _RS_SUFFIX:
                raise Broken(at)
            kinds.append("NUMBER")
        elif m["name"]:
            word = m["name"]
            soft = word == "union" and (n := _RS_UNION.match(text, m.end())) and n[1] not in RS_WORDS
            kinds.append(sys.intern(word) if soft or word in RS_WORDS else "_" if word == "_" else "NAME")
        else:
            kinds.append(sys.intern(m["mark"]))
        at = m.end()
    return kinds, at_


# ---------------------------------------------------------------- Ruby

#: Reserved words of Ruby 3.
RB_WORDS = frozenset("BEGIN END alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield __FILE__ __LINE__ __ENCODING__".split())
_RB_MARKS = _longest("** == != === =~ !~ <=> <= >= << >> && || .. ... :: -> => += -= *= /= %= **= &&= ||= &= |= ^= <<= >>= &. + - * / % & | ^ ~ ! < > = ? : , . ; ( ) [ ] { }")
_RB = re.compile(
    rf"""(?P<space>[ \t\f\v]+|\\\r?\n)|(?P<comment>\#[^\r\n]*)|(?P<line>\r\n|\n|\r)
    |(?P<heredoc><<(?P<squiggle>[~-]?)(?P<hq>["'`]?)(?P<tag>[A-Za-z_]\w*)(?P=hq))
    |(?P<label>(?:[^\W\d]\w*[?!]?):(?![:\w]))
    |(?P<number>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[bB][01](?:_?[01])*|0[oO]?[0-7](?:_?[0-7])*|[0-9](?:_?[0-9])*(?:\.[0-9](?:_?[0-9])*)?(?:[eE][+-]?[0-9](?:_?[0-9])*)?)r?i?
    |(?P<name>[^\W\d]\w*(?:[?!](?![=~]|>)|[?!](?==>))?)|(?P<at>@@?[^\W\d]\w*)|(?P<global>\$(?:[^\W\d]\w*|[0-9]+|-\w|[!@&`'+~=/\\,;.<>_*$?:"]))
    |(?P<symbol>:(?:[^\W\d]\w*[?!=]?(?![\w?!])|[^\W\d]\w*|\[\]=?|\*\*|<=>|===?|=~|![~=]?|<<|>>|<=?|>=?|[+\-]@?|[*/%&|^~`]))
    |(?P<symstring>:["'])|(?P<string>["'`])|(?P<char>\?(?:\\[^\r\n]|[^\s\\])(?!\w))|(?P<mark>{_RB_MARKS})""",
    re.VERBOSE,
)
_RB_VALUE = frozenset(("NAME", "CONST", "NUMBER", "STRING", "SYMBOL", "VAR", "REGEX", "CHAR", ")", "]", "}", "end", "nil", "true", "false", "self", "super", "yield", "redo", "retry", "__FILE__", "__LINE__", "__ENCODING__", "FNAME", "break", "next", "return"))
#: A line that goes on with a method call, after blank and comment lines.
_RB_CHAIN = re.compile(r"(?:[ \t\f\v]*(?:#[^\r\n]*)?(?:\r\n|\n|\r))*[ \t\f\v]*(?:\.(?!\.)|&\.)")
_PAIR = {"(": ")", "[": "]", "{": "}", "<": ">"}
_RB_NAMES = frozenset(("NAME", "FNAME"))


def _rb_body(text: str, at: int, close: str, open_: str = "", expand: bool = True) -> int:
    """The end of a literal body: its own brackets nest, and #{} holds code."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
        elif expand and text.startswith("#{", at):
            _, _, at = _ruby(text, at + 2, True)
        elif c == close:
            if not depth:
                return at + 1
            depth -= 1
            at += 1
        else:
            depth += bool(open_) and c == open_
            at += 1
    raise Broken(len(text), True)


def _ruby(text: str, at: int, inner: bool) -> tuple[list[str], list[int], int]:
    kinds: list[str] = []
    at_: list[int] = []
    here: list[tuple[str, str, bool]] = []
    braces, end = 0, len(text)
    space = line_start = True
    spot: list[int] = []

    def put(kind: str, where: int) -> None:
        kinds.append(kind)
        at_.append(where)

    while at < end:
        if line_start and not inner:
            if text.startswith("=begin", at) and text[at + 6 : at + 7].isspace():
                m = re.compile(r"(?<=[\r\n])=end(?:[ \t][^\r\n]*)?(?=[\r\n]|\Z)").search(text, at)
                if not m:
                    raise Broken(at, True)
                at = m.end()
                continue
            if re.compile(r"__END__(?:\r?\n|$)").match(text, at):
                break
        line_start = False
        if text[at] == " ":  # by far the most frequent token
            space = True
            at += 1
            continue
        m = _RB.match(text, at)
        if m is None:
            raise Broken(at)
        kind = m.lastgroup
        if kind == "space" or kind == "comment":
            space = True
            at = m.end()
            continue
        last = kinds[-1] if kinds else ""
        value = last in _RB_VALUE
        # After a plain name and a blank, a mark that touches what follows starts an argument.
        tight = not text[m.end() : m.end() + 1].isspace()
        starts = not value or (last in _RB_NAMES and space and tight)
        if m["line"]:
            at = m.end()
            for tag, squiggle, expand in here:
                close = re.compile(rf"^{'[ \t]*' if squiggle else ''}{re.escape(tag)}(?=\r?$)", re.MULTILINE)
                c = close.search(text, at)
                if c is None:
                    raise Broken(at, True)
                if expand:
                    i = at
                    while (i := text.find("#{", i, c.start())) >= 0:
                        i = _ruby(text, i + 2, True)[2]
                at = c.end()
                n = re.compile(r"\r\n|\n|\r").match(text, at)
                at = n.end() if n else at
            here.clear()
            space = line_start = True
            if kinds and last != "NL" and not _RB_CHAIN.match(text, at):
                put("NL", m.start())
            continue
        was_space, space = space, False
        if m["heredoc"] and (not value or (last in _RB_NAMES and was_space)) and last != "class":
            here.append((m["tag"], m["squiggle"], m["hq"] != "'"))
            put("STRING", at)
        elif m["label"] and not text.startswith("defined?(", at) and last not in (".", "&.", "::", "?") and not (value and not was_space) and not (spot and "?" in last):
            put("LABEL", at)
        elif m["number"] is not None:
            if re.compile(r"\w").match(text, m.end()):
                raise Broken(at)
            put("NUMBER", at)
        elif (m["label"] or kind == "name") and (word := re.compile(r"[^\W\d]\w*[?!]?").match(text, at)[0]):
            if word[-1] in "?!" and text[at + len(word) : at + len(word) + 1] == "=" and text[at + len(word) : at + len(word) + 2] not in ("==", "=~", "=>"):
                word = word[:-1]
            if m["label"] and text[at + len(word) : at + len(word) + 1] == ":" and word[-1] in "?":
                word = word[:-1]
            if last in (".", "&.") or last == "def" or (last == "::" and word in RB_WORDS):
                put("FNAME" if last != "def" or word != "self" else "self", at)
            elif word in RB_WORDS:
                modifies = word in ("if", "unless", "while", "until", "rescue") and value
                put(sys.intern(word + "_mod" if modifies else word), at)
            else:
                put("CONST" if word[0].isupper() else "NAME", at)
            at += len(word)
            continue
        elif m["at"] or m["global"]:
            put("VAR", at)
        elif m["symbol"] and (not value or was_space) and not (value and text[m.end() : m.end() + 0]):
            put("SYMBOL", at)
        elif m["symstring"] and not (value and not was_space):
            q = m[0][1]
            put("SYMBOL", at)
            at = _rb_body(text, m.end(), q, expand=q == '"')
            continue
        elif m["string"]:
            if last == "def" and m[0] == "`":
                put("FNAME", at)
                at = m.end()
                continue
            put("STRING", at)
            at = _rb_body(text, m.end(), m[0], expand=m[0] != "'")
            if text.startswith(":", at) and not text.startswith("::", at) and m[0] != "`" and "?" not in kinds[-6:]:
                kinds[-1] = "LABEL"
                at += 1
            continue
        elif m["char"] and not value and last not in (".", "&."):
            put("CHAR", at)
        elif m["mark"] or m["char"] or m["symbol"] or m["heredoc"] or m["symstring"]:
            k = re.compile(_RB_MARKS).match(text, at)
            if k is None:
                raise Broken(at)
            k = k[0]
            if k[0] == "/" and starts and last not in ("def", ".", "&."):
                put("REGEX", at)
                at = _rb_body(text, at + 1, "/")
                f = re.compile(r"[a-z]*").match(text, at)
                at = f.end()
                continue
            if k[0] == "%" and starts and last not in ("def", ".", "&."):
                p = re.compile(r"%([qQwWiIrsx]?)([^\w\s])").match(text, at)
                if p:
                    put("REGEX" if p[1] == "r" else "STRING", at)
                    close = _PAIR.get(p[2], p[2])
                    at = _rb_body(text, p.end(), close, p[2] if close != p[2] else "", p[1] not in ("q", "w", "i", "s"))
                    if p[1] == "r":
                        at = re.compile(r"[a-z]*").match(text, at).end()
                    continue
            if last in ("def", ".", "&.") and k not in ("(", "[", ")", "]", "{", "}", ",", ";", ":", "?", "=", "=>", "->", ".", "..", "...", "&&", "||", "::") or (last in ("def", ".", "&.") and text.startswith("[]", at)):
                op = re.compile(r"\[\]=?|\*\*|<=>|===?|=~|![~=]?|<<|>>|<=?|>=?|[+\-!~]@|[+\-*/%&|^~]").match(text, at)
                if op is None:
                    raise Broken(at)
                put("FNAME", at)
                at = op.end()
                continue
            if k == "[" and (not was_space or last not in _RB_NAMES) and value:
                k = "IDX"
            elif k == "(" and not was_space and last in ("NAME", "CONST", "FNAME", "super", "yield", "defined?", "not"):
                k = "CALL"
            elif k in ("*", "&", "**", "-", "+", "::", "!") and starts and value and k != "!":
                k = "U" + k
            elif k == "{":
                braces += 1
                k = "{" if not value and last not in ("->",) else "BLOCK"
                if last == "LAMBDA_END":
                    k = "BLOCK"
            elif k == "}":
                if not braces and inner:
                    return kinds, at_, at + 1
                braces -= 1
            put(sys.intern(k), at)
            at += 1 if k in ("IDX", "CALL", "BLOCK") else len(k) - (k[0] == "U")
            continue
        else:
            raise Broken(at)
        at = m.end()
    if inner:
        raise Broken(end, True)
    if here:
        raise Broken(end, True)
    return kinds, at_, at


def ruby(text: str) -> tuple[list[str], list[int]]:
    return _ruby(text, 0, False)[:2]
