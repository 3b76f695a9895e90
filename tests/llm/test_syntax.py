import ast
import time
import warnings

import pytest
from helpers import ENTITIES, SOURCES, entity, frame
from pyspark.sql import functions as F

from graphloom.llm import syntax
from graphloom.llm.derivative import Grammar

VALID = {
    "python": [
        "", "\ufeffx = 1\n", "# only a comment {", "def f(a, /, b=1, *c, d: int = 2, **e) -> dict[str, int] | None:\n    return [x for x in a if x]\n", "class A(B, metaclass=M):\n    x: int = 1\n\n    async def f(self):\n        async with a as b, c:\n            await d\n",
        "match x:\n    case [1, *rest] if rest:\n        pass\n    case {'a': y, **z} | Point(x=0):\n        pass\n    case _:\n        pass\n", "match = 1\nmatch.x\nprint(match)\n", "type X[T] = list[T]\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise C from e\nelse:\n    pass\nfinally:\n    pass\n",
        "x = f'{a!r:>{w}} {{}} {b[\"k\"]} {c:%Y}'\n", "if (n := 10) > 5: pass\nelif 1: pass\nelse: pass\n", "a, *b = c, d = e\n", "lambda x, *y, z=1: (x, y)\n", "x = a if b else c\nprint(*a, **b, c=d)\n", "with (open(a) as b, open(c) as d):\n    pass\n", "@a.b(c)\ndef f(): ...\n", "x = '''a\n'''\ny = r\"\\\"\n\"\"\"z\"\"\"\n" if False else "x = '''a\n'''\n", "for i, in x: pass\nwhile 0:\n\tpass\n", "x[1:2, ::3, ...] += 1; del x, y\n", "a = 1_000 + 0xFF + 1e-3j\n",
        "assert x, '# no'\nglobal y\n",
    ],
    "typescript": [
        "", "// <<<<<<< HEAD\n", "import a, { b as c } from './d';\nimport * as e from \"f\"\nexport { g } from 'h'\n", "let x = 1\nlet y: Array<Map<string, number>> = []\nconst z = { a, b: 1, ...c, d() {}, get e() { return 1 } } as const", "export async function* f<T extends A>(a?: T[], ...b: number[]): Promise<void> { for await (const x of a) yield x }",
        "abstract class A<T> extends B<T> implements C, D { private readonly x = 1; static #y?: string; constructor(public a: string) { super() } @dec() get z(): number { return this.#y! } [k: string]: any }", "const re = /[)}\\]]+\\/(?:x)/g, s = `a ${b + `${c}`} {`\n", "a?.b?.[c]?.(d) ?? e || f ? g : h", "type A = { [K in keyof B]?: B[K] } | (() => void) | [a: string, b?: number] | `x${string}`\n", "interface A extends B { (x: number): string; new (): A; readonly y?: number }",
        "switch (x) { case 'a': y += 1; break; default: z = 0 }", "try { await f<T>(x)! } catch { } finally { }", "enum E { A = 1, B }\ndeclare module 'x' { }\nnamespace N.M { }", "if (a) b\nelse c\ndo { } while (x)\n", "(async (x: number) => x)(1);\nx => ({})\n", "const f = <T,>(x: T): T => x\n", "label: for (;;) { continue label }", "export default class { }\n", "a = b\n++c\n", "x = y as unknown as Z; return_ = <any>q", "for (const k in o) if (k) break",
    ],
    "rust": [
        "", "#![allow(x)]\nuse a::{b, c::*, d as e};\n", "pub(crate) fn f<'a, T: A + 'a>(x: &'a mut [T], y: impl Fn(u8) -> u8) -> Result<Vec<Vec<u8>>, E> where T: B { x?; Ok(vec![1; 2]) }", "impl<'a> A<'a> for B { const X: u8 = 1; type Y = Z; async fn f(&self) -> Box<dyn Fn(u8) -> u8 + 'static> { let r = r#\"x \" y\"#; self.0.await?; loop { break 1 << 2; } } }",
        "match x { Some(A { b, .. }) | None if c => {} 1..=2 => d, ref e @ (_, _) => return, _ => f!(\"{}\", g) }" if False else "fn f() { match x { Some(A { b, .. }) | None if c => {} 1..=2 => d, ref e @ (_, _) => return, _ => g!(\"{}\", h) } }", "/* a /* b */ } */ struct A<T>(pub T, u8); enum B { C = 1, D { e: u8 }, F(u8) }", "fn f() { while let Some(x) = y.pop() { if x >= 2 { break; } } let Some(z) = w else { return; }; }", "macro_rules! m { ($x:expr) => { $x }; }\n", "fn f() { let c = '{'; let l: &'static str = \"\\\"[\"; let g = |x: u8, y| x + y; g(1, 2).a::<B>().0.1 }",
        "fn f() -> u8 { let a = &b[..]; let c = ..=3; if let A(x) = y && z { 1 } else if q { 2 } else { unsafe { 3 } } }", "extern \"C\" { fn f(x: i32, ...); }\nunsafe impl Send for X {}\n", "trait A: B { fn c(&mut self) -> D; }\nconst _: () = ();\nstatic mut X: u8 = b'a';\n", "#[derive(A)]\npub struct U;\nmod m { pub use super::*; }\n",
    ],
    "ruby": [
        "", "# only end ) {\n", "require 'a'\nclass A < B::C\n  attr_reader :a, :b\n  X = %w[a b (].freeze\n  def self.f(a, b = 1, *c, d:, e: 2, **f, &g) = a\n  private def h? = true\nend\n", "def f(x)\n  return nil if x.empty?\n  x.each do |a, (b, c), *d|\n    next unless a\n    puts \"#{a} end #{b[\"k\"]}\"\n  end\nend\n", "begin\n  f\nrescue A, B => e\n  warn e.message\nelse\n  1\nensure\n  2\nend\n", "x = <<~A + <<-'B'\n  a #{b} end\nA\n  c\n  B\ny = 1\n",
        "case x\nwhen 1, 2 then y += 1\nelse z = 0\nend\n", "case x\nin {a: Integer => b, **nil} if b > 1\n  1\nin [1, *rest]\n  2\nend\n", "a = b ? c : d\ne = f ? :g : h[:i]\nj &&= k || !l\n", "x = y\n  .map { |z| z * 2 }\n  .select(&:even?)\n", "f a, b: 1, 'c' => 2 do |x| end\np(*a, **b, &c)\n", "total += 1 while total < 3\nx = if a then b else c end\n", "rx = /\\(end\\[x/i\ny = a / b\nputs /x/ =~ z\n", "=begin\ndef {\n=end\nx = 1\n__END__\n)))\n", "->(x, y = 1) { x }\nlambda do |x| end\n%i[a b].each { puts _1 }\n", "a, *b = c, d\nalias x y\nundef z\nclass << self\nend\nmodule A::B\nend\n", "h = { a: 1, 'b': 2, \"c\" => 3, d:, **e }\n", "unless x\nelsif_ = 1\nend\n", "raise A, 'x' unless defined?(B) and not c\n", "until x do y end\nfor i in 1..2 do\nend\n",
    ],
}
BROKEN = {
    "python": ["def f(:\n", "x = [1, 2\n", "print 'x'\n", "if x\n    y\n", "  x = 1\n", "x = 'a\n", '"""abc', "f'{a'\n", "f'}'\n", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n", "class A:\n", "def f():\n    x\n  y\n", "import {a} from 'b';\n", "x = 1a\n", "x = 007\n", "for x y:\n    pass\n", "try:\n    x\n", "x = (]\n", "a b\n", "\ufffd\n", "else:\n    x\n", "return return\n", "diff --git a/x b/x\n"],
    "typescript": ["let x = \n", "class A {", "function f( {", "const s = 'a\n'", "`abc ${x", "def f(a):\n    return 1\n", "let let_ let\n", "import { a from 'b'", "/* open", "x = {a: 1;}", "<<<<<<< HEAD\nlet a\n=======\n", "if (x) { } else", "use std::collections::HashMap;", "require 'set'\n", "<!DOCTYPE html>\n<html></html>", "a b c", "const x: = 1", "export", "return )", "}\n"],
    "rust": ["fn f( {", "fn f() { let x = }", "struct A {", "\"abc", "/* /* */", "fn f() { a b }", "import x from 'y';", "def f():\n  pass\n", "fn f() -> { }", "impl A { fn }", "use a::{b;", "let x = 1;", "fn f() { match x { 1 => } }", "fn f() { 'ab }", "<<<<<<< ours\nfn f() {}\n", "pub fn"],
    "ruby": ["def f\n", "end\n", "class a\nend\n" if False else "class A\n  def f\n  end\n", "x = [1, 2\n", "puts \"a #{b\"\n", "if x\n  y\n", "f do |x|\n", "x = <<~A\nb\n", "=begin\nx\n", "def f(a):\n    pass\n", "import { a } from 'b';\n", "use a::{b, c};\n", "<<<<<<< HEAD\nx\n=======\n", "{ |x| }\n", "case x\nwhen 1\n", "x = 1 +\n", ")\n", "<!DOCTYPE html>\n", "foo(1, 2\n", "begin\nrescue\n"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in VALID.items() for t in v])
def test_valid(language, text):
    assert syntax.failure(language, text) is None


MORE = {
    "ruby": ["f.(1)\n", "a&.(b, c: 1) { |x| x }\n", "f.() + g\n"],
    "rust": ["union U { a: i32 }", "pub union U<T> where T: Copy { a: T, b: u8 }", "fn f() { let union = 1; union.x(); g(union) }", "fn union(a: u8) {}"],
    "typescript": ["type A<T> = T extends infer U extends string ? U : never\n", "type A<T> = T extends (infer U extends string) ? U : never\n", "type A<T> = T extends [infer H, ...infer R] ? R : never\n"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in MORE.items() for t in v])
def test_valid_constructs(language, text):
    assert syntax.failure(language, text) is None


DEEP = {
    "rust": [("fn f() " + "{" * 8000 + "}" * 8000), ("fn f() { x(" + "(" * 8000 + "1" + ")" * 8000 + ") }")],
    "typescript": ["{" * 8000 + "}" * 8000, "x = " + "[" * 8000 + "]" * 8000, "if (a) " * 3000 + ";", "x = " + "(" * 3000 + "1" + ")" * 3000],
    "ruby": ["x = " + "[" * 8000 + "]" * 8000 + "\n", "if a\n" * 4000 + "end\n" * 4000, "x = " + "(" * 4000 + "1" + ")" * 4000 + "\n"],
    "python": ["x = " + "[" * 190 + "]" * 190 + "\n", "x = " + "-" * 5000 + "1\n"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in DEEP.items() for t in v])
def test_depth_costs_neither_stack_nor_square_time(language, text):
    began = time.process_time()
    assert syntax.failure(language, text) is None
    assert syntax.failure(language, text[:-2].rstrip(";")) is not None or language == "typescript"
    assert time.process_time() - began < 4


def test_memo_is_bounded_within_a_file(monkeypatch):
    monkeypatch.setattr(Grammar, "MOST", 3000)
    body = "fn f(a: u8) -> u8 { match a { 1 => { g(a, [b; 2])?; 3 } _ => { if x { y } else { z }; 4 } } }\n" * 50
    g = Grammar(syntax.grammars.RUST, "file")
    kinds, at = syntax.lexers.rust(body)
    assert g.parse(kinds) is None and g.parse([*kinds, "}"]) == len(kinds) and len(g._made) <= 3500


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in BROKEN.items() for t in v])
def test_broken(language, text):
    assert syntax.failure(language, text) is not None


@pytest.mark.parametrize("language", ["python", "typescript", "rust", "ruby"])
def test_truncation_is_told_from_a_wrong_token(language):
    text = {"python": "x = (1,\n", "typescript": "class A {\n", "rust": "fn f() {\n", "ruby": "def f\n  x\n"}[language]
    assert syntax.failure(language, text)[0] == "truncated"
    kind, at = syntax.failure(language, text + ("]" if language != "ruby" else ")"))
    assert kind == "token" and at == len(text)


def test_python_agrees_with_the_standard_parser_on_its_own_sources():
    import graphloom.llm.lexers as a
    import graphloom.operators.hierarchy as b

    for m in (a, b, ast, warnings):
        body = open(m.__file__).read()
        assert syntax.failure("python", body) is None
        for cut in range(100, len(body), max(1, len(body) // 60)):
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                try:
                    ast.parse(body[:cut])
                    ok = True
                except (SyntaxError, ValueError):
                    ok = False
            assert (syntax.failure("python", body[:cut]) is None) == ok, body[cut - 80 : cut]


def test_derivatives_are_shared_and_bounded():
    g = Grammar("s = 'a' s 'b' | ;", "s")
    assert g.parse(list("aaabbb")) is None and g.parse(list("aab")) == 3 and g.parse(list("abb")) == 2 and g.parse([]) is None
    before = len(g._made)
    assert g.parse(list("aaabbb")) is None and len(g._made) == before
    g.MOST = 1
    assert g.parse(list("ab")) is None and len(g._made) <= before and g.parse(list("aabb")) is None


def test_operator(spark):
    rows = [
        {"path": "./r/a.py", "repo": "r", "content": "x = (\n"}, {"path": "r\\a.py", "repo": "r", "content": "x = (\n"}, {"path": "r/b.py", "repo": "r", "content": None}, {"path": "r/c.py", "repo": "r", "content": ""},
        {"path": "r/d.rb", "repo": "r", "content": "def f\nend\n"}, {"path": "r/e.md", "repo": "r", "content": "("}, {"path": None, "content": "("}, {"path": "s/f.ts", "repo": None, "content": "let x = " + "(" * 3000},
        {"path": "s/g.py", "repo": "s", "content": "x = 1\n" * 20_000},
    ]
    s = frame(spark, SOURCES, rows).withColumn("ext", F.lit("zz")).withColumn("failure", F.lit(1))
    got = {(r["path"], r["failure"], r["line"]) for r in syntax.unparsable(s).collect()}
    assert got == {("r/a.py", "truncated", 2), ("s/f.ts", "truncated", 1)}
    e = frame(spark, ENTITIES, [entity("file:r/a.py", language="Python", confidence=0.4), entity("file:r/b.py", language="python")])
    rates = {(r["repo"], r["language"]): (r["n_files"], r["n_failed"], r["hint"]) for r in syntax.rates(s, e).collect()}
    assert rates["r", "python"] == (3, 1, 0.4) and rates[None, "typescript"] == (1, 1, None) and rates["r", "ruby"] == (1, 0, None)
    assert syntax.unparsable(s.limit(0)).count() == 0
