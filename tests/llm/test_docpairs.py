import ast

import pytest
from helpers import ENTITIES, SOURCES, day, entity, frame
from pyspark.sql import functions as F

from graphloom.llm import docpairs as D

FILES = {
    "py": '''# header {
class A(B):
    """Of the class."""

    @deco(x="def no(")
    async def one(
        self, rows=(1, 2),
    ) -> dict:
        r"""Waits for the peer."""
        s = """
def fake():
"""
        return rows

    def two(self): return 1

# not documentation
def three():
    x = 1
    "late string"

def four():
    'Single.'
''',
    "ts": """import { x } from 'y';

/** Keeps order. */
// eslint-disable-next-line
@dec({ a: 1 })
export async function one<T>(a: { b: string }, c = '{'): Promise<T> {
  call(a);
  const re = /[)}]+/g; const s = `} ${a} {`;
}

export class A {
  /**
   * Reads a row.
   *
   * @param a the row
   */
  private static two(a: string): void {
    if (a) { this.three(); }
  }

  // no
  three() { return 1; }

  /* no */
  four(): { x: number } { return { x: 1 }; }
  /** Gone. */

  five() { }
}
/** Adds. */ const add = (a: number, b: number): number => a + b;
""",
    "rs": """use a::b;

/// Of the struct.
pub struct S<'a> { x: &'a u8 }

impl<'a> S<'a> {
    /// Keeps order
    /// for callers.
    #[inline]
    #[cfg(any(
        a,
    ))]
    pub(crate) fn one(&self, f: Box<dyn Fn(u8) -> u8>) -> char { let c = '{'; let r = r#"} fn no() "#; c }
    // no
    fn two() -> u8 { 1 }
}
/** Block. */
pub unsafe extern "C" fn three() {}
//// no
fn four() {}
/// Stated in a trait.
fn five();
""",
    "rb": """# Of the class.
class A < B
  # Keeps order.
  # rubocop:disable Metrics/MethodLength
  def one(a, b = ')')
    x = <<~T
      def no
    T
    x if a # end
  end

  X = 1 # trailing
  def self.two; 1; end

  # Apart.

  def three?
    puts "end #{x}"
  end

=begin
From a block.
=end
  def four = 1
end
""",
}
WANT = {
    "py": {"one": ("A.one", 6, 13, "Waits for the peer."), "two": ("A.two", 15, 15, None), "three": ("three", 18, 20, None), "four": ("four", 22, 23, "Single.")},
    "ts": {"one": ("one", 6, 9, "Keeps order."), "two": ("A.two", 17, 19, "Reads a row.\n\n@param a the row"), "three": ("A.three", 22, 22, None), "four": ("A.four", 25, 25, None), "five": ("A.five", 28, 28, None), "add": ("add", 30, None, "Adds.")},
    "rs": {"one": ("S.one", 13, 13, "Keeps order\nfor callers."), "two": ("S.two", 15, 15, None), "three": ("three", 18, 18, "Block."), "four": ("four", 20, 20, None), "five": ("five", 22, None, "Stated in a trait.")},
    "rb": {"one": ("A.one", 5, 10, "Keeps order.\nrubocop:disable Metrics/MethodLength"), "two": ("A.two", 13, 13, None), "three?": ("A.three?", 17, 19, None), "four": ("A.four", 24, 24, "From a block.")},
}


@pytest.mark.parametrize("ext", FILES)
@pytest.mark.parametrize("ends", ["\n", "\r\n", "\r"])
def test_functions_of_a_file(ext, ends):
    got = {f[0]: f for f in D.functions(ext, "﻿" + FILES[ext].replace("\n", ends))}
    assert set(got) == set(WANT[ext])
    for name, (qualified, line, last, doc) in WANT[ext].items():
        f = got[name]
        assert (f[1], f[2]) == (qualified, line), f
        assert last is None or f[3] == last, f
        assert (f[6] or "").strip() == (doc or "").strip() and (f[6] is None) == (doc is None), f


@pytest.mark.parametrize(
    "doc",
    ["", " ", "TODO", "TODO: later", "FIXME: docs", "XXX", "TBD.", "n/a", "None.", "...", "—", "*****\n*****", "------", "?", ".\n\n", "See above.", "see {@link Other}", "{@inheritDoc}", "@deprecated", "@internal", "@param rows", "@param rows\n@returns", ":param rows:", "@param {string} rows", "noqa: E501", "eslint-disable-next-line",
     "Auto-generated. Do not edit.", "Generated method stub", "Copyright 2024 X", "Licensed to the X maintainers under the terms in NOTICE.", "Drains the stale cursor.", "drain a stale cursor", "This function drains the stale cursor.", "drainStaleCursor", "drain_stale_cursor()", "Args:\nReturns:", "Draining of stale cursors", "rubocop:disable Metrics"],
)
def test_trivial(doc):
    assert not D.says_more(doc, "drain_stale_cursor") and not D.says_more(doc, "drainStaleCursor")


@pytest.mark.parametrize(
    "doc",
    ["Rounds half to even.", "Todo items older than 9 days are moved aside.", "N.B. the peer may close.", "TODO: tidy up\n\nRounds half to even.", "Drains the cursor until the peer closes.", "@param rows upper bound, inclusive", "@returns the number of rows", "@deprecated use the other one", "空の入力ではエラーを出さず、既定値をそのまま返す。", "None of the callers may hold the lock.",
     "See `x.rb` for how the retry budget is rebuilt.", "Drains the stale cursor.\nKeeps order.", ":param rows: where reading begins", "Returns nothing if the row is missing."],
)
def test_informative(doc):
    assert D.says_more(doc, "drain_stale_cursor")


def test_damaged_files_do_not_break():
    for ext, text in FILES.items():
        for cut in range(0, len(text), 7):
            D.functions(ext, text[:cut])
            D.functions(ext, text[cut:])
        D.functions(ext, "<<<<<<< HEAD\n" + text + "=======\n" + text)


def test_operator(spark):
    s = frame(spark, SOURCES, [{"path": "r\\a.py", "content": FILES["py"]}, {"path": "r/a.py", "content": FILES["py"]}, {"path": "r/b.rb", "content": FILES["rb"]}, {"path": "r/c.py", "content": None}, {"path": None, "content": "def f(): 'x y z'"}])
    rows = [
        entity("method:r/a.py#A.one", name="one", start_line=6), entity("method:r/a.py#A.one", name="one", start_line=6), entity("function:r/a.py#four", name="four", start_line=None), entity("function:r/a.py#three", name="three", start_line=18),
        entity("method:r/b.rb#A.one", name="one", start_line=5), entity("method:r/b.rb#A.four", name="four", start_line=24), entity("method:r/b.rb#A.four", name="four", start_line=24, metadata='{"deleted": true}', updated_at=day(5)),
        entity("class:r/a.py#A", name="A", start_line=2), entity("function:r/none.py#f", name="f", start_line=1),
    ]
    e = frame(spark, ENTITIES, rows).withColumn("code", F.lit("?")).withColumn("symbol", F.lit(1))
    got = {r["uid"]: r for r in D.documented(s, e).collect()}
    assert set(got) == {"method:r/a.py#A.one", "function:r/a.py#four", "method:r/b.rb#A.one"}
    assert got["method:r/a.py#A.one"]["documentation"] == "Waits for the peer." and got["method:r/a.py#A.one"]["code"].rstrip().endswith("return rows")
    assert D.documented(s.limit(0), e).count() == 0 and D.documented(s, e.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("body", "doc"),
    [
        ("'a' 'Joins the pieces'", "aJoins the pieces"), ("('Sums up'\n        ' all rows')", "Sums up all rows"), ("'Reads' \\\n    ' on'  # why", "Reads on"), ("'x'.strip()", None), ("'a' + 'b'", None), ("f'{a}'", None), ("('a', 'b')", None),
        ('r"""Raw d"""', "Raw d"), ("'''a'b''' \"c\"", "a'bc"),
    ],
)
def test_docstrings_of_several_strings(body, doc):
    text = f"def f(a):\n    {body}\n    return 1\n"
    assert ast.get_docstring(ast.parse(text).body[0], clean=False) == doc
    assert D.functions("py", text)[0][6] == doc


def test_fields_that_hold_functions():
    text = "class A {\n  /** Adds one to the total. */\n  private add = async (x: number): Promise<number> => {\n    return x + 1\n  }\n  /** Picks. */\n  static pick = x => x.y\n  count = 3\n}\n"
    got = {f[0]: (f[1], f[6]) for f in D.functions("ts", text)}
    assert got["add"] == ("A.add", "Adds one to the total.") and got["pick"] == ("A.pick", "Picks.") and "count" not in got
