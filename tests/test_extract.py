import pytest

from graphloom.api import Config, Workspace, dispatch
from graphloom.sources import extract as X
from graphloom.sources import tree


def parts(found):
    e = {(r[3], r[2].split("#")[-1], r[6]) for r in found.rows if r[0] == "entity" and r[3] != "file"}
    r = {(x[3], x[8], x[9], x[10]) for x in found.rows if x[0] == "relation" and x[3] != "contains"}
    return e, r, {x[4] for x in found.rows if x[0] == "unresolved"}


def test_python():
    e, r, u = parts(X.python("app/auth.py", "import os\nfrom .crypto import h\n\nclass A(B):\n    def m(self):\n        helper()\n\ndef helper(): pass\ndef test_x(): helper()\n"))
    assert e == {("class", "A", 4), ("method", "A.m", 5), ("function", "helper", 8), ("test", "test_x", 9)}
    assert ("imports", "file:app/auth.py", "file:app/crypto.py", 0.9) in r and ("extends", "class:app/auth.py#A", "class:app/auth.py#B", 0.86) in r
    assert ("calls", "method:app/auth.py#A.m", "function:app/auth.py#helper", 0.68) in r and u == {"os"}
    broken = X.python("a.py", "class A:\n    def m(self):\n\ndef f(x:\n")
    assert broken.source == "regex" and {(k, s) for k, s, _ in parts(broken)[0]} == {("class", "A"), ("method", "A.m"), ("function", "f")}


def test_typescript():
    e, r, u = parts(X.typescript("src/a.ts", "import { x } from './b';\nimport y from 'lib';\nexport class A extends B implements C, D {\n  private m(a: string): void {\n    helper(a);\n  }\n}\nexport function helper(q) {\n  return x;\n}\nexport const z = 1;\ninterface I {}\n"))
    assert e == {("class", "A", 3), ("method", "A.m", 4), ("function", "helper", 8), ("constant", "z", 11), ("interface", "I", 12)}
    assert ("imports", "file:src/a.ts", "file:src/b.ts", 0.92) in r and ("calls", "method:src/a.ts#A.m", "function:src/a.ts#helper", 0.68) in r and ("exports", "file:src/a.ts", "constant:src/a.ts#z", 0.98) in r
    assert {x[2] for x in r if x[0] == "implements"} == {"interface:src/a.ts#C", "interface:src/a.ts#D"} and u == {"lib"}


def test_rust():
    e, r, u = parts(X.rust("src/lib.rs", "use std::{fmt, io::{self, Read}};\nuse crate::a::b;\nmod m;\npub struct S;\nimpl Display for S {\n    pub fn f(&self) { g(1) }\n}\nfn g(x: u8) {}\n#[test]\nfn t() { g(1); }\n"))
    assert {("class", "S", 4), ("method", "S.f", 6), ("function", "g", 8), ("test", "t", 10), ("module", "m", 3)} == e
    assert ("implements", "class:src/lib.rs#S", "interface:src/lib.rs#Display", 0.86) in r and u == {"std::fmt", "std::io", "std::io::Read"}
    assert X.expand_uses("a::{b, c::{d, self}, e as f}") == ["a::b", "a::c::d", "a::c", "a::e"]
    cargo = parts(X.cargo("Cargo.toml", '[package]\nname = "p"\n[workspace]\nmembers = ["x"]\n[dependencies]\nserde = "1"\n'))
    assert cargo[2] == {"serde"} and ("module", "p", 1) in cargo[0]


def test_ruby():
    e, r, u = parts(X.ruby("app/models/user.rb", "require 'set'\nrequire_relative 'base'\nclass User < ApplicationRecord\n  has_many :companies\n  belongs_to :team\n  def full_name\n    format_name(1)\n  end\n  def format_name(x) = x\nend\n"))
    assert {("class", "User", 3), ("method", "User.full_name", 6), ("method", "User.format_name", 9)} == e
    assert ("depends_on", "class:app/models/user.rb#User", "file:app/models/company.rb", 0.7) in r and ("imports", "file:app/models/user.rb", "file:app/models/base.rb", 0.9) in r and u == {"set"}
    routes = parts(X.ruby("config/routes.rb", "get '/login', to: 'sessions#new'\nresources :users\n"))
    assert ("routes_to", "route:config/routes.rb#GET /login", "method:app/controllers/sessions_controller.rb#SessionsController.new", 0.78) in routes[1]
    assert X.rails_path("Admin::UsersController") == "app/controllers/admin/users_controller.rb" and X.rails_path("String") is None
    assert [X.implementation_of(p) for p in ("spec/models/user_spec.rb", "spec/lib/a/b_spec.rb", "test/c_test.rb", "src/d.test.ts", "src/d.ts")] == ["app/models/user.rb", "lib/a/b.rb", "lib/c.rb", "src/d.ts", None]
    assert parts(X.bundler("Gemfile", "gem 'rails'\ngem \"pg\"\ngem 'rails'\n"))[2] == {"rails", "pg"}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for p, body in {"src/a.ts": "import { f } from './b';\nexport function g() { f(); }\n", "src/b/index.ts": "// @uid func-1234abcd\nexport function f() {}\n", "app/c.py": "from .d import x\ndef y(): x()\n", "app/d.py": "def x(): pass\n"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(body)
    return str(root)


def test_index_resolves_imports_and_markers(spark, project):
    w = Workspace(spark, project)
    found = w.index(project).cache()
    assert {(r["path"], r["to_uid"]) for r in found.where("kind = 'imports'").collect()} == {("src/a.ts", "file:src/b/index.ts"), ("app/c.py", "file:app/d.py")}
    files, _ = tree.scan(spark, project)
    marks = X.markers(files)
    assert [tuple(m) for m in marks.collect()] == [("src/b/index.ts", 1, "func-1234abcd")]
    e = found.where("record = 'entity'").withColumnRenamed("line", "start_line")
    assert [tuple(m) for m in X.apply_markers(marks, e).collect()] == [("function:src/b/index.ts#f", "func-1234abcd")]


def test_tools_and_config(spark, tmp_path):
    from helpers import ENTITIES, RELATIONS, edge, entity, frame

    frame(spark, ENTITIES, [entity("file:a.py"), entity("function:a.py#f", description="parses rows")]).write.parquet(str(tmp_path / "entities.parquet"))
    frame(spark, RELATIONS, [edge("file:a.py", "function:a.py#f", "exports")]).write.parquet(str(tmp_path / "relations.parquet"))
    w = Workspace(spark, str(tmp_path))
    assert dispatch(w, "get_entity", {"uid": "a.py"})["rows"][0]["uid"] == "file:a.py"
    assert dispatch(w, "search", {"query": "parses"})["rows"][0]["uid"] == "function:a.py#f"
    assert dispatch(w, "explain_path", {"from": "a.py", "to": "function:a.py#f"}) == {"nodes": ["file:a.py", "function:a.py#f"], "found": True}
    assert dispatch(w, "impact", {"uid": "function:a.py#f"})["rows"][0]["direct"] == 1
    assert len(dispatch(w, "get_neighbors", {"uid": "a.py"})["entities"]) == 2 and "error" in dispatch(w, "none", {})
    c = Config(max_kb=7)
    c.save(str(tmp_path / "c.json"))
    assert Config.load(str(tmp_path / "c.json")) == c and Config.load("/none") == Config()
