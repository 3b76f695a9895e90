import subprocess

from graphloom.sources import sinks, tree
from graphloom.session import shared_path
from graphloom.streaming import watch


def test_scan_ignores_caps_and_classifies(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("# no\n*.log\n/out\nsecret/\n")
    for p, body in {"src/a.py": b"x = 1\n", "a.log": b"x", "out/b.py": b"y", "secret/c.py": b"z", "bin.py": b"a\0b", "bad.rb": b"\xc3\x28", "big.ts": b"x" * 3000}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(body)
    good, skipped = tree.scan(spark, str(tmp_path), max_kb=2)
    assert {(r["path"], r["language"]) for r in good.collect()} == {("src/a.py", "python")}  # hidden files are not listed
    assert {(r["path"], r["reason"]) for r in skipped.collect()} == {("bin.py", "binary"), ("bad.rb", "invalidUtf8"), ("big.ts", "tooLarge")}


def test_changes_of_a_repository(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("one\n" * 20)
    (tmp_path / "b.py").write_text("two\n")
    run("add", ".")
    run("commit", "-qm", "x")
    run("mv", "a.py", "c.py")
    (tmp_path / "b.py").write_text("three\n")
    got = {(r["status"], r["path"], r["old_path"]) for r in tree.git_changes(spark, str(tmp_path)).collect()}
    assert got == {("R", "c.py", "a.py"), ("M", "b.py", None)}
    assert {r["path"] for r in tree.git_listing(spark, str(tmp_path)).collect()} == {"b.py", "c.py"}
    assert tree.git_changes(spark, "/").count() == 0 and tree.git_changes(spark, str(tmp_path), "--help").count() == 0


def test_jsonl_round_trip(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "uid string, n long")
    root = shared_path(spark, "jsonl")
    assert sinks.write_jsonl(root, {"t": df}).first()["rows"] == 3
    assert sorted(tuple(r) for r in sinks.read_jsonl(spark, root, {"t": "uid string, n long"})["t"].collect()) == [("a", 1), ("b", 2)]


def test_watcher_sees_edits_and_deletions(spark):
    states = iter([[("a", "1"), ("b", "1")], [("a", "2"), ("c", "1")]])
    seen = {}
    w = watch.Watcher(spark, shared_path(spark, "watch"), lambda: spark.createDataFrame(next(states), "path string, state string"), lambda df, n: seen.__setitem__(n, {(r["path"], r["change"]) for r in df.collect()}))
    w.tick()
    w.tick()
    assert seen == {0: {("a", "added"), ("b", "added")}, 1: {("a", "changed"), ("b", "removed"), ("c", "added")}}
