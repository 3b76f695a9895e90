import pytest

from graphloom.session import shared_path
from graphloom.sources import indexer


def tree(spark, **files):
    return spark.createDataFrame([(p.replace("__", "/").replace("_py", ".py"), t) for p, t in files.items()], "path string, content string")


def counts(r):
    return r.total, r.indexed, r.cached, r.resumed, r.skipped, r.deleted, r.renamed


def test_runs_read_only_what_changed(spark):
    index = indexer.Indexer(spark, shared_path(spark, "index"))
    one = {"a_py": "def f():\n    pass\n", "b_py": "x = 1\n", "c_py": "def g(): ...\n", "notes": "text"}
    assert counts(index.run(tree(spark, **one))) == (4, 3, 0, 0, 1, 0, 0)
    assert counts(index.run(tree(spark, **one))) == (4, 0, 3, 0, 1, 0, 0)
    two = {"a_py": "def h():\n    pass\n", "d__c_py": "def g(): ...\n", "notes": "text"}
    assert counts(index.run(tree(spark, **two))) == (3, 2, 0, 0, 1, 1, 1)
    got = {r["uid"] for r in index.records().where("record = 'entity'").collect()}
    assert got == {"file:a.py", "function:a.py#h", "file:d/c.py", "function:d/c.py#g"}
    assert [r.status for r in index.log()] == ["completed"] * 3
    assert counts(index.run(spark.createDataFrame([], "path string, content string"))) == (0, 0, 0, 0, 0, 3, 0)
    assert index.records().count() == 0


def test_a_run_that_died_is_taken_up(spark, monkeypatch):
    index = indexer.Indexer(spark, shared_path(spark, "index"), batch_files=2)
    files = {f"f{i}_py": f"def f{i}(): ...\n" for i in range(6)}
    real, left = indexer.Indexer._extract, [2]

    def fails(self, *a):
        if not left[0]:
            raise OSError("lost")
        left[0] -= 1
        real(self, *a)

    monkeypatch.setattr(indexer.Indexer, "_extract", fails)
    with pytest.raises(OSError):
        index.run(tree(spark, **files))
    assert index.log() == [] and index.records().count() == 0
    monkeypatch.setattr(indexer.Indexer, "_extract", real)
    run = index.run(tree(spark, **files))
    assert run.indexed == 6 and 0 < run.resumed < 6
    assert index.records().where("kind = 'function'").count() == 6


def test_only_one_of_two_runs_is_committed(spark):
    from graphloom.session import commit_file

    root = shared_path(spark, "index")
    commit_file(spark, f"{root}/runs/x.json", "{}")
    with pytest.raises(FileExistsError):
        commit_file(spark, f"{root}/runs/x.json", "{}")
