import pytest
from helpers import FILES, RUNS, day, frame
from pyspark.sql import functions as F

from graphloom.operators import incremental
from graphloom.operators.incremental import ChangeFeed
from graphloom.session import shared_path


def log(spark, states):
    return frame(spark, RUNS, [{"run_id": i, "status": s} for i, s in states.items()])


def obs(path, h, d, run):
    return {"path": path, "content_hash": h, "indexed_at": day(d), "run_id": run}


ROWS = [
    obs("a", "AA", 1, 1), obs("a", "aa", 1, 1), obs("./b", "bb", 1, 1),
    obs("a", "a2", 2, 2),  # delivered by a failed run: counts from run 3 on
    obs("b", "BB", 3, 3), obs("c", "cc", 3, 3),
    obs("a", "old", 1, 4), obs("c", "c2", 4, 4), obs(None, "x", 4, 4), obs("d", None, 4, 4),
    obs("c", "cc", 5, 5), obs("e", "ee", 6, 6),
]
STATUS = {1: "completed", 2: "failed", 3: "completed", 4: "completed", 5: "completed", 6: "running"}
WANT = [("a", 1, "aa"), ("a", 3, "a2"), ("b", 1, "bb"), ("c", 3, "cc"), ("c", 4, "c2"), ("c", 5, "cc")]


def changes(feed):
    return sorted((r["path"], r["run_id"], r["content_hash"]) for r in feed.changes().collect())


@pytest.mark.parametrize("stops", [[None], [1, 3, None], [2, 4, 5, None]])
def test_any_batching_gives_the_same_changes(spark, stops):
    feed = ChangeFeed(spark, shared_path(spark, "feed"))
    for s in stops:
        feed.advance(frame(spark, FILES, ROWS), log(spark, STATUS), upper=s)
    assert changes(feed) == WANT
    assert feed.watermark() == 5
    assert feed.advance(frame(spark, FILES, ROWS), log(spark, STATUS)) is None
    assert {r["path"]: r["state"]["hash"] for r in feed.state().collect()} == {"a": "a2", "b": "bb", "c": "cc"}


def test_a_failed_commit_leaves_nothing(spark, monkeypatch):
    feed = ChangeFeed(spark, shared_path(spark, "feed"))
    feed.advance(frame(spark, FILES, ROWS), log(spark, STATUS), upper=1)
    with monkeypatch.context() as m:
        m.setattr(ChangeFeed, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            feed.advance(frame(spark, FILES, ROWS), log(spark, STATUS))
    assert feed.watermark() == 1 and len(changes(feed)) == 2
    feed.advance(frame(spark, FILES, ROWS), log(spark, STATUS))
    assert changes(feed) == WANT


def test_two_writers_cannot_both_commit(spark):
    root = shared_path(spark, "feed")
    one, two = ChangeFeed(spark, root), ChangeFeed(spark, root)
    first = one.advance(frame(spark, FILES, ROWS), log(spark, STATUS))
    with pytest.raises(RuntimeError):
        two._commit(first)
    assert changes(two) == WANT


def test_empty_tables_and_extra_columns(spark):
    feed = ChangeFeed(spark, shared_path(spark, "feed"))
    assert feed.advance(frame(spark, FILES, ROWS), log(spark, {})) is None
    assert changes(feed) == [] and feed.state().count() == 0
    feed.advance(frame(spark, FILES, []), log(spark, {1: "completed"}))
    assert changes(feed) == [] and feed.watermark() == 1
    more = frame(spark, FILES, ROWS).withColumn("state", F.lit("x")).withColumn("epoch", F.lit(3))
    feed.advance(more, log(spark, STATUS).withColumn("path", F.lit("p")))
    assert [c for c in changes(feed) if c[0] == "c"] == [c for c in WANT if c[0] == "c"]


def times(spark, rows):
    return frame(spark, RUNS, [{"run_id": i, "status": s, "started_at": at} for i, s, at in rows])


def test_an_open_run_holds_the_limit_and_is_not_skipped(spark):
    feed = ChangeFeed(spark, shared_path(spark, "feed"))
    t = day(9)
    files = [obs("a", "a1", 1, 4), obs("a", "a2", 3, 6)]
    feed.advance(frame(spark, FILES, files), times(spark, [(4, "completed", t), (5, "running", t), (6, "completed", t)]))
    assert feed.watermark() == 4 and changes(feed) == [("a", 4, "a1")]
    files += [obs("a", "a15", 2, 5), obs("b", "b1", 2, 5)]  # delivered after run 6 had ended
    feed.advance(frame(spark, FILES, files), times(spark, [(4, "completed", t), (5, "completed", t), (6, "completed", t)]))
    assert changes(feed) == [("a", 4, "a1"), ("a", 5, "a15"), ("a", 6, "a2"), ("b", 5, "b1")]


def test_an_abandoned_run_is_read_again(spark):
    feed = ChangeFeed(spark, shared_path(spark, "feed"))
    files = [obs("a", "a1", 1, 4), obs("b", "b0", 1, 5)]
    entries = [(4, "completed", day(7)), (5, "running", day(8)), (6, "completed", day(9))]
    feed.advance(frame(spark, FILES, files), times(spark, entries))
    assert feed.watermark() == 6 and feed.commits()[-1].late == [5] and changes(feed) == [("a", 4, "a1"), ("b", 6, "b0")]
    files += [obs("c", "c1", 2, 5), obs("a", "a7", 3, 7)]
    entries = [*entries[:1], (5, "failed", day(8)), entries[2], (7, "completed", day(10))]
    feed.advance(frame(spark, FILES, files), times(spark, entries))
    assert changes(feed) == [("a", 4, "a1"), ("a", 7, "a7"), ("b", 6, "b0"), ("c", 7, "c1")] and feed.commits()[-1].late == []


def test_state_is_compacted(spark, monkeypatch):
    monkeypatch.setattr(incremental, "COMPACT", 2)
    feed = ChangeFeed(spark, shared_path(spark, "feed"))
    for s in (1, 3, 4, 5):
        feed.advance(frame(spark, FILES, ROWS), log(spark, STATUS), upper=s)
    assert [c.whole for c in feed.commits()] == [False, True, False, True] and changes(feed) == WANT
    assert {r["path"]: r["state"]["hash"] for r in feed.state().collect()} == {"a": "a2", "b": "bb", "c": "cc"}
