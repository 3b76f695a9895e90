from helpers import ENTITIES, RELATIONS, UNRESOLVED, day, edge, entity, frame
from pyspark.sql import functions as F

from graphloom.operators import refcheck


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_missing_deleted_and_respelled_keys(spark):
    e = frame(spark, ENTITIES, [entity("file:a/b.py"), entity("file:gone.py"), entity("file:gone.py", metadata='{"deleted": true}', updated_at=day(9)), entity("file:back.py", metadata='{"deleted":true}'), entity("file:back.py", updated_at=day(3))])
    r = frame(
        spark,
        RELATIONS,
        [
            edge("file:.\\a\\b.py", "file:gone.py", "calls", id=1),
            edge("file:a/b.py", "file:A/b.py", "calls", id=2),
            edge("file:./a/b.py", "file:back.py", "calls", id=3),
            edge(None, "file:nowhere.py", "calls", id=4),
            edge(None, "file:nowhere.py", "calls", id=4),
        ],
    )
    assert rows(refcheck.orphan_endpoints(r, e)) == [(1, "to"), (2, "to"), (4, "to")]


def test_symbols_keep_backslashes_and_case(spark):
    from graphloom.functions.keys import normalize_uid

    df = spark.createDataFrame([("function:.\\a\\b.py#x\\y",), ("func-12345678",), ("file:././a",), ("./p#q",), (None,)], "u string")
    assert [r[0] for r in df.select(normalize_uid(F.col("u"))).collect()] == ["function:a/b.py#x\\y", "func-12345678", "file:./a", "p#q", None]


def test_empty_sides(spark):
    e, none = frame(spark, ENTITIES, [entity("file:a")]), frame(spark, ENTITIES, [])
    r = frame(spark, RELATIONS, [edge("file:a", "file:a", "calls", id=7)])
    assert rows(refcheck.orphan_endpoints(r, none)) == [(7, "from"), (7, "to")]
    assert rows(refcheck.orphan_endpoints(frame(spark, RELATIONS, []), e)) == []


def test_integer_runs(spark):
    parents = spark.createDataFrame([(i,) for i in (-3, -2, 1, 2, 3, 7, 8, 2**20 - 1, 2**20)], "code long")
    runs = refcheck.compress_runs(parents, 20)
    assert rows(runs.select("run_start", "run_end")) == [(-3, -2), (1, 3), (7, 8), (2**20 - 1, 2**20 - 1), (2**20, 2**20)]
    refs = spark.createDataFrame([(i,) for i in (-9, -3, 0, 2, 4, 8, 9, 2**20, 2**20 + 1, 2**20 + 1)] + [(None,)], "code long")
    assert rows(refcheck.orphan_codes(refs, parents)) == [(-9,), (0,), (4,), (9,), (2**20 + 1,)]


def test_codes_shared_by_chance_decide_nothing(spark):
    few = lambda key: F.length(key).cast("long")
    parents = spark.createDataFrame([("a",), ("bb",), ("cc",), ("dddd",), ("dddd",)], "key string")
    refs = spark.createDataFrame([("b",), ("bb",), ("cc",), ("xx",), ("ddd",), ("dddd",), ("",), ("eeeee",), (None,), ("b",)], "key string")
    want = [("",), ("b",), ("ddd",), ("eeeee",), ("xx",)]
    for bits in (0, 1, 46):
        assert rows(refcheck.orphan_keys(refs, parents, code=few, block_bits=bits)) == want
    runs = refcheck.compress_runs(parents.distinct().withColumn("code", few("key")), 46)
    assert [(x["run_start"], x["run_end"], len(x["entries"])) for x in runs.orderBy("run_start").collect()] == [(1, 2, 3), (4, 4, 1)]


def test_hot_key_and_report(spark):
    e = frame(spark, ENTITIES, [entity("file:a"), entity("file:late", created_at=day(20)), entity("file:dead", metadata='{"deleted": true}')])
    r = frame(spark, RELATIONS, [edge("file:a", "file:hot", "calls", id=i) for i in range(300)] + [edge("file:a", "file:late", "uses", id=900), edge("file:a", "file:dead", "uses", id=901)])
    u = frame(spark, UNRESOLVED, [{"path": "a", "from_uid": "file:zz", "symbol": "s", "kind": "call", "created_at": day(2)}, {"path": "a", "symbol": "s", "kind": "call"}])
    got = {(x["table_name"], x["endpoint"], x["month"]): x for x in refcheck.orphan_report(r, u, e).collect()}
    to = got["relations", "to", "2025-01"]
    assert (to["references"], to["orphans"], to["missing"], to["deleted"], to["late"]) == (302, 301, 300, 1, 1)
    assert got["unresolved", "from", "2025-01"]["orphans"] == 1
    assert got["relations", "from", "2025-01"]["orphans"] == 0


def test_extra_columns_with_clashing_names(spark):
    e = frame(spark, ENTITIES, [entity("file:a")]).withColumn("key", F.lit(1)).withColumn("code", F.lit("x")).withColumn("is_parent", F.lit(2))
    r = frame(spark, RELATIONS, [edge("file:a", "file:b", "calls", id=5)]).withColumn("key", F.lit(1)).withColumn("endpoint", F.lit("?"))
    assert rows(refcheck.orphan_endpoints(r, e)) == [(5, "to")]
