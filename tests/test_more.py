from graphloom.plans.more import byte_chunks, recall_at_k


def test_chunks_hold_their_budget(spark):
    df = spark.createDataFrame([(f"p{i:02}", s) for i, s in enumerate([5, 5, 5, 30, 1, 9, 1])] + [("q", None)], "path string, size_bytes long")
    got = [(r["n_files"], r["bytes"]) for r in byte_chunks(df, 10, 1).orderBy("part", "chunk").collect()]
    assert got == [(2, 10), (1, 5), (1, 30), (2, 10), (1, 1)]
    assert sum(r["n_files"] for r in byte_chunks(df, 10, 3).collect()) == 7
    assert byte_chunks(df.limit(0), 10).count() == 0


def test_recall(spark):
    golden = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("c", "w")], "query string, expected string")
    results = spark.createDataFrame([("a", "y", 2), ("b", "z", 6), ("c", "v", 1)], "query string, item string, rank int")
    assert recall_at_k(results, golden, 5).first()["recall"] == round(1 / 3, 6)
