"""BM25 over texts and over an index's postings, and what searches write."""

from pyspark.sql import functions as F

from redliner.operators import retrieval


def _odd(spark):
    rows = [(1, "The fee is due the day after"), (2, None), (3, " \t "), (4, "fee fee fee FEE"), (5, "a\x1cb fee"), (6, "x" * 50), (7, "the the term"), (7, "fee of the term"), (None, "term"), (9, "Term ends\x85the day")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "the fee"), (2, "day TERM day"), (3, "nowhere"), (4, "  "), (5, "a\x1cb")], "query_id int, query string")
    return docs, asked


def test_searches_over_texts_and_postings_agree(spark):
    docs, asked = _odd(spark)
    known = retrieval.bm25_statistics(docs, "doc_id")
    for k in (1, 3, 20):
        one = sorted(map(str, retrieval.bm25_topk(docs, asked, "doc_id", k).collect()))
        two = sorted(map(str, retrieval.bm25_topk(docs, asked, "doc_id", k, statistics=known).select("query_id", "id", "score", "rank").collect()))
        assert one == two and one
    assert retrieval.bm25_topk(docs.where("false"), asked, "doc_id", 3).collect() == []
    assert retrieval.bm25_topk(docs, asked.where("false"), "doc_id", 3).collect() == []


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_search_writes_no_postings(spark):
    docs, asked = _odd(spark)
    assert "explode(" not in _plan(retrieval.bm25_topk(docs, asked, "doc_id", 3))


def test_hybrid_search_writes_no_postings(spark):
    docs, asked = _odd(spark)
    vectors = docs.where("doc_id is not null").withColumn("embedding", F.array(F.col("doc_id").cast("double"), F.lit(1.0)))
    found = retrieval.hybrid_search(vectors, asked.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0))), "doc_id", 3)
    assert "explode(" not in _plan(found) and {r["query_id"] for r in found.collect()} == {1, 2, 3, 5}


def test_a_task_hands_on_its_best_rows_only(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SCORED", 7)
    docs = spark.range(100).selectExpr("case when id = 50 then null else 99 - id end as doc_id", "concat('fee ', case when id % 9 = 0 then 'term' else 'x' end, repeat(' y', cast(id % 4 as int))) as text", "array(cast(id % 5 as double), 1D) as embedding").coalesce(1)
    asked = spark.createDataFrame([(1, "term fee", [1.0, 0.5]), (2, "x y", [-1.0, 2.0]), (3, "nowhere", [0.0, 0.0])], "query_id int, query string, vector array<double>")
    known = retrieval.bm25_statistics(docs, "doc_id")
    made = {}
    for name, found in (("words", retrieval.bm25_topk(docs, asked, "doc_id", 4)), ("vectors", retrieval.vector_topk(docs, asked, 4, "doc_id"))):
        node = found._jdf.queryExecution().executedPlan()
        made[name] = [tuple(r) for r in found.select("query_id", "id", "score", "rank").orderBy("query_id", "rank").collect()]
        assert len(made[name]) == 12 and node is not None
    want = retrieval.bm25_topk(docs, asked, "doc_id", 4, statistics=known).select("query_id", "id", "score", "rank").orderBy("query_id", "rank")
    assert made["words"] == [tuple(r) for r in want.collect()]
    rows = [(r["doc_id"], r["embedding"]) for r in docs.collect()]
    for q, vector in ((r["query_id"], r["vector"]) for r in asked.collect()):
        best = sorted(((-sum(a * b for a, b in zip(v, vector)), i is not None, i) for i, v in rows), key=lambda x: x[:2] + (x[2] or 0,))[:4]
        assert [r[1] for r in made["vectors"] if r[0] == q] == [x[2] for x in best]


def test_rows_handed_on_do_not_grow_with_batches():
    import numpy as np
    import pyarrow as pa

    best = retrieval._Best(3)
    best.kind = pa.int64()
    for i in range(20):
        best.add(list(range(10 * i, 10 * i + 10)), np.ones((5, 10)))
    rows = [r for b in best.rows(list("abcde"), pa.string()) for r in b.to_pylist()]
    assert len(rows) == 15 and {r["id"] for r in rows} == {0, 1, 2}


def test_texts_with_a_vector_are_not_dealt_out(spark, sf_dir, monkeypatch):
    from redliner.queries import search

    seen = {}
    monkeypatch.setattr(search.R, "hybrid_search", lambda docs, asked, *a, **b: (seen.update(docs=docs), retrieval.vector_topk(docs.selectExpr("doc_id as vec_id", "array(1D) as embedding"), asked.limit(1).selectExpr("query_id", "array(1D) as vector"), 1))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        search.hybrid_rrf(spark, sf_dir)
        plan = seen["docs"]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
