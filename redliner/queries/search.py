"""Index and retrieval over clauses, documents and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redliner.operators import retrieval as R
from redliner.operators.align import vector_candidates
from redliner.plans.samples import both, table
from redliner.queries import sqltext as S

WHO, TERM = "Customer", "termination"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's items as queries."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = R.bm25_topk(table(spark, sf, "documents"), _asked(spark, sf), "doc_id", 5)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_statistics(spark: SparkSession, sf: str) -> DataFrame:
    found = R.postings(table(spark, sf, "documents"), "doc_id")
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = R.vector_topk(table(spark, sf, "embeddings"), _vectors(spark, sf), 5)
    return found.select("query_id", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a vector, searched by words and by vector for every fiftieth of them, the two lists fused."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    asked = docs.where("doc_id % 50 = 0").join(vectors, "doc_id").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 200).alias("query"), F.col("embedding").alias("vector"))
    texts = R.with_ids(docs, vectors.select("doc_id"), "doc_id")
    found = R.hybrid_search(texts, asked, "doc_id", 5, vectors=vectors.join(docs.select("doc_id"), "doc_id"))
    return found.select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def get_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf)
    return R.get_chunks(c, c.where(F.col("ordinal") % 2 == 0).select("chunk_id")).select("chunk_id", F.md5("text").alias("text"), "document_id")


def vector_similarity_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector against all vectors of its label as a second version of them, the three nearest each."""
    v = table(spark, sf, "embeddings").select(F.col("label").alias("contract_id"), F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("ordinal"), "embedding")
    return vector_candidates(v, v, 3).select("source_id", "target_id", "score", F.col("rank").cast("long").alias("rank"))


def similarity_gate_status(spark: SparkSession, sf: str) -> DataFrame:
    found = vector_similarity_join(spark, sf)
    best = found.where("rank = 1")
    return best.select("source_id", "score", F.when(F.col("score") >= 0.55, "COMPARED").otherwise("BELOW_THRESHOLD").alias("status"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both(spark, sf)
    rows = a.withColumn("version_id", F.lit("v1")).unionByName(b.withColumn("version_id", F.lit("v2")))
    return rows.select("chunk_id", "text", "ordinal", F.concat(F.lit("doc"), F.col("contract_id") % 50, F.lit("_"), "version_id").alias("document_id"), "version_id")


def entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf)
    return R.mentions(c, "stakeholder", R.STAKEHOLDERS).unionByName(R.mentions(c, "legal_term", R.LEGAL_TERMS))


def date_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return R.date_mentions(_chunks(spark, sf))


def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return R.entity_graph(_chunks(spark, sf))[0].groupBy("node_type").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_distinct"))


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return R.entity_graph(_chunks(spark, sf))[1].groupBy("relation").agg(F.count("*").alias("n"))


def graph_entity(spark: SparkSession, sf: str) -> DataFrame:
    return R.entity_search(R.entity_graph(_chunks(spark, sf))[1], "stakeholder", WHO, 5)


def graph_multi_entity(spark: SparkSession, sf: str) -> DataFrame:
    return R.multi_entity_search(R.entity_graph(_chunks(spark, sf))[1], WHO, TERM, 10)


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_statistics, vector_topk, hybrid_rrf, get_chunks, vector_similarity_join, similarity_gate_status, entity_mentions, date_mentions,
        graph_nodes, graph_edges, graph_entity, graph_multi_entity,
    )
}

_DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"
_POSTINGS = f"""
lists AS MATERIALIZED (SELECT doc_id AS id, {S.tokens("text")} AS w FROM documents),
sized AS MATERIALIZED (SELECT id, w, len(w) AS dl FROM lists),
words AS (SELECT id, unnest(w) AS term, dl FROM sized),
post AS (SELECT id, term, dl, count(*) AS tf FROM words GROUP BY ALL)"""


def _near(name: str, where: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
      SELECT q.vec_id AS query_id, e.vec_id AS id, round({_DOT.format("e.embedding", "q.embedding")}, 6) AS score
      FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND {where}) x) y WHERE rank <= 10)"""


_VJOIN = f"""vjoin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS rank FROM (
  SELECT a.vec_id AS source_id, b.vec_id AS target_id, round({_DOT.format("a.embedding", "b.embedding")}, 6) AS score
  FROM embeddings a JOIN embeddings b ON a.label = b.label) x) y WHERE rank <= 3)"""
_EVERY = "every_ AS (SELECT *, 'v1' AS v FROM clauses_a UNION ALL SELECT *, 'v2' AS v FROM clauses_b)"
_HITS = " UNION ALL ".join(
    f"SELECT chunk_id, '{kind}:{n.lower()}' AS entity FROM every_ WHERE contains(lower(text), '{n.lower()}')"
    for kind, names in (("stakeholder", R.STAKEHOLDERS), ("legal_term", R.LEGAL_TERMS))
    for n in names
)
_DATES = f"""dates AS (SELECT chunk_id, unnest(regexp_extract_all({S.norm("text")}, {S.quoted("(?i)\\b(" + "|".join(R.DATES) + ")\\b")})) AS value FROM every_)"""
SQL = {
    "bm25_topk": f"""WITH {_POSTINGS}, n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized),
      idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term) d, n),
      q AS (SELECT item_id AS query_id, unnest({S.tokens("text")}) AS term FROM benchmark),
      qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY ALL),
      w AS (SELECT query_id, term, qtf, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END AS w FROM qt JOIN idf USING (term)),
      s AS (SELECT query_id, d.doc_id, round(coalesce(sum(qtf * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 0), 6) AS score
            FROM (SELECT DISTINCT query_id FROM q) a CROSS JOIN documents d CROSS JOIN n
            LEFT JOIN (SELECT w.query_id AS qid, w.w, w.qtf, post.* FROM w JOIN post USING (term)) p ON p.qid = query_id AND p.id = d.doc_id GROUP BY 1, 2)
      SELECT query_id, doc_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) x WHERE rank <= 5""",
    "bm25_statistics": f"WITH {_POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM post GROUP BY term",
    "vector_topk": f"WITH {_near('near', 'true')} SELECT query_id, id AS vec_id, score, rank FROM near WHERE rank <= 5",
    "hybrid_rrf": f"""WITH d0 AS (SELECT d.doc_id, d.text, e.embedding FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
      lists AS MATERIALIZED (SELECT doc_id AS id, {S.tokens("text")} AS w FROM d0), sized AS MATERIALIZED (SELECT id, w, len(w) AS dl FROM lists), words AS (SELECT id, unnest(w) AS term, dl FROM sized), post AS (SELECT id, term, dl, count(*) AS tf FROM words GROUP BY ALL),
      n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized), idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term) d, n),
      q AS (SELECT doc_id AS query_id, unnest({S.tokens("substr(text, 1, 200)")}) AS term FROM d0 WHERE doc_id % 50 = 0), qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY ALL),
      w AS (SELECT query_id, term, qtf, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END AS w FROM qt JOIN idf USING (term)),
      s AS (SELECT query_id, d.doc_id AS id, round(coalesce(sum(qtf * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 0), 6) AS score FROM (SELECT DISTINCT query_id FROM q) a CROSS JOIN d0 d CROSS JOIN n
            LEFT JOIN (SELECT w.query_id AS qid, w.w, w.qtf, post.* FROM w JOIN post USING (term)) p ON p.qid = query_id AND p.id = d.doc_id GROUP BY 1, 2),
      bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) x WHERE rank <= 10),
      vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT b.doc_id AS query_id, a.doc_id AS id, round({_DOT.format("a.embedding", "b.embedding")}, 6) AS score FROM d0 a, d0 b WHERE b.doc_id % 50 = 0) x) y WHERE rank <= 10),
      fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 1000 + rank) AS tie FROM (SELECT query_id, id, rank, 0 AS list FROM vec UNION ALL SELECT query_id, id, rank, 1 FROM bm) x GROUP BY 1, 2)
      SELECT query_id, id AS doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie) AS rank FROM fused) x WHERE rank <= 5""",
    "get_chunks": S.over_clauses(_EVERY, select="SELECT chunk_id, md5(text) AS text, concat('doc', contract_id % 50, '_', v) AS document_id FROM every_ WHERE ordinal % 2 = 0"),
    "vector_similarity_join": f"WITH {_VJOIN} SELECT * FROM vjoin",
    "similarity_gate_status": f"WITH {_VJOIN} SELECT source_id, score, CASE WHEN score >= 0.55 THEN 'COMPARED' ELSE 'BELOW_THRESHOLD' END AS status FROM vjoin WHERE rank = 1",
    "entity_mentions": S.over_clauses(_EVERY, select=_HITS),
    "date_mentions": S.over_clauses(_EVERY, _DATES, select="SELECT chunk_id, concat('date:', lower(value)) AS entity, value FROM dates"),
    "graph_nodes": S.over_clauses(
        _EVERY, f"hits AS ({_HITS})", _DATES,
        select="""SELECT node_type, count(*) AS n, count(DISTINCT id) AS n_distinct FROM (
          SELECT DISTINCT concat('doc', cast(contract_id % 50 AS VARCHAR), '_', v) AS id, 'document' AS node_type FROM every_
          UNION ALL SELECT DISTINCT concat('doc', cast(contract_id % 50 AS VARCHAR), '_', v, ':', v), 'version' FROM every_
          UNION ALL SELECT chunk_id, 'chunk' FROM every_
          UNION ALL SELECT DISTINCT entity, split_part(entity, ':', 1) FROM hits
          UNION ALL SELECT DISTINCT concat('date:', lower(value)), 'date' FROM dates) x GROUP BY 1""",
    ),
    "graph_edges": S.over_clauses(
        _EVERY, f"hits AS ({_HITS})", _DATES,
        select="""SELECT relation, count(*) AS n FROM (SELECT DISTINCT concat(contract_id % 50, v) AS x, 'has_version' AS relation FROM every_
          UNION ALL SELECT '', 'contains' FROM every_ UNION ALL SELECT '', 'mentions' FROM hits UNION ALL SELECT '', 'mentions' FROM dates) y GROUP BY 1""",
    ),
    "graph_entity": S.over_clauses(_EVERY, select=f"SELECT chunk_id, 1.0::DOUBLE AS score FROM every_ WHERE contains(lower(text), '{WHO.lower()}') ORDER BY chunk_id LIMIT 5"),
    "graph_multi_entity": S.over_clauses(_EVERY, select=f"SELECT chunk_id FROM every_ WHERE contains(lower(text), '{WHO.lower()}') AND contains(lower(text), '{TERM}') ORDER BY chunk_id LIMIT 10"),
}
