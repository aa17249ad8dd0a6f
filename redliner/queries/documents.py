"""Chunking, clean-up, evaluation, questions and messages over sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redliner.functions import text as T
from redliner.operators import chunking as C
from redliner.operators import consult as Q
from redliner.operators import evaluation as E
from redliner.plans.samples import both, clauses, table
from redliner.queries import sqltext as S
from redliner.sources.files import result_key, scratch
from redliner.streaming import live

LINES = """SELECT concat('d', cast(o_custkey % 100 AS string)) AS document_id, cast(o_orderkey AS int) AS line_no, cast(o_orderkey % 7 + 1 AS int) AS page,
  CASE o_orderkey % 9 WHEN 0 THEN 14.04 WHEN 1 THEN 18.0 WHEN 2 THEN 0.0 ELSE 10.0 + (o_custkey % 2) / 2.0 END AS font_size, o_orderkey % 11 = 0 AS bold,
  CASE o_orderkey % 13 WHEN 0 THEN concat(cast(o_orderkey % 20 AS string), '. Scope of Work') WHEN 1 THEN concat(cast(o_orderkey % 9 AS string), '.1 Detail of the part')
    WHEN 2 THEN 'Article IV: General' WHEN 3 THEN '(b) an item' WHEN 4 THEN 'B. Letters' WHEN 5 THEN concat('Page ', cast(o_orderkey % 40 AS string)) WHEN 6 THEN '3/23' WHEN 7 THEN 'https://x.example/y'
    ELSE concat('The goods of order ', cast(o_orderkey AS string), ' are delivered on time and the parties sign for them at the place of the delivery named in the order; this line goes on.') END AS text
  FROM orders"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(LINES.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))
    return rows.withColumn("font_size", F.col("font_size").cast("double"))


def body_font_mode(spark: SparkSession, sf: str) -> DataFrame:
    return C.body_font_size(_lines(spark, sf))


def heading_detect(spark: SparkSession, sf: str) -> DataFrame:
    return C.headings(_lines(spark, sf)).select("document_id", "line_no", F.coalesce("level", F.lit(-1)).alias("level"), "is_numbered")


def heading_path(spark: SparkSession, sf: str) -> DataFrame:
    return C.heading_paths(C.headings(_lines(spark, sf))).select("document_id", "line_no", F.array_join("path", " > ").alias("path"))


def chunk_segments(spark: SparkSession, sf: str) -> DataFrame:
    return C.segments(_lines(spark, sf)).select("document_id", "chunk_id", F.md5("text").alias("text"), "page_start", "page_end", F.array_join("heading_path", " > ").alias("heading_path"))


def process_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses down to second-level headings, with a limit that laid-out lines never meet."""
    found = C.process_documents(_lines(spark, sf), 2, 1500)
    return found.select("document_id", "chunk_id", F.md5("text").alias("text"), "page_start", "page_end", F.array_join("heading_path", " > ").alias("heading_path"))


TEXTS = """SELECT concat('c', cast(o_orderkey AS string)) AS chunk_id, concat('d', cast(o_custkey % 50 AS string)) AS document_id, cast(o_orderkey AS int) AS ordinal, cast(o_orderkey % 9 AS int) AS page_start, cast(o_orderkey % 9 + 1 AS int) AS page_end,
  CASE o_orderkey % 5 WHEN 0 THEN concat_ws(chr(10), 'Lead in line', concat('"Fee" means the amount of ', cast(o_custkey AS string), '.'), 'that goes on', '“Goods” has the meaning below', '"Term" shall mean a year.')
    WHEN 1 THEN concat_ws(chr(10), '1. First Part. It says a lot about the goods', 'and more', '2.1 a subsection of it', concat(cast(o_custkey % 90 AS string), '. Other Things; And More.'), '5.Short.Text')
    WHEN 2 THEN concat_ws(chr(10), 'Intro text ends here.', 'THE GOODS ARE SOLD AS THEY ARE WITHOUT', 'ANY WARRANTY AT ALL OF ANY KIND.', concat('Then plain text ', cast(o_custkey AS string), ' follows;'), 'AND CAPITALS AGAIN HERE', 'end')
    WHEN 3 THEN concat_ws(chr(10), '4', '3/23', 'Expenses') ELSE concat_ws(chr(10), 'tiny', cast(o_custkey AS string)) END AS text FROM orders"""


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(TEXTS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders")).withColumn("heading_path", F.array(F.lit("A"), F.lit("B")))


def split_definitions(spark: SparkSession, sf: str) -> DataFrame:
    return C.split_definitions(_texts(spark, sf)).select("chunk_id", "piece", "text", "head")


def split_sections(spark: SparkSession, sf: str) -> DataFrame:
    return C.split_sections(_texts(spark, sf)).select("chunk_id", "piece", "text", "head")


def caps_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return C.split_caps(_texts(spark, sf)).select("chunk_id", "piece", "text", "head")


def drop_empty(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses without their noise lines, those left empty dropped; ``long`` marks what is to be cut."""
    rows = _texts(spark, sf).withColumn("text", C.without_noise(F.col("text"))).where("trim(text) <> ''")
    return rows.select("chunk_id", "text")


def pack_lines(spark: SparkSession, sf: str) -> DataFrame:
    return C.pack_lines(_texts(spark, sf), 60)


def clean_stats(spark: SparkSession, sf: str) -> DataFrame:
    return C.clean_stats(_texts(spark, sf), 120)


def split_long_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(C.split_long_text(F.replace("text", F.lit("\n"), F.lit("\n\n")), 400)).alias("piece", "text"))
    return rows.select("doc_id", "piece", F.md5("text").alias("text"))


def prepared_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Nested documents made flat, half of them with an id of their own, some with a version."""
    rows = clauses(spark, sf, "a").groupBy("contract_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id", "text"))).alias("c"))
    key = F.concat(F.lit("key"), F.col("contract_id"))
    docs = rows.select(key.alias("document_key"), F.when(F.col("contract_id") % 2 == 0, F.concat(F.lit("doc"), F.col("contract_id"))).alias("document_id"), F.transform("c", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["text"].alias("text"))).alias("chunks"))
    versions = rows.where("contract_id % 4 = 0").select(F.concat(F.lit("doc"), F.col("contract_id")).alias("document_id"), F.lit("v7").alias("version_id"))
    return C.prepare_chunks(docs, versions).select("document_id", "chunk_id", F.col("ordinal").cast("long").alias("ordinal"), "version_id")


def noise_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).where(~F.col("text").rlike(C.NOISE)).select("document_id", "line_no", "text")


def clean_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.clean(C.segments(_lines(spark, sf)))


def chunk_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.concat("l_orderkey", F.lit("_"), "l_linenumber").alias("chunk_id"), F.lit("d").alias("document_id"), F.when(F.col("l_quantity") > 1, F.col("l_returnflag")).alias("text"))
    return C.violations(rows)


def chunk_quality_profile(spark: SparkSession, sf: str) -> DataFrame:
    return C.quality_profile(table(spark, sf, "documents"))


def length_profile(spark: SparkSession, sf: str) -> DataFrame:
    return E.length_profile(table(spark, sf, "documents"))


def group_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", E.split_of(F.col("source")).alias("split"))
    return rows


def leakage_check(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that stand in several splits: none when whole sources are dealt, some when documents are."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("contract"))
    by_source = E.leakage(docs.withColumn("split", E.split_of(F.col("contract")))).select(F.lit("by source").alias("dealt"), "contract", "n_splits")
    by_doc = E.leakage(docs.withColumn("split", E.split_of(F.col("doc_id").cast("string")))).select(F.lit("by document").alias("dealt"), "contract", "n_splits")
    return by_source.unionByName(by_doc)


def split_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(E.split_of(F.col("source")).alias("split"), F.concat_ws("-", "lang", F.col("n_chars") % 50).alias("question"))
    return E.coverage(rows)


def answer_window(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of examples, tokens split once for each text; every third has no answer."""
    docs = table(spark, sf, "documents")
    n = F.size(T.tokens(F.col("text")))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("context"), F.when((F.col("doc_id") % 3 != 0) & (n > 4), (F.col("doc_id") * 7 % n).cast("int")).alias("at"), F.lit(5).alias("n"))
    return E.windows(rows).select(F.col("id").alias("doc_id"), F.col("window.start").cast("long").alias("start"), F.md5(F.array_join("window.tokens", " ")).alias("tokens"))


def flatten_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's texts as one nested document of questions, made flat again."""
    item = F.struct(F.concat(F.lit("q"), "item_id").alias("id"), F.concat(F.lit("What is in "), "item_id", F.lit("?")).alias("question"), F.array(F.struct(F.substring("text", 1, 9).alias("text"), F.lit(0).alias("answer_start"))).alias("answers"))
    qas = table(spark, sf, "benchmark").groupBy((F.col("item_id") % 10).alias("g"), "text").agg(F.collect_list(item).alias("qas"))
    paragraphs = qas.groupBy("g").agg(F.collect_list(F.struct(F.col("text").alias("context"), "qas")).alias("paragraphs"))
    nested = paragraphs.agg(F.collect_list(F.struct(F.concat(F.lit("t"), "g").alias("title"), "paragraphs")).alias("data"))
    return E.flatten_examples(nested).select("contract", "context", "id", "question", F.col("answers")[0]["text"].alias("answer"))


def rendered_examples(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").select("item_id", "text", F.when(F.col("item_id") % 3 != 0, F.substring("text", 1, 20)).alias("answer"))
    out = E.rendered(F.col("text"), F.concat(F.lit("Item "), "item_id"), F.col("answer"))
    return rows.select("item_id", out["prompt"].alias("prompt"), out["label"].alias("label"))


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of which some are missing on either side."""
    rows = _answers(spark, sf)
    x = F.when(F.col("k") % 5 == 0, F.lit("No such clause.")).when(F.col("k") % 7 == 0, F.lit(" ")).otherwise(F.col("x"))
    y = F.when(F.col("k") % 10 == 0, F.lit(None).cast("string")).when(F.col("k") % 11 == 0, F.lit("")).otherwise(F.col("y"))
    return rows.withColumns({"context": F.col("y"), "x": x, "y": y})


def extraction_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = _predictions(spark, sf)
    return E.extraction_scores(rows, "k", "x", "y").select("k", "precision", "recall", "f1", "exact", "no_answer")


def eval_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    rows = _predictions(spark, sf)
    scores = E.extraction_scores(rows, "k", "x", "y").join(rows.select("k", "heading", E.is_grounded(F.col("x"), F.col("context")).alias("grounded")), "k")
    found = E.aggregates(scores, "heading", "grounded")
    return found.select(*[F.round(c, 4).alias(c) for c in found.columns])


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both(spark, sf)
    return a.select("k", F.col("text").alias("x")).join(b.select("k", F.col("text").alias("y"), "heading"), "k")


def token_f1(spark: SparkSession, sf: str) -> DataFrame:
    return E.token_scores(_answers(spark, sf), "k", "x", "y")


def eval_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    rows = _answers(spark, sf)
    return E.macro(E.token_scores(rows, "k", "x", "y").join(rows.select("k", "heading"), "k"), "heading").select(*[F.round(c, 4).alias(c) for c in ("f1", "exact", "macro_f1")])


def legal_gate(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both(spark, sf)
    rows = a.unionByName(b).select("chunk_id", F.when(F.col("k") % 4 == 0, F.replace("text", F.lit("shall"), F.lit("would"))).otherwise(F.col("text")).alias("text"))
    return rows.select("chunk_id", Q.legal_gate(F.col("text")).alias("gate"))


def lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    items = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")
    return Q.lexical_search(items, asked, "id", "role", "text").select("query_id", "id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


def message_reassembly(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of four parts, sent out of order and repeatedly; orders with other numbers of parts stay torn."""
    parts = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 5).alias("job"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("n"), F.lit(4).alias("total"), F.col("l_linenumber").cast("string").alias("part"))
    return Q.reassembled(parts)


def live_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A live table: placeholders for all pairs, then the events as a stream of results."""
    rows = table(spark, sf, "events").select(F.concat(F.lit("p"), F.col("user_id")).alias("pair_id"), F.col("event_id").alias("arrival_no"), F.col("event_type").alias("status"))
    base = scratch(spark, "live")
    rows.repartition(3).write.parquet(f"{base}/in")
    live.preview(rows.select("pair_id").distinct().unionByName(spark.createDataFrame([("p-none",)], "pair_id string")), f"{base}/out", buckets=8)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    live.start(stream, f"{base}/out", f"{base}/checkpoint", buckets=8).awaitTermination()
    return live.newest(spark, f"{base}/out").select("pair_id", "arrival_no", F.col("status").alias("event_type"))


def result_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", result_key("text", "lang", "source").alias("key"))


def word_diff(spark: SparkSession, sf: str) -> DataFrame:
    return Q.word_diffs(_answers(spark, sf).where("x <> y"), "k", "x", "y")


def diff_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    """How much of a pair of texts its differences make up; texts that differ in one known word."""
    rows = clauses(spark, sf, "a").select("k", F.col("text").alias("x"), F.concat("text", F.lit(" zzz")).alias("y"))
    return Q.word_diffs(rows, "k", "x", "y").select("k", F.round("magnitude", 6).alias("magnitude"))


QUERIES = {
    f.__name__: f
    for f in (
        body_font_mode, heading_detect, heading_path, chunk_segments, process_documents, split_definitions, split_sections, caps_blocks, drop_empty, pack_lines,
        clean_stats, split_long_text, prepared_chunks, noise_filter, clean_chunks, chunk_validation, chunk_quality_profile, length_profile,
        group_split, leakage_check, split_coverage, answer_window, flatten_examples, rendered_examples, token_f1, eval_macro_f1, extraction_scores,
        eval_aggregates, legal_gate, lexical_search, message_reassembly, live_upsert, result_cache_key, word_diff, diff_magnitude,
    )
}

_BODY = f"""WITH lines AS (SELECT * REPLACE (font_size::DOUBLE AS font_size) FROM ({LINES}) l), sizes AS (SELECT document_id, round(font_size, 1) AS size, count(*) AS n, min(line_no) AS first FROM lines WHERE font_size > 0 GROUP BY 1, 2),
body AS (SELECT document_id, coalesce(max(b), 0.0) AS body FROM (SELECT DISTINCT document_id FROM lines) d LEFT JOIN (
  SELECT document_id AS id, size AS b FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, first) AS r FROM sizes) x WHERE r = 1) y ON y.id = document_id GROUP BY 1)"""


def _level() -> str:
    cases = []
    for p, level in C.NUMBERED:
        q = S.quoted(p)
        then = str(level)
        if level == 1:
            first = f"regexp_extract(t, {q}, 1)"
            dots = f"(length({first}) - length(replace({first}, '.', '')))"
            then = f"CASE WHEN {dots} > 0 THEN {dots} + 1 ELSE 1 END"
        cases.append(f"WHEN regexp_matches(t, {q}) THEN {then}")
    return "CASE " + " ".join(cases) + " END"


_HEADS = f"""{_BODY}, h1 AS (SELECT l.*, trim(text) AS t, body, CASE WHEN body > 0 THEN font_size / body ELSE 1.0 END AS ratio FROM lines l JOIN body USING (document_id)),
h2 AS (SELECT *, {_level()} AS num, CASE WHEN length(t) <= 120 AND (font_size >= body * 1.3 OR bold AND len(string_split(regexp_replace(t, '\\s+', ' ', 'g'), ' ')) <= 12) THEN CASE WHEN ratio >= 1.5 THEN 0 WHEN ratio >= 1.2 THEN 1 ELSE 2 END END AS vis FROM h1),
heads AS (SELECT *, coalesce(num, vis)::INT AS level, num IS NOT NULL AS is_numbered FROM h2)"""
_NORM_ANSWER = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
_F1 = S.over_clauses(f"""ans AS (SELECT a.k, b.heading, {_NORM_ANSWER.format("a.text")} AS x, {_NORM_ANSWER.format("b.text")} AS y FROM clauses_a a JOIN clauses_b b USING (k)),
  px AS (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(string_split(x, ' ')) AS w FROM ans) z WHERE w <> '' GROUP BY 1, 2),
  py AS (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(string_split(y, ' ')) AS w FROM ans) z WHERE w <> '' GROUP BY 1, 2),
  sums AS (SELECT k, sum(least(coalesce(px.n, 0), coalesce(py.n, 0)))::DOUBLE AS c, sum(coalesce(px.n, 0))::DOUBLE AS np, sum(coalesce(py.n, 0))::DOUBLE AS ne FROM px FULL JOIN py USING (k, w) GROUP BY k),
  sc AS (SELECT k, heading, c / np AS p, c / ne AS r, (x = y)::INT AS exact FROM ans JOIN sums USING (k)),
  scores AS (SELECT k, heading, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, exact FROM sc)""", select="")
_STOPS = "'the','a','an','and','or','of','to','in','on','for','with','by','is','are','was','were','be','what','which','who','how','does','did','do','that','this','these','those','about','any','all','changed','change','changes','clause','clauses','version','new','old','there','it','its','from','as','at'"
_STEM = "list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9%$ ]+', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN (" + _STOPS + ")), lambda w: regexp_replace(regexp_replace(w, '(ies|ied)$', 'y'), '(ing|ion|ions|ed|es|s)$', '')))"
_BUCKET = "(('0x' || substr(md5(source), 1, 8))::BIGINT % 100)"
_BUCKET_DOC = "(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100)"
_SPLIT_DOC = f"CASE WHEN {_BUCKET_DOC} < 80 THEN 'train' WHEN {_BUCKET_DOC} < 90 THEN 'validation' ELSE 'test' END"
_SPLIT = f"CASE WHEN {_BUCKET} < 80 THEN 'train' WHEN {_BUCKET} < 90 THEN 'validation' ELSE 'test' END"
_TOK = f"WITH d AS MATERIALIZED (SELECT doc_id, {S.tokens('text')} AS w FROM documents)"
#: Answers with missing ones: the same texts as the query's, scored in SQL.
_EX = S.over_clauses(f"""pred AS (SELECT a.k, b.heading, b.text AS ctx, CASE WHEN a.k % 5 = 0 THEN 'No such clause.' WHEN a.k % 7 = 0 THEN ' ' ELSE a.text END AS x, CASE WHEN a.k % 10 = 0 THEN NULL WHEN a.k % 11 = 0 THEN '' ELSE b.text END AS y FROM clauses_a a JOIN clauses_b b USING (k)),
  ans AS (SELECT k, heading, {_NORM_ANSWER.format("ctx")} AS c, {_NORM_ANSWER.format("x")} AS x, {_NORM_ANSWER.format("y")} AS y, k % 5 = 0 OR trim(x) = '' AS p, coalesce(trim(y), '') = '' AS e FROM pred),
  px AS (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(string_split(x, ' ')) AS w FROM ans WHERE NOT p AND NOT e) z WHERE w <> '' GROUP BY 1, 2),
  py AS (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(string_split(y, ' ')) AS w FROM ans WHERE NOT p AND NOT e) z WHERE w <> '' GROUP BY 1, 2),
  sums AS (SELECT k, sum(least(coalesce(px.n, 0), coalesce(py.n, 0)))::DOUBLE AS c, sum(coalesce(px.n, 0))::DOUBLE AS np, sum(coalesce(py.n, 0))::DOUBLE AS ne FROM px FULL JOIN py USING (k, w) GROUP BY k),
  scored AS (SELECT a.k, a.heading, a.c, a.x, p, e, CASE WHEN p AND e THEN 1.0 WHEN p OR e THEN 0.0 ELSE round(s.c / np, 6) END AS precision, CASE WHEN p AND e THEN 1.0 WHEN p OR e THEN 0.0 ELSE round(s.c / ne, 6) END AS recall,
    CASE WHEN p AND e THEN 1.0 WHEN p OR e THEN 0.0 WHEN s.c = 0 THEN 0.0 ELSE round(2 * (s.c / np) * (s.c / ne) / (s.c / np + s.c / ne), 6) END AS f1, CASE WHEN p OR e THEN (p AND e)::INT ELSE (x = y)::INT END AS exact FROM ans a LEFT JOIN sums s USING (k))""", select="")
_PATHS = f"""{_HEADS}, opened AS (SELECT h.document_id, h.line_no, h.t, min(g.line_no) AS shut FROM heads h LEFT JOIN heads g ON g.document_id = h.document_id AND g.level IS NOT NULL AND g.line_no > h.line_no AND g.level <= h.level WHERE h.level IS NOT NULL GROUP BY ALL),
paths AS (SELECT l.*, coalesce(p.path, '') AS path FROM heads l LEFT JOIN (SELECT l.document_id, l.line_no, string_agg(o.t, ' > ' ORDER BY o.line_no) AS path FROM heads l JOIN opened o ON o.document_id = l.document_id AND l.line_no >= o.line_no AND (o.shut IS NULL OR l.line_no < o.shut) GROUP BY 1, 2) p USING (document_id, line_no))"""


def _segments(level: int) -> str:
    return f"""{_PATHS}, parts AS (SELECT *, coalesce(level <= {level}, false) AS opens, sum(CASE WHEN level <= {level} THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY line_no) AS part FROM paths),
      g AS (SELECT document_id, part, regexp_replace(string_agg(text, chr(10) ORDER BY line_no), '^\\s+|\\s+$', '', 'g') AS text, min(page) AS page_start, max(page) AS page_end, coalesce(max(CASE WHEN opens THEN path END), '') AS heading_path FROM parts GROUP BY 1, 2)
      SELECT document_id, concat(document_id, '_', lpad((row_number() OVER (PARTITION BY document_id ORDER BY part))::VARCHAR, 4, '0')) AS chunk_id, md5(text) AS text, page_start, page_end, heading_path FROM g WHERE text <> ''"""


_LINES_OF = f"WITH t AS ({TEXTS}), l AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM t)"
_PIECES = "p AS (SELECT *, sum(opens::INT) OVER (PARTITION BY chunk_id ORDER BY i) AS piece FROM o) SELECT chunk_id, piece::BIGINT AS piece, string_agg(line, chr(10) ORDER BY i) AS text, max(head) AS head FROM p GROUP BY 1, 2"
_SECTION_AT = "'^\\s*(\\d{1,2})\\.\\s*([A-Z][A-Za-z;,’''&\\- ]{2,60}?)\\.(?:\\s|$|[A-Z])'"
_NOISE_LINE = (
    "'(?i)^\\s*(?:\\d{1,2}/\\d{1,2}/\\d{2,4},?\\s+\\d{1,2}:\\d{2}\\s*(?:AM|PM)?|https?://\\S+|ex[\\w.\\-]*?(?:\\.htm)?|\\d{1,3}\\s*/\\s*\\d{1,3}"
    "|-?\\s*\\d{1,3}\\s*-?|EX-\\d+(?:\\.\\d+)?\\s+\\d+\\s+\\S+\\.htm\\b.*)\\s*$'"
)
SQL = {
    "heading_path": f"{_PATHS} SELECT document_id, line_no, path FROM paths",
    "chunk_segments": _segments(1),
    "process_documents": _segments(2),
    "split_definitions": f"""{_LINES_OF}, h AS (SELECT *, regexp_matches(line, '(?i)^\\s*[“"]([^”"]{{1,80}})[”"]\\s+(?:means|has the meaning|shall mean|shall have)') AS hit FROM l),
      o AS (SELECT *, hit OR i = 0 AS opens, CASE WHEN hit THEN concat('“', regexp_extract(line, '^\\s*[“"]([^”"]{{1,80}})[”"]', 1), '”') END AS head FROM h WHERE chunk_id IN (SELECT chunk_id FROM h WHERE hit GROUP BY 1 HAVING count(*) >= 3)), {_PIECES}""",
    "split_sections": f"""{_LINES_OF}, o AS (SELECT *, regexp_matches(line, {_SECTION_AT}) OR regexp_matches(line, '^\\s*\\d{{1,2}}\\.\\d{{1,2}}[\\s\\x{{A0}}]') OR i = 0 AS opens,
      CASE WHEN regexp_matches(line, {_SECTION_AT}) THEN concat(regexp_extract(line, {_SECTION_AT}, 1), '. ', trim(regexp_extract(line, {_SECTION_AT}, 2)), '.') END AS head FROM l), {_PIECES}""",
    "caps_blocks": f"""{_LINES_OF}, c AS (SELECT *, length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(line, '[^\\p{{Lu}}]', '', 'g')) AS uppers, list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '') AS w FROM l),
      d AS (SELECT *, letters >= 12 AND uppers::DOUBLE / letters > 0.9 AS caps FROM c),
      e AS (SELECT *, lag(line, 1, '') OVER q AS before, lag(caps, 1, false) OVER q AS caps_before, sum(CASE WHEN caps THEN 0 ELSE 1 END) OVER q AS run FROM d WINDOW q AS (PARTITION BY chunk_id ORDER BY i)),
      f AS (SELECT *, sum(CASE WHEN caps THEN len(w) ELSE 0 END) OVER (PARTITION BY chunk_id, run ORDER BY i) AS words FROM e), g AS (SELECT *, lag(words, 1, 0) OVER (PARTITION BY chunk_id ORDER BY i) AS words_before, regexp_matches(before, '[.;:!?]["''”’)\\]]*\\s*$') AS ended FROM f),
      o0 AS (SELECT *, i > 0 AND ended AND ((caps AND NOT caps_before AND len(w) >= 4) OR (caps_before AND NOT caps AND trim(line) <> '' AND words_before >= 8)) AS opens FROM g),
      o AS (SELECT *, CASE WHEN opens THEN left(array_to_string(w[1:8], ' '), 60) END AS head FROM o0), {_PIECES}""",
    "drop_empty": f"WITH t AS ({TEXTS}), c AS (SELECT chunk_id, array_to_string(list_filter(string_split(text, chr(10)), lambda y: NOT regexp_matches(y, {_NOISE_LINE})), chr(10)) AS text FROM t) SELECT chunk_id, text FROM c WHERE trim(text) <> ''",
    "prepared_chunks": S.over_clauses(select="SELECT concat(CASE WHEN contract_id % 2 = 0 THEN 'doc' ELSE 'key' END, contract_id) AS document_id, chunk_id, ordinal, CASE WHEN contract_id % 4 = 0 THEN 'v7' END AS version_id FROM clauses_a"),
    "diff_magnitude": S.over_clauses(select="SELECT k, round(4.0::DOUBLE / (length(text) + 4), 6) AS magnitude FROM clauses_a"),
    "body_font_mode": f"{_BODY} SELECT document_id, body FROM body",
    "heading_detect": f"{_HEADS} SELECT document_id, line_no, coalesce(level, -1)::INT AS level, is_numbered FROM heads",
    "noise_filter": f"WITH l AS ({LINES}) SELECT document_id, line_no, text FROM l WHERE NOT regexp_matches(text, {_NOISE_LINE})",
    "chunk_validation": """WITH c AS (SELECT concat(l_orderkey, '_', l_linenumber) AS chunk_id, CASE WHEN l_quantity > 1 THEN l_returnflag END AS text FROM lineitem)
      SELECT chunk_id, 'blank text' AS problem FROM c WHERE text IS NULL OR trim(text) = '' UNION ALL SELECT chunk_id, 'duplicate chunk_id' FROM c GROUP BY chunk_id HAVING count(*) > 1""",
    "chunk_quality_profile": """SELECT count(*) AS n_chunks, round(quantile_cont(n, 0.1), 3) AS p10, round(quantile_cont(n, 0.5), 3) AS p50, round(quantile_cont(n, 0.9), 3) AS p90, max(n)::INT AS longest,
      count(*) FILTER (WHERE n < 80) AS n_tiny, count(*) FILTER (WHERE n > 1500) AS n_over FROM (SELECT length(text) AS n FROM documents) x""",
    "length_profile": f"""{_TOK} SELECT min(n)::INT AS shortest, max(n)::INT AS longest, round(avg(n), 4) AS mean, round(quantile_cont(n, 0.5), 3) AS p50, round(quantile_cont(n, 0.9), 3) AS p90, round(quantile_cont(n, 0.95), 3) AS p95,
      round(quantile_cont(n, 0.99), 3) AS p99, count(*) FILTER (WHERE n > 1024) AS n_over_1024, count(*) FILTER (WHERE n > 1536) AS n_over_1536, count(*) FILTER (WHERE n > 2048) AS n_over_2048 FROM (SELECT len(w) AS n FROM d) x""",
    "group_split": f"SELECT doc_id, {_SPLIT} AS split FROM documents",
    "leakage_check": f"""SELECT 'by source' AS dealt, source AS contract, count(DISTINCT {_SPLIT}) AS n_splits FROM documents GROUP BY 2 HAVING count(DISTINCT {_SPLIT}) > 1
      UNION ALL SELECT 'by document', source, count(DISTINCT {_SPLIT_DOC}) FROM documents GROUP BY 2 HAVING count(DISTINCT {_SPLIT_DOC}) > 1""",
    "split_coverage": f"""WITH r AS (SELECT {_SPLIT} AS split, concat(lang, '-', n_chars % 50) AS q FROM documents) SELECT split, count(*) AS n_examples, count(DISTINCT q) AS n_categories, (SELECT count(DISTINCT q) FROM r) - count(DISTINCT q) AS missing FROM r GROUP BY 1""",
    "answer_window": f"""{_TOK}, s AS (SELECT doc_id, w, greatest(0, least(coalesce(CASE WHEN doc_id % 3 <> 0 AND len(w) > 4 THEN doc_id * 7 % len(w) + 2 END, 2) - 650, len(w) - 1300)) AS start FROM d)
      SELECT doc_id, start::BIGINT AS start, md5(array_to_string(w[start + 1:start + 1300], ' ')) AS tokens FROM s""",
    "flatten_examples": "SELECT concat('t', item_id % 10) AS contract, text AS context, concat('q', item_id) AS id, concat('What is in ', item_id, '?') AS question, substr(text, 1, 9) AS answer FROM benchmark",
    "rendered_examples": """SELECT item_id, concat('Quote the part of the contract that answers the question, word for word. If there is none, say: No such clause', chr(10), chr(10), 'CONTRACT:', chr(10), text, chr(10), chr(10), 'QUESTION: Item ', item_id, chr(10), chr(10), 'ANSWER:') AS prompt,
      CASE WHEN item_id % 3 <> 0 AND trim(substr(text, 1, 20)) <> '' THEN substr(text, 1, 20) ELSE 'No such clause' END AS label FROM benchmark""",
    "extraction_scores": _EX + "SELECT k, precision, recall, f1, exact::INT AS exact, e AS no_answer FROM scored",
    "eval_aggregates": _EX + """SELECT round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1, round(avg(exact), 4) AS exact, round(avg(CASE WHEN e THEN (p AND e)::INT END), 4) AS no_answer_accuracy,
      round(avg(contains(c, x)::INT), 4) AS grounding_rate, round((SELECT avg(m) FROM (SELECT avg(f1) AS m FROM scored GROUP BY heading) z), 4) AS macro_f1 FROM scored""",
    "token_f1": _F1 + "SELECT k, precision, recall, f1, exact FROM scores",
    "eval_macro_f1": _F1 + "SELECT round(avg(f1), 4) AS f1, round(avg(exact), 4) AS exact, round((SELECT avg(c) FROM (SELECT avg(f1) AS c FROM scores GROUP BY heading) z), 4) AS macro_f1 FROM scores",
    "legal_gate": S.over_clauses(select="""SELECT chunk_id, CASE WHEN length(regexp_replace(text, '\\s', '', 'g')) < 200 THEN 'unreadable' WHEN regexp_matches(text, '(?i)\\b(?:shall|agree\\w*|law\\w*)\\b') THEN 'legal' ELSE 'not_legal' END AS gate
      FROM (SELECT chunk_id, CASE WHEN k % 4 = 0 THEN replace(text, 'shall', 'would') ELSE text END AS text FROM (SELECT * FROM clauses_a UNION ALL SELECT * FROM clauses_b) z) x"""),
    "lexical_search": f"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({_STEM.format("text")}) AS term FROM benchmark),
      it AS (SELECT conv_id * 1000 + turn AS id, unnest({_STEM.format("role")}) AS term, 2 AS pts FROM conversations UNION ALL SELECT conv_id * 1000 + turn, unnest({_STEM.format("text")}), 1 FROM conversations),
      s AS (SELECT query_id, id, sum(pts) AS score FROM q JOIN it USING (term) GROUP BY 1, 2)
      SELECT query_id, id, score::BIGINT AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) x WHERE rank <= 4""",
    "message_reassembly": "SELECT l_orderkey % 5 AS job, l_orderkey AS seq, string_agg(l_linenumber::VARCHAR, '' ORDER BY l_linenumber) AS message FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) x GROUP BY 1, 2 HAVING count(*) = 4",
    "live_upsert": "SELECT concat('p', user_id) AS pair_id, max(event_id) AS arrival_no, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id UNION ALL SELECT 'p-none', -1, 'PENDING'",
    "result_cache_key": "SELECT doc_id, sha256(concat(text, chr(0), lang, chr(0), source)) AS key FROM documents",
}
