"""Text functions, sentences, duties and alignment over the sample contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redliner.functions import text as T
from redliner.operators import align as A
from redliner.operators import deontic as D
from redliner.plans.compare import with_places
from redliner.plans.samples import both, table
from redliner.queries import sqltext as S
from redliner.sources.files import kept


def listed(column: str, by: str = ",") -> F.Column:
    return F.coalesce(F.array_join(column, by), F.lit("")).alias(column)


def _every(spark: SparkSession, sf: str) -> DataFrame:
    """The clauses of both versions."""
    a, b = both(spark, sf)
    return a.unionByName(b).select("chunk_id", "text")


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


def formatting_key(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both(spark, sf)
    keys = T.formatting_key(F.col("text")).alias("fkey")
    return a.select("k", keys).join(b.select("k", keys), ["k", "fkey"]).groupBy("k").agg(F.min(F.md5("fkey")).alias("fkey"))


def numeric_diff(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both(spark, sf)
    pairs = a.select("k", F.col("text").alias("x")).join(b.select("k", F.col("text").alias("y")), "k")
    d = T.numeric_diff(F.col("x"), F.col("y"))
    return pairs.select("k", F.array_join(d["only_in_source"], ",").alias("only_in_source"), F.array_join(d["only_in_target"], ",").alias("only_in_target"))


def number_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of the new version that the old one does not have: a summary may not state them of the old one."""
    a, b = both(spark, sf)
    pairs = b.select("k", F.col("text").alias("x")).join(a.select("k", F.col("text").alias("y")), "k")
    missing = F.sort_array(F.array_except(T.number_cores(F.col("x")), T.number_cores(F.col("y"))))
    return pairs.select("k", F.array_join(missing, ",").alias("missing")).where("missing <> ''")


def cut_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.cut(F.col("text"), 300).alias("cut"))


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    found = D.sentences(_every(spark, sf))
    return found.select("chunk_id", F.col("sentence_no").cast("long").alias("sentence_no"), "sentence", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_"))


def sentence_split_documents(spark: SparkSession, sf: str) -> DataFrame:
    return D.sentences(table(spark, sf, "documents").select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"))


def deontic_labels(spark: SparkSession, sf: str) -> DataFrame:
    found = D.tagged(_every(spark, sf))
    return found.select("chunk_id", F.col("sentence_no").cast("long").alias("sentence_no"), "sentence", "label", "ambiguous")


def deontic_profile(spark: SparkSession, sf: str) -> DataFrame:
    found = D.profiles(D.tagged(_every(spark, sf)), "chunk_id")
    return found.select("chunk_id", "prohibitions", "obligations", "permissions", "primary_label", listed("labels"))


def topk_similarity_join(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both(spark, sf)
    return A.candidates(a, b).select("source_id", "target_id", "score", F.col("rank").cast("long").alias("rank"))


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    return A.align(*both(spark, sf))


def align_documents(spark: SparkSession, sf: str) -> DataFrame:
    return aligned(spark, sf).select(
        "contract_id", "source_id", "best_score", "status", "verdict", "target_id", "candidate_id", "decided_by",
        F.coalesce(F.array_join("numeric_diff.only_in_source", ","), F.lit("")).alias("only_in_source"),
        F.coalesce(F.array_join("numeric_diff.only_in_target", ","), F.lit("")).alias("only_in_target"),
    )


def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aligned(spark, sf).groupBy("contract_id").agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in A.VERDICTS])


def structural_match(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both(spark, sf)
    found = A.judged(a, b, A.candidates(a, b))
    return found.select("source_id", "target_id", "structural", "exact", "same_key", "verdict", "decided_by")


def added_chunks(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both(spark, sf)
    return A.added(A.align(a, b), b).select("contract_id", "chunk_id")


def removed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return A.removed(aligned(spark, sf)).select("contract_id", "source_id", "status")


def changed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both(spark, sf)
    return A.changed_pairs(A.align(a, b), b)


def threshold_calibration(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both(spark, sf)
    scores = A.best_scores(A.candidates(a, b), a)
    cuts = F.percentile("score", F.array(*[F.lit(x) for x in (0.1, 0.5, 0.9)]))
    return scores.agg(F.count("*").alias("n"), F.count_if(F.col("score") >= A.GATE).alias("n_pass"), F.min("score").alias("low"), F.max("score").alias("high"), cuts.alias("p")).select(
        "n", "n_pass", "low", "high", F.round(F.col("p")[0], 5).alias("p10"), F.round(F.col("p")[1], 5).alias("p50"), F.round(F.col("p")[2], 5).alias("p90")
    )


def kept_pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The alignment, its changed pairs and the clauses of both versions with their places, written once: what follows reads them many times."""
    a, b = (kept(with_places(x), "clauses") for x in both(spark, sf))
    found = kept(A.align(a, b), "aligned")
    return found, kept(A.changed_pairs(found, b), "pairs"), a, b


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    _, pairs, a, b = kept_pairs(spark, sf)
    return D.shifts(pairs, a, b)


def deontic_shift(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf).select("pair_id", "contract_id", "change_status", "primary_label", "shift", listed("labels_added"), listed("labels_removed"), "has_deontic_change")


def deontic_summary(spark: SparkSession, sf: str) -> DataFrame:
    return D.summary(_enriched(spark, sf))


def match_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates that are left of each source when an equivalent first one ends the search."""
    a, b = both(spark, sf)
    return A.early_exit(A.judged(a, b, A.candidates(a, b))).select("source_id", "target_id", F.col("rank").cast("long").alias("rank"), "verdict")


def given_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates from a matrix of scores that lacks some pairs of every third contract."""
    a, b = both(spark, sf)
    scores = a.select("contract_id", F.col("chunk_id").alias("source_id"), F.col("k").alias("ka")).join(b.select("contract_id", F.col("chunk_id").alias("target_id"), F.col("k").alias("kb")), "contract_id")
    scores = scores.where(~((F.col("contract_id") % 3 == 0) & (F.col("ka") == F.col("kb")))).select("source_id", "target_id", F.round(1 / (1 + F.abs(F.col("ka") - F.col("kb")) % 97), 6).alias("score"))
    return A.checked_scores(scores, a, b, 2).select("source_id", "target_id", "score", F.col("rank").cast("long").alias("rank"))


def parse_verdict(spark: SparkSession, sf: str) -> DataFrame:
    raw = _raw_answers(spark, sf)
    v = A.parse_verdict(F.col("raw"))
    return raw.select("k", v["verdict"].alias("verdict"), v["change_type"].alias("change_type"))


RAW = """
  SELECT o_orderkey AS k, CASE o_orderkey % 8
    WHEN 0 THEN concat('Sure. {"alignment_result": "MODIFIED", "change_type": " amount ', cast(o_custkey AS string), '"} done')
    WHEN 1 THEN '{"alignment_result": "no_match", "change_type": "x"}' WHEN 2 THEN 'The clauses are equivalent.'
    WHEN 3 THEN 'EQUIVALENT | MODIFIED | NO_MATCH' WHEN 4 THEN 'No match' WHEN 5 THEN '{"alignment_result": "MODIFIED", "change_type": "<CHANGE>"}'
    WHEN 6 THEN '{broken MODIFIED' ELSE '' END AS raw
  FROM orders"""


def _raw_answers(spark: SparkSession, sf: str) -> DataFrame:
    sql = RAW.replace("{", "{{").replace("}", "}}").replace("FROM orders", "FROM {orders}")
    return spark.sql(sql, orders=table(spark, sf, "orders"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, formatting_key, numeric_diff, number_grounding, cut_text, sentence_split, sentence_split_documents, deontic_labels,
        deontic_profile, topk_similarity_join, align_documents, verdict_counts, structural_match, added_chunks, removed_chunks, changed_pairs,
        threshold_calibration, deontic_shift, deontic_summary, match_lists, given_scores, parse_verdict,
    )
}
_SENTS = "every_ AS (SELECT chunk_id, text FROM clauses_a UNION ALL SELECT chunk_id, text FROM clauses_b)," + S.sentences("every_", "chunk_id", "sents")
_TAGGED = f"""{_SENTS}, plain AS (SELECT * FROM sents WHERE NOT regexp_matches(sentence, {S.quoted("(?i)" + S.D.DEFINITION)})),
{S.labels("plain", "labelled")}"""
_COUNTS = """SELECT chunk_id, count(*) FILTER (WHERE label = 'PROHIBITION') AS prohibitions, count(*) FILTER (WHERE label = 'OBLIGATION') AS obligations,
  count(*) FILTER (WHERE label = 'PERMISSION') AS permissions FROM labelled WHERE label IS NOT NULL GROUP BY chunk_id"""
SQL = {
    "normalize_text": f"SELECT doc_id, {S.norm('text')} AS norm FROM documents",
    "formatting_key": S.over_clauses(select=f"SELECT a.k, min(md5({S.key('a.text')})) AS fkey FROM clauses_a a JOIN clauses_b b ON a.k = b.k AND {S.key('a.text')} = {S.key('b.text')} GROUP BY a.k"),
    "numeric_diff": S.over_clauses(select=f"SELECT a.k, {S.joined(S.minus(S.numbers('a.text'), S.numbers('b.text')))} AS only_in_source, {S.joined(S.minus(S.numbers('b.text'), S.numbers('a.text')))} AS only_in_target FROM clauses_a a JOIN clauses_b b USING (k)"),
    "number_grounding": S.over_clauses(select=f"SELECT * FROM (SELECT a.k, {S.joined(S.minus(S.cores('b.text'), S.cores('a.text')))} AS missing FROM clauses_a a JOIN clauses_b b USING (k)) x WHERE missing <> ''"),
    "cut_text": f"SELECT doc_id, CASE WHEN length(n) <= 300 THEN n ELSE concat(regexp_replace(left(n, 300), ' [^ ]*$', ''), ' ...') END AS cut FROM (SELECT doc_id, {S.norm('text')} AS n FROM documents) x",
    "sentence_split": S.over_clauses(_SENTS, select="SELECT chunk_id, sentence_no, sentence, start::BIGINT AS start, end_::BIGINT AS end_ FROM sents"),
    "sentence_split_documents": f"WITH {S.sentences('documents', 'doc_id', 'sents')} SELECT doc_id, count(*) AS n_sentences, sum(length(sentence))::BIGINT AS n_chars FROM sents GROUP BY doc_id",
    "deontic_labels": S.over_clauses(_TAGGED, select="SELECT chunk_id, sentence_no, sentence, label, ambiguous FROM labelled WHERE label IS NOT NULL"),
    "deontic_profile": S.over_clauses(_TAGGED, select=f"""SELECT *, CASE WHEN prohibitions >= obligations AND prohibitions >= permissions THEN 'PROHIBITION' WHEN obligations >= permissions THEN 'OBLIGATION' ELSE 'PERMISSION' END AS primary_label,
      concat_ws(',', CASE WHEN prohibitions > 0 THEN 'PROHIBITION' END, CASE WHEN obligations > 0 THEN 'OBLIGATION' END, CASE WHEN permissions > 0 THEN 'PERMISSION' END) AS labels FROM ({_COUNTS}) x"""),
    "topk_similarity_join": S.over_clauses(S.ALIGN, select="SELECT source_id, target_id, score, rank FROM cand"),
    "align_documents": S.over_clauses(S.ALIGN, select=f"SELECT contract_id, source_id, best_score, status, verdict, target_id, candidate_id, decided_by, {S.joined('only_in_source')} AS only_in_source, {S.joined('only_in_target')} AS only_in_target FROM aligned"),
    "verdict_counts": S.over_clauses(S.ALIGN, select="SELECT contract_id, " + ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v.lower()}" for v in A.VERDICTS) + " FROM aligned GROUP BY contract_id"),
    "structural_match": S.over_clauses(S.ALIGN, select="SELECT source_id, target_id, structural, exact, same_key, verdict, decided_by FROM judged"),
    "added_chunks": S.over_clauses(S.ALIGN, select="SELECT contract_id, chunk_id FROM added"),
    "removed_chunks": S.over_clauses(S.ALIGN, select="SELECT contract_id, source_id, status FROM aligned WHERE verdict = 'NO_MATCH'"),
    "changed_pairs": S.over_clauses(S.ALIGN, select="SELECT pair_id, contract_id, change_status, source_id, target_id FROM pairs"),
    "threshold_calibration": S.over_clauses(S.ALIGN, select="""SELECT count(*) AS n, count(*) FILTER (WHERE s >= 0.55) AS n_pass, min(s) AS low, max(s) AS high, round(quantile_cont(s, 0.1), 5) AS p10,
      round(quantile_cont(s, 0.5), 5) AS p50, round(quantile_cont(s, 0.9), 5) AS p90 FROM (SELECT coalesce(best_score, 0.0) AS s FROM aligned) x"""),
    "deontic_shift": S.over_clauses(S.ALIGN, S.DUTIES, select="""SELECT pair_id, contract_id, change_status, primary_label, shift, labels_added, labels_removed,
      shift IS NOT NULL OR labels_added <> '' OR labels_removed <> '' AS has_deontic_change FROM shifts"""),
    "deontic_summary": S.over_clauses(S.ALIGN, S.DUTIES, select="""SELECT change_status, primary_label, count(*) AS n_pairs,
      count(*) FILTER (WHERE shift IS NOT NULL OR labels_added <> '' OR labels_removed <> '') AS n_duty_changes FROM shifts GROUP BY 1, 2"""),
    "match_lists": S.over_clauses(S.ALIGN, "e AS (SELECT source_id, target_id, rank, verdict, decided_by, bool_or(rank = 1 AND verdict = 'EQUIVALENT') OVER (PARTITION BY source_id) AS done FROM judged)",
      select="SELECT source_id, target_id, rank, verdict FROM e WHERE NOT done OR decided_by <> 'model' OR rank = 1"),
    "given_scores": S.over_clauses(S.ALIGN, "m AS (SELECT a.contract_id, a.chunk_id AS source_id, b.chunk_id AS target_id, b.ordinal AS o, round(1 / (1 + abs(a.k - b.k) % 97)::DOUBLE, 6) AS score, a.contract_id % 3 = 0 AND a.k = b.k AS gap FROM clauses_a a JOIN clauses_b b USING (contract_id))",
      "holes AS (SELECT DISTINCT contract_id FROM m WHERE gap)",
      "g AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, o) AS rank FROM m WHERE contract_id NOT IN (SELECT contract_id FROM holes))",
      select="SELECT source_id, target_id, score, rank FROM g WHERE rank <= 2 UNION ALL SELECT source_id, target_id, score, rank FROM cand WHERE rank <= 2 AND contract_id IN (SELECT contract_id FROM holes)"),
    "parse_verdict": f"""WITH raw AS ({RAW}),
      parsed AS (SELECT *, regexp_extract(raw, '(?s)(\\{{.*?\\}})', 1) AS blob FROM raw),
      named AS (SELECT *, CASE WHEN json_valid(blob) THEN upper(trim(json_extract_string(blob, '$.alignment_result'))) END AS v,
                       CASE WHEN json_valid(blob) THEN trim(coalesce(json_extract_string(blob, '$.change_type'), '')) END AS c,
                       list_distinct(list_filter(regexp_extract_all(replace(upper(raw), 'NO MATCH', 'NO_MATCH'), '[A-Z_]+'), lambda y: y IN ('EQUIVALENT', 'MODIFIED', 'NO_MATCH'))) AS hits FROM parsed)
      SELECT k, CASE WHEN v IN ('EQUIVALENT', 'MODIFIED', 'NO_MATCH') THEN v WHEN len(hits) = 1 THEN hits[1] ELSE 'UNKNOWN' END AS verdict,
             CASE WHEN v = 'MODIFIED' AND upper(c) <> '<CHANGE>' THEN c ELSE '' END AS change_type FROM named""",
}
