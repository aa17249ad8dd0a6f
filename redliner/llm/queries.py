"""One query per operator of this subpackage, each over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redliner.llm import html_main, langid, lengths, lines, mixing, packing, quality, simhash, substrings, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(_table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(_table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_histogram(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = langid.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep_text=False)
    return docs.select("doc_id", "lang", "language", "language_share", "language_accepted")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evidence at once: main texts, the languages declared in the markup, and the addresses of pages."""
    pages = html_main.extract(_table(spark, sf_dir, "pages"), with_language=True)
    found = langid.identify(pages, "page_id", "text", "lang", host_col=None, url_col="url", keep_text=False)
    return found.select("page_id", "lang", "language", "language_share", "language_accepted")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_line_dedup": op4_line_dedup,
        "op5_html_main": op5_html_main,
        "op6_token_counts": op6_token_counts,
        "op7_language_id": op7_language_id,
        "language_id_pages": language_id_pages,
        "op8_quality": op8_quality,
        "op9_mixing": op9_mixing,
        "op10_packing": op10_packing,
    }


LINE_DEDUP = r"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT row_no, doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS line_no FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
frequent AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row_no, doc_id
"""


#: Slot by slot: the released block with the earliest deadline, ties to the first source.
MIXING = """
WITH RECURSIVE
numbered AS (SELECT *, coalesce('s:' || source, 'null') AS q, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS n_at FROM documents),
shares AS (SELECT q, count(*) AS n, greatest(1, floor(1000 * pow(count(*), 0.5) + 0.5))::BIGINT AS share FROM numbered GROUP BY q),
queues AS (SELECT q, n, CASE WHEN s.every <= 1000000 THEN share ELSE greatest(1, (2 * share * 1000000 + s.every) // (2 * s.every)) END::BIGINT AS parts
           FROM shares, (SELECT sum(share)::BIGINT AS every FROM shares) s),
total AS (SELECT sum(parts)::BIGINT AS m FROM queues),
every AS (SELECT list(q ORDER BY q) AS qs, list(parts ORDER BY q) AS ws, any_value(m) AS m, least(any_value(m), max((((n + 31) // 32) * m + parts - 1) // parts)) AS slots FROM queues, total),
steps AS (
  SELECT -1::BIGINT AS t, list_transform(ws, lambda x: 0::BIGINT) AS served, 0::BIGINT AS p, 0::BIGINT AS k FROM every
  UNION ALL
  SELECT t, list_transform(served, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), p, served[p] FROM (
    SELECT t + 1 AS t, served, list_min(list_transform(
        list_filter(range(1, len(ws) + 1), lambda i: served[i] < ws[i] AND (served[i] * m) // ws[i] <= t + 1),
        lambda i: (((served[i] + 1) * m + ws[i] - 1) // ws[i]) * 1000000 + i)) % 1000000 AS p
    FROM steps, every WHERE t + 1 < slots) x),
slots AS (SELECT t, qs[p] AS q, ws[p] AS w, m, k FROM steps, every WHERE t >= 0),
placed AS (SELECT n.*, n.n_at // 32 AS b, s.w, s.m, s.t FROM numbered n JOIN queues u ON u.q = n.q JOIN slots s ON s.q = n.q AND s.k = (n.n_at // 32) % u.parts)
SELECT doc_id, source, b::BIGINT AS mix_block, ((b * m) // w)::BIGINT AS mix_release, (((b + 1) * m + w - 1) // w)::BIGINT AS mix_deadline,
       ((b // w) * m + t)::BIGINT AS mix_slot, (((b // w) * m + t) * 32 + n_at % 32)::BIGINT AS mix_position
FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": LINE_DEDUP, "op9_mixing": MIXING}
