"""Categories, parties, views, routing and report layers over the sample contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redliner.operators import impact as I
from redliner.operators import ontology as O
from redliner.operators import report as R
from redliner.plans import compare
from redliner.plans.samples import both, clauses, table
from redliner.queries import sqltext as S
from redliner.queries.compare import kept_pairs
from redliner.sources.files import kept


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    found, pairs, a, b = kept_pairs(spark, sf)
    return kept(compare.changes_of(a, b, found, pairs), "changes")


def only_changes(spark: SparkSession, sf: str, *wanted: str) -> DataFrame:
    """These columns of the changes, for what reads them once: they are not written first."""
    found, pairs, a, b = kept_pairs(spark, sf)
    return compare.changes_of(a, b, found, pairs, wanted)


def _every(spark: SparkSession, sf: str) -> DataFrame:
    """The clauses of both versions."""
    a, b = both(spark, sf)
    return a.unionByName(b)


def _pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    _, pairs, a, b = kept_pairs(spark, sf)
    return pairs, a, b


def detect_categories(spark: SparkSession, sf: str) -> DataFrame:
    return O.detect_categories(_every(spark, sf), "chunk_id")


def stakeholders(spark: SparkSession, sf: str) -> DataFrame:
    found = O.detect_categories(_every(spark, sf), "chunk_id")
    return O.stakeholders_for(found, "chunk_id", O.ontology(spark))


def find_parties(spark: SparkSession, sf: str) -> DataFrame:
    return _every(spark, sf).select("chunk_id", F.array_join(O.find_parties(F.col("text")), ",").alias("parties"))


def contract_parties(spark: SparkSession, sf: str) -> DataFrame:
    every = _every(spark, sf).withColumn("version", F.split_part("chunk_id", F.lit("_"), F.lit(2))).withColumn("document_id", F.concat("contract_id", F.lit("_"), "version"))
    return O.contract_parties(every, "document_id").select("document_id", F.array_join("parties", ",").alias("parties"))


NAMES = """SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN 'the Licensees' WHEN 1 THEN 'Licensor / provider' WHEN 2 THEN 'each party' WHEN 3 THEN 'Inc.'
  WHEN 4 THEN '"subsidiaries"' WHEN 5 THEN '' WHEN 6 THEN 'Echo Therapeutics' WHEN 7 THEN 'business' ELSE ' [employees]; ' END AS name FROM orders"""


def normalize_parties(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(NAMES.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))
    return rows.select("k", O.normalize_party(F.col("name")).alias("party"))


def changed_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return I.changed_sentences(*_pairs(spark, sf))


def neighbor_context(spark: SparkSession, sf: str) -> DataFrame:
    pairs, a, _ = _pairs(spark, sf)
    return I.neighbor_context(pairs, a, "source_id", 1)


def trivial_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of clauses, some of them heading and little else."""
    a, b = both(spark, sf)
    short = F.when(F.col("k") % 4 == 0, F.concat(F.lit("  "), "heading", F.lit(" applies. "))).when(F.col("k") % 4 == 1, F.concat("heading", F.lit(" "), F.repeat(F.lit("x"), F.pmod("k", F.lit(80)).cast("int")))).otherwise(F.col("text"))
    rows = a.select("k", "heading", short.alias("x")).join(b.select("k", short.alias("y")), "k", "full")
    return rows.select("k", I.is_trivial(F.coalesce("heading", F.lit("")), F.col("x"), F.col("y")).alias("trivial"))


def unsupported_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each clause's new version with no family in the old one."""
    a, b = both(spark, sf)
    rows = b.select("k", F.col("text").alias("x")).join(a.select("k", F.col("text").alias("y")), "k")
    return rows.select("k", F.array_join(I.unsupported_words(F.col("x"), F.col("y")), ",").alias("unsupported"))


DRAFTS = """SELECT concat('p', cast(o_orderkey AS string)) AS pair_id, j AS attempt, CASE WHEN (o_orderkey + j) % 4 = 0 THEN 1 ELSE 0 END AS n_issues,
  CASE (o_orderkey div 4 + j) % 4 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'HALLUCINATION' WHEN 2 THEN 'MISSING_CONTEXT' ELSE 'UNKNOWN' END AS critic, concat('r', cast(j AS string)) AS reason"""


def route_attempts(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(f"{DRAFTS} FROM {{orders}} LATERAL VIEW explode(array(1, 2)) t AS j", orders=table(spark, sf, "orders"))
    return I.route(rows)


def report_order(spark: SparkSession, sf: str) -> DataFrame:
    return only_changes(spark, sf, "contract_id", "pair_id", "change_id", "place").withColumn("place", F.round("place", 6))


def key_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return only_changes(spark, sf, "pair_id", "key_old", "key_new").select("pair_id", F.array_join("key_old", ",").alias("key_old"), F.array_join("key_new", ",").alias("key_new"))


def importance(spark: SparkSession, sf: str) -> DataFrame:
    return only_changes(spark, sf, "pair_id", "importance", "why")


def overview(spark: SparkSession, sf: str) -> DataFrame:
    found, pairs, a, b = kept_pairs(spark, sf)
    unchanged = found.groupBy("contract_id").agg(F.count_if(F.col("verdict") == "EQUIVALENT").alias("unchanged_clauses"))
    return R.overview(kept(compare.changes_of(a, b, found, pairs), "changes"), unchanged=unchanged)


def highlights(spark: SparkSession, sf: str) -> DataFrame:
    return R.highlights(_changes(spark, sf)).select("contract_id", "rank", "change_id", "importance")


def by_stakeholder(spark: SparkSession, sf: str) -> DataFrame:
    a, _ = both(spark, sf)
    return R.by_stakeholder(_changes(spark, sf), O.contract_parties(a, "contract_id"))


def by_section(spark: SparkSession, sf: str) -> DataFrame:
    return R.by_section(_changes(spark, sf))


def markdown_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = _changes(spark, sf)
    return R.markdown(rows, R.overview(rows), stakeholders=R.by_stakeholder(rows, O.contract_parties(clauses(spark, sf, "a"), "contract_id")))


def index_by_page(spark: SparkSession, sf: str) -> DataFrame:
    a = clauses(spark, sf, "a").select(F.col("contract_id").alias("document_id"), F.format_string("C%09d", "k").alias("change_id"), (F.floor(F.col("ordinal") / 3) + 1).cast("int").alias("page_start"))
    return R.index_by_page(a.withColumn("page_end", F.when(F.col("page_start") % 2 == 0, F.col("page_start") + 1)))


def ui_rows(spark: SparkSession, sf: str) -> DataFrame:
    pairs, a, b = _pairs(spark, sf)
    return R.ui_rows(pairs, a, b).select("pair_id", "ui", "source_heading", "target_heading", F.md5(F.concat_ws("|", "source_text", "target_text")).alias("texts"))


def review_facet(spark: SparkSession, sf: str) -> DataFrame:
    pairs, a, b = _pairs(spark, sf)
    rows = R.ui_rows(pairs.withColumn("needs_review", F.col("change_status") == "UNVERIFIED"), a, b)
    return R.facets(rows, "review").unionByName(R.facets(rows, "missing_in_a")).select("pair_id", "ui")


def facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    pairs, _, _ = _pairs(spark, sf)
    return R.facet_counts(pairs.withColumn("ui", R.ui_status(F.col("change_status"))).withColumn("needs_review", F.col("change_status") == "UNVERIFIED"))


QUERIES = {
    f.__name__: f
    for f in (
        detect_categories, stakeholders, find_parties, contract_parties, normalize_parties, changed_sentences, neighbor_context, trivial_filter,
        unsupported_words, route_attempts, report_order, key_numbers, importance, overview, highlights, by_stakeholder, by_section,
        markdown_report, index_by_page, ui_rows, review_facet, facet_counts,
    )
}

_HITS = " UNION ALL ".join(
    f"SELECT chunk_id, {S.quoted(c)} AS category, {i} AS ord, " + " + ".join(f"contains(low, {S.quoted(w)})::INT" for w in ks) + " AS hits FROM low"
    for i, (c, ks, _) in enumerate(O.CATEGORIES)
    if ks
)
_EVERY = "every_ AS (SELECT * FROM clauses_a UNION ALL SELECT * FROM clauses_b)"
_CATEGORIES = f"""{_EVERY}, low AS (SELECT chunk_id, {S.norm("lower(text)")} AS low FROM every_), hits AS ({_HITS}),
cats AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY hits DESC, ord) AS rank FROM hits WHERE hits > 0) x WHERE rank <= 3)"""
_WHO = "VALUES " + ", ".join(f"({S.quoted(c)}, {n}, {S.quoted(s)})" for c, _, ss in O.CATEGORIES for n, s in enumerate(ss))


def _parties(text: str, table: str, keys: str) -> str:
    named = ", ".join(f"CASE WHEN regexp_matches(lower({text}), {S.quoted(chr(92) + 'b' + r + '(?:s|es)?' + chr(92) + 'b')}) THEN {S.quoted(r.title())} END" for r in O.ROLES)
    both_ = f"CASE WHEN regexp_matches({text}, {S.quoted(O.BOTH_PARTIES.replace('(?i)', '(?i)', 1))}) THEN 'Both parties' END"
    return f"SELECT {keys}, list_filter([{named}, {both_}], lambda y: y IS NOT NULL) AS parties FROM {table}"


_FIRST = "firsts AS (SELECT * FROM clauses_a WHERE ordinal = 1)"
_CPARTIES = f"{_FIRST}, cparties AS (SELECT contract_id, list_filter(parties, lambda y: y <> 'Both parties') AS parties FROM ({_parties('text', 'firsts', 'contract_id')}) x)"
_KEYNUM = "list_filter({0}, lambda y: contains(y, '$') OR contains(y, '%') OR (NOT regexp_full_match(y, '\\d+\\.\\d+') AND regexp_matches(txt, concat('(?i)(^|[^\\d.,])', regexp_escape(y), " + S.quoted(R.UNIT) + "))))"
CHANGES = f"""
ev AS (
  SELECT s.*, concat_ws(' ', a.text, b.text) AS txt, coalesce(b.heading, a.heading) AS heading,
         CASE WHEN x.target_id IS NOT NULL THEN x.only_in_source ELSE [] END AS old_n, CASE WHEN x.target_id IS NOT NULL THEN x.only_in_target ELSE [] END AS new_n
  FROM shifts s LEFT JOIN aligned x ON x.source_id = s.source_id LEFT JOIN clauses_a a ON a.chunk_id = s.source_id LEFT JOIN clauses_b b ON b.chunk_id = s.target_id),
keyed AS (SELECT *, {_KEYNUM.format("old_n")} AS key_old, {_KEYNUM.format("new_n")} AS key_new FROM ev),
placed AS (
  SELECT k.*, coalesce((b.ordinal - 1)::DOUBLE / nb.n, (a.ordinal - 1)::DOUBLE / na.n, 2.0) AS place, k.change_status = 'UNVERIFIED' AS needs_review,
    (CASE WHEN shift IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN contains(labels_removed, 'OBLIGATION') OR contains(labels_removed, 'PROHIBITION') THEN 2 ELSE 0 END
     + CASE WHEN labels_added <> '' THEN 1 ELSE 0 END + CASE WHEN len(key_old) + len(key_new) > 0 THEN 3 ELSE 0 END
     + CASE WHEN k.change_status IN ('ADDED', 'DELETED') AND (labels_added <> '' OR labels_removed <> '') THEN 1 ELSE 0 END) AS importance,
    concat_ws('; ', 'duty shift ' || shift,
      CASE WHEN len(key_old) + len(key_new) > 0 THEN concat('numbers ', CASE WHEN len(key_old) > 0 THEN array_to_string(key_old, ', ') ELSE '-' END, ' -> ', CASE WHEN len(key_new) > 0 THEN array_to_string(key_new, ', ') ELSE '-' END) END,
      CASE WHEN labels_removed <> '' AND shift IS NULL THEN concat('removes ', lower(replace(labels_removed, ',', '/'))) END,
      CASE WHEN labels_added <> '' AND shift IS NULL THEN concat('adds ', lower(replace(labels_added, ',', '/'))) END) AS why
  FROM keyed k LEFT JOIN clauses_b b ON b.chunk_id = k.target_id LEFT JOIN clauses_a a ON a.chunk_id = k.source_id
  LEFT JOIN (SELECT contract_id, count(*) AS n FROM clauses_b GROUP BY 1) nb ON nb.contract_id = b.contract_id
  LEFT JOIN (SELECT contract_id, count(*) AS n FROM clauses_a GROUP BY 1) na ON na.contract_id = a.contract_id),
changes AS (
  SELECT *, concat('C', lpad(change_no::VARCHAR, 3, '0')) AS change_id FROM (
    SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY place, pair_id) AS change_no FROM placed) x)"""
_ALL = (S.ALIGN, S.DUTIES, CHANGES)
SQL = {
    "detect_categories": S.over_clauses(_CATEGORIES, select="SELECT chunk_id, category, ord, hits, rank::INT AS rank FROM cats"),
    "stakeholders": S.over_clauses(_CATEGORIES, f"who(category, n, stakeholder) AS ({_WHO})", select="""SELECT chunk_id, stakeholder, (row_number() OVER (PARTITION BY chunk_id ORDER BY first))::INT AS pos
      FROM (SELECT chunk_id, stakeholder, min(rank * 100 + n) AS first FROM cats JOIN who USING (category) GROUP BY 1, 2) x"""),
    "find_parties": S.over_clauses(_EVERY, select=f"SELECT chunk_id, {S.joined('parties')} AS parties FROM ({_parties('text', 'every_', 'chunk_id')}) x"),
    "contract_parties": S.over_clauses("firsts2 AS (SELECT concat(contract_id, '_A') AS document_id, text FROM clauses_a WHERE ordinal = 1 UNION ALL SELECT concat(contract_id, '_B'), text FROM clauses_b WHERE ordinal = 1)",
      f"cp2 AS (SELECT document_id, list_filter(parties, lambda y: y <> 'Both parties') AS parties FROM ({_parties('text', 'firsts2', 'document_id')}) x)", select=f"SELECT document_id, {S.joined('parties')} AS parties FROM cp2"),
    "normalize_parties": """SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN 'Licensee' WHEN 1 THEN 'Licensor' WHEN 2 THEN 'Both parties' WHEN 3 THEN NULL
      WHEN 4 THEN 'Subsidiary' WHEN 5 THEN NULL WHEN 6 THEN 'Echo Therapeutics' WHEN 7 THEN 'Business' ELSE 'Employee' END AS party FROM orders""",
    "changed_sentences": S.over_clauses(S.ALIGN, "two AS (SELECT * FROM pairs WHERE source_id IS NOT NULL AND target_id IS NOT NULL)",
      "sides2 AS (SELECT pair_id, 'source' AS side, text FROM two JOIN clauses_a ON chunk_id = source_id UNION ALL SELECT pair_id, 'target', text FROM two JOIN clauses_b ON chunk_id = target_id)",
      S.sentences("sides2", "pair_id, side", "s2"),
      f"n2 AS (SELECT *, {S.norm('lower(sentence)')} AS t FROM s2)",
      select=f"""SELECT pair_id, side, {S.norm("sentence")} AS sentence, pos::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY sentence_no) AS pos FROM n2 x
        WHERE NOT EXISTS (SELECT 1 FROM n2 y WHERE y.pair_id = x.pair_id AND y.side <> x.side AND y.t = x.t)) z WHERE pos <= 3"""),
    "neighbor_context": S.over_clauses(S.ALIGN, select="""SELECT p.pair_id, n.chunk_id AS neighbor_id, (n.ordinal - c.ordinal)::INT AS "offset" FROM pairs p JOIN clauses_a c ON c.chunk_id = p.source_id
      JOIN clauses_a n ON n.contract_id = c.contract_id AND n.ordinal BETWEEN c.ordinal - 1 AND c.ordinal + 1 AND n.ordinal <> c.ordinal"""),
    "trivial_filter": S.over_clauses(
      "x AS (SELECT k, heading, CASE WHEN k % 4 = 0 THEN concat('  ', heading, ' applies. ') WHEN k % 4 = 1 THEN concat(heading, ' ', repeat('x', (k % 80)::INT)) ELSE text END AS t FROM clauses_a)",
      "y AS (SELECT k, CASE WHEN k % 4 = 0 THEN concat('  ', heading, ' applies. ') WHEN k % 4 = 1 THEN concat(heading, ' ', repeat('x', (k % 80)::INT)) ELSE text END AS t FROM clauses_b)",
      "z AS (SELECT coalesce(x.k, y.k) AS k, coalesce(heading, '') AS h, trim(x.t) AS a, trim(y.t) AS b FROM x FULL JOIN y ON x.k = y.k)",
      select="""SELECT k, coalesce(length(trim(CASE WHEN h <> '' AND starts_with(a, h) THEN substr(a, length(h) + 1) ELSE a END)) < 40, true) AND coalesce(length(trim(CASE WHEN h <> '' AND starts_with(b, h) THEN substr(b, length(h) + 1) ELSE b END)) < 40, true) AS trivial FROM z"""),
    "unsupported_words": S.over_clauses(f"""w AS (SELECT a.k, list_distinct(regexp_extract_all(lower(a.text), '[a-z]+')) || {I.FREE_WORDS} AS known, regexp_extract_all(lower(b.text), '[a-z]+') AS asked FROM clauses_a a JOIN clauses_b b USING (k)),
      u AS (SELECT k, known, unnest(asked) AS x, unnest(range(len(asked))) AS i FROM w),
      f AS (SELECT k, x, min(i) AS i FROM u WHERE length(x) >= 3 AND NOT (length(x) = 3 AND x IN ({", ".join(map(S.quoted, I.SHORT_STOP))})) AND NOT list_contains(known, x)
            AND len(list_filter(known, lambda v: least(5, length(x), length(v)) >= 3 AND left(x, least(5, length(x), length(v))) = left(v, least(5, length(x), length(v))))) = 0 GROUP BY k, x)""",
      select="SELECT w.k, coalesce(string_agg(x, ',' ORDER BY i), '') AS unsupported FROM w LEFT JOIN f USING (k) GROUP BY w.k"),
    "route_attempts": f"""WITH d AS ({DRAFTS.replace(" div ", " // ")} FROM orders, (VALUES (1), (2)) t(j)),
      v AS (SELECT *, CASE WHEN n_issues > 0 THEN 'HALLUCINATION' ELSE critic END AS verdict FROM d),
      r AS (SELECT a.pair_id, a.verdict AS v1, CASE WHEN a.verdict IN ('VERIFIED', 'UNKNOWN') THEN a.verdict ELSE b.verdict END AS v,
                   CASE WHEN a.verdict IN ('VERIFIED', 'UNKNOWN') THEN 1 ELSE 2 END AS n FROM v a JOIN v b ON a.pair_id = b.pair_id AND a.attempt = 1 AND b.attempt = 2)
      SELECT pair_id, CASE WHEN v = 'VERIFIED' THEN 'VERIFIED' ELSE 'LOW_CONFIDENCE' END AS status, CASE WHEN v = 'VERIFIED' THEN 'HIGH' ELSE 'LOW' END AS confidence, v AS final_verdict,
             CASE WHEN v = 'UNKNOWN' THEN 'the critic''s answer was unreadable' WHEN v = 'VERIFIED' THEN concat('r', n::VARCHAR) ELSE concat('rejected ', n::VARCHAR, ' times (', v, '): r', n::VARCHAR) END AS reason,
             n AS attempts, CASE WHEN n = 2 AND v1 = 'MISSING_CONTEXT' THEN 1 ELSE 0 END AS context_level FROM r""",
    "report_order": S.over_clauses(*_ALL, select="SELECT contract_id, pair_id, change_id, round(place, 6) AS place FROM changes"),
    "key_numbers": S.over_clauses(*_ALL, select=f"SELECT pair_id, {S.joined('key_old')} AS key_old, {S.joined('key_new')} AS key_new FROM changes"),
    "importance": S.over_clauses(*_ALL, select="SELECT pair_id, importance, why FROM changes"),
    "overview": S.over_clauses(*_ALL, """o AS (SELECT contract_id, count(*) AS total_changes, count(*) FILTER (WHERE change_status = 'MODIFIED') AS modified, count(*) FILTER (WHERE change_status = 'ADDED') AS added,
      count(*) FILTER (WHERE change_status = 'DELETED') AS deleted, count(*) FILTER (WHERE change_status = 'UNVERIFIED') AS unverified, count(shift) AS duty_shifts, count(*) FILTER (WHERE needs_review) AS n_review,
      0::BIGINT AS n_high, 0::BIGINT AS n_low, count(*) AS n_none, coalesce(string_agg(change_id, ',' ORDER BY change_no) FILTER (WHERE needs_review), '') AS review_ids FROM changes GROUP BY 1),
      same AS (SELECT contract_id, count(*) FILTER (WHERE verdict = 'EQUIVALENT') AS unchanged_clauses FROM aligned GROUP BY 1),
      p AS (SELECT *, concat_ws(', ', CASE WHEN modified > 0 THEN concat(modified, ' modified') END, CASE WHEN added > 0 THEN concat(added, ' added') END, CASE WHEN deleted > 0 THEN concat(deleted, ' deleted') END, CASE WHEN unverified > 0 THEN concat(unverified, ' unverified') END) AS parts FROM o)""",
      select="""SELECT * EXCLUDE (parts), concat(total_changes, ' change', CASE WHEN total_changes <> 1 THEN 's' ELSE '' END, CASE WHEN parts <> '' THEN concat(': ', parts) ELSE '' END,
        CASE WHEN duty_shifts > 0 THEN concat('; ', duty_shifts, ' duty shift', CASE WHEN duty_shifts <> 1 THEN 's' ELSE '' END) ELSE '' END, '; ', n_review, ' need', CASE WHEN n_review = 1 THEN 's' ELSE '' END, ' human review') AS headline FROM p LEFT JOIN same USING (contract_id)"""),
    "highlights": S.over_clauses(*_ALL, select="SELECT contract_id, rank::INT AS rank, change_id, importance FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY importance DESC, change_no) AS rank FROM changes WHERE importance > 0 AND NOT needs_review) x WHERE rank <= 5"),
    "by_stakeholder": S.over_clauses(*_ALL, _CPARTIES, f"aff AS ({_parties('txt', 'changes', 'contract_id, change_no, change_id')})",
      "whom AS (SELECT f.contract_id, change_no, change_id, CASE WHEN list_contains(f.parties, 'Both parties') AND len(c.parties) > 0 THEN list_filter(f.parties, lambda y: y <> 'Both parties') || c.parties ELSE f.parties END AS l FROM aff f LEFT JOIN cparties c USING (contract_id))",
      "each_ AS (SELECT contract_id, change_no, change_id, unnest(l) AS party, unnest(range(len(l))) AS n FROM whom)",
      "once AS (SELECT contract_id, change_no, change_id, party, min(n) AS n FROM each_ GROUP BY ALL)",
      "g AS (SELECT contract_id, party, count(*) AS change_count, string_agg(change_id, ',' ORDER BY change_no) AS changes, min(change_no * 10000 + n) AS first FROM once GROUP BY 1, 2)",
      select="SELECT contract_id, party, change_count, changes, (row_number() OVER (PARTITION BY contract_id ORDER BY change_count DESC, first))::INT AS rank FROM g"),
    "by_section": S.over_clauses(*_ALL, "starts AS (SELECT *, CASE WHEN regexp_matches(text, '^\\d{1,2}\\. [A-Z]') THEN regexp_extract(text, '^(\\d{1,2}\\. [^.]*)\\.', 1) END AS s, 'A' AS v FROM clauses_a UNION ALL SELECT *, CASE WHEN regexp_matches(text, '^\\d{1,2}\\. [A-Z]') THEN regexp_extract(text, '^(\\d{1,2}\\. [^.]*)\\.', 1) END, 'B' FROM clauses_b)",
      "run AS (SELECT chunk_id, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY contract_id, v ORDER BY ordinal), 'Preamble') AS section FROM starts)",
      "sec AS (SELECT contract_id, change_no, section FROM changes c JOIN run r ON r.chunk_id = coalesce(c.target_id, c.source_id))",
      "g AS (SELECT contract_id, section, count(*) AS change_count, min(change_no) AS first FROM sec GROUP BY 1, 2)",
      select="SELECT contract_id, section, change_count, (row_number() OVER (PARTITION BY contract_id ORDER BY first))::INT AS rank FROM g"),
    "index_by_page": S.over_clauses("e AS (SELECT contract_id AS document_id, concat('C', lpad(k::VARCHAR, 9, '0')) AS change_id, (ordinal // 3 + 1)::INT AS p FROM clauses_a)",
      "q AS (SELECT document_id, change_id, unnest(CASE WHEN p % 2 = 0 THEN [p, p + 1] ELSE [p] END) AS page FROM e)",
      select="SELECT document_id, page, string_agg(change_id, ',' ORDER BY change_id) AS changes FROM q GROUP BY 1, 2"),
    "ui_rows": S.over_clauses(S.ALIGN, select="""SELECT pair_id, CASE change_status WHEN 'MODIFIED' THEN 'diverge' WHEN 'ADDED' THEN 'missing_in_a' ELSE 'missing_in_b' END AS ui, a.heading AS source_heading, b.heading AS target_heading, md5(concat_ws('|', a.text, b.text)) AS texts
      FROM pairs LEFT JOIN clauses_a a ON a.chunk_id = source_id LEFT JOIN clauses_b b ON b.chunk_id = target_id"""),
    "review_facet": S.over_clauses(S.ALIGN, select="""SELECT pair_id, CASE change_status WHEN 'ADDED' THEN 'missing_in_a' ELSE 'missing_in_b' END AS ui FROM pairs WHERE change_status IN ('UNVERIFIED', 'ADDED')"""),
    "facet_counts": S.over_clauses(S.ALIGN, select="""SELECT count(*) AS n_all, count(*) FILTER (WHERE change_status = 'UNVERIFIED') AS n_review, count(*) FILTER (WHERE change_status = 'MODIFIED') AS n_diverge,
      count(*) FILTER (WHERE change_status = 'ADDED') AS n_missing_in_a, count(*) FILTER (WHERE change_status IN ('DELETED', 'UNVERIFIED')) AS n_missing_in_b FROM pairs"""),
}
