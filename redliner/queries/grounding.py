"""Model answers, grounding, evidence and the report's remaining layers over the sample contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redliner.functions import deontic as L
from redliner.operators import consult as Q
from redliner.operators import deontic as D
from redliner.operators import evidence as V
from redliner.operators import grounding as G
from redliner.operators import impact as I
from redliner.operators import ontology as O
from redliner.operators import report as R
from redliner.plans import compare
from redliner.plans.samples import both, clauses, table
from redliner.queries import sqltext as S
from redliner.queries.compare import kept_pairs
from redliner.queries.reports import CHANGES, _CPARTIES, _parties, only_changes
from redliner.sources import files


def _orders(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))


def _joined(column: str, by: str = ",") -> F.Column:
    return F.coalesce(F.array_join(column, by), F.lit("")).alias(column)


def _pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return kept_pairs(spark, sf)


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    aligned, pairs, a, b = kept_pairs(spark, sf)
    return files.kept(compare.changes_of(a, b, aligned, pairs), "changes")


GROUNDED = """SELECT o_orderkey AS k, CASE o_orderkey % 10 WHEN 0 THEN 'the Licensees' WHEN 1 THEN 'Zebra / vendor' WHEN 2 THEN 'each party' WHEN 3 THEN 'Zebra Holdings'
  WHEN 4 THEN 'buyers' WHEN 5 THEN 'all companies' WHEN 6 THEN 'owners of the goods and books' WHEN 7 THEN ' ' WHEN 8 THEN 'people with zebras and goods' ELSE 'Its Customers' END AS party FROM orders"""


def party_grounding(spark: SparkSession, sf: str) -> DataFrame:
    rows = clauses(spark, sf, "a").select("k", "text").join(_orders(spark, sf, GROUNDED), "k")
    allowed = F.when(F.col("k") % 3 == 0, F.array(F.lit("Licensee / buyer"), F.lit("Companies"))).otherwise(F.array().cast("array<string>"))
    return rows.select("k", "party", G.party_is_grounded(F.col("party"), F.col("text"), allowed).alias("grounded"))


ANSWERS = """SELECT o_orderkey AS k, CASE o_orderkey % 8
  WHEN 0 THEN concat('Here is the revised text: The fee rises to $', cast(o_custkey AS string), '. AFFECTED: Licensee; Licensor')
  WHEN 1 THEN concat('Summary: The  buyer pays.', chr(10), 'Affected parties: the buyer, seller and buyer', chr(10), 'AFFECTED: Seller; none')
  WHEN 2 THEN '**The term ends.** Affected: party one; party two; <party>; [Other Party]'
  WHEN 3 THEN concat('Impact: Explanation: Only text', chr(10), 'and more of it')
  WHEN 4 THEN 'The fee is due. AFFECTED: no party concerned' WHEN 5 THEN 'affected: ** Vendor. ; VENDOR; n/a' WHEN 6 THEN '' ELSE concat('  plain text ', cast(o_orderkey AS string), '  ') END AS raw FROM orders"""


def impact_answers(spark: SparkSession, sf: str) -> DataFrame:
    found = G.parse_impact(F.col("raw"))
    return _orders(spark, sf, ANSWERS).select("k", found["summary"].alias("summary"), F.array_join(found["affected"], "|").alias("affected"))


CRITICS = """SELECT o_orderkey AS k, CASE o_orderkey % 9
  WHEN 0 THEN concat('VERIFIED', chr(10), 'All of it is there: see ', cast(o_custkey AS string))
  WHEN 1 THEN '**Hallucination** - the text names no fee.' WHEN 2 THEN concat('The text depends on others.', chr(10), 'missing context: see 4.')
  WHEN 3 THEN concat('VERIFIED - every claim', chr(10), 'HALLUCINATION - some', chr(10), 'MISSING_CONTEXT - depends') WHEN 4 THEN 'VERIFIED or HALLUCINATION'
  WHEN 5 THEN '' WHEN 6 THEN 'I cannot say.' WHEN 7 THEN concat(chr(10), '  MISSING_CONTEXT.', chr(10), chr(10)) ELSE concat('It is VERIFIED. ', repeat('so ', 150)) END AS raw FROM orders"""


def critic_answers(spark: SparkSession, sf: str) -> DataFrame:
    found = G.parse_critic(F.col("raw"))
    return _orders(spark, sf, CRITICS).select("k", found["verdict"].alias("verdict"), found["reason"].alias("reason"))


SUMMARIES = """SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'too short' WHEN 1 THEN 'The fee is now 777777 dollars and 12.5 more for the buyer.'
  WHEN 2 THEN 'The zebra, the giraffe and the elephant must inspect.' WHEN 3 THEN 'The goods are to be inspected by zebra giraffe okapi or lynx families.'
  WHEN 4 THEN 'Neither party may inspect the books and records.' ELSE 'The amount is due within the days named, to the vendor.' END AS summary,
  CASE o_orderkey % 4 WHEN 0 THEN array('Vendor', 'Zebra Holdings') WHEN 1 THEN array('Both parties', 'Licensee') WHEN 2 THEN array('Zebra Holdings') ELSE array('buyers', 'Insurers') END AS affected FROM orders"""


def checked_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """What a draft's summary and parties hold against both versions of a clause."""
    a, b = both(spark, sf)
    rows = a.select("k", F.col("text").alias("x")).join(b.select("k", F.col("text").alias("y")), "k").join(_orders(spark, sf, SUMMARIES), "k")
    rows = rows.withColumn("text", F.concat_ws(" ", "x", "y")).withColumn("named", O.find_parties(F.col("text")))
    rows, named = files.kept(rows.drop("x", "y"), "drafts"), F.col("named")
    rows = rows.withColumn("kept", G.grounded_parties(F.col("affected"), F.col("text"), named))
    lost = F.filter("affected", lambda x: ~G.party_is_grounded(x, F.col("text"), F.array_append(named, F.lit("Insurers"))))
    rows = rows.withColumn("issues", I.check_summary(F.col("summary"), F.col("text"), lost))
    double = G.double_check_words(F.col("issues"), I.unsupported_words(F.col("summary"), F.col("text")), 0)
    return rows.select("k", _joined("kept", "|"), F.array_join("issues", "; ").alias("issues"), F.array_join(double, ",").alias("double_check"))


def pair_views(spark: SparkSession, sf: str) -> DataFrame:
    aligned, pairs, a, b = _pairs(spark, sf)
    found = compare.views(a, b, aligned, pairs)
    return found.select("pair_id", "heading", "shift", _joined("labels_added"), "numbers_changed", _joined("parties"), _joined("contract_parties"), F.size("changed_old").alias("n_old"), F.size("changed_new").alias("n_new"))


def _scripted(rows: DataFrame, salt: str, answers: list[str]) -> DataFrame:
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat("pair_id", F.lit(salt))), 1, 6), 16, 10).cast("int"), F.lit(len(answers)))
    return rows.select("pair_id", F.element_at(F.array(*[F.lit(x) for x in answers]), pick + 1).alias("raw"))


def impact_results(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair through two rounds of scripted summaries and critics."""
    aligned, pairs, a, b = _pairs(spark, sf)
    views = files.kept(compare.views(a, b, aligned, pairs), "views")
    summaries = ["The clause is changed for both parties. AFFECTED: both parties", "The zebra pays 777777. AFFECTED: Zebra", "The goods may be inspected. AFFECTED: Buyer", "no"]
    critics = ["VERIFIED", "HALLUCINATION: not said", "MISSING_CONTEXT", "I cannot say"]
    context = G.context_texts(I.neighbor_context(pairs, b, "target_id", 1), b)
    attempts = G.reviewed(
        views,
        lambda asked: _scripted(asked.withColumn("pair_id", F.col("pair_id")), "s", summaries),
        lambda drafts: _scripted(drafts, "c", critics).join(_scripted(drafts, "r", critics).withColumnRenamed("raw", "raw_retry"), "pair_id"),
        files.kept(context, "context"),
    )
    attempts = files.kept(attempts, "attempts")
    done = files.kept(G.results(views, attempts).select("pair_id", "contract_id", "status"), "results")
    return G.run_counts(done, attempts).withColumn("low_confidence", F.size("low_confidence"))


def numbers_changed(spark: SparkSession, sf: str) -> DataFrame:
    aligned = _pairs(spark, sf)[0].where("verdict = 'MODIFIED'")
    return aligned.select("source_id", I.numbers_changed(F.col("numeric_diff.only_in_source"), F.col("numeric_diff.only_in_target")).alias("numbers"))


def deontic_confirmed(spark: SparkSession, sf: str) -> DataFrame:
    """Duty labels of both versions, ambiguous ones confirmed by a scripted model."""
    a, b = both(spark, sf)
    found = D.tagged(a.unionByName(b).select("chunk_id", "text"))
    size = F.length(F.trim(F.regexp_replace(F.lower("sentence"), r"\s+", " ")))
    raw = F.when(size % 4 == 0, '{"label": "NONE"}').when(size % 4 == 1, "I say PERMISSION.").when(size % 4 == 2, '{"label": "MAYBE"}').otherwise("OBLIGATION or PERMISSION")
    out = D.confirmed(found, lambda asked: asked.select("key", raw.alias("raw")))
    return out.select("chunk_id", F.col("sentence_no").cast("long").alias("sentence_no"), "label", "rule_label", "decided_by")


def deontic_run(spark: SparkSession, sf: str) -> DataFrame:
    aligned, pairs, a, b = _pairs(spark, sf)
    out = D.run_summary(D.shifts(pairs, a, b), aligned)
    return out.select("contract_id", "n_modified", "n_added", "n_deleted", "n_unverified", "n_prohibition", "n_obligation", "n_permission", "n_none", "n_skipped", _joined("deontic_changes"))


def evidence_sentences(spark: SparkSession, sf: str) -> DataFrame:
    _, pairs, a, b = _pairs(spark, sf)
    found = V.marked_sentences(pairs, a, b)
    return found.select("pair_id", "side", F.col("sentence_no").cast("long").alias("sentence_no"), "sentence", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_"), "changed")


def evidence_sides(spark: SparkSession, sf: str) -> DataFrame:
    _, pairs, a, b = _pairs(spark, sf)
    marks = F.transform("highlights", lambda h: F.concat_ws("-", h["start"].cast("string"), h["end"].cast("string")))
    found = V.evidence(pairs, a, b)
    return found.select("pair_id", "side", "chunk_id", F.size("sentences").alias("n_sentences"), F.array_join(marks, ",").alias("highlights"), F.md5(F.array_join("changed_sentences", "|")).alias("changed"))


def ui_chunks(spark: SparkSession, sf: str) -> DataFrame:
    _, pairs, a, b = _pairs(spark, sf)
    return R.ui_chunks(V.evidence(pairs, a, b)).select("chunk_id", F.md5("text").alias("text"), F.size("highlights").alias("n_highlights"))


def change_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles where every third heading is a row of a table."""
    _, pairs, a, b = _pairs(spark, sf)
    bare = F.when(F.col("k") % 3 == 0, F.lit("5 – 10")).otherwise(F.col("heading"))
    heads = a.select(F.col("chunk_id").alias("source_id"), bare.alias("ha")), b.select(F.col("chunk_id").alias("target_id"), bare.alias("hb"))
    rows = pairs.join(heads[0], "source_id", "left").join(heads[1], "target_id", "left").withColumn("heading", F.coalesce("hb", "ha"))
    return V.titles(rows, V.marked_sentences(pairs, a, b))


def index_by_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return V.index_by_chunk(only_changes(spark, sf, "change_id", "source_id", "target_id"))


def documents_block(spark: SparkSession, sf: str) -> DataFrame:
    a = clauses(spark, sf, "a").select(F.col("contract_id").cast("string").alias("document_id"), (F.floor(F.col("ordinal") / 3) + 1).cast("int").alias("page_start"))
    a = a.withColumn("page_end", F.when(F.col("page_start") % 2 == 0, F.col("page_start") + 1))
    names = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("document_id"), F.concat(F.lit("Contract of "), "c_name").alias("name"))
    return V.documents_block(a, names)


def party_lists(spark: SparkSession, sf: str) -> DataFrame:
    names = "array('the Licensees', CASE o_orderkey % 3 WHEN 0 THEN 'licensee / buyer' WHEN 1 THEN 'Inc.' ELSE 'either party' END, 'VENDORS', CASE o_orderkey % 2 WHEN 0 THEN 'both parties' ELSE 'licensor' END)"
    rows = _orders(spark, sf, f"SELECT o_orderkey AS k, {names} AS names FROM orders")
    return rows.select("k", F.array_join(O.normalize_parties(F.col("names")), "|").alias("parties"))


SECTIONS = """SELECT concat('d', cast(o_custkey % 40 AS string)) AS document_id, cast(o_orderkey AS int) AS ordinal, concat('c', cast(o_orderkey AS string)) AS chunk_id,
  CASE o_orderkey % 12 WHEN 0 THEN concat(cast(o_custkey % 15 + 1 AS string), '. Grant of License. The goods.') WHEN 1 THEN concat(cast(o_custkey % 15 + 1 AS string), '.', chr(10), 'Definitions and terms.')
    WHEN 2 THEN concat(cast(o_custkey % 15 + 2 AS string), '.3 For a period of days') WHEN 3 THEN concat('Text first', chr(10), cast(o_custkey % 9 + 1 AS string), '. TERM AND TERMINATION')
    WHEN 4 THEN CASE WHEN o_orderkey % 60 = 4 THEN 'Schedule b to the contract' ELSE 'Plain' END
    WHEN 5 THEN concat(cast(o_custkey % 20 + 1 AS string), '. Very Long Title; Going On And On; For More Than Sixty Characters, Or So It Seems') ELSE 'The goods are delivered.' END AS text,
  array(CASE WHEN o_orderkey % 12 = 6 THEN concat(cast(o_custkey % 15 + 1 AS string), '. Heading Only. x') ELSE 'A' END) AS heading_path FROM orders"""


def running_sections(spark: SparkSession, sf: str) -> DataFrame:
    return V.running_sections(_orders(spark, sf, SECTIONS))


def report_files(spark: SparkSession, sf: str) -> DataFrame:
    """The reports as printable pages."""
    aligned, pairs, a, b = _pairs(spark, sf)
    rows = files.kept(compare.changes_of(a, b, aligned, pairs), "changes")
    heads = R.overview(rows)
    made = R.markdown(rows, heads, stakeholders=R.by_stakeholder(rows, O.contract_parties(a, "contract_id")), evidence=V.evidence(pairs, a, b, include_text=False))
    reports = made.join(heads.select("contract_id", F.to_json(F.struct("*")).alias("json")), "contract_id").withColumn("name", F.concat(F.lit("Contract: "), F.col("contract_id").cast("string")))
    return files.report_files(reports, "html").select("contract_id", "file_name", "media_type", F.length("body").alias("n_chars"))


QUESTIONS = ["Which changes need review?", "Which duties changed for the vendor?", "What about payments and fees?", "How does the delivery of goods change?", "Is arbitration settled in Geneva?"]


def _asked(changes: DataFrame) -> DataFrame:
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("question")) for i, q in enumerate(QUESTIONS)]))
    rows = changes.select("contract_id").distinct().select("contract_id", every.alias("q"))
    return rows.select(F.concat(F.col("contract_id").cast("string"), F.lit("-"), F.col("q.i").cast("string")).alias("query_id"), "contract_id", "q.question")


def relevant_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = files.kept(only_changes(spark, sf, "contract_id", "change_id", "change_no", "needs_review", "shift"), "changes")  # read twice
    found = Q.relevant_changes(rows, _asked(rows))
    return found.select("query_id", "change_id", "tier", "rank")


def related_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _changes(spark, sf)
    return Q.related_changes(rows, _asked(rows), ["title", "section"], ["why"]).select("query_id", "change_id", "score", "rank")


def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return Q.suggestions(_changes(spark, sf)).select("contract_id", F.array_join("suggestions", " ").alias("suggestions"))


REPLIES = """SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'The fee rises [C001] and [C999] the term [C002] ends [C001].' WHEN 1 THEN 'The report does not show it [Report overview].'
  WHEN 2 THEN 'It is  so [C777] .' WHEN 3 THEN 'There are no changes.' WHEN 4 THEN '' WHEN 5 THEN '[C002]' ELSE concat('Number ', cast(o_custkey AS string), ' [note] [C002] , yes') END AS raw FROM orders"""


def clean_answers(spark: SparkSession, sf: str) -> DataFrame:
    found = Q.clean_answer(F.col("raw"), F.array(F.lit("C001"), F.lit("C002")))
    return _orders(spark, sf, REPLIES).select("k", found["answer"].alias("answer"), F.array_join(found["citations"], ",").alias("citations"), F.array_join(found["removed"], ",").alias("removed"), found["kind"].alias("kind"))


def question_queue(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("report_id"), F.substring("text", 1, 12).alias("question"), F.col("turn").alias("asked_no"), "role")
    again = rows.withColumn("question", F.concat(F.lit("  "), "question", F.lit(" ?"))).withColumn("asked_no", F.col("asked_no") + 100)
    found = Q.question_queue(rows.drop("role").unionByName(again.drop("role")), rows.where("asked_no = 1").select("report_id", "question"), batch=2)
    return found.select("report_id", "question_key", "place", "batch_no")


def message_log(spark: SparkSession, sf: str) -> DataFrame:
    """Messages sent as base64 parts in log lines, some torn, some of other jobs, some parts twice."""
    rows = table(spark, sf, "events").select(F.lit("j1").alias("job"), F.col("event_id").alias("seq"), "event_type", "user_id")
    text = F.to_json(F.struct(F.when(F.col("seq") % 9 == 0, "j2").otherwise("j1").alias("job_id"), F.concat(F.lit("p"), "user_id").alias("pair_id"), F.col("event_type").alias("status")))
    coded = rows.withColumn("b", F.replace(F.replace(F.base64(F.encode(text, "utf-8")), F.lit("\r\n"), F.lit("")), F.lit("\n"), F.lit("")))
    parts = coded.select("job", "seq", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.expr("substr(b, 1, cast(floor(length(b) / 2) as int))").alias("p")), F.struct(F.lit(2).alias("n"), F.expr("substr(b, 1 + cast(floor(length(b) / 2) as int))").alias("p")), F.struct(F.lit(1).alias("n"), F.expr("substr(b, 1, cast(floor(length(b) / 2) as int))").alias("p")))).alias("x"))
    parts = parts.where(~((F.col("seq") % 7 == 0) & (F.col("x.n") == 2)))
    line = F.concat(F.lit("[ReportData result "), F.col("seq").cast("string"), F.lit(" "), F.col("x.n").cast("string"), F.lit("/2] "), F.col("x.p"))
    log = parts.select("job", line.alias("line")).unionByName(rows.select("job", F.lit("[Report] stage {}").alias("line")))
    found = Q.messages(Q.message_parts(log), "job_id string, pair_id string, status string")
    current = rows.select(F.concat(F.lit("p"), "user_id").alias("pair_id")).distinct().withColumn("status", F.lit("PENDING"))
    return Q.replaced(current, found.select("pair_id", "status", "seq"))


QUERIES = {
    f.__name__: f
    for f in (
        party_grounding, impact_answers, critic_answers, checked_drafts, pair_views, impact_results, numbers_changed, deontic_confirmed, deontic_run,
        evidence_sentences, evidence_sides, ui_chunks, change_titles, index_by_chunk, documents_block, party_lists, running_sections, report_files,
        relevant_changes, related_changes, suggestions, clean_answers, question_queue, message_log,
    )
}

# SQL: patterns and word lists are written out here, not taken from the operators.
_SING = "CASE WHEN {0} LIKE '%ies' AND {0} <> 'third parties' THEN regexp_replace({0}, 'ies$', '') || 'y' WHEN {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN regexp_replace({0}, 's$', '') ELSE {0} END"


def _forms(x: str) -> str:
    """SQL of all forms of a list of names."""
    parts = f"list_filter(list_transform(flatten(list_transform({x}, lambda s: list_append(regexp_split_to_array(lower(s), '\\s*/\\s*'), lower(s)))), lambda s: trim(s)), lambda s: s <> '')"
    return f"list_concat({parts}, list_transform({parts}, lambda s: {_SING.format('s')}))"


_PLAIN = """['of','the','this','that','these','which','with','from','for','and','any','all','their','its','who','into','onto','by','in','on','to','an','a','anyone','anybody','everyone','someone','those','people','person','persons','party','parties','user','users','creator','creators','maker','makers','developer','developers','distributor','distributors','company','companies','entity','entities','individual','individuals','organization','organizations','organisation','organisations','owner','owners','holder','holders','business','businesses','whoever']"""


def _grounded(party: str, text: str, allowed: str) -> str:
    name = f"regexp_replace(lower(trim({party})), '^(?:the|all|any|its)\\s+', '')"
    words = f"regexp_extract_all({name}, '[a-z]+')"
    content = f"list_filter({words}, lambda w: length(w) > 2 AND NOT list_contains({_PLAIN}, w))"
    vocabulary = f"regexp_extract_all(lower({text}), '[a-z]+')"
    known = f"len(list_filter({content}, lambda w: list_contains({vocabulary}, w) OR list_contains({vocabulary}, {_SING.format('w')}) OR list_contains({vocabulary}, w || 's')))"
    word = f"len(list_filter({_forms(f'[{name}]')}, lambda f: regexp_matches(lower({text}), concat('\\b', regexp_escape(f), '(?:s|es)?\\b')))) > 0"
    return f"""({name} <> '' AND ({name} IN ('both parties','either party','each party','the parties','parties','neither party') OR list_has_any({_forms(f'[{name}]')}, {_forms(allowed)})
      OR {word} OR (len({words}) >= 3 AND len({content}) >= 2 AND {known} = len({content}))))"""


_AFF = "\\baffected(?:\\s+parties)?\\s*:"
_ECHO1, _ECHO2 = "(?i)^\\s*(?:here\\s+is|here''s)\\b[^:\\n]{0,80}:\\s*", "(?i)^\\s*(?:revised\\s+)?(?:summary|impact|explanation)\\s*:\\s*"
_BARE = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_V = "VERIFIED|HALLUCINATION|MISSING[_ ]CONTEXT"
_VERDICTS = "list_distinct(list_transform(regexp_extract_all(upper({0}), '" + _V + "'), lambda v: replace(v, ' ', '_')))"
_TWO = "sides2 AS (SELECT pair_id, 'source' AS side, text FROM pairs JOIN clauses_a ON chunk_id = source_id UNION ALL SELECT pair_id, 'target', text FROM pairs JOIN clauses_b ON chunk_id = target_id)"
_MARKED = (
    _TWO,
    S.sentences("sides2", "pair_id, side", "s2"),
    f"n2 AS (SELECT *, {S.norm('lower(sentence)')} AS t FROM s2)",
    "marked2 AS (SELECT x.*, NOT EXISTS (SELECT 1 FROM n2 y WHERE y.pair_id = x.pair_id AND y.side <> x.side AND y.t = x.t) AS changed FROM n2 x)",
)
_ALL = (S.ALIGN, S.DUTIES, CHANGES)
_FREE = "[" + ", ".join(S.quoted(w) for w in I.FREE_WORDS) + "]"
_REL = "list_filter(known, lambda v: least(5, length(x), length(v)) >= 3 AND left(x, least(5, length(x), length(v))) = left(v, least(5, length(x), length(v))))"
_SHORT = ", ".join(map(S.quoted, I.SHORT_STOP))
_QLIST = ", ".join(f"({i}, {S.quoted(q)})" for i, q in enumerate(QUESTIONS))
_ASKED = f"asked AS (SELECT concat(contract_id, '-', i) AS query_id, contract_id, question FROM (SELECT DISTINCT contract_id FROM changes) c CROSS JOIN (VALUES {_QLIST}) q(i, question))"
SQL = {
    "party_grounding": S.over_clauses(f"n AS ({GROUNDED})", select=f"""SELECT k, party, {_grounded("party", "text", "CASE WHEN k % 3 = 0 THEN ['Licensee / buyer', 'Companies'] ELSE [] END")} AS grounded FROM clauses_a JOIN n USING (k)"""),
    "impact_answers": f"""WITH r AS ({ANSWERS}), t AS (SELECT k, {_BARE.format("replace(raw, '**', '')")} AS x FROM r),
      l AS (SELECT k, x, regexp_extract_all(x, '(?i){_AFF}\\s*([^\\n]*)', 1) AS lists FROM t),
      b AS (SELECT k, lists, {_BARE.format(f"CASE WHEN len(lists) > 0 THEN regexp_extract(x, '(?is)^(.*?){_AFF}', 1) ELSE x END")} AS s FROM l),
      e AS (SELECT k, lists, {_BARE.format(f"regexp_replace(s, '{_ECHO1}', '')")} AS s FROM b),
      p AS (SELECT k, regexp_replace(s, '{_ECHO2}', '') AS s, list_filter(list_transform(flatten(list_transform(lists, lambda y: regexp_split_to_array(y, '[;,]|\\band\\b'))), lambda y: regexp_replace(y, '^[ .*\\-]+|[ .*\\-]+$', '', 'g')), lambda y: y <> '') AS names FROM e),
      u AS (SELECT k, s, unnest(names) AS n, unnest(range(len(names))) AS i FROM p),
      d AS (SELECT k, lower(n) AS low, min(i) AS i FROM u GROUP BY 1, 2),
      f AS (SELECT u.k, string_agg(u.n, '|' ORDER BY u.i) AS affected FROM u JOIN d ON d.k = u.k AND d.i = u.i WHERE lower(u.n) NOT IN ('party one', 'party two') AND NOT regexp_matches(trim(u.n), '^[\\[<{{].*[\\]>}}]$')
            AND NOT regexp_matches(u.n, '(?i)^(?:no|none|nobody|n/?a|not applicable|unknown)\\b|\\bno part(?:y|ies)\\b') GROUP BY u.k)
      SELECT p.k, {S.norm("p.s")} AS summary, coalesce(f.affected, '') AS affected FROM p LEFT JOIN f USING (k)""",
    "critic_answers": f"""WITH r AS ({CRITICS}), t AS (SELECT k, {_BARE.format("replace(raw, '**', '')")} AS x FROM r),
      l AS (SELECT k, x, list_filter(string_split(x, chr(10)), lambda y: trim(y) <> '') AS lines FROM t),
      s AS (SELECT *, len(list_distinct(list_filter(list_transform(lines, lambda y: replace(regexp_extract(upper(regexp_replace(y, '^[ \\-*#>]+|[ \\-*#>]+$', '', 'g')), '^({_V})', 1), ' ', '_')), lambda y: y <> ''))) > 1 AS several,
                   {_VERDICTS.format("coalesce(lines[1], '')")} AS first, {_VERDICTS.format("x")} AS every FROM l),
      v AS (SELECT *, CASE WHEN len(first) > 0 THEN first ELSE every END AS found FROM s)
      SELECT k, CASE WHEN NOT several AND len(found) = 1 THEN found[1] ELSE 'UNKNOWN' END AS verdict,
             CASE WHEN NOT several AND len(found) = 1 THEN left({S.norm(f"regexp_replace(regexp_extract(x, '(?is)^.*?(?:{_V})(.*)$', 1), '^[ .:\\-\\n]+|[ .:\\-\\n]+$', '', 'g')")}, 300) ELSE '' END AS reason FROM v""",
    "checked_drafts": S.over_clauses(
        f"d AS ({SUMMARIES.replace('array(', 'list_value(')})",
        "txt AS (SELECT a.k, summary, affected, concat_ws(' ', a.text, b.text) AS text FROM clauses_a a JOIN clauses_b b USING (k) JOIN d USING (k))",
        f"named AS ({_parties('text', 'txt', 'k, summary, affected, text')})",
        f"w AS (SELECT k, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) || {_FREE} AS known, regexp_extract_all(lower(summary), '[a-z]+') AS asked FROM txt)",
        "u AS (SELECT k, known, unnest(asked) AS x, unnest(range(len(asked))) AS i FROM w)",
        f"f AS (SELECT k, x, min(i) AS i FROM u WHERE length(x) >= 3 AND NOT (length(x) = 3 AND x IN ({_SHORT})) AND NOT list_contains(known, x) AND len({_REL}) = 0 GROUP BY k, x)",
        "strange AS (SELECT k, list(x ORDER BY i) AS words FROM f GROUP BY k)",
        f"""parts AS (SELECT n.k, summary, list_filter(affected, lambda p: {_grounded("p", "text", "parties")}) AS kept, list_filter(affected, lambda p: NOT {_grounded("p", "text", "list_append(parties, 'Insurers')")}) AS lost,
          {S.minus(S.cores("summary"), S.cores("text"))} AS numbers, coalesce(words, []) AS words FROM named n LEFT JOIN strange USING (k))""",
        """judged2 AS (SELECT *, CASE WHEN length(trim(summary)) < 20 THEN 'the summary is empty or too short' ELSE concat_ws('; ', CASE WHEN len(numbers) > 0 THEN 'numbers not in the text: ' || array_to_string(numbers, ', ') END,
          CASE WHEN len(lost) > 0 THEN 'parties not in the text: ' || array_to_string(lost, ', ') END, CASE WHEN len(words) > 2 THEN 'words not in the text: ' || array_to_string(words[1:8], ', ') END) END AS issues FROM parts)""",
        select="SELECT k, coalesce(array_to_string(kept, '|'), '') AS kept, issues, CASE WHEN issues = '' AND len(words) > 0 THEN array_to_string(words, ',') ELSE '' END AS double_check FROM judged2",
    ),
    "pair_views": S.over_clauses(
        S.ALIGN, S.DUTIES, *_MARKED, _CPARTIES,
        "vt AS (SELECT s.*, concat_ws(' ', a.text, b.text) AS txt, coalesce(b.heading, a.heading) AS heading, x.only_in_source AS o, x.only_in_target AS n, x.target_id AS matched FROM shifts s LEFT JOIN clauses_a a ON a.chunk_id = s.source_id LEFT JOIN clauses_b b ON b.chunk_id = s.target_id LEFT JOIN aligned x ON x.source_id = s.source_id)",
        f"vp AS ({_parties('txt', 'vt', 'pair_id, contract_id, heading, shift, labels_added, o, n, matched, source_id, target_id')})",
        "vc AS (SELECT pair_id, least(3, count(*) FILTER (WHERE side = 'source' AND changed)) AS n_old, least(3, count(*) FILTER (WHERE side = 'target' AND changed)) AS n_new FROM marked2 GROUP BY 1)",
        select=f"""SELECT v.pair_id, heading, shift, labels_added, CASE WHEN matched IS NULL OR (len(o) = 0 AND len(n) = 0) THEN '' ELSE concat('old version only: ', CASE WHEN len(o) > 0 THEN array_to_string(o, ', ') ELSE '-' END, ' | new version only: ', CASE WHEN len(n) > 0 THEN array_to_string(n, ', ') ELSE '-' END) END AS numbers_changed,
          {S.joined("v.parties")} AS parties, {S.joined("c.parties")} AS contract_parties, (CASE WHEN source_id IS NULL OR target_id IS NULL THEN 0 ELSE n_old END)::INT AS n_old, (CASE WHEN source_id IS NULL OR target_id IS NULL THEN 0 ELSE n_new END)::INT AS n_new
          FROM vp v LEFT JOIN cparties c USING (contract_id) LEFT JOIN vc USING (pair_id)""",
    ),
    "numbers_changed": S.over_clauses(S.ALIGN, select="""SELECT source_id, CASE WHEN len(only_in_source) = 0 AND len(only_in_target) = 0 THEN '' ELSE concat('old version only: ', CASE WHEN len(only_in_source) > 0 THEN array_to_string(only_in_source, ', ') ELSE '-' END,
      ' | new version only: ', CASE WHEN len(only_in_target) > 0 THEN array_to_string(only_in_target, ', ') ELSE '-' END) END AS numbers FROM aligned WHERE verdict = 'MODIFIED'"""),
    "deontic_run": S.over_clauses(S.ALIGN, S.DUTIES,
        "d AS (SELECT *, shift IS NOT NULL OR labels_added <> '' OR labels_removed <> '' AS dc FROM shifts)",
        "g AS (SELECT contract_id, " + ", ".join(f"count(*) FILTER (WHERE change_status = '{x}') AS n_{x.lower()}" for x in ("MODIFIED", "ADDED", "DELETED", "UNVERIFIED")) + ", " + ", ".join(f"count(*) FILTER (WHERE primary_label = '{x}') AS n_{x.lower()}" for x in ("PROHIBITION", "OBLIGATION", "PERMISSION", "NONE")) + ", string_agg(pair_id, ',' ORDER BY pair_id) FILTER (WHERE dc) AS deontic_changes FROM d GROUP BY 1)",
        "k AS (SELECT contract_id, count(*) FILTER (WHERE verdict = 'EQUIVALENT') AS n_skipped FROM aligned GROUP BY 1)",
        select="SELECT contract_id, " + ", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in ("modified", "added", "deleted", "unverified", "prohibition", "obligation", "permission", "none")) + ", n_skipped, coalesce(deontic_changes, '') AS deontic_changes FROM k LEFT JOIN g USING (contract_id)"),
    "evidence_sentences": S.over_clauses(S.ALIGN, *_MARKED, select="SELECT pair_id, side, sentence_no, sentence, start::BIGINT AS start, end_::BIGINT AS end_, changed FROM marked2"),
    "evidence_sides": S.over_clauses(S.ALIGN, *_MARKED,
        "ids AS (SELECT pair_id, 'source' AS side, source_id AS chunk_id FROM pairs WHERE source_id IS NOT NULL UNION ALL SELECT pair_id, 'target', target_id FROM pairs WHERE target_id IS NOT NULL)",
        select="""SELECT i.pair_id, i.side, i.chunk_id, count(sentence)::INT AS n_sentences, coalesce(string_agg(concat(start, '-', end_), ',' ORDER BY sentence_no) FILTER (WHERE changed), '') AS highlights,
          md5(coalesce(string_agg(sentence, '|' ORDER BY sentence_no) FILTER (WHERE changed), '')) AS changed FROM ids i LEFT JOIN marked2 m USING (pair_id, side) GROUP BY 1, 2, 3"""),
    "ui_chunks": S.over_clauses(S.ALIGN, *_MARKED,
        "ids AS (SELECT pair_id, 'source' AS side, source_id AS chunk_id FROM pairs WHERE source_id IS NOT NULL UNION ALL SELECT pair_id, 'target', target_id FROM pairs WHERE target_id IS NOT NULL)",
        "first AS (SELECT chunk_id, min(pair_id) AS pair_id FROM ids GROUP BY 1)",
        "texts2 AS (SELECT chunk_id, text FROM clauses_a UNION ALL SELECT chunk_id, text FROM clauses_b)",
        select="SELECT f.chunk_id, md5(any_value(t.text)) AS text, (count(*) FILTER (WHERE m.changed))::INT AS n_highlights FROM first f JOIN ids i USING (chunk_id, pair_id) JOIN texts2 t USING (chunk_id) LEFT JOIN marked2 m ON m.pair_id = f.pair_id AND m.side = i.side GROUP BY 1"),
    "change_titles": S.over_clauses(S.ALIGN, *_MARKED,
        "f AS (SELECT pair_id, arg_min(sentence, (CASE side WHEN 'source' THEN 1 ELSE 0 END) * 1000000 + (CASE WHEN changed THEN 0 ELSE 1 END) * 100000 + sentence_no) AS s FROM marked2 GROUP BY 1)",
        "h AS (SELECT p.pair_id, coalesce(CASE WHEN b.k % 3 = 0 THEN '5 – 10' ELSE b.heading END, CASE WHEN a.k % 3 = 0 THEN '5 – 10' ELSE a.heading END) AS heading FROM pairs p LEFT JOIN clauses_a a ON a.chunk_id = source_id LEFT JOIN clauses_b b ON b.chunk_id = target_id)",
        f"t AS (SELECT pair_id, CASE WHEN heading = '5 – 10' THEN regexp_replace({S.norm('s')}, '^[^A-Za-z]+', '') ELSE heading END AS t FROM h JOIN f USING (pair_id))",
        select="SELECT pair_id, CASE WHEN length(t) > 70 THEN concat(regexp_replace(left(t, 70), ' [^ ]*$', ''), ' …') ELSE t END AS title FROM t"),
    "index_by_chunk": S.over_clauses(*_ALL, select="SELECT chunk_id, string_agg(change_id, ',' ORDER BY change_id) AS changes FROM (SELECT source_id AS chunk_id, change_id FROM changes WHERE source_id IS NOT NULL UNION ALL SELECT target_id, change_id FROM changes WHERE target_id IS NOT NULL) x GROUP BY 1"),
    "documents_block": S.over_clauses("e AS (SELECT contract_id::VARCHAR AS document_id, (ordinal // 3 + 1)::INT AS p FROM clauses_a)", "g AS (SELECT document_id, count(*) AS chunks, max(CASE WHEN p % 2 = 0 THEN p + 1 ELSE p END)::INT AS pages FROM e GROUP BY 1)",
        select="SELECT coalesce(n.document_id, g.document_id) AS document_id, name, chunks, pages FROM g FULL JOIN (SELECT c_custkey::VARCHAR AS document_id, concat('Contract of ', c_name) AS name FROM customer) n ON n.document_id = g.document_id"),
    "party_lists": "SELECT o_orderkey AS k, concat('Licensee', CASE o_orderkey % 3 WHEN 2 THEN '|Both parties' ELSE '' END, '|VENDOR', CASE WHEN o_orderkey % 2 = 1 THEN '|Licensor' WHEN o_orderkey % 3 = 2 THEN '' ELSE '|Both parties' END) AS parties FROM orders",
    "relevant_changes": S.over_clauses(*_ALL, _ASKED, """r AS (SELECT query_id, change_id, change_no, CASE WHEN regexp_matches(question, '(?i)review|unsure|uncertain|low confidence|not sure') AND needs_review THEN 0
        WHEN regexp_matches(question, '(?i)\\bdut(y|ies)\\b|obligation|shall|must|permission|prohibit|allowed to') AND shift IS NOT NULL THEN 1 ELSE 2 END::INT AS tier FROM asked JOIN changes USING (contract_id))""",
        select="SELECT query_id, change_id, tier, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, change_no) AS rank FROM r) x WHERE rank <= 8"),
    "suggestions": S.over_clauses(*_ALL, "g AS (SELECT contract_id, bool_or(needs_review) AS r, bool_or(shift IS NOT NULL) AS d, bool_or(change_status = 'DELETED') AS x, arg_min(heading, change_no) AS t FROM changes GROUP BY 1)",
        select="""SELECT contract_id, array_to_string(list_filter([CASE WHEN r THEN 'Which changes need human review?' END, CASE WHEN d THEN 'Which duties changed, and for whom?' END, CASE WHEN x THEN 'What was removed from the new version?' END,
          concat('What changed in "', t, '"?'), 'What are the most important changes for me?'], lambda y: y IS NOT NULL)[1:4], ' ') AS suggestions FROM g"""),
    "clean_answers": f"""WITH r AS ({REPLIES}), a AS (SELECT k, {_BARE.format("raw")} AS x FROM r), w AS (SELECT k, x, list_sort(list_distinct(list_filter(regexp_extract_all(x, '\\[(C\\d{{3,}})\\]', 1), lambda c: c NOT IN ('C001', 'C002')))) AS removed FROM a),
      b AS (SELECT k, removed, regexp_replace(x, '\\[C(777|999)\\]', '', 'g') AS x FROM w),
      c AS (SELECT k, removed, {_BARE.format("regexp_replace(regexp_replace(regexp_replace(x, '\\s*\\[([^C\\]\\n][^\\]\\n]{0,39})\\]', '', 'g'), '[ \\t]{2,}', ' ', 'g'), '\\s+([.,;:])', '\\1', 'g')")} AS x FROM b),
      d AS (SELECT *, regexp_extract_all(x, '\\[(C\\d{{3,}})\\]', 1) AS c FROM c), u AS (SELECT k, unnest(c) AS c, unnest(range(len(c))) AS i FROM d), o AS (SELECT k, c, min(i) AS i FROM u GROUP BY 1, 2), l AS (SELECT k, string_agg(c, ',' ORDER BY i) AS citations FROM o GROUP BY 1)
      SELECT k, x AS answer, coalesce(citations, '') AS citations, array_to_string(removed, ',') AS removed, CASE WHEN citations IS NOT NULL THEN 'cited'
        WHEN regexp_matches(x, '(?i)does ?n[o'']t show|not (shown|mentioned|listed|covered|in the report)|no (listed )?changes?\\b|none of the (listed )?changes|zero changes|there (are|were) no') THEN 'nothing' ELSE 'unsupported' END AS kind FROM d LEFT JOIN l USING (k)""",
    "question_queue": """WITH r AS (SELECT conv_id AS report_id, substr(text, 1, 12) AS question, turn AS n FROM conversations), a AS (SELECT * FROM r UNION ALL SELECT report_id, concat('  ', question, ' ?'), n + 100 FROM r),
      q AS (SELECT report_id, n, sha256(regexp_replace(regexp_replace(lower(trim(question)), '\\s+', ' ', 'g'), '[?.!]+$', '')) AS question_key FROM a WHERE trim(question) <> ''),
      o AS (SELECT report_id, question_key, min(n) AS n FROM q GROUP BY 1, 2),
      d AS (SELECT DISTINCT report_id, sha256(regexp_replace(regexp_replace(lower(trim(question)), '\\s+', ' ', 'g'), '[?.!]+$', '')) AS question_key FROM r WHERE n = 1),
      p AS (SELECT report_id, question_key, row_number() OVER (PARTITION BY report_id ORDER BY n, question_key) AS place FROM o WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.report_id = o.report_id AND d.question_key = o.question_key))
      SELECT report_id, question_key, place::INT AS place, ((place - 1) // 2 + 1)::INT AS batch_no FROM p""",
    "message_log": "WITH m AS (SELECT concat('p', user_id) AS pair_id, event_id, event_type FROM events), l AS (SELECT pair_id, arg_max(event_type, event_id) AS status FROM m WHERE event_id % 7 <> 0 AND event_id % 9 <> 0 GROUP BY 1) SELECT DISTINCT m.pair_id, coalesce(l.status, 'PENDING') AS status FROM m LEFT JOIN l USING (pair_id)",
}
_CONFIRM_IN = S.over_clauses(
    "every_ AS (SELECT chunk_id, text FROM clauses_a UNION ALL SELECT chunk_id, text FROM clauses_b)", S.sentences("every_", "chunk_id", "sents"),
    f"plain AS (SELECT * FROM sents WHERE NOT regexp_matches(sentence, {S.quoted('(?i)' + L.DEFINITION)}))", S.labels("plain", "labelled", keep_found=True),
    f"m AS (SELECT *, length({S.norm('lower(sentence)')}) % 4 AS z FROM labelled WHERE label IS NOT NULL)",
    "c AS (SELECT *, CASE WHEN NOT ambiguous THEN NULL WHEN z = 0 THEN 'NONE' WHEN z = 1 AND list_contains(found, 'PERMISSION') THEN 'PERMISSION' WHEN z = 3 AND list_contains(found, 'OBLIGATION') AND NOT list_contains(found, 'PERMISSION') THEN 'OBLIGATION' WHEN z = 3 AND list_contains(found, 'PERMISSION') AND NOT list_contains(found, 'OBLIGATION') THEN 'PERMISSION' END AS chosen FROM m)",
    select="SELECT chunk_id, sentence_no, coalesce(chosen, label) AS label, label AS rule_label, CASE WHEN chosen IS NULL THEN 'rules' ELSE 'model' END AS decided_by FROM c",
)
SQL["deontic_confirmed"] = _CONFIRM_IN
