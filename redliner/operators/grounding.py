"""Reading model answers and holding them against the text: parties, summaries, critics, and the rounds between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redliner.functions import text as T
from redliner.operators import impact
from redliner.sources.files import kept

#: Names that stand for every party.
GENERIC = ["both parties", "either party", "each party", "the parties", "parties", "neither party"]
#: Words that say who without naming anyone.
ROLE_WORDS = """anyone anybody everyone someone those people person persons party parties user users creator creators maker makers
developer developers distributor distributors company companies entity entities individual individuals organization
organizations organisation organisations owner owners holder holders business businesses who whoever""".split()
#: Function words of a description.
PARTY_STOP = "of the this that these which with from for and any all their its who into onto by in on to an a".split()
#: Where an answer lists the affected parties, entries that name nobody, and echoes of the question.
AFFECTED = r"(?i)\baffected(?:\s+parties)?\s*:"
NOBODY = r"(?i)^(?:no|none|nobody|n/?a|not applicable|unknown)\b|\bno part(?:y|ies)\b"
ECHOES = [r"(?i)^\s*(?:here\s+is|here's)\b[^:\n]{0,80}:\s*", r"(?i)^\s*(?:revised\s+)?(?:summary|impact|explanation)\s*:\s*"]
VERDICTS = r"(?:VERIFIED|HALLUCINATION|MISSING[_ ]CONTEXT)"


def _names() -> Column:
    return F.array().cast("array<string>")


def _stripped(text: Column, signs: str) -> Column:
    return F.regexp_replace(text, rf"^[{signs}]+|[{signs}]+$", "")


def _singular(word: Column) -> Column:
    return (
        F.when(word.endswith("ies") & (word != "third parties"), F.concat(F.regexp_replace(word, "ies$", ""), F.lit("y")))
        .when(word.endswith("s") & ~word.endswith("ss"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def _forms(names: Column) -> Column:
    """The lower-cased names, their parts around strokes, and the singulars of all these."""
    low = F.transform(names, lambda x: F.lower(x))
    parts = F.flatten(F.transform(low, lambda x: F.array_append(F.split(x, r"\s*/\s*"), x)))
    bare = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.concat(bare, F.transform(bare, _singular)))


def party_is_grounded(party: Column, text: Column, allowed: Column) -> Column:
    """The text names the party, or it is one of ``allowed``: in singular or plural, with an article, as one of two names around a
    stroke, or described by words that are all in the text (three words, two of them with content)."""
    name = F.regexp_replace(F.lower(F.trim(party)), r"^(?:the|all|any|its)\s+", "")
    plain = F.array(*[F.lit(x) for x in PARTY_STOP + ROLE_WORDS])
    # Bound once: an expression inside a lambda is evaluated for every element.
    bound = F.struct(
        name.alias("name"), F.lower(text).alias("low"), T.words(text).alias("vocabulary"), _forms(F.array(name)).alias("forms"), _forms(allowed).alias("allowed"),
        F.regexp_extract_all(name, F.lit("([a-z]+)"), F.lit(1)).alias("words"),
    )

    def judged(x: Column) -> Column:
        word = lambda f: F.rlike(x["low"], F.concat(F.lit(r"\b\Q"), f, F.lit(r"\E(?:s|es)?\b")))
        has = lambda w: F.array_contains(x["vocabulary"], w)
        content = F.filter(x["words"], lambda w: ~F.array_contains(plain, w) & (F.length(w) > 2))
        described = (F.size(x["words"]) >= 3) & (F.size(content) >= 2) & F.forall(content, lambda w: has(w) | has(_singular(w)) | has(F.concat(w, F.lit("s"))))
        return (x["name"] != "") & (x["name"].isin(GENERIC) | F.arrays_overlap(x["forms"], x["allowed"]) | F.exists(x["forms"], word) | described)

    return F.coalesce(F.transform(F.array(bound), judged)[0], F.lit(False))


def grounded_parties(affected: Column, text: Column, named: Column) -> Column:
    """The affected parties that the text or the contract names: those only hinted at by the clause's category go."""
    return F.filter(affected, lambda a: party_is_grounded(a, text, named))


def parse_impact(raw: Column) -> Column:
    """``struct<summary, affected>`` of an answer: the text before its list of affected parties, and the list, each party once."""
    text = F.trim(F.replace(raw, F.lit("**"), F.lit("")))
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    lists = F.regexp_extract_all(text, F.lit(AFFECTED + r"\s*([^\n]*)"), F.lit(1))
    before = F.when(F.size(lists) > 0, F.regexp_extract(text, r"(?s)^(.*?)" + AFFECTED, 1)).otherwise(text)
    for echo in ECHOES:
        before = F.regexp_replace(F.regexp_replace(before, r"^\s+|\s+$", ""), echo, "")
    pieces = F.flatten(F.transform(lists, lambda x: F.split(x, r"[;,]|\band\b")))
    named = F.filter(F.transform(pieces, lambda x: _stripped(x, r" .*\-")), lambda x: x != "")
    lower = F.transform(named, lambda x: F.lower(x))
    once = F.filter(named, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)
    placeholder = lambda x: F.lower(x).isin("party one", "party two") | F.trim(x).rlike(r"^[\[<{].*[\]>}]$")
    return F.struct(T.normalize_text(before).alias("summary"), F.filter(once, lambda x: ~placeholder(x) & ~x.rlike(NOBODY)).alias("affected"))


def parse_critic(raw: Column) -> Column:
    """``struct<verdict, reason>``: the one verdict of the first line, else the one of the whole answer; UNKNOWN where several
    lines begin with different ones or there is no single one."""
    text = F.regexp_replace(F.replace(raw, F.lit("**"), F.lit("")), r"^\s+|\s+$", "")
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x) != "")

    def verdicts(s: Column) -> Column:
        found = F.regexp_extract_all(F.upper(s), F.lit(f"({VERDICTS})"), F.lit(1))
        return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(" "), F.lit("_"))))

    starts = F.transform(lines, lambda x: F.replace(F.regexp_extract(F.upper(_stripped(x, r" \-*#>")), f"^({VERDICTS})", 1), F.lit(" "), F.lit("_")))
    several = F.size(F.array_distinct(F.filter(starts, lambda x: x != ""))) > 1
    first = verdicts(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")))
    found = F.when(F.size(first) > 0, first).otherwise(verdicts(text))
    readable = ~several & (F.size(found) == 1)
    rest = F.regexp_extract(text, rf"(?is)^.*?{VERDICTS}(.*)$", 1)
    reason = F.left(T.normalize_text(F.regexp_replace(rest, r"^[ .:\-\n]+|[ .:\-\n]+$", "")), F.lit(300))
    return F.struct(
        F.when(readable, F.try_element_at(found, F.lit(1))).otherwise("UNKNOWN").alias("verdict"), F.when(readable, reason).otherwise("").alias("reason")
    )


def double_check_words(issues: Column, unsupported: Column, least: int = 2) -> Column:
    """Words the critic is asked about: those of a draft without issues that has more than ``least`` words the text does not have."""
    return F.when((F.size(issues) == 0) & (F.size(unsupported) > least), unsupported).otherwise(_names())


def views(
    pairs: DataFrame, source: DataFrame, target: DataFrame, shifts: DataFrame, facts: DataFrame, contract_parties: DataFrame, sentences: DataFrame, key: str = "contract_id"
) -> DataFrame:
    """All that is known about each pair, one row each: texts, heading, duties, numbers, categories, parties, changed sentences.

    ``facts(pair_id, numbers_changed, categories, stakeholders, parties)``, ``contract_parties(contract, parties)`` and
    ``sentences(pair_id, side, sentence, pos)`` come from their operators; what a pair lacks is null or empty.
    """
    a = source.select(F.col("chunk_id").alias("source_id"), F.col("text").alias("source_text"), F.col("heading").alias("source_heading"))
    b = target.select(F.col("chunk_id").alias("target_id"), F.col("text").alias("target_text"), F.col("heading").alias("target_heading"))
    said = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "sentence")))), lambda x: x["sentence"])
    changed = sentences.groupBy("pair_id").agg(said("source").alias("changed_old"), said("target").alias("changed_new"))
    duties = shifts.select("pair_id", "shift", "labels_added", "labels_removed")
    rows = pairs.select("pair_id", key, "change_status", "source_id", "target_id").join(a, "source_id", "left").join(b, "target_id", "left")
    rows = rows.join(duties, "pair_id", "left").join(facts, "pair_id", "left").join(changed, "pair_id", "left")
    rows = rows.join(contract_parties.withColumnRenamed("parties", "contract_parties"), key, "left")
    lists = ["labels_added", "labels_removed", "categories", "stakeholders", "parties", "contract_parties", "changed_old", "changed_new"]
    return rows.withColumns({c: F.coalesce(c, _names()) for c in lists} | {"heading": F.coalesce("target_heading", "source_heading")}).drop("source_heading", "target_heading")


def context_texts(around: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(pair_id, context_text)`` of neighbours ``(pair_id, neighbor_id, offset)``: each once, in document order, joined by `` [...] ``."""
    rows = around.select("pair_id", F.col("neighbor_id").alias("chunk_id")).distinct().join(chunks.select("chunk_id", "ordinal", "text"), "chunk_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id", "text"))), lambda x: x["text"])
    return rows.groupBy("pair_id").agg(F.array_join(listed, " [...] ").alias("context_text"))


def drafts(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Views with an answer, judged: ``summary``, ``affected`` (hints gone), ``issues`` and the words to ``double_check``."""
    parsed = parse_impact(F.coalesce(raw, F.lit("")))
    text = F.concat_ws(" ", "source_text", "target_text", F.when(F.col("context_text") != "", F.col("context_text")), "heading")
    named = F.concat("parties", "contract_parties")
    out = rows.withColumn("__p", parsed).withColumn("__text", text).withColumn("summary", F.col("__p.summary"))
    out = out.withColumn("affected", grounded_parties(F.col("__p.affected"), F.col("__text"), named))
    wider = F.concat_ws(" ", "__text", F.array_join("contract_parties", " "))
    strange = impact.unsupported_words(F.col("summary"), wider)
    lost = F.filter("affected", lambda a: ~party_is_grounded(a, F.col("__text"), F.concat(named, F.col("stakeholders"))))
    issues = impact.check_summary(F.col("summary"), F.col("__text"), lost, vocabulary=wider)
    out = out.withColumn("issues", issues).withColumn("double_check", double_check_words(F.col("issues"), strange))
    return out.drop("__p", "__text")


AnswerFn = Callable[[DataFrame], DataFrame]


def reviewed(rows: DataFrame, summary_fn: AnswerFn, critic_fn: AnswerFn, wider: DataFrame | None = None) -> DataFrame:
    """Every view through summary, checks and critic, twice at most: the attempts ``(pair_id, attempt, n_issues, critic, reason, summary, affected, context_level, decided_by)``.

    ``summary_fn`` answers views, with ``warning`` (why the last draft was rejected), with ``(pair_id, raw)``; ``critic_fn``
    answers drafts without issues with ``(pair_id, raw, raw_retry)``.  Missing context gives the second attempt the
    neighbours of ``wider(pair_id, context_text)`` instead of a warning.  Drafts and first attempts are written as they are made,
    so no question is asked twice (for a result read once) and no task holds the sorts of all rounds.
    """
    none = F.lit(None).cast("string")

    def attempt(todo: DataFrame, no: int) -> DataFrame:
        drafted = kept(drafts(todo.join(summary_fn(todo).select("pair_id", "raw"), "pair_id", "left")), "drafts")
        asked = drafted.where("size(issues) = 0")
        answers = critic_fn(asked).select("pair_id", parse_critic(F.col("raw")).alias("c1"), parse_critic(F.coalesce("raw_retry", F.lit(""))).alias("c2"))
        out = drafted.select("pair_id", "issues", "summary", "affected", "context_level").join(answers, "pair_id", "left")
        said = F.when(F.col("c1.verdict") == "UNKNOWN", F.col("c2")).otherwise(F.col("c1"))
        bad = F.size("issues") > 0
        return out.select(
            "pair_id",
            F.lit(no).alias("attempt"),
            F.size("issues").alias("n_issues"),
            F.when(~bad, F.coalesce(said["verdict"], F.lit("UNKNOWN"))).alias("critic"),
            F.when(bad, F.array_join("issues", "; ")).otherwise(F.coalesce(said["reason"], F.lit(""))).alias("reason"),
            "summary",
            "affected",
            "context_level",
            F.when(bad, "checks").otherwise("critic").alias("decided_by"),
        )

    first = kept(attempt(rows.withColumns({"context_text": F.lit(""), "context_level": F.lit(0), "warning": none}), 1), "attempt")
    rejected = first.withColumn("verdict", F.when(F.col("n_issues") > 0, "HALLUCINATION").otherwise(F.col("critic"))).where("verdict not in ('VERIFIED', 'UNKNOWN')")
    again = rows.join(rejected.select("pair_id", F.col("verdict").alias("__v"), F.col("reason").alias("__r")), "pair_id")
    again = again.join(wider, "pair_id", "left") if wider is not None else again.withColumn("context_text", F.lit(""))
    widens = F.col("__v") == "MISSING_CONTEXT"
    again = again.withColumns(
        {
            "context_text": F.when(widens, F.coalesce("context_text", F.lit(""))).otherwise(""),
            "context_level": widens.cast("int"),
            "warning": F.when(~widens, F.when(F.col("__r") != "", F.col("__r")).otherwise("the summary was not supported by the text")),
        }
    ).drop("__v", "__r")
    again = kept(again, "rejected")
    return first.unionByName(attempt(again, 2))


def results(rows: DataFrame, attempts: DataFrame, trivial: DataFrame | None = None) -> DataFrame:
    """The result of each pair: its last attempt with status and confidence, and its history; pairs of ``trivial(pair_id)`` are SKIPPED."""
    last = attempts.groupBy("pair_id").agg(
        F.max_by(F.struct("summary", "affected", "decided_by"), "attempt").alias("last"), F.array_sort(F.collect_list(F.struct("attempt", "context_level", "summary", "critic", "reason", "decided_by"))).alias("history")
    )
    out = rows.join(impact.route(attempts), "pair_id", "left").join(last, "pair_id", "left")
    skipped = F.lit(False) if trivial is None else F.col("__skip").isNotNull()
    if trivial is not None:
        out = out.join(trivial.select("pair_id", F.lit(1).alias("__skip")), "pair_id", "left")
    return out.withColumns(
        {
            "status": F.when(skipped, "SKIPPED").otherwise(F.col("status")),
            "summary": F.coalesce("last.summary", F.lit("")),
            "affected": F.coalesce("last.affected", _names()),
            "decided_by": F.col("last.decided_by"),
        }
    ).drop("last", *([] if trivial is None else ["__skip"]))


def run_counts(done: DataFrame, attempts: DataFrame, key: str = "contract_id") -> DataFrame:
    """Per contract: results by status, the ids of low confidence, and how often summary and critic were asked."""
    calls = attempts.join(done.select("pair_id", key), "pair_id").groupBy(key).agg(F.count("*").alias("summary_calls"), F.count_if(F.col("decided_by") == "critic").alias("critic_calls"))
    low = F.sort_array(F.collect_list(F.when(F.col("status") == "LOW_CONFIDENCE", F.col("pair_id"))))
    by = [F.count_if(F.col("status") == s).alias("n_" + s.lower()) for s in ("VERIFIED", "LOW_CONFIDENCE", "SKIPPED")]
    out = done.groupBy(key).agg(*by, low.alias("low_confidence")).join(calls, key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("summary_calls", "critic_calls")})
