"""The report's layers: changes in document order, overview, stakeholders, sections, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redliner.operators.ontology import BOTH

TYPES = ["MODIFIED", "ADDED", "DELETED", "UNVERIFIED"]
#: Fixed value: a unit of time after a number.
UNIT = r"\)?\s*(?:\(\w+\)\s*)?(?:calendar\s+|business\s+|successive\s+)?(?:days?|weeks?|months?|years?)\b"


def latest(results: DataFrame) -> DataFrame:
    """The last arrival of each pair, whatever the order rows come in: ``results(pair_id, arrival_no, ...)``."""
    cols = [c for c in results.columns if c != "pair_id"]
    return results.groupBy("pair_id").agg(F.max_by(F.struct(*cols), "arrival_no").alias("r")).select("pair_id", "r.*")


def numbered(changes: DataFrame, source: DataFrame, target: DataFrame, key: str = "contract_id") -> DataFrame:
    """``changes`` with ``place`` (relative place in the new version, else in the old one, else 2) and ``change_id`` C001, C002 ... per contract.

    Changes whose ``status`` is SKIPPED take no number; without the column all are numbered.
    """

    def places(chunks: DataFrame, name: str) -> DataFrame:
        of = F.count("*").over(Window.partitionBy(key))
        return chunks.select(F.col("chunk_id").alias(name), ((F.col("ordinal") - 1) / of).alias(f"{name}_place"))

    rows = changes.join(places(target, "target_id"), "target_id", "left").join(places(source, "source_id"), "source_id", "left")
    return numbered_by_place(rows.withColumn("place", F.coalesce("target_id_place", "source_id_place", F.lit(2.0))).drop("target_id_place", "source_id_place"), key)


def numbered_by_place(rows: DataFrame, key: str = "contract_id") -> DataFrame:
    """``numbered`` of changes that have their ``place``."""
    skipped = F.coalesce(F.col("status") == "SKIPPED", F.lit(False)) if "status" in rows.columns else F.lit(False)
    no = F.row_number().over(Window.partitionBy(key, skipped).orderBy("place", "pair_id"))
    return rows.withColumn("change_no", F.when(~skipped, no)).withColumn("change_id", F.format_string("C%03d", "change_no")).withColumn("change_id", F.when(~skipped, F.col("change_id")))


def key_numbers(tokens: Column, text: Column) -> Column:
    """Numbers that matter: amounts, percentages, and those followed by a period of time; section references are none."""
    quoted = lambda t: F.concat(F.lit(r"(?i)(?<![\d.,])\Q"), t, F.lit(r"\E" + UNIT))
    return F.filter(tokens, lambda t: F.contains(t, F.lit("$")) | F.contains(t, F.lit("%")) | (~t.rlike(r"^\d+\.\d+$") & F.rlike(text, quoted(t))))


def importance(change_type: Column, shift: Column, added: Column, removed: Column, n_key_numbers: Column) -> Column:
    duties = (F.size(added) > 0) | (F.size(removed) > 0)
    return (
        F.when(shift.isNotNull(), 3).otherwise(0)
        + F.when(F.array_contains(removed, "OBLIGATION") | F.array_contains(removed, "PROHIBITION"), 2).otherwise(0)
        + F.when(F.size(added) > 0, 1).otherwise(0)
        + F.when(n_key_numbers > 0, 3).otherwise(0)
        + F.when(change_type.isin("ADDED", "DELETED") & duties, 1).otherwise(0)
    )


def why(shift: Column, old: Column, new: Column, added: Column, removed: Column) -> Column:
    shown = lambda x: F.when(F.size(x) > 0, F.array_join(x, ", ")).otherwise("-")
    return F.concat_ws(
        "; ",
        F.concat(F.lit("duty shift "), shift),
        F.when((F.size(old) > 0) | (F.size(new) > 0), F.concat(F.lit("numbers "), shown(old), F.lit(" -> "), shown(new))),
        F.when((F.size(removed) > 0) & shift.isNull(), F.concat(F.lit("removes "), F.lower(F.array_join(removed, "/")))),
        F.when((F.size(added) > 0) & shift.isNull(), F.concat(F.lit("adds "), F.lower(F.array_join(added, "/")))),
    )


def section_fallback(heading_path: Column) -> Column:
    """The first numbered heading, else Other."""
    flat = F.transform(heading_path, lambda h: F.trim(F.regexp_replace(h, r"\s+", " ")))
    sub = r"^(\d{1,2})\.\d{1,2}(?!\d)"
    named = F.transform(flat, lambda h: F.when(h.rlike(sub), F.concat(F.lit("Section "), F.regexp_extract(h, sub, 1))).when(h.rlike(r"^\s*\d{1,2}\.(?!\d)"), F.left(h, F.lit(70))))
    return F.coalesce(F.get(F.filter(named, lambda x: x.isNotNull()), F.lit(0)), F.lit("Other"))


def title(heading: Column, first_sentence: Column) -> Column:
    clean = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    letters = F.length(F.regexp_replace(clean(heading), r"[^\p{L}]", ""))
    shown = F.when(letters < 4, F.regexp_replace(F.coalesce(clean(first_sentence), clean(heading)), r"^[^A-Za-z]+", "")).otherwise(clean(heading))
    return F.when(F.length(shown) > 70, F.concat(F.regexp_replace(F.left(shown, F.lit(70)), r" [^ ]*$", ""), F.lit(" …"))).otherwise(shown)


def overview(changes: DataFrame, key: str = "contract_id", unchanged: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """Counts by type and confidence, duty shifts, ids to review, and the headline, per contract.

    ``unchanged(contract, unchanged_clauses)`` and ``skipped(contract, n_skipped)`` are joined where given; confidence is counted where changes have one.
    """
    n = {t: F.count_if(F.col("change_status") == t) for t in TYPES}
    confidence = F.coalesce("confidence", F.lit("NONE")) if "confidence" in changes.columns else F.lit("NONE")
    review = F.transform(F.array_sort(F.collect_list(F.when(F.col("needs_review"), F.struct("change_no", "change_id")))), lambda x: x["change_id"])
    out = changes.groupBy(key).agg(
        F.count("*").alias("total_changes"), *[c.alias(t.lower()) for t, c in n.items()], *[F.count_if(confidence == c).alias("n_" + c.lower()) for c in ("HIGH", "LOW", "NONE")],
        F.count("shift").alias("duty_shifts"), F.count_if("needs_review").alias("n_review"), F.array_join(review, ",").alias("review_ids"),
    )
    parts = F.concat_ws(", ", *[F.when(F.col(t.lower()) > 0, F.concat(F.col(t.lower()).cast("string"), F.lit(" " + t.lower()))) for t in TYPES])
    plural = lambda c, word: F.concat(F.col(c).cast("string"), F.lit(" " + word), F.when(F.col(c) != 1, "s").otherwise(""))
    headline = F.concat(
        plural("total_changes", "change"),
        F.when(parts != "", F.concat(F.lit(": "), parts)).otherwise(""),
        F.when(F.col("duty_shifts") > 0, F.concat(F.lit("; "), plural("duty_shifts", "duty shift"))).otherwise(""),
        F.lit("; "), F.col("n_review").cast("string"), F.lit(" need"), F.when(F.col("n_review") == 1, "s").otherwise(""), F.lit(" human review"),
    )
    out = out.withColumn("headline", headline)
    for more in (unchanged, skipped):
        out = out if more is None else out.join(more, key, "left")
    return out


def highlights(changes: DataFrame, k: int = 5, key: str = "contract_id") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("importance"), "change_no")
    return changes.where("importance > 0 and not needs_review").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def by_stakeholder(changes: DataFrame, parties: DataFrame, key: str = "contract_id") -> DataFrame:
    """``(contract, party, change_count, changes, rank)``; changes of both parties count for each contract party, where these are known."""
    rows = changes.join(parties.withColumnRenamed("parties", "__p"), key, "left")
    known = F.coalesce(F.size("__p") > 0, F.lit(False)) & F.array_contains("affected", BOTH)
    whom = F.array_distinct(F.when(known, F.concat(F.array_remove("affected", BOTH), F.col("__p"))).otherwise(F.col("affected")))
    rows = rows.select(key, "change_no", "change_id", F.posexplode(whom).alias("n", "party"))
    out = rows.groupBy(key, "party").agg(
        F.count("*").alias("change_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("change_no", "change_id"))), lambda x: x["change_id"]), ",").alias("changes"),
        F.min(F.struct("change_no", "n")).alias("first"),
    )
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("change_count"), "first"))).drop("first")


def by_section(changes: DataFrame, key: str = "contract_id") -> DataFrame:
    out = changes.groupBy(key, "section").agg(F.count("*").alias("change_count"), F.min("change_no").alias("first"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("first"))).drop("first")


def index_by_page(evidence: DataFrame) -> DataFrame:
    """``evidence(document_id, change_id, page_start, page_end)`` to ``(document_id, page, changes)``, every page of a span."""
    rows = evidence.where("page_start is not null").select("document_id", "change_id", F.explode(F.sequence("page_start", F.greatest("page_start", F.coalesce("page_end", "page_start")))).alias("page"))
    return rows.groupBy("document_id", "page").agg(F.array_join(F.sort_array(F.collect_list("change_id")), ",").alias("changes"))


def ui_status(change_status: Column) -> Column:
    return F.when(change_status == "MODIFIED", "diverge").when(change_status == "ADDED", "missing_in_a").otherwise("missing_in_b")


def facet_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("n_all"), F.count_if("needs_review").alias("n_review"),
        *[F.count_if(F.col("ui") == s).alias("n_" + s) for s in ("diverge", "missing_in_a", "missing_in_b")],
    )


def ui_rows(changes: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Changes as rows of a comparison: ``ui`` status and the clause on either side, by two left joins."""
    sides = []
    for side, chunks in (("source", source), ("target", target)):
        sides.append(chunks.select(F.col("chunk_id").alias(f"{side}_id"), F.col("heading").alias(f"{side}_heading"), F.col("text").alias(f"{side}_text")))
    return changes.withColumn("ui", ui_status(F.col("change_status"))).join(sides[0], "source_id", "left").join(sides[1], "target_id", "left")


def ui_chunks(evidence: DataFrame) -> DataFrame:
    """The clauses that changes touch, each once: ``(chunk_id, text, page_start, page_end, highlights)``, in the order of ids."""
    first = evidence.groupBy("chunk_id").agg(F.min_by(F.struct("text", "page_start", "page_end", "highlights"), "pair_id").alias("c"))
    return first.select("chunk_id", "c.*").orderBy("chunk_id")


def facets(rows: DataFrame, facet: str) -> DataFrame:
    """The rows of one facet: all, pending, review, or a status."""
    chosen = {"all": F.lit(True), "pending": F.col("pending") if "pending" in rows.columns else F.lit(False), "review": F.col("needs_review")}
    return rows.where(chosen[facet] if facet in chosen else F.col("ui") == facet)


def markdown(changes: DataFrame, heads: DataFrame, key: str = "contract_id", stakeholders: DataFrame | None = None, evidence: DataFrame | None = None, k: int = 5, max_quote: int = 300) -> DataFrame:
    """``(contract, markdown)``: headline, most important changes, those to review, stakeholders, and every change by section with quotes; written by tasks, not on the driver.

    ``stakeholders`` and ``evidence`` are the reports' layers of these names; their parts are left out without them.
    """
    dash = lambda x: F.when(F.size(x) > 0, F.array_join(x, ", ")).otherwise("-")
    rows = changes.withColumn("__affected", F.array_join("affected", ", "))
    if evidence is not None:
        flat = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
        quote = flat(F.array_join("changed_sentences", " "))
        cut = F.when(F.length(quote) > max_quote, F.concat(F.regexp_replace(F.left(quote, F.lit(max_quote)), r" [^ ]*$", ""), F.lit(" …"))).otherwise(quote)
        pages = F.when(F.col("page_start").isNull(), "").when(F.coalesce("page_end", "page_start") == F.col("page_start"), F.concat(F.lit("p. "), F.col("page_start").cast("string"))).otherwise(
            F.concat(F.lit("pp. "), F.col("page_start").cast("string"), F.lit("–"), F.col("page_end").cast("string"))
        )
        label = F.when(F.col("side") == "source", "Previous version").otherwise("New version")
        line = F.when(F.size("changed_sentences") > 0, F.concat(F.lit("> *"), label, F.lit(", "), pages, F.lit(":* "), cut))
        quotes = evidence.groupBy("pair_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("side", line.alias("l"))))), lambda x: x["l"]), "\n>\n").alias("__quotes"))
        rows = rows.join(quotes, "pair_id", "left")
    else:
        rows = rows.withColumn("__quotes", F.lit(""))
    high = F.col("confidence") == "HIGH" if "confidence" in changes.columns else ~F.col("needs_review")
    facts = F.concat_ws(
        " · ",
        F.when(F.col("__affected") != "", F.concat(F.lit("**Affected:** "), "__affected")),
        F.concat(F.lit("**Duty shift:** "), "shift"),
        F.when((F.size("old_numbers") > 0) | (F.size("new_numbers") > 0), F.concat(F.lit("**Numbers:** "), dash(F.col("old_numbers")), F.lit(" → "), dash(F.col("new_numbers")))),
    )
    block = F.concat_ws(
        "\n\n",
        F.concat(F.lit("#### "), "change_id", F.lit(" · "), "change_status", F.lit(" · "), "title", F.lit("  ("), F.when(high, "✅").otherwise("⚠️ needs review"), F.lit(")")),
        F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise("*(no summary)*"),
        F.when(facts != "", facts),
        F.when(F.col("__quotes") != "", F.col("__quotes")),
    )
    opens = F.lag("section").over(Window.partitionBy(key).orderBy("change_no"))
    rows = rows.withColumn("__block", F.when(opens.isNull() | (opens != F.col("section")), F.concat(F.lit("### "), "section", F.lit("\n\n"), block)).otherwise(block))
    ranked = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.when((F.col("importance") > 0) & ~F.col("needs_review"), F.col("importance"))), "change_no"))
    top = (F.col("importance") > 0) & ~F.col("needs_review") & (F.col("__rank") <= k)
    named = F.concat(F.lit("- **"), "change_id", F.lit(" "), "title", F.lit("**: "))
    joined = lambda rank, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, line.alias("l")))), lambda x: x["l"]), "\n")
    body = (
        rows.withColumn("__rank", ranked)
        .groupBy(key)
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("change_no", "__block"))), lambda x: x["__block"]), "\n\n").alias("__body"),
            joined("__rank", F.when(top, F.concat(named, F.coalesce("summary", F.lit("")), F.when(F.col("why") != "", F.concat(F.lit(" *("), "why", F.lit(")*"))).otherwise("")))).alias("__top"),
            joined("change_no", F.when(F.col("needs_review"), F.concat(named, F.left(F.coalesce(F.col("review_reason") if "review_reason" in changes.columns else F.lit(""), F.lit("")), F.lit(200))))).alias("__review"),
        )
    )
    out = heads.join(body, key)
    if stakeholders is not None:
        ids = F.split("changes", ",")
        line = F.concat(F.lit("| "), "party", F.lit(" | "), F.col("change_count").cast("string"), F.lit(": "), F.array_join(F.slice(ids, 1, 12), ", "), F.when(F.size(ids) > 12, " …").otherwise(""), F.lit(" |"))
        out = out.join(stakeholders.groupBy(key).agg(joined("rank", line).alias("__who")), key, "left")
    else:
        out = out.withColumn("__who", F.lit(""))
    unchanged = F.when(F.col("unchanged_clauses").isNotNull(), F.concat(F.lit("Unchanged clauses: "), F.col("unchanged_clauses").cast("string"), F.lit("."))) if "unchanged_clauses" in heads.columns else F.lit(None).cast("string")
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head + "\n\n"), c))
    whole = F.concat_ws(
        "\n\n",
        F.lit("# Comparison report"),
        F.concat(F.lit("> "), "headline"),
        unchanged,
        part("## Most important changes", F.col("__top")),
        part("## Needs human review", F.col("__review")),
        part("## By stakeholder", F.when(F.col("__who") != "", F.concat(F.lit("| Party | Changes |\n|---|---|\n"), "__who"))),
        F.concat(F.lit("## All changes\n\n"), "__body"),
    )
    return out.select(key, F.concat(whole, F.lit("\n")).alias("markdown"))
