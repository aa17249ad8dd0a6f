"""The whole comparison of two versions of many contracts, from clauses to report layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redliner.operators import align, deontic, evidence, grounding, impact, ontology, report


def compared(source: DataFrame, target: DataFrame, verdict_fn=None) -> tuple[DataFrame, DataFrame]:
    """The alignment and its changed pairs.  Callers that read them many times write or cache them."""
    aligned = align.align(source, target, verdict_fn)
    return aligned, align.changed_pairs(aligned, target)


def facts(pairs: DataFrame, source: DataFrame, target: DataFrame, aligned: DataFrame) -> DataFrame:
    """``(pair_id, numbers_changed, categories, stakeholders, parties)`` of each pair's texts."""
    none = F.array().cast("array<string>")
    diff = aligned.where("target_id is not null").select("source_id", F.col("numeric_diff.only_in_source").alias("old"), F.col("numeric_diff.only_in_target").alias("new"))
    a, b = source.select(F.col("chunk_id").alias("source_id"), F.col("text").alias("a")), target.select(F.col("chunk_id").alias("target_id"), F.col("text").alias("b"))
    rows = pairs.join(a, "source_id", "left").join(b, "target_id", "left").withColumn("text", F.concat_ws(" ", "a", "b")).join(diff, "source_id", "left")
    found = ontology.detect_categories(rows.select("pair_id", "text"), "pair_id")
    listed = lambda name, by: F.transform(F.array_sort(F.collect_list(F.struct(by, name))), lambda x: x[name])
    categories = found.groupBy("pair_id").agg(listed("category", "rank").alias("categories"))
    who = ontology.stakeholders_for(found, "pair_id", ontology.ontology(pairs.sparkSession)).groupBy("pair_id").agg(listed("stakeholder", "pos").alias("stakeholders"))
    numbers = impact.numbers_changed(F.coalesce("old", none), F.coalesce("new", none))
    out = rows.select("pair_id", numbers.alias("numbers_changed"), ontology.find_parties(F.col("text")).alias("parties"))
    return out.join(categories, "pair_id", "left").join(who, "pair_id", "left")


def _with_numbers(pairs: DataFrame, aligned: DataFrame) -> DataFrame:
    """``pairs`` with the numbers on one side only of each, empty where nothing is matched."""
    none = F.array().cast("array<string>")
    diff = aligned.where("target_id is not null").select(F.col("source_id").alias("__key"), F.col("numeric_diff.only_in_source").alias("old_numbers"), F.col("numeric_diff.only_in_target").alias("new_numbers"))
    rows = pairs.withColumn("__key", F.coalesce("source_id", F.concat(F.lit("\x00"), "pair_id"))).join(diff, "__key", "left").drop("__key")
    return rows.withColumns({"old_numbers": F.coalesce("old_numbers", none), "new_numbers": F.coalesce("new_numbers", none)})


def views(source: DataFrame, target: DataFrame, aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """Everything that is known about each changed pair, for summaries and their checks: ``grounding.views`` made of each pair's row as its texts are joined."""
    sides = [side.select(F.col("chunk_id").alias(f"{n}_id"), F.col("text").alias(f"{n}_text"), F.col("heading").alias(f"{n}_heading")) for n, side in (("source", source), ("target", target))]
    rows = _with_numbers(pairs.select("pair_id", "contract_id", "change_status", "source_id", "target_id"), aligned)
    rows = deontic.described(deontic.with_clauses(rows, *sides), 3).drop("primary_label", "has_deontic_change")
    text = F.concat_ws(" ", "source_text", "target_text")
    rows = ontology.with_categories(rows, text).withColumn("parties", ontology.find_parties(text))
    rows = rows.withColumns({"numbers_changed": impact.numbers_changed(F.col("old_numbers"), F.col("new_numbers")), "heading": F.coalesce("target_heading", "source_heading")})
    rows = rows.drop("old_numbers", "new_numbers", "source_heading", "target_heading")
    who = ontology.contract_parties(source, "contract_id").withColumnRenamed("parties", "contract_parties")
    return rows.join(who, "contract_id", "left").withColumn("contract_parties", F.coalesce("contract_parties", F.array().cast("array<string>")))


def changes(source: DataFrame, target: DataFrame, verdict_fn=None) -> DataFrame:
    """Every changed pair with duties, numbers, affected parties, importance, place and id; pairs with too little text are left out."""
    aligned, pairs = compared(source, target, verdict_fn)
    return changes_of(source, target, aligned, pairs)


def with_places(side: DataFrame) -> DataFrame:
    """Clauses with their relative ``place`` in the contract, for ``changes_of``; made where they are dealt by contract anyway."""
    return side.withColumn("place", (F.col("ordinal") - 1) / F.count("*").over(Window.partitionBy("contract_id")))


def changes_of(source: DataFrame, target: DataFrame, aligned: DataFrame, pairs: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """``changes`` of an alignment that is already there.  With ``wanted`` these columns only, of the same rows: joins and passes over the
    texts that none of them needs are not made."""
    asked = lambda *made: wanted is None or not set(made).isdisjoint(wanted)
    duties = asked("primary_label", "shift", "labels_added", "labels_removed", "has_deontic_change", "importance", "why", "summary")
    numbers = asked("old_numbers", "new_numbers", "key_old", "key_new", "importance", "why", "summary")
    numbered, sections = asked("change_no", "change_id"), asked("section")
    places = numbered or asked("place")

    def placed(side: DataFrame, name: str) -> DataFrame:
        have = ["text", "heading", *["place"] * places]
        rows = side
        if places and "place" not in side.columns:
            rows = with_places(side.repartition("contract_id"))
        if sections:
            rows = evidence.running_sections(rows, "contract_id", tuple(have))
        return rows.select(F.col("chunk_id").alias(f"{name}_id"), *[F.col(c).alias(f"{name}_{c}") for c in [*have, *["section"] * sections]])

    # A clause brings its text, place and section along, so that each side is joined once.
    rows = deontic.with_clauses(_with_numbers(pairs, aligned) if numbers else pairs, placed(source, "source"), placed(target, "target"))
    rows = rows.withColumn("heading", F.coalesce("target_heading", "source_heading"))
    rows = rows.where(~impact.is_trivial(F.coalesce("heading", F.lit("")), F.col("source_text"), F.col("target_text")))
    if duties:
        rows = deontic.described(rows)
    text = F.concat_ws(" ", "source_text", "target_text")
    if numbers:
        rows = rows.withColumns({"key_old": report.key_numbers(F.col("old_numbers"), text), "key_new": report.key_numbers(F.col("new_numbers"), text)})
    if duties and numbers:
        score = report.importance(F.col("change_status"), F.col("shift"), F.col("labels_added"), F.col("labels_removed"), F.size("key_old") + F.size("key_new"))
        rows = rows.withColumn("importance", score).withColumn("why", report.why(F.col("shift"), F.col("key_old"), F.col("key_new"), F.col("labels_added"), F.col("labels_removed")))
    rows = rows.withColumn("affected", ontology.find_parties(text)).withColumn("needs_review", F.col("change_status") == "UNVERIFIED")
    # What texts are read for is made before the next exchange, which goes without them.
    rows = rows.withColumn("title", report.title(F.col("heading"), text)).drop("source_text", "target_text", "source_heading", "target_heading")
    if sections:
        section = F.when(F.col("target_id").isNotNull(), F.col("target_section")).otherwise(F.col("source_section"))
        rows = rows.withColumn("section", F.coalesce(section, report.section_fallback(F.array("heading")))).drop("target_section", "source_section")
    if places:
        rows = rows.withColumn("place", F.coalesce("target_place", "source_place", F.lit(2.0))).drop("target_place", "source_place")
    if duties and numbers:
        changed = impact.numbers_changed(F.col("old_numbers"), F.col("new_numbers"))
        rows = rows.withColumn("summary", impact.template_summary(F.col("change_status"), F.col("heading"), F.col("shift"), changed))
    rows = rows.drop("heading")
    if numbered:
        rows = report.numbered_by_place(rows)
    return rows if wanted is None else rows.select(*wanted)
