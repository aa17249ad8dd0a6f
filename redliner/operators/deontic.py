"""Duties of clauses and their change: sentences, profiles, shifts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from redliner.functions import deontic as D
from redliner.functions import text as T
from redliner.functions.deontic import sentence_label
from redliner.functions.sentences import sentence_texts, split_sentences
from redliner.functions.text import split_words
from redliner.sources.files import cached

#: Sentences whose labels a task keeps.
KNOWN = 1 << 14
LabelFn = Callable[[DataFrame], DataFrame]


def sentences(chunks: DataFrame, text: str = "text") -> DataFrame:
    """``chunks`` less the text, a row for each sentence: ``sentence_no`` from 0, ``sentence``, ``start``, ``end``."""
    keep = [c for c in chunks.columns if c != text]
    return chunks.select(*keep, F.posexplode(split_sentences(F.col(text))).alias("sentence_no", "s")).select(
        *keep, "sentence_no", F.col("s.text").alias("sentence"), F.col("s.start").alias("start"), F.col("s.end").alias("end")
    )


def tagged(chunks: DataFrame, text: str = "text") -> DataFrame:
    """The sentences with a cue, without definitions, with ``label``, ``ambiguous`` and the labels ``found``."""
    return D.with_labels(sentences(chunks, text).where(~D.is_definition(F.col("sentence"))))


def confirmed(found: DataFrame, label_fn: LabelFn | None = None, mode: str = "ambiguous", cache: DataFrame | None = None) -> DataFrame:
    """``found`` with labels confirmed by a model: ``label``, ``rule_label``, ``decided_by`` (rules or model).

    Asked are the ambiguous sentences, or all of them (``mode``), each distinct sentence with its allowed labels once;
    ``label_fn`` answers ``(key, sentence, allowed)`` with ``(key, raw)``.  Answers in ``cache(key, raw)`` are not asked again.
    The model may choose a label the cues found, or NONE; an unusable answer leaves the rules' label.
    """
    if mode not in ("ambiguous", "all", "off"):
        raise ValueError(f"unknown mode {mode}")
    rows = found.withColumn("rule_label", F.col("label"))
    if label_fn is None or mode == "off":
        return rows.withColumn("decided_by", F.lit("rules"))
    allowed = F.array_append("found", F.lit(D.NONE))
    rows = rows.withColumn("allowed", allowed).withColumn("key", F.sha2(F.concat_ws("\x00", T.normalize_text(F.lower("sentence")), F.array_join(F.sort_array("allowed"), ",")), 256))
    asked = rows.where("ambiguous" if mode == "ambiguous" else "true").select("key", "sentence", "allowed").dropDuplicates(["key"])
    answers = label_fn(asked).select("key", "raw") if cache is None else cached(asked, cache.select("key", "raw"), lambda misses: label_fn(misses).select("key", "raw"))
    rows = rows.join(answers.dropDuplicates(["key"]), "key", "left").withColumn("chosen", D.parse_label(F.col("raw"), F.col("allowed")))
    asks = F.col("ambiguous") if mode == "ambiguous" else F.lit(True)
    model = asks & F.col("chosen").isNotNull()
    rows = rows.withColumn("label", F.when(model, F.col("chosen")).otherwise(F.col("rule_label"))).withColumn("decided_by", F.when(model, "model").otherwise("rules"))
    return rows.drop("key", "allowed", "raw", "chosen")


def profiles(found: DataFrame, *keys: str) -> DataFrame:
    """Counts by label, the primary label and the ordered labels, for each key (or NONE and no labels)."""
    counts = found.groupBy(*keys).agg(*[F.count(F.when(F.col("label") == x, 1)).alias(x.lower() + "s") for x in D.PRIORITY])
    n = {x: F.col(x.lower() + "s") for x in D.PRIORITY}
    labels = F.filter(F.array(*[F.when(n[x] > 0, F.lit(x)) for x in D.PRIORITY]), lambda x: x.isNotNull())
    return counts.withColumn("primary_label", D.primary_label(n)).withColumn("labels", labels)


def sides(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """``(pair_id, change_status, side, text)``: the texts of each pair."""
    a = pairs.select("pair_id", "change_status", F.lit("source").alias("side"), F.col("source_id").alias("chunk_id")).join(source.select("chunk_id", "text"), "chunk_id")
    b = pairs.select("pair_id", "change_status", F.lit("target").alias("side"), F.col("target_id").alias("chunk_id")).join(target.select("chunk_id", "text"), "chunk_id")
    return a.unionByName(b).drop("chunk_id")


def mark_changed(found: DataFrame) -> DataFrame:
    """``changed``: no sentence of the pair's other side reads the same.  A pair's equal sentences meet in one window."""
    same = Window.partitionBy("pair_id", T.normalize_text(F.lower("sentence")))
    return found.withColumn("changed", F.min("side").over(same) == F.max("side").over(same))


def duties(pairs: DataFrame, source: DataFrame, target: DataFrame, label_fn: LabelFn | None = None, mode: str = "ambiguous") -> DataFrame:
    """The duty sentences of each pair and side, with ``changed``; a clause is tagged once, whatever pairs it is in."""
    chunks = source.select("chunk_id", "text").unionByName(target.select("chunk_id", "text"))
    ids = [pairs.select("pair_id", "change_status", F.lit(side).alias("side"), F.col(f"{side}_id").alias("chunk_id")) for side in ("source", "target")]
    wanted = ids[0].unionByName(ids[1]).where("chunk_id is not null")
    found = tagged(chunks.join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    found = confirmed(found, label_fn, mode).where(F.col("label") != D.NONE) if label_fn else found
    return mark_changed(found.join(wanted, "chunk_id"))


def with_clauses(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """``pairs`` with the columns of its clauses on either side, whose ids are ``source_id`` and ``target_id``; ids that are null are spread over the tasks."""
    for name, side in (("source", source), ("target", target)):
        key = F.coalesce(F.col(f"{name}_id"), F.concat(F.lit("\x00"), F.col("pair_id")))
        pairs = pairs.withColumn("__key", key).join(side.withColumnRenamed(f"{name}_id", "__key"), "__key", "left").drop("__key")
    return pairs


def _duties_of(texts: tuple[str | None, str | None], k: int, known: dict[str, int | None]) -> tuple[list[int], list[list[str]]]:
    """Sentences with a duty by side, label and whether the other side has them too, and the first ``k`` sentences a side that the other does not have.

    ``known`` keeps the labels of sentences seen, so many at a time.
    """
    if len(known) > KNOWN:
        known.clear()
    said = [[(s, " ".join(split_words(s.lower()))) for s in sentence_texts(t)] for t in texts]
    for own in said:
        for s, _ in own:
            if s not in known:
                known[s] = sentence_label(s)
    tagged_ = [[(known[s], low) for s, low in own] for own in said]
    counts = [0] * 12
    for side, own in enumerate(tagged_):
        other = {low for label, low in tagged_[1 - side] if label is not None}
        for label, low in own:
            if label is not None:
                counts[6 * side + 2 * label] += 1
                counts[6 * side + 2 * label + 1] += low not in other
    changed: list[list[str]] = [[], []]
    if k:
        for side, own in enumerate(said):
            other = {low for _, low in said[1 - side]}
            changed[side] = [" ".join(split_words(s)) for s, low in own if low not in other][:k]
    return counts, changed


def described(rows: DataFrame, k: int = 0) -> DataFrame:
    """``rows`` of pairs with their texts ``source_text`` and ``target_text``, and what ``shifts`` says of each, in one pass without an exchange; with ``k``
    also ``changed_old`` and ``changed_new``, the first ``k`` sentences a side that the other does not have."""
    lists = ["__duties array<int>", *(["changed_old array<string>", "changed_new array<string>"] if k else [])]
    schema = StructType([*rows.schema.fields, *_parse_datatype_string(", ".join(lists)).fields])

    def run(batches):
        known: dict[str, int | None] = {}
        for batch in batches:
            two = pc.and_(batch.column("source_id").is_valid(), batch.column("target_id").is_valid()).to_pylist()  # sentences of one side alone are not listed
            texts = zip(batch.column("source_text").to_pylist(), batch.column("target_text").to_pylist(), strict=True)
            found = [_duties_of(t, k * has, known) for t, has in zip(texts, two, strict=True)]
            more = [pa.array([x[0] for x in found], pa.list_(pa.int32())), *([pa.array([x[1][i] for x in found], pa.list_(pa.string())) for i in (0, 1)] if k else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    n = {(side, only): {x: F.col("__duties")[6 * i + 2 * j + only] for j, x in enumerate(D.PRIORITY)} for i, side in enumerate(("source", "target")) for only in (False, True)}
    return _shifted(rows.mapInArrow(run, schema), n).drop("__duties")


def shifts(pairs: DataFrame, source: DataFrame, target: DataFrame, label_fn: LabelFn | None = None, mode: str = "ambiguous") -> DataFrame:
    """Each pair with its primary label, the shift ``X -> Y`` of duties, and labels added and removed."""
    if label_fn is None:
        texts = [side.select(F.col("chunk_id").alias(f"{name}_id"), F.col("text").alias(f"{name}_text")) for name, side in (("source", source), ("target", target))]
        return described(with_clauses(pairs, *texts)).drop("source_text", "target_text")
    found = duties(pairs, source, target, label_fn, mode)
    counts = [
        F.count_if((F.col("side") == side) & (F.col("label") == x) & (F.col("changed") if only else F.lit(True))).alias(f"{side}_{x}_{only}")
        for side in ("source", "target")
        for x in D.PRIORITY
        for only in (False, True)
    ]
    out = pairs.join(found.groupBy("pair_id").agg(*counts), "pair_id", "left")
    n = {(side, only): {x: F.coalesce(F.col(f"{side}_{x}_{only}"), F.lit(0)) for x in D.PRIORITY} for side in ("source", "target") for only in (False, True)}
    return _shifted(out, n).select(*pairs.columns, "primary_label", "shift", "labels_added", "labels_removed", "has_deontic_change")


def _shifted(out: DataFrame, n: dict) -> DataFrame:
    """``out`` with what counts ``n`` by side and label, of all and of changed sentences, say of each pair's duties."""
    main = F.when(F.col("target_id").isNotNull(), D.primary_label(n["target", False])).otherwise(D.primary_label(n["source", False]))
    old, new = D.primary_label(n["source", True]), D.primary_label(n["target", True])

    def only_in(a: str, b: str):
        return F.filter(F.array(*[F.when((n[a, False][x] > 0) & (n[b, False][x] == 0), F.lit(x)) for x in D.PRIORITY]), lambda x: x.isNotNull())

    return out.select(
        "*",
        main.alias("primary_label"),
        F.when((old != D.NONE) & (new != D.NONE) & (old != new), F.concat(old, F.lit(" -> "), new)).alias("shift"),
        only_in("target", "source").alias("labels_added"),
        only_in("source", "target").alias("labels_removed"),
    ).withColumn("has_deontic_change", F.col("shift").isNotNull() | (F.size("labels_added") > 0) | (F.size("labels_removed") > 0))


def run_summary(enriched: DataFrame, aligned: DataFrame, key: str = "contract_id") -> DataFrame:
    """Per contract: pairs by status and by primary label, the ids with a change of duties, and the clauses left out by verdict."""
    status = [F.count_if(F.col("change_status") == x).alias("n_" + x.lower()) for x in ("MODIFIED", "ADDED", "DELETED", "UNVERIFIED")]
    labels = [F.count_if(F.col("primary_label") == x).alias("n_" + x.lower()) for x in (*D.PRIORITY, D.NONE)]
    ids = F.sort_array(F.collect_list(F.when(F.col("has_deontic_change"), F.col("pair_id"))))
    out = enriched.groupBy(key).agg(*status, *labels, ids.alias("deontic_changes"))
    skipped = aligned.groupBy(key).agg(F.count_if(~F.col("verdict").isin("MODIFIED", "NO_MATCH", "UNKNOWN")).alias("n_skipped"))
    return skipped.join(out, key, "left").select(
        key, *[F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c.startswith("n_")], "n_skipped", F.coalesce("deontic_changes", F.array().cast("array<string>")).alias("deontic_changes")
    )


def summary(enriched: DataFrame) -> DataFrame:
    """Pairs by change status and primary label."""
    return enriched.groupBy("change_status", "primary_label").agg(F.count("*").alias("n_pairs"), F.count_if("has_deontic_change").alias("n_duty_changes"))
