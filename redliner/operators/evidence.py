"""Evidence of changes: their sentences with places, running sections of a document, and the blocks a report opens with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redliner.functions import text as T
from redliner.operators.deontic import sentences, sides

#: Section starts, titled with a full stop or alone on a line, subsections, schedules; a bare number.
TOP_WITH_TITLE = r"^(\d{1,2})\.\s*([A-Z][^.\n]{1,160}?)\.(?:\s|$|(?=[A-Z]))"
TOP_LINE = r"^(\d{1,2})\.\s*([A-Z][A-Za-z ,;&'’\-]{1,160})$"
SUBSECTION = r"^(\d{1,2})\.\d{1,2}(?!\d)"
SCHEDULE = r"(?i)^SCHEDULE\s+([A-Z])\b"
BARE_NUMBER = r"^\d{1,2}\.$"
TITLE_CHARS = 60


def marked_sentences(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """``(pair_id, side, sentence_no, sentence, start, end, changed)``: every sentence of both sides; unchanged are those that
    the other side has too, in any case and spacing.  A pair with one side has changed sentences only."""
    rows = sentences(sides(pairs, source, target)).drop("change_status")
    same = Window.partitionBy("pair_id", T.normalize_text(F.lower("sentence")))
    return rows.withColumn("changed", F.min("side").over(same) == F.max("side").over(same))


def evidence(pairs: DataFrame, source: DataFrame, target: DataFrame, include_text: bool = True) -> DataFrame:
    """``(pair_id, side, chunk_id, document_id, page_start, page_end, text, sentences, highlights, changed_sentences)``, a row for each side of a pair.

    Columns the clauses lack are null; ``highlights`` are the changed sentences' places in the text.
    """
    found = marked_sentences(pairs, source, target)
    row = F.struct("sentence_no", F.col("sentence").alias("text"), "start", "end", "changed")
    listed = found.groupBy("pair_id", "side").agg(F.array_sort(F.collect_list(row)).alias("sentences"))  # one clause's sentences
    wanted = ["document_id", "page_start", "page_end", "heading_path"]

    def about(side: str, chunks: DataFrame) -> DataFrame:
        kinds = {"document_id": "string", "page_start": "int", "page_end": "int", "heading_path": "array<string>"}
        have = [F.col(c) if c in chunks.columns else F.lit(None).cast(kinds[c]).alias(c) for c in wanted]
        ids = pairs.where(F.col(f"{side}_id").isNotNull()).select("pair_id", F.lit(side).alias("side"), F.col(f"{side}_id").alias("chunk_id"))
        return ids.join(chunks.select("chunk_id", *have, "text"), "chunk_id")

    rows = about("source", source).unionByName(about("target", target)).join(listed, ["pair_id", "side"], "left")
    own = F.coalesce("sentences", F.array().cast("array<struct<sentence_no:int,text:string,start:int,end:int,changed:boolean>>"))
    changed = F.filter(own, lambda s: s["changed"])
    out = rows.withColumns(
        {
            "sentences": own,
            "highlights": F.transform(changed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))),
            "changed_sentences": F.transform(changed, lambda s: s["text"]),
        }
    )
    return out if include_text else out.drop("text")


def _short_title(title: Column) -> Column:
    flat = F.trim(title)
    back = F.regexp_replace(F.regexp_replace(F.left(flat, F.lit(TITLE_CHARS)), r" [^ ]*$", ""), r"[;,]+$", "")
    return F.when(F.length(flat) > TITLE_CHARS, F.concat(back, F.lit(" …"))).otherwise(flat)


def running_sections(chunks: DataFrame, key: str = "document_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(chunk_id, section)`` and the columns ``keep``: the last top-level section or schedule begun at or before each clause, in document order.

    A clause's starts are sought in its first two lines (a bare number with the line after it), then its last heading.
    Numbers only go forward, and inside a schedule there are no sections.  One pass over each document's ordered clauses, which keeps
    nothing of them but where it stands.
    """
    clean = lambda x: T.normalize_text(F.coalesce(x, F.lit("")))
    lines = F.transform(F.slice(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n"), 1, 2), clean)
    path = F.col("heading_path") if "heading_path" in chunks.columns else F.array(F.col("heading")) if "heading" in chunks.columns else F.array().cast("array<string>")
    last = F.transform(F.slice(F.coalesce(path, F.array().cast("array<string>")), F.greatest(F.size(path), F.lit(1)), F.lit(1)), clean)
    joined = F.when((F.size(lines) == 2) & lines[0].rlike(BARE_NUMBER), F.array(F.concat_ws(" ", lines[0], F.try_element_at(lines, F.lit(2))))).otherwise(F.array().cast("array<string>"))

    def start(text: Column) -> Column:
        titled = F.when(text.rlike(TOP_WITH_TITLE), F.regexp_extract(text, TOP_WITH_TITLE, 2)).when(text.rlike(TOP_LINE), F.regexp_extract(text, TOP_LINE, 2))
        number = F.regexp_extract(text, r"^(\d{1,2})\.", 1).try_cast("int")
        kind = F.when(text.rlike(SCHEDULE), "schedule").when(titled.isNotNull(), "top").when(text.rlike(SUBSECTION), "sub")
        name = F.when(kind == "schedule", F.concat(F.lit("Schedule "), F.upper(F.regexp_extract(text, SCHEDULE, 1)))).when(
            kind == "top", F.concat(number.cast("string"), F.lit(". "), _short_title(titled))
        )
        return F.struct(kind.alias("kind"), number.alias("n"), F.regexp_extract(text, r"^(\d{1,2})\.", 1).alias("digits"), name.alias("name"))

    # only texts that begin with a number or a schedule can start a section
    begins = F.filter(F.concat(joined, lines, last), lambda x: x.rlike(r"(?i)^(?:\d{1,2}\.|SCHEDULE)"))
    starts = F.filter(F.transform(begins, start), lambda s: s["kind"].isNotNull())
    rows = chunks.select(key, "chunk_id", "ordinal", starts.alias("starts"), *keep).repartition(key).sortWithinPartitions(key, "ordinal", "chunk_id")

    def run(batches):
        import pyarrow as pa

        nothing = object()
        document, current, n, schedule, names = nothing, "Preamble", 0, False, {}
        for batch in batches:
            out = []
            for own, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != document or document is nothing:
                    document, current, n, schedule, names = own, "Preamble", 0, False, {}
                for s in found:
                    if s["kind"] == "schedule" or not schedule and s["n"] is not None and s["n"] >= n:
                        digits = s["digits"]
                        plain = f"Section {digits}"
                        if s["kind"] == "schedule":
                            current, schedule = s["name"], True
                        elif s["kind"] == "top":
                            current = names.setdefault(digits, s["name"])
                        elif not current.startswith(f"{digits}. ") and current != plain:
                            current = names.get(digits, plain)
                        n = n if s["kind"] == "schedule" else s["n"]
                        break
                out.append(current)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.string()), *batch.columns[3:]], names=["chunk_id", "section", *keep])

    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(key, "chunk_id", "starts", *keep).mapInArrow(run, f"chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, section string{kinds}")


def documents_block(chunks: DataFrame, names: DataFrame | None = None, key: str = "document_id") -> DataFrame:
    """``(document_id, name, chunks, pages)``: clauses and last page of each document; ``names(document_id, name)`` also adds documents without clauses."""
    pages = F.max(F.coalesce("page_end", "page_start")) if "page_start" in chunks.columns else F.lit(None).cast("int")
    out = chunks.groupBy(key).agg(F.count("*").alias("chunks"), pages.alias("pages"))
    if names is None:
        return out.select(key, F.lit(None).cast("string").alias("name"), "chunks", "pages")
    return names.select(key, "name").join(out, key, "full").select(key, "name", "chunks", "pages")


def index_by_chunk(changes: DataFrame) -> DataFrame:
    """``(chunk_id, changes)``: the changes that touch a clause, on either side."""
    rows = changes.select("change_id", F.explode(F.array("source_id", "target_id")).alias("chunk_id")).where("chunk_id is not null")
    return rows.groupBy("chunk_id").agg(F.array_join(F.sort_array(F.collect_list("change_id")), ",").alias("changes"))


def titles(changes: DataFrame, marked: DataFrame, heading: str = "heading") -> DataFrame:
    """``(pair_id, title)``: the heading, or where it is none the first changed sentence, of the new side if there is one."""
    place = F.struct((F.col("side") == "source").cast("int"), (~F.col("changed")).cast("int"), F.col("sentence_no"))
    first = marked.groupBy("pair_id").agg(F.min_by("sentence", place).alias("__first"))
    from redliner.operators.report import title

    return changes.select("pair_id", heading).join(first, "pair_id", "left").select("pair_id", title(F.col(heading), F.col("__first")).alias("title"))
