"""Readers and writers of the engine's files."""

from __future__ import annotations

import html as entities
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUAD = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string,answer_start:int>>>>>>>>"
LINES = "document_id string, line_no int, text string, page int, font_size double, bold boolean"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Laid-out lines, as a parser has written them."""
    return spark.read.schema(LINES).parquet(path)


def read_pdf_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of PDF files; needs the optional parser ``pdfplumber`` on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")

    def run(batches):
        import io

        import pdfplumber
        import pyarrow as pa

        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                no = 0
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    for page_no, page in enumerate(pdf.pages, 1):
                        for line in page.extract_text_lines(return_chars=True):
                            if line["text"].strip():
                                fonts = [c["fontname"].lower() for c in line["chars"]]
                                bold = any(w in f for f in fonts for w in ("bold", "black", "heavy"))
                                size = max((c["size"] for c in line["chars"]), default=0.0)
                                rows.append({"document_id": name, "line_no": no, "text": line["text"], "page": page_no, "font_size": float(size), "bold": bold})
                                no += 1
            yield from pa.Table.from_pylist(rows, schema=pa.schema([("document_id", pa.string()), ("line_no", pa.int32()), ("text", pa.string()), ("page", pa.int32()), ("font_size", pa.float64()), ("bold", pa.bool_())])).to_batches()

    return files.mapInArrow(run, LINES)


def read_cuad(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CUAD).json(path, multiLine=True)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of results; headers and torn lines are left out."""
    rows = spark.read.schema(f"{schema}, _meta string").json(path, mode="DROPMALFORMED")
    return rows.where("_meta is null").drop("_meta")


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object a row; the commit is atomic."""
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def cached(keys: DataFrame, cache: DataFrame, compute) -> DataFrame:
    """Answers by content key: cached ones, and ``compute`` for the distinct missing keys only."""
    missing = keys.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    return cache.join(keys.select("key").distinct(), "key", "left_semi").unionByName(compute(missing))


def result_key(*columns: str):
    """The key of a result: the hash of what it was made from."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report that ``write_report`` wrote."""
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")


def read_words(spark: SparkSession, path: str) -> list[str]:
    """A word list of a parameter, one or several words a line."""
    return [w for r in spark.read.text(path).collect() for w in r["value"].split()]


def fingerprint(*columns: str):
    """What a result depends on, as the key it is kept under: ids, texts, modes, versions."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("")) for c in columns]), 256)


def resumed(todo: DataFrame, path: str, compute, key: str = "key") -> DataFrame:
    """Results for all of ``todo`` by ``key``: those kept at ``path``, and ``compute`` for the missing, which is added to it.

    A run that broke off goes on where it was: the kept table is written by whole commits, a torn one is not read.  A changed input
    has another key (``fingerprint``) and is computed anew.
    """
    spark = todo.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(conf).exists(folder)
    kept = spark.read.parquet(path) if exists else None
    missing = todo if kept is None else todo.join(kept.select(key), key, "left_anti")
    if not missing.isEmpty():
        compute(missing).write.mode("append").parquet(path)
    done = spark.read.parquet(path)
    return done.join(todo.select(key).distinct(), key, "left_semi").dropDuplicates([key])


#: The media types of a report's files.
MEDIA = {"md": "text/markdown; charset=utf-8", "json": "application/json", "html": "text/html; charset=utf-8"}


def file_name(base: str, kind: str) -> str:
    """A name without signs that file systems refuse."""
    return re.sub(r'[\\/:*?"<>|]+', "_", base) + "." + kind


def _inline(text: str) -> str:
    text = entities.escape(text, quote=False)
    return re.sub(r"\*([^*]+)\*", r"<em>\1</em>", re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", text))


def printable(title: str, markdown: str) -> str:
    """A page to print of the markdown that reports use: headings, lists, quotes, tables, paragraphs."""
    out: list[str] = []
    for block in re.split(r"\n{2,}", markdown.strip()):
        lines = block.split("\n")
        if m := re.match(r"(#{1,4}) (.*)", lines[0]):
            out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>")
            lines = lines[1:]
        if not lines:
            continue
        if all(x.startswith("- ") for x in lines):
            out.append("<ul>" + "".join(f"<li>{_inline(x[2:])}</li>" for x in lines) + "</ul>")
        elif all(x.startswith(">") for x in lines):
            out.append("<blockquote>" + "<br>".join(_inline(x.lstrip("> ")) for x in lines if x.strip("> ")) + "</blockquote>")
        elif all(x.startswith("|") for x in lines):
            cells = [[_inline(c.strip()) for c in x.strip("|").split("|")] for x in lines if not re.fullmatch(r"[|\- ]+", x)]
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in cells) + "</table>")
        else:
            out.append("<p>" + "<br>".join(map(_inline, lines)) + "</p>")
    head = f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{entities.escape(title)}</title></head>'
    return head + "<body>" + "\n".join(out) + "</body></html>"


def report_files(reports: DataFrame, kind: str, key: str = "contract_id") -> DataFrame:
    """``(contract, file_name, media_type, body)`` of reports ``(contract, name, markdown, json)`` as md, json or html."""
    if kind not in MEDIA:
        raise ValueError(f"unknown format {kind}: md, json or html")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, names, texts, bodies = (batch.column(i).to_pylist() for i in range(4))
            out = [printable(n, t) if kind == "html" else t if kind == "md" else b for n, t, b in zip(names, texts, bodies, strict=True)]
            columns = [keys, [file_name(n, kind) for n in names], [MEDIA[kind]] * len(keys), out]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns[1:])], names=[key, "file_name", "media_type", "body"])

    rows = reports.select(key, "name", "markdown", "json")
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, file_name string, media_type string, body string")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under ``spark.checkpoint.dir``, or a local one where that is unset and all tasks run here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="redliner-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to a scratch folder and reread: what reads it many times neither plans nor computes it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
