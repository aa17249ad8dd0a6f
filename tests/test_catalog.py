"""Every query with SQL gives what DuckDB gives; operators beyond SQL are held against plain Python."""

import functools
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from redliner import catalog
from redliner.functions.sentences import split_sentences
from redliner.operators import align, chunking, consult, impact
from redliner.operators.deontic import tagged
from redliner.queries import compare, grounding, reports
from redliner.streaming import live

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EMPTY_AT_SMALLEST = {"leakage_check"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_alignment():
    """The queries' alignment and changes of one set of tables are made once for all tests."""
    patch = pytest.MonkeyPatch()
    pairs = functools.cache(compare.kept_pairs)
    changes = functools.cache(reports._changes)
    for module in (compare, reports, grounding):
        patch.setattr(module, "kept_pairs", pairs)
    for module in (reports, grounding):
        patch.setattr(module, "_changes", changes)
    yield
    patch.undo()


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or v.__class__.__name__ == "Decimal" else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    got = _rows(df.columns, df.collect())
    cur = duck.execute(catalog.oracle_sql()[name])
    want = _rows([c[0] for c in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in cur.description)
    assert got == want
    spark.catalog.clearCache()


def test_sentences_have_offsets(spark):
    text = 'One. Two; "Three. A. B. Acme Inc. The end.  Last: (x) no.'
    found = spark.createDataFrame([(text,)], "t string").select(split_sentences(F.col("t")).alias("s")).first()["s"]
    assert [s["text"] for s in found] == ["One.", "Two;", '"Three.', "A. B. Acme Inc. The end.", "Last:", "(x) no."]
    assert all(text[s["start"] : s["end"]] == s["text"] for s in found)


def test_duties(spark):
    cases = {
        "The Licensee shall pay.": ("OBLIGATION", False), "The Licensee shall not be required to pay.": ("PERMISSION", False),
        "Neither party may assign.": ("PROHIBITION", False), "It will work.": ("OBLIGATION", True), "Fees shall include tax.": None,
        '"Fee" means what the Buyer shall pay.': None, "It may stop and must tell.": ("OBLIGATION", True), "Nothing here.": None,
    }
    rows = tagged(spark.createDataFrame([(t,) for t in cases], "text string").withColumn("id", F.col("text"))).collect()
    assert {r["id"]: (r["label"], r["ambiguous"]) for r in rows} == {k: v for k, v in cases.items() if v}


def test_same_document_twice_is_equivalent(spark, sf_dir):
    from redliner.plans.samples import clauses

    a = clauses(spark, sf_dir, "a")
    b = a.withColumn("chunk_id", F.concat("chunk_id", F.lit("x")))
    out = align.align(a, b)
    assert out.where("verdict <> 'EQUIVALENT'").count() == 0 and align.changed_pairs(out, b).count() == 0
    with pytest.raises(Exception, match="share clause"):
        align.check_versions(a, a).collect()


def test_scripted_verdicts(spark):
    columns = "contract_id long, chunk_id string, ordinal int, heading string, text string"
    a = spark.createDataFrame([(1, "a1", 1, "H", "alpha beta gamma delta epsilon zeta"), (1, "a2", 2, "", "one two three four five six seven")], columns)
    b = spark.createDataFrame([(1, "b1", 1, "H", "alpha beta gamma delta epsilon other"), (1, "b2", 2, "", "one two three four five six eight nine")], columns)

    def answers(pairs):
        return pairs.select("pair_key", F.lit("No match").alias("raw_first"), F.lit(None).cast("string").alias("raw_second"))

    got = {r["source_id"]: (r["verdict"], r["decided_by"]) for r in align.align(a, b, answers).collect()}
    assert got == {"a1": ("MODIFIED", "structure"), "a2": ("NO_MATCH", "model")}


def test_summary_checks(spark):
    rows = [("The fee is 90 days of secret zebra giraffes and elephants", "The fee is 60 days"), ("short", "x"), ("The fee is due in 60 days now", "The fee is due in 60 days")]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, t string").select(impact.check_summary(F.col("s"), F.col("t"))).collect()]
    assert len(got[0]) == 2 and "90" in got[0][0] and "zebra" in got[0][1]
    assert got[1] == ["the summary is empty or too short"] and got[2] == []


def test_packing_and_merging(spark):
    chunks = spark.createDataFrame([("d", "c1", 1, "aaa\nbbb\ncc", 1, 2), ("d", "c2", 2, "x" * 50, 2, 2), ("d", "c3", 3, "tail", 3, 3)], "document_id string, chunk_id string, ordinal int, text string, page_start int, page_end int")
    assert [r["text"] for r in chunking.pack_lines(chunks.limit(1), 7).orderBy("piece").collect()] == ["aaa\nbbb", "cc"]
    got = chunking.merge_fragments(chunks).collect()
    assert [(r["chunk_id"], r["page_start"], r["text"]) for r in got] == [("c2", 1, "aaa\nbbb\ncc\n" + "x" * 50 + "\ntail")]


def test_clean_splits_sections(spark):
    text = "1. First Part. It says a lot about the goods and more.\n2. Second Part. It says other things about the goods too.\n4\nTHE GOODS ARE SOLD AS THEY ARE WITHOUT ANY WARRANTY AT ALL."
    chunks = spark.createDataFrame([("d", "c", 1, text, 1, 1, ["A", "B"])], "document_id string, chunk_id string, ordinal int, text string, page_start int, page_end int, heading_path array<string>")
    got = chunking.clean(chunks).orderBy("ordinal").collect()
    assert [r["chunk_id"] for r in got] == ["c_01", "c_02", "c_03"]
    assert [r["heading_path"][-1] for r in got] == ["1. First Part.", "2. Second Part.", "THE GOODS ARE SOLD AS THEY ARE WITHOUT"]


def test_word_diff_round_trip():
    ops = consult.word_diff("a b c d", "a x c d e")
    assert "".join(t for k, t in ops if k != "insert") == "a b c d" and "".join(t for k, t in ops if k != "delete") == "a x c d e"
    assert ops[1] == ("delete", "b")


def test_live_upsert(spark, tmp_path):
    schema = "pair_id string, arrival_no long, status string"
    parts = [[("p1", 1, "PENDING"), ("p2", 2, "PENDING")], [("p1", 5, "VERIFIED")], [("p2", 4, "LOW"), ("p1", 3, "late")]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    live.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r["pair_id"], r["status"]) for r in live.newest(spark, str(tmp_path / "out")).collect()} == {("p1", "VERIFIED"), ("p2", "LOW")}


def test_no_query_names_a_sample():
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in catalog.queries())
