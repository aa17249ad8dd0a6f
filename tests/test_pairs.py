"""What is made of pairs in one pass, held against the operators over sentences."""

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from redliner.functions.deontic import PRIORITY, sentence_label
from redliner.functions.sentences import sentence_texts
from redliner.operators import deontic, impact, ontology
from redliner.plans import compare

TEXTS = [
    "1. Term. The Buyer shall pay 3 days. Neither party may assign. See Sec. 4 and Acme Inc. The fee is due; (a) It may end: No.",
    '"Fee" means the sum; The Vendor shall mean well. He CANNOT go. It will be so. Mr. X shall not be required to pay.',
    "The tenant is entitled to stay.\x0b\x1c Of No. 5 it agrees to nothing. É shall not. She is prohibited. a. B shall",
    "The Buyer may pay 3 days.  neither PARTY may assign. It\x01shall. Must",
    "", " \t ", None, "no cue here", "It has the right to go; 'Quoted' shall have the meaning. \"T\" refers to it and shall be",
]


def _pairs(spark):
    n = len(TEXTS)
    a = spark.createDataFrame([("k", f"a{i}", i, t, "Audit" if i % 2 else None) for i, t in enumerate(TEXTS)], "contract_id string, chunk_id string, ordinal int, text string, heading string")
    b = a.withColumn("chunk_id", F.regexp_replace("chunk_id", "a", "b"))
    rows = [(f"p{i}-{j}", "k", "MODIFIED", f"a{i}", f"b{j}") for i in range(n) for j in range(n)]
    rows += [(f"d{i}", "k", "DELETED", f"a{i}", None) for i in range(n)] + [(f"n{i}", "k", "ADDED", None, f"b{i}") for i in range(n)]
    return spark.createDataFrame(rows, "pair_id string, contract_id string, change_status string, source_id string, target_id string"), a, b


def test_sentences_and_labels_of_texts(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "chunk_id int, text string")
    got = {i: sentence_texts(t) for i, t in enumerate(TEXTS)}
    want: dict = {i: [] for i in got}
    for r in deontic.sentences(rows).orderBy("chunk_id", "sentence_no").collect():
        want[r["chunk_id"]].append(r["sentence"])
    assert got == want
    labels = {(r["chunk_id"], r["sentence"]): r["label"] for r in deontic.tagged(rows).collect()}
    assert {(i, s): PRIORITY[n] for i, own in got.items() for s in own if (n := sentence_label(s)) is not None} == labels


def test_shifts_of_pairs_in_one_pass(spark):
    pairs, a, b = _pairs(spark)
    got = deontic.shifts(pairs, a, b)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString() and "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    none = deontic.shifts(pairs, a, b, lambda asked: asked.select("key", F.lit("").alias("raw")))  # answers that leave the rules' labels
    assert sorted(map(str, got.collect())) == sorted(map(str, none.select(got.columns).collect()))


def test_views_hold_what_their_operators_say(spark):
    pairs, a, b = _pairs(spark)
    aligned = spark.createDataFrame([("a0", "b1", (["3"], ["4"]))], "source_id string, target_id string, numeric_diff struct<only_in_source:array<string>,only_in_target:array<string>>")
    views = compare.views(a, b, aligned, pairs)
    assert "Aggregate [pair_id" not in views._jdf.queryExecution().optimizedPlan().toString()
    got = {r["pair_id"]: r for r in views.collect()}
    assert len(got) == pairs.count() and got["p0-3"]["numbers_changed"] == "old version only: 3 | new version only: 4"
    said = impact.changed_sentences(pairs, a, b).collect()
    for side, name in (("source", "changed_old"), ("target", "changed_new")):
        for key, row in got.items():
            assert row[name] == [r["sentence"] for r in sorted((r for r in said if r["pair_id"] == key and r["side"] == side), key=lambda r: r["pos"])]
    facts = {r["pair_id"]: r for r in compare.facts(pairs, a, b, aligned).collect()}
    for key, row in got.items():
        assert (row["categories"], row["stakeholders"], row["parties"]) == (facts[key]["categories"] or [], facts[key]["stakeholders"] or [], facts[key]["parties"])


def test_functions_reach_workers_that_have_no_package(tmp_path):
    code = """
import sys; sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from redliner.operators import deontic, retrieval
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
rows = s.createDataFrame([("p", "It shall be.", "It may be.")], "pair_id string, source_text string, target_text string")
from pyspark.sql import functions as F
assert deontic.described(rows.withColumns({"source_id": F.lit("a"), "target_id": F.lit("b")}), 3).first()["shift"] == "OBLIGATION -> PERMISSION"
docs = s.createDataFrame([(1, "a b"), (2, "c")], "id long, text string")
assert retrieval.bm25_topk(docs, docs.selectExpr("id as query_id", "text as query"), "id", 1).count() == 2
"""
    done = subprocess.run([sys.executable, "-c", code, str(Path(__file__).resolve().parents[1])], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr[-2000:]


def test_diffs_compare_what_follows_equal_beginnings(monkeypatch):
    from redliner.operators import consult

    made = []
    monkeypatch.setattr(consult, "_row_above", lambda row, same, real=consult._row_above: (made.append(len(row)), real(row, same))[1])
    text = " ".join(f"w{i}" for i in range(200))
    assert consult.word_diff(text, text + " zzz") == [("equal", text), ("insert", " zzz")] and not made
    assert consult.word_diff(text + " a b", text + " b a b") == [("equal", text + " "), ("insert", "b "), ("equal", "a b")] and max(made) < 10
    assert consult.word_diff("", "") == [] and consult.word_diff("a b", None) == [("delete", "a b")]
