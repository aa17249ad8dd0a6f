"""Operators beyond SQL against plain restatements and scripted cases."""

import random

import pytest
from pyspark.sql import functions as F

from redliner.operators import align, chunking, consult, deontic, evaluation, evidence, grounding, ontology, report, retrieval
from redliner.sources import files
from redliner.streaming import live

VIEW = """pair_id string, change_status string, source_id string, target_id string, contract_id string, source_text string, target_text string, heading string, shift string,
labels_added array<string>, labels_removed array<string>, numbers_changed string, categories array<string>, stakeholders array<string>, parties array<string>,
contract_parties array<string>, changed_old array<string>, changed_new array<string>"""
GOOD, BAD = "The term is now 90 days for the Buyer. AFFECTED: the Buyer; Customers", "The term is now 75 days. AFFECTED: Buyer"
#: (summaries, critics) by attempt, and what becomes of the pair: status, verdict, attempts, context level
SCENARIOS = {
    "verified": ([GOOD], ["VERIFIED"], ("VERIFIED", "VERIFIED", 1, 0)),
    "rejected by checks, then verified": ([BAD, GOOD], [None, "VERIFIED"], ("VERIFIED", "VERIFIED", 2, 0)),
    "rejected by the critic twice": ([GOOD, GOOD], ["HALLUCINATION: no", "HALLUCINATION: again"], ("LOW_CONFIDENCE", "HALLUCINATION", 2, 0)),
    "context missing, then verified": ([GOOD, GOOD], ["MISSING_CONTEXT", "VERIFIED"], ("VERIFIED", "VERIFIED", 2, 1)),
    "context missing twice": ([GOOD, GOOD], ["MISSING_CONTEXT", "MISSING_CONTEXT"], ("LOW_CONFIDENCE", "MISSING_CONTEXT", 2, 1)),
    "unreadable critic": ([GOOD], ["VERIFIED or HALLUCINATION"], ("LOW_CONFIDENCE", "UNKNOWN", 1, 0)),
    "unreadable, read on retry": ([GOOD], ["what? / VERIFIED"], ("VERIFIED", "VERIFIED", 1, 0)),
    "empty summary twice": (["", "no"], [None, None], ("LOW_CONFIDENCE", "HALLUCINATION", 2, 0)),
    "invented words": (["The zebra, the giraffe and an elephant graze here. AFFECTED: Buyer", GOOD], [None, "VERIFIED"], ("VERIFIED", "VERIFIED", 2, 0)),
    "no answer at all": ([None, None], [None, None], ("LOW_CONFIDENCE", "HALLUCINATION", 2, 0)),
}


def test_rounds_of_summary_and_critic(spark):
    rows = [(n, "MODIFIED", "a", "b", "k", "The Buyer pays in 60 days.", "The Buyer pays in 90 days; the term is fixed.", "Payment", None, [], [], "", [], ["Customers"], ["Buyer"], [], [], []) for n in SCENARIOS]
    views = spark.createDataFrame(rows, VIEW)
    asked: list[tuple] = []

    def scripted(pick):
        def answer(todo):
            own = todo.select("pair_id", "context_level", "warning", "context_text").collect()
            asked.extend((r["pair_id"], r["warning"], r["context_text"]) for r in own)
            return pick(todo, {r["pair_id"]: int(bool(r["warning"]) or r["context_level"] > 0) for r in own})

        return answer

    def summaries(todo, attempt):
        return spark.createDataFrame([(p, SCENARIOS[p][0][min(k, len(SCENARIOS[p][0]) - 1)]) for p, k in attempt.items()], "pair_id string, raw string")

    def critics(todo, attempt):
        said = [(p, (SCENARIOS[p][1][min(k, len(SCENARIOS[p][1]) - 1)] or "").split(" / ")) for p, k in attempt.items()]
        return spark.createDataFrame([(p, s[0], s[-1] if len(s) > 1 else "") for p, s in said], "pair_id string, raw string, raw_retry string")

    wider = spark.createDataFrame([(n, "neighbours") for n in SCENARIOS], "pair_id string, context_text string")
    attempts = files.kept(grounding.reviewed(views, scripted(summaries), scripted(critics), wider), "attempts")
    skip = spark.createDataFrame([("verified",)], "pair_id string")
    got = {r["pair_id"]: r for r in grounding.results(views, attempts).collect()}
    for name, (_, _, want) in SCENARIOS.items():
        assert (got[name]["status"], got[name]["final_verdict"], got[name]["attempts"], got[name]["context_level"]) == want, name
    assert got["verified"]["affected"] == ["the Buyer"] and got["verified"]["confidence"] == "HIGH"  # a party only hinted at goes
    assert ("context missing twice", None, "neighbours") in asked and any(p == "rejected by the critic twice" and w == "no" for p, w, _ in asked)
    assert [r["status"] for r in grounding.results(views, attempts, skip).where("pair_id = 'verified'").collect()] == ["SKIPPED"]
    counts = grounding.run_counts(grounding.results(views, attempts), attempts).first()
    assert counts["n_verified"] + counts["n_low_confidence"] == len(SCENARIOS) and counts["summary_calls"] == attempts.count()


def _sections(chunks):
    """Plain walk over a document's clauses."""
    import re

    names, current, number, schedule, out = {}, "Preamble", 0, False, {}
    for chunk_id, text, path in chunks:
        first = [" ".join(x.split()) for x in text.split("\n")[:2]]
        tries = first + [" ".join(x.split()) for x in path[-1:]]
        if len(first) == 2 and re.fullmatch(r"\d{1,2}\.", first[0]):
            tries.insert(0, " ".join(first))
        for t in tries:
            if m := re.match(evidence.SCHEDULE.replace("(?i)", ""), t, re.I):
                current, schedule = f"Schedule {m[1].upper()}", True
                break
            if schedule:
                continue
            top = re.match(evidence.TOP_WITH_TITLE, t) or re.match(evidence.TOP_LINE, t)
            sub = re.match(evidence.SUBSECTION, t)
            if top and int(top[1]) >= number:
                title = top[2].strip()
                title = title if len(title) <= 60 else title[:60].rsplit(" ", 1)[0].rstrip(";,") + " …"
                current = names.setdefault(top[1], f"{top[1]}. {title}")
                number = int(top[1])
                break
            if sub and int(sub[1]) >= number:
                if not current.startswith(sub[1] + ". ") and current != "Section " + sub[1]:
                    current = names.get(sub[1], "Section " + sub[1])
                number = int(sub[1])
                break
        out[chunk_id] = current
    return out


def test_running_sections(spark):
    r, rows = random.Random(4), []
    for doc in range(30):
        for k in range(40):
            n = r.randint(1, 12)
            text = r.choice([f"{n}. Title {'long ' * r.randint(0, 20)}here. Text", f"{n}.\nDefinitions. x", f"{n}.{k} sub", "plain", f"x\n{n}. TERM", "Schedule b now" if r.random() < 0.1 else "y", "", f"{n}.Use. It"])
            rows.append((f"d{doc}", f"d{doc}c{k}", k, text, r.choice([[], ["A", f"{n}. Head. z"], ["B"]])))
    got = {x["chunk_id"]: x["section"] for x in evidence.running_sections(spark.createDataFrame(rows, "document_id string, chunk_id string, ordinal int, text string, heading_path array<string>")).collect()}
    want = {}
    for doc in range(30):
        want |= _sections([(c, t, p) for d, c, _, t, p in rows if d == f"d{doc}"])
    assert got == want and len(set(got.values())) > 20


def test_splitting_and_packing(spark):
    r = random.Random(3)
    texts = ["\n\n".join("w" * r.randint(1, 30) for _ in range(r.randint(1, 12))) for _ in range(40)] + ["", "x" * 99]
    rows = spark.createDataFrame([(k, t, t.replace("\n\n", "\n")) for k, t in enumerate(texts)], "k int, t string, lines string")
    for row in rows.select("t", "lines", chunking.split_long_text(F.col("t"), 40).alias("s"), chunking.packed(F.col("lines"), 40).alias("p")).collect():
        assert "\n\n".join(row["s"]) == row["t"] and "\n".join(row["p"]) == row["lines"]
        want, used = [[]], 0
        for line in row["lines"].split("\n"):
            if want[-1] and used + len(line) > 40:
                want.append([])
                used = 0
            want[-1].append(line)
            used += len(line) + 1
        assert row["p"] == ["\n".join(x) for x in want]


def test_clean_stats(spark):
    schema = "document_id string, chunk_id string, ordinal int, text string, page_start int, page_end int, heading_path array<string>"
    rows = [("d", "a", 1, "3/23\n4", 1, 1, []), ("d", "b", 2, "tiny", 1, 1, []), ("d", "c", 3, "1. First Part. It says a lot about the goods.\n2. Second Part. It says more about other goods.", 1, 2, ["H"]), ("e", "x", 1, "7", 1, 1, [])]
    got = {r["document_id"]: tuple(r)[1:] for r in chunking.clean_stats(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"d": (2, 1, 1, 1), "e": (0, 1, 0, 0)}


def test_refusals(spark):
    empty = spark.createDataFrame([], "document_id string, chunk_id string, text string, ordinal int")
    with pytest.raises(ValueError, match="no clauses"):
        chunking.checked(empty)
    twice = spark.createDataFrame([("d", "c", "text", 1), ("d", "c", " ", 2)], empty.schema)
    with pytest.raises(ValueError, match="duplicate chunk_id"):
        chunking.checked(twice)
    docs = spark.createDataFrame([("k", None, [("c1", "text"), ("c2", "")])], "document_key string, document_id string, chunks array<struct<chunk_id:string,text:string>>")
    with pytest.raises(Exception, match="blank text in document k"):
        chunking.prepare_chunks(docs).collect()
    with pytest.raises(ValueError, match="no documents"):
        chunking.prepare_chunks(docs.limit(0))
    with pytest.raises(ValueError, match="no lines"):
        chunking.process_documents(spark.createDataFrame([], files.LINES))
    with pytest.raises(Exception, match="no clause zz"):
        retrieval.get_chunks(twice, spark.createDataFrame([("zz",)], "chunk_id string")).collect()
    example = spark.createDataFrame([(1, "a b c", "q", "a b c", 0, 3)], "id int, context string, question string, answer string, at int, n int")
    with pytest.raises(Exception, match="does not fit"):
        evaluation.windows(example, 2).collect()
    with pytest.raises(ValueError, match="unknown mode"):
        deontic.confirmed(example, mode="often")


def test_index(spark, tmp_path):
    rows = [("d", f"c{k}", f"clause {k} on payment by the Customer and {'delivery' if k % 5 == 0 else 'audit'}", k) for k in range(20)]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id string, text string, ordinal int")
    index = retrieval.build_index(chunks, str(tmp_path), lambda c: c.select("chunk_id", F.array(F.length("text").cast("double"), F.lit(2.0)).alias("embedding")))
    asked = spark.createDataFrame([(1, "delivery payment"), (2, "  ")], "query_id int, query string")
    found = retrieval.bm25_topk(index.chunks, asked, "chunk_id", 3, statistics=index.statistics).collect()
    assert {r["query_id"] for r in found} == {1} and all(int(r["id"][1:]) % 5 == 0 for r in found)
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-9 for r in index.vectors.collect())
    assert index.edges.where("relation = 'mentions'").count() == 40
    everything = retrieval.bm25_topk(index.chunks, asked, "chunk_id", 50, statistics=index.statistics)
    assert everything.count() == 20


def test_vectors_in_blocks(spark, monkeypatch):
    r = random.Random(2)
    rows = [(k, [r.random() for _ in range(4)]) for k in range(60)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = items.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    whole = sorted(map(tuple, retrieval.vector_topk(items, asked, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, retrieval.vector_topk(items, asked, 3).collect())) == whole and len(whole) == 180
    side = items.select((F.col("vec_id") % 2).alias("contract_id"), F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("ordinal"), "embedding")
    one = sorted(map(tuple, align.vector_candidates(side, side, 2).collect()))
    monkeypatch.setattr(align, "BLOCK", 7)
    assert sorted(map(tuple, align.vector_candidates(side, side, 2).collect())) == one and len(one) == 120


def test_answers_are_asked_once(spark, tmp_path):
    calls = []

    def label(asked):
        calls.append(asked.count())
        return asked.select("key", F.lit('{"label": "PERMISSION"}').alias("raw"))

    rows = spark.createDataFrame([(k, "It may stop and must tell." if k < 3 else "The Buyer shall pay.") for k in range(5)], "chunk_id int, text string")
    found = deontic.tagged(rows)
    got = deontic.confirmed(found, label).collect()
    assert calls == [1] and [(r["label"], r["decided_by"]) for r in sorted(got, key=lambda r: r["chunk_id"])] == [("PERMISSION", "model")] * 3 + [("OBLIGATION", "rules")] * 2
    cache = files.kept(found.where("ambiguous").select(F.lit("k").alias("key"), F.lit("x").alias("raw")).limit(1))
    deontic.confirmed(found, label, "all", cache)
    assert len(calls) == 2
    done = []

    def compute(missing):
        done.extend(r["key"] for r in missing.collect())
        return missing.select("key", F.lit(1).alias("value"))

    todo = spark.createDataFrame([("a",), ("b",)], "key string")
    files.resumed(todo.where("key = 'a'"), str(tmp_path / "kept"), compute)
    assert files.resumed(todo, str(tmp_path / "kept"), compute).count() == 2 and done == ["a", "b"]


def test_question_queue(spark):
    asked = spark.createDataFrame([("r", f"Question {k}?", k) for k in range(12)] + [("r", "question  3", 50), ("r", " ", 51)], "report_id string, question string, asked_no int")
    failed = spark.createDataFrame([("r", "Question 11?", 0), ("r", "Lost one", 1)], asked.schema)
    answers = spark.createDataFrame([("r", "QUESTION 0")], "report_id string, question string")
    got = consult.question_queue(asked, answers, failed).orderBy("place").collect()
    assert [r["question"] for r in got][:3] == ["Question 11?", "Lost one", "Question 1?"] and len(got) == 12 and [r["batch_no"] for r in got] == [1] * 10 + [2] * 2
    said = spark.createDataFrame([("r", "A?", "old", 1), ("r", "a", "new", 2)], "report_id string, question string, answer string, answered_no int")
    assert [r["answer"] for r in consult.saved_answers(said).collect()] == ["new"]


def test_answered(spark):
    changes = spark.createDataFrame([("k", f"C00{n}", n, "MODIFIED", "S", f"T{n}", None if n % 2 else "A -> B", "sum", n == 4) for n in range(1, 6)], "contract_id string, change_id string, change_no int, change_status string, section string, title string, shift string, summary string, needs_review boolean")
    asked = spark.createDataFrame([("q1", "k", "Which need review?"), ("q2", "k", "What duties?")], "query_id string, contract_id string, question string")
    relevant = consult.relevant_changes(changes, asked, k=3)
    got = {r["query_id"]: r for r in consult.answered(asked, relevant, changes, lambda a: a.select("query_id", F.concat(F.lit("See "), F.substring("listed", 1, 6), F.lit(" and [C099]."))  .alias("raw"))).collect()}
    assert got["q1"]["used"] == ["C004", "C001", "C002"] and got["q1"]["citations"] == ["C004"] and got["q1"]["removed"] == ["C099"] and got["q2"]["used"][:2] == ["C002", "C004"]


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([("k", "A: b/c", "# Title\n\n> quote *x*\n\n- **C1** a & b\n\n| Party | n |\n|---|---|\n| x | 1 |\n\n### S\n\ntext", "{}")], "contract_id string, name string, markdown string, json string")
    page = files.report_files(rows, "html").first()
    assert page["file_name"] == "A_ b_c.html" and "<h1>Title</h1>" in page["body"] and "<li><strong>C1</strong> a &amp; b</li>" in page["body"] and "<td>x</td>" in page["body"]
    assert files.report_files(rows, "md").first()["body"].startswith("# Title")
    with pytest.raises(ValueError, match="unknown format"):
        files.report_files(rows, "pdf")
    files.write_report(rows, str(tmp_path / "r"))
    assert [tuple(r) for r in files.read_report(spark, str(tmp_path / "r"), "contract_id string, name string, markdown string, json string").collect()] == [tuple(rows.first())]
    (tmp_path / "o.json").write_text('{"B": {"keywords": ["x"], "stakeholders": ["S"]}, "A": {}}')
    assert ontology.load_ontology(spark, str(tmp_path / "o.json")) == [("B", ["x"], ["S"]), ("A", [], [])]
    (tmp_path / "done.jsonl").write_text('{"_meta": {"node": 1}}\n{"pair_id": "p", "n": 1}\n{"pair_id": "q", "n"')
    assert [tuple(r) for r in files.read_results(spark, str(tmp_path / "done.jsonl"), "pair_id string, n int").collect()] == [("p", 1)]


def test_live_table(spark, tmp_path):
    """Placeholders, results in any order, a batch that runs again, and versions that go."""
    table = str(tmp_path / "t")
    pairs = spark.createDataFrame([(f"p{k}",) for k in range(10)], "pair_id string")
    live.preview(pairs, table, pairs.where("pair_id = 'p9'"), buckets=3)
    assert live.progress(live.newest(spark, table)).first()[:] == (0, 9)
    for no, rows in enumerate([[("p1", 5, "VERIFIED")], [("p1", 3, "late"), ("p2", 4, "LOW_CONFIDENCE")], [("p1", 3, "late"), ("p2", 4, "LOW_CONFIDENCE")], [("p3", 9, "VERIFIED")]]):
        live.merge(spark.createDataFrame(rows, "pair_id string, arrival_no long, status string"), [1, 2, 2, 3][no], table, 3)
    got = {r["pair_id"]: r["status"] for r in live.newest(spark, table).collect()}
    assert got == {f"p{k}": "PENDING" for k in range(10)} | {"p9": "SKIPPED", "p1": "VERIFIED", "p2": "LOW_CONFIDENCE", "p3": "VERIFIED"}
    assert all(len(v) <= 2 for v in live._versions(spark, table).values())


def test_numbering_leaves_skipped_out(spark):
    chunks = spark.createDataFrame([("k", f"b{n}", n) for n in range(1, 4)], "contract_id string, chunk_id string, ordinal int")
    rows = spark.createDataFrame([(f"x{n}", "k", None, f"b{n}", "SKIPPED" if n == 2 else "VERIFIED") for n in range(1, 4)], "pair_id string, contract_id string, source_id string, target_id string, status string")
    got = {r["pair_id"]: r["change_id"] for r in report.numbered(rows, chunks.limit(0), chunks).collect()}
    assert got == {"x1": "C001", "x2": None, "x3": "C002"}
