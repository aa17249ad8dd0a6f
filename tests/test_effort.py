"""How much work the queries over all clauses do: what is made once and what is never held whole."""

from pyspark.sql import functions as F

from redliner.functions import text as T
from redliner.operators import align, deontic, evidence, impact


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _sides(spark):
    rows = [("k", f"{v}{i}", i, f"{i}. Term. The Buyer shall pay {i + n} days. Neither party may assign.", "Term") for n, v in enumerate("ab") for i in range(3)]
    made = spark.createDataFrame(rows, "contract_id string, chunk_id string, ordinal int, text string, heading string")
    return made.where("chunk_id like 'a%'"), made.where("chunk_id like 'b%'")


def test_pairs_are_scored_once(spark):
    a, b = _sides(spark)
    assert _plan(align.align(a, b)).count("array_intersect(") == 1


def test_sections_do_not_hold_a_document(spark):
    a, _ = _sides(spark)
    assert "collect_list" not in _plan(evidence.running_sections(a, "contract_id"))


def test_rules_have_fixed_patterns(spark):
    a, _ = _sides(spark)
    found = deontic.tagged(a.select("chunk_id", "text"))
    assert "aggregate(array(" not in _plan(found) and {r["label"] for r in found.collect()} == {"OBLIGATION", "PROHIBITION"}


def test_words_meet_by_family_and_not_pair_by_pair(spark):
    row = spark.createDataFrame([("payments pay inspected goodness term abc zebra goo", "payment inspection good terminal ab")], "s string, t string")
    words = impact.unsupported_words(F.col("s"), F.col("t"), [])
    assert "exists(" not in _plan(row.select(words.alias("w")))
    assert row.select(words.alias("w")).first()["w"] == ["abc", "zebra"]  # "term" and "goo" begin known words, "goodness" begins with one


def test_white_space_and_marks_one_by_one(spark):
    signs = [*range(9, 14), 0x1C, 0x85, 0xA0, 0x1680, 0x180E, 0x2003, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x2013, 0x2122, 0xAE, 0x2A]
    rows = spark.createDataFrame([(f"{chr(c)}A{chr(c)} {chr(c)}b{chr(c)}c ",) for c in signs], "x string")
    norm = F.trim(F.regexp_replace("x", r"(?U)\s+", " "))
    key = F.regexp_replace(F.lower("x"), "(?U)" + T.FORMAT_CHARS, "")
    assert rows.where((T.normalize_text(F.col("x")) != norm) | (T.formatting_key(F.col("x")) != key)).count() == 0
