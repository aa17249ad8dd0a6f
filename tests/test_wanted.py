"""Queries that read a few columns of the changes make no others."""

import pytest
from pyspark.sql import functions as F

from redliner.operators import align
from redliner.plans import compare
from redliner.queries import reports


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _sides(spark):
    rows = [("k", f"{v}{i}", i, f"{i}. Term. The Buyer {'shall' if (i + n) % 3 else 'may'} pay {i + n * (i > 2)} days to the other. Neither party may assign.", "Term") for n, v in enumerate("ab") for i in range(1, 9 - 3 * n)]
    made = spark.createDataFrame([*rows, (None, "a9", 1, "It shall be as long as it takes to have forty signs.", None)], "contract_id string, chunk_id string, ordinal int, text string, heading string")
    return made.where("chunk_id like 'a%'"), made.where("chunk_id like 'b%'")


@pytest.mark.parametrize("wanted", [("pair_id", "change_id", "place"), ("pair_id", "key_old", "key_new"), ("pair_id", "importance", "why"), ("change_no", "needs_review", "shift"), ("change_id", "source_id", "section"), ("pair_id", "summary", "title", "affected")])
def test_wanted_columns_are_those_of_the_changes(spark, wanted):
    a, b = _sides(spark)
    aligned = align.align(a, b)
    pairs = align.changed_pairs(aligned, b)
    whole = compare.changes_of(a, b, aligned, pairs).select(*wanted)
    for x, y in ((a, b), (compare.with_places(a), compare.with_places(b))):
        got = compare.changes_of(x, y, aligned, pairs, wanted)
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and got.count() > 2


@pytest.mark.parametrize("query", ["report_order", "index_by_chunk", "key_numbers", "importance"])
def test_passes_that_nothing_wants_are_not_made(spark, sf_dir, query):
    from redliner.queries import grounding

    plan = _plan({**reports.QUERIES, **grounding.QUERIES}[query](spark, sf_dir))
    assert ("MapInArrow" in plan) == (query == "importance")
    assert ("Window" in plan) == (query in ("report_order", "index_by_chunk"))


def test_changes_read_twice_hold_what_is_asked(spark, sf_dir, monkeypatch):
    from redliner.queries import grounding

    held = []
    monkeypatch.setattr(grounding.files, "kept", lambda df, name="table": (held.append(df.columns), df)[1])
    grounding.relevant_changes(spark, sf_dir)
    assert held == [["contract_id", "change_id", "change_no", "needs_review", "shift"]]


def test_questions_of_all_contracts_do_not_go_to_the_driver(spark):
    from redliner.operators import consult
    from redliner.queries import grounding

    rows = [(i % 9, f"C{i:03d}", i // 9 + 1, i % 2 == 0, None) for i in range(99)]
    changes = spark.createDataFrame(rows, "contract_id long, change_id string, change_no int, needs_review boolean, shift string")
    found = consult.relevant_changes(changes, grounding._asked(changes))
    assert len(found.collect()) == 9 * 5 * 8
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_texts_without_signs_are_not_mapped_and_read_the_same(spark):
    from redliner.functions import text as T

    rows = spark.createDataFrame([(x,) for x in ("a b", " a  b ", "é  b", "a\x1c b", "", "   ", None, "A-b_c*\"'", "ab c", "tab\tx", "a\xa0", "™")], "x string")
    norm, key = F.trim(F.regexp_replace(F.translate("x", T.SPACES, " " * len(T.SPACES)), " {2,}", " ")), F.translate(F.lower("x"), T.SPACES + T.FORMAT_SIGNS, "")
    assert rows.where(~T.normalize_text(F.col("x")).eqNullSafe(norm) | ~T.formatting_key(F.col("x")).eqNullSafe(key)).count() == 0
    assert "CASE WHEN" in _plan(rows.select(T.normalize_text(F.col("x"))))


def test_words_in_common_are_compiled(spark):
    a, b = _sides(spark)
    plan = _plan(align.align(a, b))
    assert "transform(array(size(array_intersect(" not in plan and plan.count("array_intersect(") == 1
