"""Rounds of summary and critic: how often a model is asked."""

from pyspark.sql import functions as F

from redliner.operators import grounding


def test_no_question_is_asked_twice(spark, tmp_path):
    rows = [(f"p{i}", "k", "MODIFIED", f"a{i}", f"b{i}", "The Buyer shall pay 5 days after delivery.", "The Buyer may pay 6 days after delivery.", "Term", []) for i in range(4)]
    views = spark.createDataFrame(rows, "pair_id string, contract_id string, change_status string, source_id string, target_id string, source_text string, target_text string, heading string, parties array<string>")
    views = views.withColumns({"contract_parties": F.array(F.lit("Buyer")), "stakeholders": F.array().cast("array<string>")})

    def model(name, answer):
        def run(batches):
            for batch in batches:
                with open(tmp_path / name, "a") as log:
                    log.write("".join(f"{x}\n" for x in batch.column(0).to_pylist()))
                yield batch

        return lambda df: df.select("pair_id").mapInArrow(run, "pair_id string").withColumns({"raw": F.lit(answer), "raw_retry": F.lit("")})

    attempts = grounding.reviewed(views, model("summaries", "The Buyer may pay 6 days after delivery. AFFECTED: Buyer"), model("critics", "HALLUCINATION: not said"))
    assert attempts.groupBy("attempt").count().orderBy("attempt").collect() == [(1, 4), (2, 4)]
    for name in ("summaries", "critics"):  # each pair once in each of its two rounds
        assert sorted((tmp_path / name).read_text().split()) == sorted([f"p{i}" for i in range(4)] * 2), name
