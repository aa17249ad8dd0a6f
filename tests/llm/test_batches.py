"""What travels to Python at once: whole texts in small batches, and each of them once."""

from pyspark.sql.readwriter import DataFrameWriter

from redliner.llm import common, langid, packing, simhash

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_texts_travel_in_small_batches_and_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the cat number {i} sat on the mat and saw the dog of the house", "en", "s") for i in range(4)], "doc_id long, text string, lang string, source string")
    before, seen, write = spark.conf.get(ROWS), [], DataFrameWriter.parquet

    def watched(self, path, *a, **b):
        plan = self._df._jdf.queryExecution().analyzed().toString()
        if "MapInArrow" in plan:
            seen.append((int(spark.conf.get(ROWS)), plan))
        return write(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    assert langid.identify(docs).count() == 4
    assert len(seen) == 1 and "__t" not in seen[0][1].replace("__text", "")  # kept texts are not sent beside themselves
    simhash.one_per_group(docs).count()
    packing.pack(docs).count()
    assert len(seen) >= 5 and max(n for n, _ in seen) <= common.TEXT_ROWS
    assert spark.conf.get(ROWS) == before
    with common.batches_of(spark, 10**6):
        assert spark.conf.get(ROWS) == before  # only ever less


def test_text_kept_or_not_gives_the_same_languages(spark):
    docs = spark.createDataFrame([(i, ("the cat sat on the mat", "der Hund lag auf dem Boden")[i % 2] * 3, ("en", "de")[i % 2], "s") for i in range(8)], "doc_id long, text string, lang string, source string")
    kept, bare = (sorted(langid.identify(docs, keep_text=k).drop("text").collect()) for k in (True, False))
    assert kept == bare and {r["language"] for r in kept} == {"de", "en"}
    assert sorted(langid.identify(docs).select("doc_id", "text").collect()) == sorted(docs.select("doc_id", "text").collect())
