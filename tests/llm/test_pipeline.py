"""Each stage of the pipeline against a plain restatement over what the stage before kept."""

import brute
from pyspark.sql import functions as F
from test_brute import check_mixing, check_packing

import corpus_pipeline
from redliner.llm import mixing


def _pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf_dir, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "mix_sources", "pack"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, kept[name] = docs, out
        if name == "language_id":
            assert out.count() >= 0.98 * before.count()
        elif name == "line_dedup":
            assert dict(_pairs(out)) == {i: t for i, (_, _, t) in brute.lines(_pairs(before)).items()}
        elif name == "simhash_near_dedup":
            assert sorted(i for i, _ in _pairs(out)) == sorted(i for i, c in brute.similar(_pairs(before)).items() if i == c)
        elif name == "mix_sources":
            mixed = mixing.mix(before.select("doc_id", "source")).collect()
            check_mixing(mixed, 32)
            at = out.select("doc_id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("m")).collect()
            order = [r["doc_id"] for r in sorted(at, key=lambda r: (r["f"], r["m"]))]
            assert order == [r["doc_id"] for r in sorted(mixed, key=lambda r: r["mix_position"])]
        else:
            pieces = out.collect()
            check_packing(pieces, _pairs(before))
            firsts = [p["doc_id"] for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])) if p["start"] == 0]
            assert firsts == order  # the mix is the order of the packed stream
        if k < 4:
            assert out.columns == columns
            assert out.where(F.length("text") != F.col("n_chars")).count() == 0
        docs = out
    whole = {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert whole == {tuple(r) for r in kept["pack"].collect()}


def test_awkward_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns; and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, language string, n_dropped string, mix_slot string"
    english, long = "the quick brown fox jumps over the lazy dog and runs away from here", "one more word of the text " * 20_000
    rows = [(k, f"{english} number {k} of many others", "en", "a", 5) for k in range(30)]
    rows += [(3, rows[3][1], "en", "a", 5), (40, None, None, None, None), (None, english, "en", None, 1), (41, "", "en", "b", 0), (42, long, "en-GB", "b", None), (None, None, None, None, None)]
    for n, part in enumerate((rows, [])):
        spark.createDataFrame([(*r, "x", "y", "z") for r in part], schema).write.parquet(str(tmp_path / str(n) / "documents.parquet"))
        pieces = corpus_pipeline.run(spark, str(tmp_path / str(n))).collect()
        if not part:
            assert pieces == []
            continue
        whole = {p["doc_id"] for p in pieces}
        assert {0, 42} <= whole
        assert sum(p["length"] for p in pieces if p["doc_id"] == 42) == next(p["doc_tokens"] for p in pieces if p["doc_id"] == 42)
        ends = sorted((p["sequence_id"] * 2048 + p["offset"], p["length"]) for p in pieces)
        assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))
