"""The near-duplicate stage goes through its keys in parts, so that shuffle files of one part at a time are on disk."""

import random

import brute
from pyspark.sql import functions as F

from redliner.llm import common, simhash


def _groups(spark, rows):
    return {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_groups_by_parts_are_those_of_all_pairs(spark, monkeypatch):
    r = random.Random(3)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    form, kin = fresh(140), fresh(120)
    rows = [" ".join(form + fresh(260)) for _ in range(60)] + [" ".join(form + fresh(9)) for _ in range(6)]
    rows = list(enumerate([*rows, *(" ".join([*kin, *fresh(3)]) for _ in range(9)), None, "", "x y"]))
    monkeypatch.setattr(common, "PARTS", 2)
    for name in ("SECTION_ROWS", "SHINGLE_ROWS", "DEALT_TEXTS", "DEALT_PAIRS"):
        monkeypatch.setattr(simhash, name, 1)
    held, put = [], common.Staged.put

    def watched(self, df, **k):
        out = put(self, df, **k)
        if "sh" in out.columns:
            held.append({x["sh"] % 2 for x in out.select("sh").distinct().collect()})
        return out

    monkeypatch.setattr(common.Staged, "put", watched)
    assert _groups(spark, rows) == brute.similar(rows)
    assert len(held) == 4 and all(len(x) <= 1 for x in held) and len(set().union(*held)) > 1


def test_copies_in_other_case_keep_their_links(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join(words).upper()]
    made = spark.createDataFrame([(x,) for x in texts], "x string").select("x", F.xxhash64("x").alias("h"))
    texts = [r["x"] for r in sorted(made.collect(), key=lambda r: -r["h"])]  # the least id has not the least hash
    assert _groups(spark, [(1, texts[0]), (2, texts[1]), (3, " ".join([*words[:-1], "other"]))]) == {1: 1, 2: 1, 3: 1}


def test_a_table_by_parts_is_whole_and_drops_what_it_took(spark):
    staged, after = common.Staged(spark, "parts"), []

    def made(part):
        after.append(staged.put(spark.range(part)))
        return after[0].select(F.lit(part).alias("part"), "id")

    out = staged.put_in_parts(made, 3, after=after)
    assert sorted(map(tuple, out.collect())) == [(1, 0), (2, 0), (2, 1)] and not after
    assert [common.parts_of(n, 10) for n in (0, 10, 11, 10**9)] == [1, 1, 2, common.PARTS]
