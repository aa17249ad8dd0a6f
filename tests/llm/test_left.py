"""What the near-duplicate stage leaves on disk."""

import os

from redliner.llm import common, simhash


def test_groups_alone_are_left(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text + f" x{i}") for i in range(6)] + [(10, "one of its own kind"), (11, None), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    top = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    kept = simhash.one_per_group(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 10, 11]
    left = [x for x in set(os.listdir(top)) - before if any(not f.startswith(".") for _, _, fs in os.walk(f"{top}/{x}") for f in fs)]
    assert [x.rsplit("-", 1)[0] for x in left] == ["simhash-groups"]
