"""Groups of similar texts that no leader of a section joins."""

import random

import brute

from redliner.llm import simhash


def _rows():
    r = random.Random(7)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    form = fresh(140)
    rows = [" ".join(form + fresh(260)) for _ in range(300)]  # texts that share a form and are not alike
    rows += [" ".join(form + fresh(9)) for _ in range(6)]  # texts that are little else and alike
    return list(enumerate(rows))


def test_groups_are_whole_where_sections_are_common(spark):
    rows = _rows()
    want = brute.similar(rows)
    assert sum(i != c for i, c in want.items()) == 5
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
