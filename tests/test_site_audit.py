"""Sequences in order, spellings of a name, steps of a projected score."""

import random

from crawlframe.operators import entities, site_audit


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (rng.choices("abcdef", k=rng.randrange(12)) for _ in range(2))
        assert site_audit.in_order(a, b) == plain_lcs(a, b)


def test_spellings_of_a_name_are_one(spark):
    rows = [(1, "organizations", "ACME Works, Inc.", "text", 0.8), (1, "organizations", '"Acme  works"', "schema", 0.95), (1, "organizations", "Ltd", "text", 0.8), (1, "persons", "x", "text", 0.7), (2, "organizations", "acme works group", "text", 0.8)]
    got = entities.merged([spark.createDataFrame(rows, "page_id long, bucket string, name string, source string, confidence double")]).collect()
    assert sorted((r.page_id, r.key, r.confidence, r.sources) for r in got) == [(1, "acme works", 0.99, "schema+text"), (1, "ltd", 0.8, "text"), (2, "acme works", 0.8, "text")]


def test_steps_gain_what_is_left(spark):
    pages = spark.createDataFrame([(1, 70.0, 10, 0, 10), (2, 90.0, 10, 0, 10), (3, 50.0, 90, 1, 90), (4, None, 90, 0, 90)], "page_id long, score double, schema int, author int, trust int")
    got = [(r.page_id, r.step, r.before, r.after, r.gained) for r in site_audit.waterfall(pages, "score").orderBy("page_id", "step").collect()]
    assert got[:7] == [(1, 1, 70.0, 82.0, 12.0), (1, 2, 82.0, 90.0, 8.0), (1, 3, 90.0, 95.0, 5.0), (2, 1, 90.0, 100.0, 10.0), (2, 2, 100.0, 100.0, 0.0), (2, 3, 100.0, 100.0, 0.0), (3, 0, 50.0, 50.0, 0.0)]
