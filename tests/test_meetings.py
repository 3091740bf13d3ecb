"""Pairs are counted where blocks of entities meet, whatever the blocks."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("block", [7, 1 << 19])
def test_shared_terms_are_those_of_a_plain_join(spark, block, monkeypatch):
    from larkgraph.operators import meetings

    monkeypatch.setattr(meetings, "AT_ONCE", 5)
    rng = random.Random(1)
    rows = {(rng.randrange(-30, 60), rng.choice([0, 0, rng.randrange(40)])): rng.randrange(4) for _ in range(400)}
    table = [(e, t, v) for (e, t), v in rows.items()] + [(None, 0, 1), (1, None, 1)]
    df = spark.createDataFrame(table, "entity long, term long, value long").repartition(3)
    every = defaultdict(lambda: [0, 0])
    for (a, t), x in rows.items():
        for (b, u), y in rows.items():
            if t == u and a != b:
                every[a, b][0] += 1
                every[a, b][1] += x * y
    got = lambda out: {(r["a"], r["b"]): [r["shared"], r["total"]] for r in out.collect()}
    assert got(meetings.shared_terms(df, lambda x, y: x * y, block=block)) == {k: v for k, v in every.items() if k[0] < k[1]}
    assert got(meetings.shared_terms(df, lambda x, y: x * y, F.col("entity") % 20 == 0, 2, block)) == {k: v for k, v in every.items() if k[0] % 20 == 0 and v[0] >= 2}
    assert meetings.shared_terms(df.where("term = 99"), lambda x, y: x).count() == 0


def test_pairs_are_not_shuffled(spark):
    from larkgraph.plans.catalog import QUERIES

    plan = QUERIES["an_10"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("FlatMapGroupsInArrow")[0]  # what comes out isn't grouped again


def test_sizes_come_along_and_ranges_serve_what_is_grouped(spark):
    """Lines are not shuffled again for what their entities carry."""
    from larkgraph.operators import meetings
    from larkgraph.plans.catalog import QUERIES

    rows = spark.createDataFrame([(e, t, 1, 10 * e) for e in range(9) for t in range(e % 4 + 1)], "entity long, term long, value long, size long")
    for dealt in (False, True):
        got = meetings.shared_terms(meetings.ranges(rows, 8192, 4096) if dealt else rows, lambda x, y: x, dealt=dealt).collect()
        assert len(got) == 36 and all(r["size_a"] == 10 * r["a"] and r["size_b"] == 10 * r["b"] for r in got)
        assert all(r["shared"] == min(r["a"] % 4, r["b"] % 4) + 1 for r in got)
    plan = QUERIES["an_10"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # rows meet the ranges of their term once
