"""Sizes of terms by classes of terms, and tasks that stay small as rows grow."""

from pyspark.sql import functions as F


def test_sizes_of_annotated_inner_terms(spark):
    from larkgraph.operators.ontology import annotated_sizes

    up = {"a": ["a", "m", "r"], "b": ["b", "m", "r"], "m": ["m", "r"], "x": ["x", "r"], "r": ["r"]}
    closed = spark.createDataFrame([(n, t) for n, ts in up.items() for t in ts], "node string, ancestor string")
    rows = [(1, "a"), (1, "a"), (1, "b"), (1, "m"), (2, "m"), (3, "x"), (None, "x"), (4, "other")]
    ann = spark.createDataFrame(rows, "entity long, term string")
    expected = {}
    for e, t in rows:
        for u in up.get(t, []):
            if e is not None:
                expected.setdefault(u, set()).add(e)
    got = {r["term"]: r["size"] for r in annotated_sizes(ann, closed).collect()}
    assert got == {t: len(s) for t, s in expected.items()}


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    from larkgraph.operators import stored
    from larkgraph.plans.catalog import QUERIES

    df = spark.range(10).withColumn("k", F.col("id"))
    assert stored.spread(df, 4 * stored.ROWS, "k") is df
    assert stored.spread(df, 9 * stored.ROWS, "k").rdd.getNumPartitions() == 9
    at = "/root/testdata/sf0.001"
    plain = sorted(map(tuple, QUERIES["ag_10"](spark, at).collect()))
    monkeypatch.setattr(stored, "ROWS", 500)
    out = QUERIES["ag_10"](spark, at)
    assert sorted(map(tuple, out.collect())) == plain
    assert "RepartitionByExpression" in out._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_not_broadcast(spark, monkeypatch):
    """What is a few MB in files or in a shuffle may be hundreds in the driver."""
    from larkgraph.operators import ontology

    plans, kept = [], ontology.keep
    monkeypatch.setattr(ontology, "keep", lambda df: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), kept(df))[1])
    edges = spark.createDataFrame([("a", "m"), ("b", "m"), ("m", "r")], "child string, parent string")
    closed = ontology.closure(edges)
    assert not any("BroadcastHashJoin" in p for p in plans) and any("SortMergeJoin" in p for p in plans)
    ann = spark.createDataFrame([(1, "a"), (2, "b"), (2, "m")], "entity long, term string")
    out = ontology.information_content(ann, closed)
    assert {r["term"]: round(r["ic"], 6) for r in out.collect()} == {"a": 0.693147, "b": 0.693147, "m": 0.0, "r": 0.0}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "[term#" in x]
    assert not joins


def test_only_the_sets_of_drawn_pairs_are_made(spark):
    from larkgraph.operators.partitions import background

    rows = spark.createDataFrame([(e, t) for e in range(30) for t in ("r", f"t{e % 4}", f"u{e % 3}")], "entity long, term string")
    content = rows.select("term").distinct().withColumn("ic", F.length("term") + 0.5)
    asked = []
    some = lambda e: (asked.append({r[0] for r in e.collect()}), rows.join(e, "entity", "left_semi"))[1]
    got = background(spark, some, content, pairs=8, entities=rows.select("entity").distinct()).first()
    assert got == background(spark, rows, content, pairs=8).first() and got["pairs"] > 0
    assert 1 < len(asked[0]) <= 16
