"""Facts are derived from a written table, not made again for each atom of each rule."""


def test_rules_read_written_facts(spark, tmp_path):
    from larkgraph.operators.rules import Rule, derive

    at = str(tmp_path / "edges")
    spark.createDataFrame([("1", "x", "r", "y"), ("2", "z", "r", "y"), ("3", "q", "r", "w")], "id string, subject string, relation string, object string").write.parquet(at)
    rule = Rule("same", ("s", "same", "o"), (("s", "r", "y"), ("o", "r", "y")), (("s", "o"),))
    seeds = spark.createDataFrame([("x",)], "node string")
    out = derive(spark.read.parquet(at), [rule], seeds)
    assert [tuple(r) for r in out.collect()] == [("same", "x", "same", "z", ["1", "2"], 1)]
    assert not any(at in f for f in out.inputFiles())
