"""Core operators on small hand-typed tables."""

import math

import pytest
from pyspark.sql import functions as F

from larkgraph.functions import text as t
from larkgraph.operators import graph as g
from larkgraph.operators import ontology as o
from larkgraph.operators import ranking as r
from larkgraph.operators import search as se
from larkgraph.operators import similarity as s


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(column.alias("x")).first()["x"]


def test_closure_ends_on_cycles_and_ignores_nulls(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), (None, "a")], "child string, parent string")
    got = {tuple(x) for x in o.closure(edges).collect()}
    assert got == {(x, y) for x in "abc" for y in "abc"} | {("d", x) for x in "abcd"}


def test_information_content_counts_below(spark):
    closed = o.closure(spark.createDataFrame([("x", "r"), ("y", "r"), ("z", "y")], "child string, parent string"))
    ann = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y")], "entity long, term string")
    got = dict(o.information_content(ann, closed).collect())
    assert got == pytest.approx({"r": 0.0, "x": 0.0, "y": math.log(2), "z": math.log(3)})


def test_most_specific(spark):
    closed = o.closure(spark.createDataFrame([("x", "r"), ("z", "x")], "child string, parent string"))
    sets = spark.createDataFrame([(1, "r"), (1, "z"), (2, "x"), (2, "x")], "g long, t string")
    assert sorted(map(tuple, o.most_specific(sets.toDF("grp", "term"), closed, "grp", "term").collect())) == [(1, "z"), (2, "x"), (2, "x")]


def test_midranks_chain_ties(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.0 - 0.9e-9), ("c", 1.0 - 1.8e-9), ("d", 0.5)], "entity string, score double")
    got = {x["entity"]: (x["rank_mid"], x["tied"]) for x in r.midranks(rows, "score", "entity").collect()}
    assert got == {"a": (2.0, 3), "b": (2.0, 3), "c": (2.0, 3), "d": (4.0, 1)}


def test_fusion_refuses_different_candidates(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "entity string, rank_mid double")
    assert dict(r.fuse(a, a).collect()) == pytest.approx({"x": 0.5, "y": 1 / 3})
    with pytest.raises(Exception, match="different candidates"):
        r.fuse(a, a.where("entity = 'x'")).collect()


def test_annotation_frequency(spark):
    c = lambda n, m, iea: one(spark, r.annotation_frequency(F.lit(n).cast("int"), F.lit(m).cast("int"), F.lit(iea)))
    assert [c(1, 1, False), c(None, None, False), c(None, None, True), c(0, 1000, True)] == pytest.approx([2 / 3, 0.5, 0.35, 0.01])


def test_plan_limits():
    step = g.Step("r")
    for bad in (lambda: g.Plan((), (step,)), lambda: g.Plan(("a",), (step,) * 5), lambda: g.Plan(("a",), (step,), 101), lambda: g.Plan(("a",), (g.Step("r", "up"),))):
        with pytest.raises(ValueError):
            bad()


def test_shortest_path_and_page(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("a", "q", "x"), ("x", "q", "c"), ("c", "r", "d")], "src string, relation string, dst string")
    assert sorted((x["hop"], x["node"]) for x in g.shortest_path(edges, "a", "d").collect()) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert g.shortest_path(edges, "a", "nowhere").count() == 0
    plan = g.Plan(("a",), (g.Step("r"), g.Step("r")), 1)
    assert [tuple(x) for x in g.page(g.traverse(edges, plan), plan, "focus", "node").collect()] == [("a", "c", False)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    assert dict(g.components(edges).collect()) == {**{i: 0 for i in range(21)}, 50: 50, 51: 50}


def test_simgic_example(spark):
    sets = spark.createDataFrame([("p", 1), ("p", 2), ("p", 3), ("q", 2), ("q", 3), ("q", 4)], "entity string, term long")
    content = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)], "term long, ic double")
    assert s.simgic(sets, content).first()["score"] == pytest.approx(0.5)


def test_validation_values(spark):
    rows = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False)], "score double, y boolean")
    got = s.auroc(rows, "score", "y").first()
    assert (got["auroc"], got["average_precision"]) == pytest.approx((0.875, 0.5 * 1 + 0.5 * 2 / 3))
    labels = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1)], "a int, b int")
    assert s.adjusted_rand(labels, "a", "b").first()[0] == pytest.approx(1.0)


def test_search_tiers_and_corrections(spark):
    names = spark.createDataFrame([(1, "red fox"), (2, "red"), (3, "the red"), (4, "blue")], "node long, name string")
    assert {x["node"]: x["tier"] for x in se.tiers(names, "red").collect()} == {1: 1, 2: 0, 3: 2}
    asked = spark.createDataFrame([("strem",), ("known",), ("abc",), ("tabel",)], "asked string")
    known = spark.createDataFrame([("stream",), ("known",), ("table",), ("abd",)], "word string")
    asked = asked.union(spark.createDataFrame([("quuickly",), ("sttreamxng",)], "asked string"))
    known = known.union(spark.createDataFrame([("quickly",), ("streaming",), ("quietly",)], "word string"))
    got = {x["asked"]: (x["word"], x["edits"]) for x in se.corrections(asked, known).collect()}
    assert got == {"strem": ("stream", 1), "tabel": ("table", 1), "quuickly": ("quickly", 1), "sttreamxng": ("streaming", 2)}


@pytest.mark.parametrize("raw, value", [("3/12", 0.25), ("40%", 0.4), ("0/0", None), ("often", None), ("HP:0040281", 0.895), ("12.5%", 0.125)])
def test_frequency_forms(spark, raw, value):
    assert one(spark, t.frequency(F.lit(raw))["value"]) == (pytest.approx(value) if value is not None else None)


def test_text_functions(spark):
    f = lambda c: one(spark, c)
    assert f(t.frequency(F.lit("  "))) is None
    assert f(t.normalize_label(F.lit("Dravet  Syndrome! STRAßE"))) == "dravet syndrome strasse"
    assert [f(t.soundex(F.lit(w))) for w in ("miller", "robert", "ashcraft", "")] == ["m46", "r163", "a226", ""]
    assert [f(t.within_one_edit(F.lit(a), F.lit(b))) for a, b in (("abcd", "abdc"), ("abcd", "abcd"), ("abcd", "abce"), ("abcd", "badc"), ("ca", "abc"))] == [True, True, True, False, False]
    assert f(t.html_text(F.lit("<p>a &amp; b<script>x<y</script><!-- no --></p>\n<b>c</b>"))) == "a & b c"
    assert f(t.mod_11_2(F.lit("000000021825009"))) == "7"
    red = f(t.redact(F.lit("write to a.b@c.org, born 01.02.1990")))
    assert red["text"] == "write to [email], [born]" and (red["email"], red["born"], red["date"]) == (1, 1, 0)


def test_licence_classes(spark):
    from larkgraph.functions.licences import licence_class

    names = {
        "CC-BY-4.0": "open",
        "Creative Commons Attribution-ShareAlike": "share_alike",
        "non commercial use": "non_commercial",
        "Public-Domain": "open",
        "ncsa": "unknown",
        "CC0 1.0": "open",
        "": "unknown",
        "CC BY-NC-SA 4.0": "non_commercial",
        "ccbysa 3.0": "share_alike",
        "under CC BY 4.0, parts under CC BY-NC 4.0": "non_commercial",
        "Attribution is not required": "unknown",
        "CC-BY-ND 4.0": "open",
        "ODbL-1.0": "share_alike",
        "PDDL": "open",
        "MIT License": "unknown",
        None: "unknown",
    }
    rows = spark.createDataFrame(list(names.items()), "name string, label string")
    assert {x["name"]: x["c"] for x in rows.withColumn("c", licence_class(F.col("name"))).collect()} == names


def test_curation_functions(spark):
    f = lambda c: one(spark, c)
    assert [f(t.annotation_date(F.lit(x))) for x in ("HPO:p[2021-06-21]", "a[1];b[2] x", "none", "a]b[c")] == ["2021-06-21", "2", None, None]
    assert [f(t.keyboard_neighbours(F.lit(a), F.lit(b))) for a, b in (("test", "tesr"), ("test", "tesp"), ("test", "rwst"), ("zu", "tu"))] == [True, False, False, True]
    assert [f(t.frequency_tier(F.lit(x).cast("double"))) for x in (1.0, 0.8, 0.05, 0.01, 0.0, None)] == ["obligate", "very_frequent", "occasional", "very_rare", "zero_observed", "unknown"]
    assert [f(t.protocol_key(F.lit(x))) for x in (" ab-12 34 ", "123-456", "short", "protocol")] == ["AB-1234", None, None, None]
    assert f(t.iri_encode(F.lit("a b*~/é"))) == "a%20b%2A~%2F%C3%A9" and f(t.turtle_literal(F.lit('a"\\\n'))) == '"a\\"\\\\\\n"'
    assert sorted(f(t.deletions(F.lit("abc")))) == ["ab", "abc", "ac", "bc"]


def test_running_sums_over_ranges(spark):
    from larkgraph.operators.stored import running

    rows = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v long")
    got = {x["v"]: x["total"] for x in running(rows, F.desc("v"), parts=7, total=F.col("v")).collect()}
    assert got == {v: sum(range(v, 1000)) for v in range(1000)}


def test_simgic_from_a_score_on_loses_no_pair(spark):
    import random

    rng = random.Random(2)
    sets = spark.createDataFrame([(e, term) for e in range(40) for term in rng.sample(range(30), 12)], "entity long, term long")
    content = spark.createDataFrame([(x, 0.2 + x / 9) for x in range(30)], "term long, ic double")
    every = {(x["a"], x["b"]): round(x["score"], 9) for x in s.simgic(sets, content).collect()}
    for least in (0.2, 0.5):
        assert {(x["a"], x["b"]): round(x["score"], 9) for x in s.simgic(sets, content, least).collect()} == {k: v for k, v in every.items() if v >= least}


def test_streaming_windows(spark, tmp_path):
    from larkgraph.streaming import windows as w

    rows = spark.createDataFrame([(1, "2024-01-01 00:01:00", 1.0), (1, "2024-01-01 00:02:00", 2.0), (2, "2024-01-01 00:20:00", 4.0)], "user_id long, t string, value double").select("user_id", F.to_timestamp("t").alias("ts"), "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = w.counts(stream, "ts", "10 minutes", late="5 minutes").writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(x["n"] for x in spark.sql("SELECT * FROM win").collect()) == [1, 2]
    assert [x["admitted"] for x in w.admitted(rows, "user_id", "ts", 90, 1).orderBy("ts").collect()] == [True, False, True]
