"""Agreement of partitions, chance, and seeded draws."""

import math

import pytest
from pyspark.sql import functions as F


def score(spark, a, b):
    from larkgraph.operators.partitions import adjusted_mutual_information

    return tuple(adjusted_mutual_information(spark.createDataFrame(list(zip(a, b)), "a long, b long"), "a", "b").first())


def test_adjusted_mutual_information_of_known_partitions(spark):
    cases = [
        ([0, 0, 0, 1, 1, 1, 2, 2, 2], [5, 5, 5, 7, 7, 7, 1, 1, 1], 1.0, 1.0),
        ([0, 0, 1, 1], [0, 1, 0, 1], -0.5, -0.5),
        ([0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 2, 2], 0.2987924581708901, 0.24242424242424246),
        ([0, 0, 0], [4, 4, 4], 1.0, 1.0),
        ([0, 1, 2], [4, 5, 6], 1.0, 1.0),
    ]
    for a, b, ami, ari in cases:
        got = score(spark, a, b)
        assert got[0] == pytest.approx(ami, abs=1e-9) and got[1] == pytest.approx(ari, abs=1e-9)


def test_expected_information_is_the_mean_over_all_shuffles(spark):
    import itertools

    from larkgraph.operators.partitions import expected_mutual_information

    a, b = [0, 0, 0, 1, 1, 2], [0, 0, 1, 1, 1, 1]

    def information(x, y):
        n, out = len(x), 0.0
        for i in set(x):
            for j in set(y):
                both = sum(p == i and q == j for p, q in zip(x, y))
                if both:
                    out += both / n * math.log(n * both / (x.count(i) * y.count(j)))
        return out

    every = [information(list(p), b) for p in itertools.permutations(a)]
    size = lambda x: spark.createDataFrame([(s, sum(x.count(k) == s for k in set(x))) for s in {x.count(k) for k in set(x)}], "size long, clusters long")
    assert expected_mutual_information(size(a), size(b), 6) == pytest.approx(sum(every) / len(every), abs=1e-12)


def test_large_cells_are_summed_in_stretches(spark, monkeypatch):
    from larkgraph.operators import partitions as p

    sizes = spark.createDataFrame([(700, 1), (300, 2)], "size long, clusters long")
    whole = p.expected_mutual_information(sizes, sizes, 1300)
    monkeypatch.setattr(p, "STRETCH", 7)
    assert p.expected_mutual_information(sizes, sizes, 1300) == pytest.approx(whole, rel=1e-9) and whole > 0


def test_log_factorials(spark):
    from larkgraph.functions.draws import log_factorial

    ks = [0, 1, 2, 10, 15, 16, 17, 100, 10**6, 10**12]
    got = spark.createDataFrame([(k,) for k in ks], "k long").select(log_factorial(F.col("k")).alias("f")).collect()
    assert [r["f"] for r in got] == pytest.approx([math.lgamma(k + 1) for k in ks], rel=1e-14, abs=1e-14)


def test_shuffles_are_the_same_on_any_partitions(spark):
    from larkgraph.operators.partitions import against_shuffles, random_pairs, shuffled

    rows = spark.createDataFrame([(i, i % 4, i % 4 if i % 5 else 9) for i in range(120)] + [(500, None, 1)], "id long, a long, b long")
    deal = lambda n: {tuple(r) for r in shuffled(rows.where("a IS NOT NULL").repartition(n), "id", "a", 5, 3).collect()}
    one = deal(3)
    assert one == deal(17) and len(one) == 600
    by = {}
    for k, i, a in one:
        by.setdefault(k, {})[i] = a
    want = sorted(i % 4 for i in range(120))
    assert all(sorted(x.values()) == want for x in by.values()) and len({tuple(sorted(x.items())) for x in by.values()}) == 5
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in (3, 17):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            seen.append([round(v, 9) for v in against_shuffles(rows.repartition(n), "id", "a", "b", times=50).first()])
        assert seen[0] == seen[1]
        pairs = []
        for n in (3, 17):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            pairs.append(sorted(tuple(r) for r in random_pairs(spark, rows.select(F.col("id").alias("entity")).repartition(n), 40, 7).collect()))
        assert pairs[0] == pairs[1] and len(pairs[0]) > 30 and all(a != b for _, a, b in pairs[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # Labels that mostly follow the clusters beat every shuffle; labels dealt without regard to them don't.
    assert seen[0][0] > 0.5 and seen[0][4] == round(1 / 51, 9) and abs(seen[0][2]) < 0.05
    loose = spark.createDataFrame([(i, i % 4, (i // 4) % 3) for i in range(120)], "id long, a long, b long")
    assert against_shuffles(loose, "id", "a", "b", times=50).first()["p_ami"] > 0.2


def test_background_of_random_pairs(spark):
    from larkgraph.operators.partitions import background, pair_similarity

    sets = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")], "entity string, term string")
    content = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0)], "term string, ic double")
    pairs = spark.createDataFrame([(0, "a", "b"), (1, "a", "c"), (2, "b", "a")], "i long, a string, b string")
    assert {r["i"]: r["score"] for r in pair_similarity(pairs, sets, content).collect()} == pytest.approx({0: 1 / 3, 1: 0.0, 2: 1 / 3})
    got = background(spark, sets, content, pairs=60)
    row = got.first()
    assert 20 < row["pairs"] < 60 and 0 <= row["median"] <= row["strong"] <= 1 / 3 + 1e-9
    assert background(spark, sets.limit(0), content).first()["pairs"] == 0


def test_ranks_of_targets_count_the_band_around_them(spark):
    from larkgraph.operators.ranking import rank_among

    scores = [9.0, 8.0, 8.0, 7.5, 5.0, 5.0, 1.0, -2.0]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "entity long, score double").repartition(3)
    for gap in (0.0, 0.5, 3.0):
        got = {r["entity"]: (r["mid"], r["best"], r["worst"]) for r in rank_among(rows, rows, gap).collect()}
        want = {}
        for i, s in enumerate(scores):
            above, tied = sum(x > s + gap for x in scores), sum(abs(x - s) <= gap for x in scores)
            want[i] = ((2 * above + 1 + tied) / 2, above + 1, above + tied)
        assert got == want


def test_quantiles_are_exact(spark):
    import numpy as np

    from larkgraph.operators.ranking import quantiles

    values = {"a": [1.0, 2.0, 2.0, 10.0], "b": [5.0], None: [3.0, 4.0, 4.0, 4.0, 9.0, -1.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double").repartition(5)
    got = {r["g"]: r for r in quantiles(rows, "g", "v", low=0.0, q=0.3, mid=0.5, high=0.95, top=1.0).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        for name, q in (("low", 0.0), ("q", 0.3), ("mid", 0.5), ("high", 0.95), ("top", 1.0)):
            assert got[g][name] == pytest.approx(np.quantile(vs, q))


def test_fingerprints_do_not_depend_on_order(spark):
    from larkgraph.operators.stored import fingerprint

    rows = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    one = fingerprint(rows).first()[0]
    assert one == fingerprint(rows.repartition(7)).first()[0] and len(one) == 64
    assert one != fingerprint(rows.where("h <> (SELECT sha2('7', 256))")).first()[0] != fingerprint(rows.union(rows.limit(1))).first()[0]
    assert fingerprint(rows.limit(0)).count() == 0


def test_blocks_of_sets_give_the_same_pairs(spark):
    import random

    from larkgraph.operators.similarity import neighbours, set_pairs, simgic

    rng = random.Random(4)
    sets = spark.createDataFrame([(e, f"t{t}") for e in range(40) for t in rng.sample(range(12), rng.randrange(1, 11))], "entity long, term string")
    content = spark.createDataFrame([(f"t{t}", float(t % 4)) for t in range(12)], "term string, ic double")
    plain = simgic(sets, content).withColumn("score", F.round("score", 6)).cache()
    for block in (7, 1024):
        got = {tuple(r) for r in set_pairs(sets, content, block=block).collect()}
        assert got == {tuple(r) for r in plain.collect()}
        high = {tuple(r) for r in set_pairs(sets, content, least=0.6, block=block).collect()}
        assert high == {tuple(r) for r in plain.where("score >= 0.6").collect()} and high
        near = {tuple(r) for r in neighbours(set_pairs(sets, content, most=3, block=block), 3).collect()}
        assert near == {tuple(r) for r in neighbours(plain, 3).collect()}


def test_edit_distances_of_all_lengths(spark):
    import random

    from larkgraph.operators.search import osa

    def distance(x, y):
        d = {(i, j): i + j for i in range(len(x) + 1) for j in range(len(y) + 1) if not i or not j}
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
                if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(x), len(y)]

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcä𝛼") for _ in range(rng.randrange(8)))
    pairs = [(word(), word()) for _ in range(300)] + [("ca", "abc"), ("", "")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", osa("a", "b").alias("d")).collect()
    assert all(r["d"] == distance(r["a"], r["b"]) for r in got)


def test_sets_are_dealt_in_one_order(spark):
    """Sets go to every block; alike byte by byte, they are small there. Digests of terms don't go through the shuffle."""
    from larkgraph.operators import similarity as s

    sets = spark.createDataFrame([(e, t) for e in range(6) for t in ("x", "y", "z")[: e % 3 + 1]], "entity long, term string").repartition(5)
    content = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 0.5)], "term string, ic double")
    plan = s.set_pairs(sets, content)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort(collect_list(struct(term" in plan.replace("sort_array", "array_sort")
    members = {r["entity"]: r["rep"] for r in s.set_classes(sets, content)[0].collect()}
    assert members == {e: e % 3 for e in range(6)}
