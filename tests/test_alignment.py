"""Identity links, decisions, rules, budgets and mentions on small cases typed by hand."""

import pytest
from pyspark.sql import functions as F

LINKS = "a string, b string, exact boolean, conflict string"


def links(spark, *pairs):
    return spark.createDataFrame([(a, b, True, None) for a, b in pairs], LINKS)


def exact(df):
    return {(r["a"], r["b"]) for r in df.collect() if r["exact"]}


def test_cardinality_keeps_rows_and_flags_them(spark):
    from larkgraph.operators import alignment as al

    got = al.cardinality(links(spark, ("MONDO:1", "OMIM:1"), ("MONDO:2", "OMIM:2"), ("MONDO:2", "OMIM:3"), ("NCT:1", "EU:1"), ("NCT:2", "EU:1"))).collect()
    by = {(r["a"], r["b"]): (r["cardinality"], r["exact"], r["conflict"]) for r in got}
    assert by[("MONDO:1", "OMIM:1")] == ("1:1", True, None)
    assert by[("MONDO:2", "OMIM:3")] == ("1:n", False, "one_to_many")
    assert by[("NCT:1", "EU:1")] == by[("NCT:2", "EU:1")] == ("n:1", False, "many_to_one") and len(by) == 5
    again = al.accept(al.cardinality(links(spark, ("ROR:1", "F:1"), ("ROR:1", "F:2"))), "ROR", "one_to_many")
    assert exact(again) == {("ROR:1", "F:1"), ("ROR:1", "F:2")}


def test_chained_links_may_not_join_two_ids_of_one_prefix(spark):
    from larkgraph.operators import alignment as al

    got = al.consistent(links(spark, ("MONDO:1", "ORPHA:1"), ("MONDO:2", "OMIM:9"), ("ORPHA:1", "OMIM:9")))
    assert exact(got) == {("ORPHA:1", "OMIM:9")} and got.count() == 3


def test_the_weakest_terminology_gives_way(spark):
    from larkgraph.operators import alignment as al

    got = al.consistent(links(spark, ("MONDO:1", "ORPHA:1"), ("MONDO:1", "UMLS:C1"), ("ORPHA:1", "UMLS:C2")), weakest=("UMLS", "ORPHA", "MONDO"))
    assert exact(got) == {("MONDO:1", "ORPHA:1")}
    assert {r["conflict"] for r in got.collect() if not r["exact"]} == {"cluster_conflict"}
    # An id of an unlisted prefix is the first to go, and ids of a prefix that may repeat are no conflict.
    got = al.consistent(links(spark, ("A:1", "X:1"), ("A:2", "X:1"), ("A:1", "B:1")), weakest=("B", "A"))
    assert exact(got) == {("A:1", "B:1")}
    assert len(exact(al.consistent(links(spark, ("A:1", "X:1"), ("A:2", "X:1")), multi=("A",)))) == 2


def test_three_rounds_until_clusters_are_consistent(spark):
    from larkgraph.operators import alignment as al

    # Without the weakest, the next one is the bridge, and then the third.
    rows = [("A:1", "W:1"), ("A:2", "W:1"), ("A:1", "X:1"), ("A:2", "X:1"), ("A:1", "Y:1"), ("A:2", "Y:1"), ("A:1", "B:1")]
    got = al.consistent(links(spark, *rows), weakest=("W", "X", "Y", "B", "A"))
    assert exact(got) == {("A:1", "B:1")}
    with pytest.raises(RuntimeError):
        al.consistent(links(spark, *rows), weakest=("W", "X", "Y", "B", "A"), most_rounds=3)


def test_background_keeps_what_is_published(spark):
    from larkgraph.operators import alignment as al

    pairs = lambda *p: spark.createDataFrame(list(p), "a string, b string")
    published = pairs(("MONDO:1", "ORPHA:1"), ("MONDO:2", "ORPHA:2"))
    new = links(spark, ("GARD:1", "MONDO:1"), ("GARD:1", "ORPHA:2"), ("GARD:3", "MONDO:2"), ("GARD:4", "MONDO:4"))
    got = al.against_background(new, published, pairs(("GARD:3", "ORPHA:2")), "GARD")
    by = {(r["a"], r["b"]): (r["exact"], r["conflict"]) for r in got.collect()}
    # GARD:1 would bridge two published clusters, and GARD:3 would become what another source holds narrower.
    assert by == {("GARD:1", "MONDO:1"): (False, "cluster_conflict"), ("GARD:1", "ORPHA:2"): (False, "cluster_conflict"), ("GARD:3", "MONDO:2"): (False, "cluster_conflict"), ("GARD:4", "MONDO:4"): (True, None)}
    got = al.against_background(links(spark, ("GARD:3", "MONDO:2")), published, pairs(("GARD:3", "ORPHA:2"), ("MONDO:1", "MONDO:2")), "GARD")
    assert [(r["exact"], r["conflict"]) for r in got.collect()] == [(False, "cross_source")]
    assert al.contradictions(links(spark, ("GARD:3", "MONDO:2"), ("MONDO:2", "ORPHA:2")), pairs(("GARD:3", "ORPHA:2"), ("GARD:3", "X:1"))).count() == 1


GOOD = {"file": "f", "line": 1, "subject": "MONDO:1", "predicate": "skos:exactMatch", "object": "OMIM:1", "justification": "semapv:ManualMappingCuration", "conflict": None, "rule": "R-1", "rule_version": "1", "evidence_url": "https://example.org", "evidence_locator": "2", "evidence_sha256": "a" * 64}


def rows_of(spark, *changes):
    from larkgraph.operators import ledger

    schema = ", ".join(f"{c} {'long' if c == 'line' else 'string'}" for c in ledger.ASSERTION)
    rows = [tuple({**GOOD, "line": i, **c}[k] for k in ledger.ASSERTION) for i, c in enumerate(changes)]
    return ledger.identified(spark.createDataFrame(rows, schema))


def test_each_reason_of_the_ladder(spark):
    from larkgraph.operators import ledger

    cases = [
        ({}, None),
        ({"subject": "MONDO:2", "object": "OMIM:2", "conflict": "old"}, "source_conflict"),
        ({"justification": "guess"}, "unknown_justification"),
        ({"object": "OMIM:x"}, "invalid_identifier"),
        ({"object": "NOPE:1"}, "unknown_entity_regime"),
        ({"object": "HGNC:1"}, "incompatible_entity_regime"),
        ({"subject": "pubmed.author:1", "object": "epmc.author:2"}, "person_without_orcid"),
        ({"rule": "R-ORG-01", "subject": "ROR:1", "object": "gtr.org:2"}, "organisation_without_source_equivalence"),
        ({"justification": "semapv:LexicalMatching"}, "candidate_method"),
        ({"rule_version": "2"}, "unknown_rule_or_version"),
        ({"evidence_sha256": "short"}, "missing_evidence_receipt"),
        ({"evidence_url": None}, "missing_evidence_receipt"),
        ({"predicate": "skos:relatedMatch", "object": "OMIM:x"}, None),
    ]
    rows = rows_of(spark, *(c for c, _ in cases))
    got = {r["line"]: (r["status"], r["reason"]) for r in ledger.decide(rows, ledger.Policy((("R-1", "1", "skos:exactMatch"),)), spark.createDataFrame([], ledger.REVIEW), "d").collect()}
    assert [got[i][1] for i in range(len(cases))] == [w for _, w in cases]
    assert got[0][0] == "accepted" and got[12][0] == "typed_or_candidate" and got[1][0] == "rejected"


def test_a_revoked_link_stays_away_after_a_rebuild(spark, tmp_path):
    from larkgraph.operators import ledger

    policy = ledger.Policy((("R-1", "1", "skos:exactMatch"),))
    rows = rows_of(spark, {}, {"subject": "MONDO:5", "object": "ORPHA:5"})
    digest, reviews = ledger.input_digest(rows), ledger.Reviews(spark, str(tmp_path / "reviews"))
    of = lambda r: {x["node"]: x["representative"] for x in ledger.accepted(r).collect()}
    assert of(ledger.decide(rows, policy, reviews.read(), digest)) == {"MONDO:1": "MONDO:1", "OMIM:1": "MONDO:1", "MONDO:5": "MONDO:5", "ORPHA:5": "MONDO:5"}
    mark = lambda revoked, at, d=digest: rows.where("line = 0").select(F.lit(d).alias("input_digest"), F.lit("me").alias("actor"), F.lit(at).alias("reviewed_at"), F.lit("wrong").alias("reason"), "assertion", F.lit(revoked).alias("revoked"))
    reviews.append(mark(True, "2024-01-01"))
    for _ in range(2):  # a rebuild gives the same
        got = ledger.decide(rows, policy, reviews.read(), digest)
        assert of(got) == {"MONDO:5": "MONDO:5", "ORPHA:5": "MONDO:5"}
        assert {r["reason"] for r in got.collect()} == {None, "review_revoked"}
    # A review of another input plays no part; a later one of this input takes the decision back.
    other = rows_of(spark, {"evidence_locator": "9"})
    assert ledger.input_digest(other) != digest and len(of(ledger.decide(other, policy, reviews.read(), ledger.input_digest(other)))) == 2
    reviews.append(mark(False, "2024-02-01"))
    assert len(of(ledger.decide(rows, policy, reviews.read(), digest))) == 4 and reviews.read().count() == 2
    with pytest.raises(ValueError):
        reviews.append(mark(True, " "))
    assert ledger.input_digest(rows.repartition(3)) == digest


def test_components_are_quarantined_whole(spark):
    from larkgraph.operators import ledger

    policy = ledger.Policy((("R-1", "1", "skos:exactMatch"),))
    rows = rows_of(spark, {}, {"subject": "MONDO:2"}, {"subject": "ORPHA:7", "object": "OMIM:7"}, {"subject": "ORPHA:8", "object": "OMIM:8"}, {"predicate": "skos:broadMatch", "subject": "OMIM:7", "object": "ORPHA:7"}, {"subject": "ICTRP:1", "object": "NCT:1"}, {"subject": "ICTRP:2", "object": "NCT:1"})
    got = {r["line"]: r["reason"] for r in ledger.decide(rows, policy, spark.createDataFrame([], ledger.REVIEW), "d").collect()}
    assert got == {0: "component_prefix_collision:MONDO", 1: "component_prefix_collision:MONDO", 2: "component_collapses_typed_relation", 3: None, 4: None, 5: None, 6: None}


def test_identifiers(spark):
    from larkgraph.functions import identity as i

    cases = {"DOI:10.1000/x": True, "DOI:10.10/x": False, "DOI:10.1000/a b": False, "HGNC:12": True, "HGNC:": False, "HGNC:1a": False, "NCIT:C12": True, "NCIT:12": False, "ENSEMBL:ENSG00000000001": True, "ENSEMBL:ENSG1": False, "ORCID:0000-0002-1825-0097": True, "ORCID:0000-0002-1825-0098": False, "other:any": True, "nothing": False, ":x": False, None: False}
    rows = spark.createDataFrame([(k,) for k in cases], "id string").select("id", i.valid_curie(F.col("id")).alias("ok"), i.regime(F.col("id")).alias("regime")).collect()
    assert {r["id"]: r["ok"] for r in rows} == cases
    assert {r["id"]: r["regime"] for r in rows}["HGNC:12"] == "human-gene"


def facts(spark, *rows):
    return spark.createDataFrame([(f"{s}-{r}-{o}", s, r, o) for s, r, o in rows], "id string, subject string, relation string, object string")


def test_six_rules_with_witnesses(spark):
    from larkgraph.operators import rules as r

    rows = [("a", "has_phenotype", x) for x in "xyz"] + [("b", "has_phenotype", x) for x in "xyz"] + [("c", "has_phenotype", "x")]
    rows += [("a", "has_causal_gene", "g"), ("b", "has_causal_gene", "g"), ("c", "has_causal_gene", "h"), ("g", "in_pathway", "p"), ("h", "in_pathway", "p"), ("drug", "targets", "g"), ("group", "serves_gene", "g"), ("mouse", "models_gene", "g")]
    base = facts(spark, *rows)
    got = {(x["rule"], x["subject"], x["object"]): x for x in r.derive(base, r.connections(), spark.createDataFrame([("a",)], "node string")).collect()}
    assert set(got) == {("shared_phenotypes", "a", "b"), ("shared_gene", "a", "b"), ("shared_pathway", "a", "b"), ("shared_pathway", "a", "c"), ("drug_target", "a", "drug"), ("community_via_gene", "a", "group"), ("asset_via_gene", "a", "mouse")}
    asserted = {x["id"]: (x["subject"], x["relation"], x["object"]) for x in base.collect()}
    for (rule, s, o), x in got.items():  # every witness is made of asserted edges and leads from one end to the other
        path = [asserted[w] for w in x["witness"]]
        body = next(k for k in r.connections() if k.name == rule).body
        bound = {}
        for atom, edge in zip(body, path, strict=True):
            assert atom[1] == edge[1]
            for var, value in ((atom[0], edge[0]), (atom[2], edge[2])):
                assert bound.setdefault(var, value) == value
        assert bound["s"] == s and bound["o"] == o
    assert got[("shared_phenotypes", "a", "b")]["paths"] == 3
    assert got[("shared_phenotypes", "a", "b")]["witness"] == ["a-has_phenotype-x", "b-has_phenotype-x", "a-has_phenotype-y", "b-has_phenotype-y"]


def test_rules_that_feed_on_each_other(spark):
    from larkgraph.operators import rules as r

    base = facts(spark, ("1", "is_a", "2"), ("2", "is_a", "3"), ("3", "is_a", "4"), ("4", "is_a", "1"), ("1", "is_a", "3"))
    above = [r.Rule("direct", ("x", "within", "y"), (("x", "is_a", "y"),)), r.Rule("further", ("x", "within", "z"), (("x", "is_a", "y"), ("y", "within", "z")))]
    got = {(x["subject"], x["object"]): x["witness"] for x in r.derive(base, above).collect()}
    assert len(got) == 16 and got[("1", "4")] == ["1-is_a-3", "3-is_a-4"] and got[("2", "2")] == ["2-is_a-3", "3-is_a-4", "4-is_a-1", "1-is_a-2"]
    with pytest.raises(RuntimeError):
        r.derive(base, above, most_rounds=2)
    with pytest.raises(ValueError):
        r.Rule("loose", ("x", "r", "y"), (("x", "p", "z"), ("y", "p", "v")))


def test_rare_objects_only(spark):
    from larkgraph.operators import rules as r

    base = facts(spark, *((str(i), "has", "all") for i in range(20)), *((str(i), "has", "two") for i in range(2)), ("0", "other", "x"))
    got = r.distinctive(base, "has", "rare").collect()
    assert {(x["subject"], x["relation"], x["object"]) for x in got} == {("0", "rare", "two"), ("1", "rare", "two")}


def sequential(queues, budgets, given):
    """The same selection one path after the other."""
    taken, out = set(given), []
    for k in range(max(map(len, queues.values()))):
        for seed in sorted(queues):
            if k < len(queues[seed]):
                place, items = queues[seed][k]
                after = taken | set(items)
                if all(sum(kind == b for kind, _ in after) <= n for b, n in budgets.items()):
                    taken = after
                    out.append((seed, place, k + 1))
    return out


def paths(spark, queues):
    rows = [(s, p, [{"kind": a, "id": b} for a, b in items]) for s, q in queues.items() for p, items in q]
    return spark.createDataFrame(rows, "seed int, place int, items array<struct<kind:string,id:string>>")


def test_three_queues_of_unlike_length_share_the_budget(spark):
    from larkgraph.operators.budgets import round_robin

    queues = {}
    for s in range(3):
        queues[s] = []
        for person in range(90 if s == 0 else 6):
            paper = "paper:shared" if person == 0 else f"paper:{s}:{person}"
            queues[s].append((person, [("node", f"gene:{s}"), ("node", paper), ("node", f"person:{s}:{person}"), ("edge", f"{paper}>{s}"), ("edge", f"{s}:{person}>{paper}")]))
    given, budgets = [("node", f"gene:{s}") for s in range(3)], {"node": 100, "edge": 160}
    got = sorted(tuple(r) for r in round_robin(paths(spark, queues), budgets, given).collect())
    assert got == sorted(sequential(queues, budgets, given))
    assert all(sum(s == g[0] for g in got) >= 6 for s in range(3))


def test_paths_that_are_too_large_are_passed_over(spark):
    import random

    from larkgraph.operators.budgets import round_robin

    for seed in range(4):
        rng = random.Random(seed)
        queues = {s: [(p * 3, list({(rng.choice(("node", "edge")), str(rng.randrange(40))) for _ in range(rng.randrange(1, 9))})) for p in range(rng.randrange(1, 25))] for s in range(4)}
        budgets = {"node": 9, "edge": 12}
        got = sorted(tuple(r) for r in round_robin(paths(spark, queues), budgets).collect())
        assert got == sorted(sequential(queues, budgets, []))


def test_mentions_and_denials(spark):
    from larkgraph.operators import mentions as m

    texts = spark.createDataFrame([(1, "no seizure and ataxia".split()), (2, "focal seizure today".split()), (3, "nottestgenex".split()), (4, "he has testgene mutation".split()), (5, "without any real seizure".split()), (6, "seizure".split()), (7, []), (8, "no one of us has ataxia".split()), (9, None)], "id int, words array<string>")
    names = spark.createDataFrame([("seizure", 1), ("focal seizure", 2), ("ataxia", 3), ("testgene", 4), ("today", 8), ("today", 9), ("he", 5)], "phrase string, node int")
    found = m.mentions(texts, names.select("phrase"))
    got = {(r["id"], r["start"], r["n"], r["phrase"]) for r in found.collect()}
    # Words only, no mention is the whole text, and no single word of two letters.
    assert got == {(1, 1, 1, "seizure"), (1, 3, 1, "ataxia"), (2, 0, 2, "focal seizure"), (2, 1, 1, "seizure"), (2, 2, 1, "today"), (4, 2, 1, "testgene"), (5, 3, 1, "seizure"), (8, 5, 1, "ataxia")}
    assert {(r["id"], r["phrase"]) for r in m.longest(found).collect()} == {(1, "seizure"), (1, "ataxia"), (2, "focal seizure"), (2, "today"), (4, "testgene"), (5, "seizure"), (8, "ataxia")}
    above = spark.createDataFrame([(2, 1)], "node int, ancestor int")
    state = {(r["id"], r["node"], r["state"]) for r in m.profile(found, names, above).collect()}
    # A conjunction ends a denial, so does distance; a phrase of two names makes neither present; the specific one remains.
    assert state == {(1, 1, "excluded"), (1, 3, "present"), (2, 2, "present"), (4, 4, "present"), (5, 1, "excluded"), (8, 3, "present")}


def test_longer_spans_hold_shorter_ones_but_not_overlaps(spark):
    from larkgraph.operators import mentions as m

    spans = [(1, 0, 3, "x"), (1, 1, 2, "y"), (1, 2, 2, "z"), (1, 0, 3, "w"), (1, 0, 1, "v"), (2, 2, 1, "u"), (1, 9, 1, "t")]
    got = m.longest(spark.createDataFrame(spans, "id int, start int, n int, phrase string"))
    assert {r["phrase"] for r in got.collect()} == {"x", "w", "z", "u", "t"}


def test_digests_go_through_shuffles_as_bytes(spark):
    import hashlib

    from larkgraph.operators.stored import WIDTHS, fingerprint

    level = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)] + ["ab" * 32] * 2
    out = fingerprint(spark.createDataFrame([(h,) for h in level], "h string").repartition(3))
    for width in WIDTHS:
        groups = {}
        for h in level:
            groups.setdefault(h[:width], []).append(h)
        level = [k + hashlib.sha256("".join(sorted(v)).encode()).hexdigest() for k, v in groups.items()]
    assert [r[0] for r in out.collect()] == level
    assert "collect_list(unhex(h" in out._jdf.queryExecution().optimizedPlan().toString()
