"""Forward rules over asserted edges, with one witness path for every derived pair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import keep, written


@dataclass(frozen=True)
class Rule:
    """``head`` (subject, relation, object) follows from ``body``, atoms of the same shape over variables.

    Every atom but the first shares a variable with those before it. Variables of a pair in ``different`` differ;
    those in ``ordered`` ascend, where the order of the two plays no part.
    """

    name: str
    head: tuple[str, str, str]
    body: tuple[tuple[str, str, str], ...]
    different: tuple[tuple[str, str], ...] = ()
    ordered: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        seen = set(self.body[0][::2])
        for s, _, o in self.body[1:]:
            if not {s, o} & seen:
                raise ValueError(f"{self.name}: an atom shares no variable with those before it")
            seen |= {s, o}
        if not {self.head[0], self.head[2], *(v for pair in (*self.different, *self.ordered) for v in pair)} <= seen:
            raise ValueError(f"{self.name}: a variable is not bound by the body")


FACTS = ("subject", "relation", "object", "witness", "paths")


def _apply(rule: Rule, atoms: list[DataFrame], seeds: DataFrame | None) -> DataFrame:
    """Head pairs of a rule, with their least witness and how many there are. ``atoms``: facts for each atom of the body.

    Variables are dropped as soon as nothing asks for them any more, and what is left is summed, so rows grow with the pairs
    that are joined next and not with the paths behind them.
    """
    at: DataFrame | None = None
    pending = {(x, y): True for x, y in rule.different} | {(x, y): False for x, y in rule.ordered}
    for i, ((s, relation, o), facts) in enumerate(zip(rule.body, atoms)):
        hop = facts.where(F.col("relation") == relation)
        if s == o:
            hop = hop.where(F.col("subject") == F.col("object")).select(F.col("subject").alias(s), F.col("witness").alias("_w"), F.col("paths").alias("_n"))
        else:
            hop = hop.select(F.col("subject").alias(s), F.col("object").alias(o), F.col("witness").alias("_w"), F.col("paths").alias("_n"))
        if at is None:
            at = hop.withColumnsRenamed({"_w": "witness", "_n": "paths"})
            if seeds is not None:
                at = at.join(seeds.select(F.col("node").alias(rule.head[0])), rule.head[0], "left_semi")
        else:
            at = at.join(hop, sorted({s, o} & set(at.columns))).withColumns({"witness": F.concat("witness", "_w"), "paths": F.col("paths") * F.col("_n")}).drop("_w", "_n")
        for x, y in [pair for pair in pending if set(pair) <= set(at.columns)]:
            at = at.where(F.col(x) != F.col(y) if pending.pop((x, y)) else F.col(x) < F.col(y))
        later = {v for atom in rule.body[i + 1 :] for v in atom[::2]} | {rule.head[0], rule.head[2]}
        later |= {v for pair in pending for v in pair}
        at = at.groupBy(*[c for c in at.columns if c in later]).agg(F.min("witness").alias("witness"), F.sum("paths").alias("paths"))
        if seeds is not None:
            at = written(at)  # of a few subjects: its size is known then, and facts need not be shuffled for a small side
    return at.select(F.col(rule.head[0]).alias("subject"), F.lit(rule.head[1]).alias("relation"), F.col(rule.head[2]).alias("object"), "witness", "paths")


def derive(asserted: DataFrame, rules: list[Rule], seeds: DataFrame | None = None, most_rounds: int = 64) -> DataFrame:
    """(rule, subject, relation, object, witness, paths) of everything that follows from ``asserted`` (id, subject, relation, object).

    The witness is an array of ids of asserted edges in the order of the body, the least of those that the first round to
    derive the fact found, and ``paths`` is their number. Rules may use what others derive: each round joins
    only with facts that the round before was the first to derive, in each place of a body in turn, until nothing is new.
    With ``seeds`` (node) only facts about these subjects are derived by the first atom of a body. Raises if facts are still new
    after ``most_rounds`` rounds. A fact that is asserted is not derived.
    """
    base = asserted.select("subject", "relation", "object", F.array(F.col("id")).alias("witness"), F.lit(1).cast("long").alias("paths"))
    base = base.groupBy("subject", "relation", "object").agg(F.min("witness").alias("witness"), F.sum("paths").alias("paths"))
    heads = {r.head[1] for r in rules}
    if not any(relation in heads for r in rules for _, relation, _ in r.body):  # nothing feeds on what is derived
        base, out = written(base, "relation"), None  # each atom reads its own relation
        for r in rules:
            rows = _apply(r, [base] * len(r.body), seeds).select(F.lit(r.name).alias("rule"), *FACTS)
            out = rows if out is None else out.unionByName(rows)
        return out.join(base.where(F.col("relation").isin(*heads)), ["subject", "relation", "object"], "left_anti").select("rule", *FACTS)
    base = keep(base)
    old, delta, out = None, base, None
    for k in range(most_rounds):
        every = delta if old is None else old.unionByName(delta)
        found = None
        for r in rules:
            for place, (_, relation, _) in enumerate(r.body):
                if k and relation not in heads or not k and place:
                    continue  # asserted facts are new in the first round only, where all atoms take them
                atoms = [every] * len(r.body) if not k else [old if i < place else delta if i == place else every for i in range(len(r.body))]
                rows = _apply(r, atoms, seeds).withColumn("rule", F.lit(r.name))
                found = rows if found is None else found.unionByName(rows)
        found = found.groupBy("subject", "relation", "object").agg(F.min(F.struct("witness", "rule")).alias("best"), F.sum("paths").alias("paths"))
        found = found.join(every.select("subject", "relation", "object"), ["subject", "relation", "object"], "left_anti")
        new = keep(found.select("best.rule", "subject", "relation", "object", "best.witness", "paths"))
        if not new.limit(1).count():
            return out if out is not None else new
        out = new if out is None else keep(out.unionByName(new))
        old, delta = keep(every), new.select(*FACTS)
    raise RuntimeError(f"derive: still new facts after {most_rounds} rounds")


def connections(least_shared: str = "has_phenotype") -> list[Rule]:
    """Six ways in which two things of a knowledge graph may be connected; candidates to look at, no claims."""
    gene = ("s", "has_causal_gene", "g")
    return [
        Rule("shared_phenotypes", ("s", "shares_phenotypes_with", "o"), (("s", least_shared, "p"), ("o", least_shared, "p"), ("s", least_shared, "q"), ("o", least_shared, "q")), (("s", "o"),), (("p", "q"),)),
        Rule("shared_gene", ("s", "shares_gene_with", "o"), (gene, ("o", "has_causal_gene", "g")), (("s", "o"),)),
        Rule("shared_pathway", ("s", "shares_pathway_with", "o"), (gene, ("g", "in_pathway", "p"), ("h", "in_pathway", "p"), ("o", "has_causal_gene", "h")), (("s", "o"),)),
        Rule("drug_target", ("s", "has_gene_targeted_by", "o"), (gene, ("o", "targets", "g"))),
        Rule("community_via_gene", ("s", "has_gene_served_by", "o"), (gene, ("o", "serves_gene", "g"))),
        Rule("asset_via_gene", ("s", "has_gene_modelled_by", "o"), (gene, ("o", "models_gene", "g"))),
    ]


def distinctive(facts: DataFrame, relation: str, name: str, share: int = 10) -> DataFrame:
    """Facts of ``relation`` whose object at most one subject in ``share`` has, renamed to ``name``."""
    own = facts.where(F.col("relation") == relation)
    total = own.agg(F.countDistinct("subject").alias("total"))
    rare = own.groupBy("object").agg(F.countDistinct("subject").alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") * share <= F.col("total"))  # total: one row
    return own.join(rare.select("object"), "object", "left_semi").withColumn("relation", F.lit(name)).select(facts.columns)
