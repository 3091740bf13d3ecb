"""Identifiers: their syntax, the kind of thing they name, and whether a link may mean identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import mod_11_2

#: The kind of thing that ids of a prefix name.
REGIMES = {
    "disease-concept": ("MONDO", "ORPHA", "OMIM", "DOID", "NCIT", "GARD", "UMLS", "MEDGEN", "MESH", "ICD10CM", "ICD10WHO", "icd11.foundation", "icd11.code"),
    "phenotypic-series": ("OMIMPS",),
    "human-gene": ("HGNC", "NCBIGene", "ENSEMBL"),
    "protein": ("UniProtKB",),
    "trial-registration": ("NCT", "EUDRACT", "EUCT", "ISRCTN", "ICTRP", "JRCT", "JAPICCTI", "CTRI", "DRKS", "UMIN", "ANZCTR", "CHICTR", "IRCT", "NTR", "KCT", "PACTR", "TCTR", "RBR", "OMON"),
    "organisation": ("ROR", "atlasorg", "cordis.org", "gtr.org", "epicare-centre", "nih.ic", "crossref.funder", "ctgov.org", "reporter.org"),
    "work": ("PMID", "PMC", "PMCID", "DOI", "PPR", "AGR", "CBA", "ETH", "CTX", "HIR"),
    "person": ("ORCID", "OPENALEX.AUTHOR", "REPORTER.PI", "pubmed.author", "epmc.author", "openalex", "reporter-pi", "cordis-person", "author-mention"),
    "substance": ("CHEMBL.COMPOUND", "DRUGBANK", "UNII"),
    "rxnorm-concept": ("RXCUI", "RXNORM"),
    "cell-line": ("CVCL", "hpscreg", "RRID"),
}
#: The published terms for how a link was found.
JUSTIFICATIONS = ("BackgroundKnowledgeBasedMatching", "UnspecifiedMatching", "CompositeMatching", "LexicalMatching", "ManualMappingCuration", "MappingChaining", "LogicalReasoning", "AgentBasedMatching", "LLMBasedMatching", "LexicalSimilarityThresholdMatching")
#: Those of them that a source's own statement of identity has.
STATED = ("BackgroundKnowledgeBasedMatching", "ManualMappingCuration")
#: Prefixes whose local ids are digits; rules that match organisations without a source's word; the rule that equates ingredients.
NUMERIC = ("HGNC", "NCBIGene", "PMID", "MONDO", "ORPHA", "OMIM", "OMIMPS", "GARD", "DOID", "RXNORM", "RXCUI")
ORGANISATION_RULES = ("R-ORG-01", "R-ORG-03", "R-ORG-05", "R-ORG-06", "R-ORG-07")
INGREDIENT_RULE = "R-DRG-02"


def prefix(id_: Column) -> Column:
    return F.substring_index(id_, ":", 1)


def local(id_: Column) -> Column:
    return F.when(F.contains(id_, F.lit(":")), F.regexp_replace(id_, "^[^:]*:", ""))


def valid_orcid(value: Column) -> Column:
    """Four groups of four, the last character a check over the others."""
    shape = value.rlike("^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$")
    bare = F.regexp_replace(value, "-", "")
    return F.coalesce(F.when(shape, mod_11_2(F.substring(bare, 1, 15)) == F.substring(bare, 16, 1)), F.lit(False))


def valid_doi(value: Column) -> Column:
    """A registrant of four digits or more and a suffix without blanks; syntax only."""
    return F.coalesce(value.rlike("^10\\.[0-9]{4,}/[^\\s\\p{Z}\\p{Cc}]+$"), F.lit(False))


def valid_curie(id_: Column) -> Column:
    """A prefix and a local id without blanks, as the prefix demands; of other prefixes the grammar isn't judged."""
    p, rest = prefix(id_), local(id_)
    own = (
        F.when(p == "DOI", valid_doi(rest))
        .when(p.isin(*NUMERIC), rest.rlike("^[0-9]+$"))
        .when(p == "NCIT", rest.rlike("^C[0-9]+$"))
        .when(p == "ENSEMBL", rest.rlike("^ENSG[0-9]{11}$"))
        .when(p == "ORCID", valid_orcid(rest))
        .otherwise(True)
    )
    return F.coalesce((p != "") & (rest != "") & ~id_.rlike("[\\s\\p{Z}\\p{Cc}]") & own, F.lit(False))


def regime(id_: Column) -> Column:
    """What kind of thing an id names; null for prefixes that aren't known."""
    table = F.create_map(*(F.lit(x) for kind, names in REGIMES.items() for name in names for x in (name, kind)))
    return F.try_element_at(table, prefix(id_))


def ineligible(subject: Column, object_: Column, justification: Column, conflict: Column, rule: Column) -> Column:
    """The first reason why a link can't be taken for identity; null where none holds."""
    a, b = regime(subject), regime(object_)
    method = F.when(justification.startswith("semapv:"), F.substring(justification, 8, 1000))
    ingredient = (rule == INGREDIENT_RULE) & F.coalesce(F.array_contains(F.array(a, b), "rxnorm-concept") & F.array_contains(F.array(a, b), "substance"), F.lit(False))
    return F.coalesce(
        F.when(F.trim(conflict) != "", "source_conflict"),
        F.when(~F.coalesce(method.isin(*JUSTIFICATIONS), F.lit(False)), "unknown_justification"),
        F.when(~valid_curie(subject) | ~valid_curie(object_), "invalid_identifier"),
        F.when(a.isNull() | b.isNull(), "unknown_entity_regime"),
        F.when((a != b) & ~F.coalesce(ingredient, F.lit(False)), "incompatible_entity_regime"),
        F.when((a == "person") & (prefix(subject) != "ORCID") & (prefix(object_) != "ORCID"), "person_without_orcid"),
        F.when(rule.isin(*ORGANISATION_RULES), "organisation_without_source_equivalence"),
        F.when(~method.isin(*STATED), "candidate_method"),
    )
