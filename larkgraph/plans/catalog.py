"""All registered queries; importing this module registers them."""

from . import alignment, curation, evidence, graph, identity, lookups, ontology, phrases, ranking, readers, release, rules, search, similarity, streams, texts, validation  # noqa: F401
from .registry import FLAGSHIP, ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
