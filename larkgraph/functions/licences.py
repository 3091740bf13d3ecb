"""What a licence of works or data allows, from its name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a licence asks for, and the class of those that ask for it, the one that restricts most first.
CLASSES = {"non-commercial": "non_commercial", "share-alike": "share_alike", "attribution": "open", "no-derivatives": "open", "public-domain": "open"}
UNKNOWN = "unknown"
#: Licences of works and data by their SPDX ids, without versions, their names there, and their terms.
LICENCES = (
    ("CC0", "Creative Commons Zero", ("public-domain",)),
    ("CC-PDDC", "Creative Commons Public Domain Dedication and Certification", ("public-domain",)),
    ("CC-BY", "Creative Commons Attribution", ("attribution",)),
    ("CC-BY-NC", "Creative Commons Attribution Non Commercial", ("attribution", "non-commercial")),
    ("CC-BY-NC-ND", "Creative Commons Attribution Non Commercial No Derivatives", ("attribution", "non-commercial", "no-derivatives")),
    ("CC-BY-NC-SA", "Creative Commons Attribution Non Commercial Share Alike", ("attribution", "non-commercial", "share-alike")),
    ("CC-BY-ND", "Creative Commons Attribution No Derivatives", ("attribution", "no-derivatives")),
    ("CC-BY-SA", "Creative Commons Attribution Share Alike", ("attribution", "share-alike")),
    ("PDDL", "Open Data Commons Public Domain Dedication and License", ("public-domain",)),
    ("ODC-By", "Open Data Commons Attribution License", ("attribution",)),
    ("ODbL", "Open Data Commons Open Database License", ("attribution", "share-alike")),
    ("CDLA-Permissive", "Community Data License Agreement Permissive", ("attribution",)),
    ("CDLA-Sharing", "Community Data License Agreement Sharing", ("attribution", "share-alike")),
)
#: A name that spells one of these out has the term, whichever licence it is.
SPELT = ("non-commercial", "share-alike", "public-domain")
#: Terms are written in one word, in two, or with a hyphen.
_JOINED = tuple((term.replace("-", ""), "(?:\\b)" + term.replace("-", "[- ]?") + "\\b") for term in CLASSES if "-" in term)


def _plain(text: str) -> str:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    out = f" {' '.join(words)} "
    for term in CLASSES:
        out = out.replace(f" {term.replace('-', ' ')} ", f" {term.replace('-', '')} ")
    return out


def phrases() -> dict[str, list[str]]:
    """For each class, the runs of words that a name of it holds: ids, their letters in one, names, and terms spelt out."""
    out: dict[str, list[str]] = {c: [] for c in dict.fromkeys(CLASSES.values())}
    for id_, name, terms in LICENCES:
        own = next(CLASSES[t] for t in CLASSES if t in terms)
        out[own] += [_plain(id_), f" {_plain(id_).replace(' ', '')} ", _plain(name)]
    for term in SPELT:
        out[CLASSES[term]].append(f" {term.replace('-', '')} ")
    return {c: list(dict.fromkeys(p)) for c, p in out.items()}


def licence_class(name: Column) -> Column:
    """The class of the licence that a text names, of several the one that restricts most; ``unknown`` without one."""
    words = F.lower(F.coalesce(name, F.lit("")))
    for plain, spelling in _JOINED:
        words = F.regexp_replace(words, spelling, plain)
    words = F.concat(F.lit(" "), F.regexp_replace(words, "[^\\p{L}\\p{N}]+", " "), F.lit(" "))
    out = None
    for label, own in phrases().items():
        # A run of words that holds another one says the same or less, so the shortest are enough.
        held = [p for p in own if not any(q != p and q in p for q in own)]
        hit = F.lit(False)
        for p in held:
            hit = hit | F.contains(words, F.lit(p))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(UNKNOWN)


def licence_class_sql(name: str) -> str:
    """The same class in DuckDB SQL, for oracles."""
    words = f"lower(coalesce({name}, ''))"
    for plain, spelling in _JOINED:
        words = f"regexp_replace({words}, '{spelling}', '{plain}', 'g')"
    words = f"' ' || regexp_replace({words}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    cases = " ".join(f"WHEN len(list_filter([{', '.join(repr(p) for p in own)}], lambda p: contains(n, p))) > 0 THEN '{label}'" for label, own in phrases().items())
    return f"(SELECT CASE {cases} ELSE '{UNKNOWN}' END FROM (SELECT {words} AS n))"
