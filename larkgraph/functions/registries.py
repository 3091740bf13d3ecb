"""Ids of trial registries in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Registries in the order in which they claim text, and the syntax of their ids; the group is the local id.
REGISTRIES = (
    ("NCT", r"\b(NCT\d{8})\b"),
    ("EUCT", r"\b(20\d{2}-5\d{5}-\d{2}-\d{2})\b"),
    ("EUDRACT", r"\b((?:19|20)\d{2}-\d{6}-\d{2})\b"),
    ("ISRCTN", r"\bISRCTN ?(\d{8})\b"),
    ("DRKS", r"\b(DRKS\d{8})\b"),
    ("CHICTR", r"\b(ChiCTR-?(?:[A-Z]{2,4}-)?\d{6,10})\b"),
    ("ANZCTR", r"\b(ACTRN\d{14})\b"),
    ("CTRI", r"\b(CTRI/\d{4}/\d{2,3}/\d{6})\b"),
    ("JRCT", r"\b(jRCT[a-z]?\d{9,10})\b"),
    ("JAPICCTI", r"\bJapicCTI-? ?(\d{6})\b"),
    ("UMIN", r"\bUMIN ?(\d{9})\b"),
    ("NTR", r"\b(NTR\d{3,5})\b"),
    ("OMON", r"\b(NL-OMON\d+)\b"),
    ("IRCT", r"\b(IRCT\d{8,14}N\d{1,3})\b"),
    ("KCT", r"\b(KCT\d{7})\b"),
    ("PACTR", r"\b(PACTR\d{15})\b"),
    ("TCTR", r"\b(TCTR\d{11})\b"),
    ("SLCTR", r"\b(SLCTR/\d{4}/\d{3})\b"),
    ("RBR", r"\b(RBR-[0-9a-z]{6,8})\b"),
    ("RPCEC", r"\b(RPCEC\d{8})\b"),
    ("LBCTR", r"\b(LBCTR\d{10})\b"),
)
SPANS = "array<struct<start:int,end:int,id:string>>"
#: Marks around a match while its place is worked out; the text's own ones become blanks.
OPEN, CLOSE = "\x01", "\x02"


def spans(text: Column, name: str, pattern: str) -> Column:
    """Array of (start, end, id) of a pattern's matches: the text is marked, cut at the marks, and the lengths are summed."""
    pieces = F.split(F.regexp_replace(text, F.lit("(?U)" + pattern), F.lit(f"{OPEN}$0{CLOSE}")), f"[{OPEN}{CLOSE}]")
    state = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(s: Column, p: Column) -> Column:
        # Pieces come in turn: text between, match, text between. A mark of state tells which.
        end = s["at"] + F.length(p["piece"])
        local = F.replace(F.regexp_extract(p["piece"], "(?U)" + pattern, 1), F.lit(" "), F.lit(""))
        found = F.struct(s["at"].alias("start"), end.alias("end"), F.concat(F.lit(f"{name}:"), local).alias("id"))
        return F.struct(end.alias("at"), F.when(p["i"] % 2 == 1, F.concat(s["out"], F.array(found))).otherwise(s["out"]).alias("out"))

    counted = F.transform(pieces, lambda p, i: F.struct(p.alias("piece"), i.alias("i")))
    return F.when(text.rlike("(?U)" + pattern), F.aggregate(counted, state, step, lambda s: s["out"])).otherwise(F.array().cast(SPANS))


def registry_ids(text: Column) -> Column:
    """All registry ids in a text, each once; of matches that overlap, the registry that comes first has it."""
    clean = F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, "  ")
    claimed = F.array().cast(SPANS)
    every = F.concat(*(spans(clean, name, pattern) for name, pattern in REGISTRIES))

    def step(kept: Column, x: Column) -> Column:
        taken = F.exists(kept, lambda k: (x["start"] < k["end"]) & (k["start"] < x["end"]))
        return F.when(taken, kept).otherwise(F.concat(kept, F.array(x)))

    # Most texts hold none and are told so by one pattern.
    some = clean.rlike("(?U)" + "|".join(pattern for _, pattern in REGISTRIES))
    return F.when(some, F.array_distinct(F.transform(F.aggregate(every, claimed, step), lambda x: x["id"]))).otherwise(F.array().cast("array<string>"))


def main_id(text: Column) -> Column:
    """The registration that a portal's own id stands for; null if none or several are named."""
    eu, ctis = F.substring(text, 6, 14), F.substring(text, 5, 1000)
    whole, part, rest = registry_ids(text), registry_ids(eu), registry_ids(ctis)
    return (
        F.when(text.startswith("EUCTR"), F.when((F.length(eu) == 14) & (F.size(part) == 1), F.concat(F.lit("EUDRACT:"), eu)))
        .when(text.startswith("CTIS"), F.get(F.filter(rest, lambda i: i.startswith("EUCT:")), 0))
        .otherwise(F.when(F.size(whole) == 1, F.get(whole, 0)))
    )
