"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a boolean expression over a document's text that rejects it when true. A bounded sample, chosen by
a hash of the id, gives each rule's cost (seconds to evaluate it on the sample, less those of reading it) and
which rows it rejects. The rule that rejects most per second comes first, then the one that rejects most per
second of what that one left, and so on. The rules are chained in one CASE, so that most rejected rows never
reach the costly rules. The order changes speed only: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, words

WINDOW = 8
#: Rows of the sample that orders the rules.
SAMPLE_ROWS = 300


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: a lambda over a one-element array is Spark's only let."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """How many of the words ``found`` lie in a run of ``window`` words that occurs twice or more, the first one included.

    Hashes of 1, 2, 4 and 8 words are built by doubling (``window`` is a power of two). Only texts in which
    two window hashes are equal go on to mark positions; equal hashes of 64 bits within one text count as
    equal windows.
    """

    def covered(sorted_starts: Column) -> Column:
        n = F.size(sorted_starts)
        steps = F.zip_with(F.slice(sorted_starts, 1, n - 1), F.slice(sorted_starts, 2, n - 1), lambda a, b: F.least(b - a, F.lit(window)))
        return F.when(n == 0, 0).otherwise(F.aggregate(steps, F.lit(window), lambda s, d: s + d)).cast("long")

    def mark(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])

        return once(F.sort_array(once(pairs, starts)), covered)

    def fold(h: Column, step: int) -> Column:
        if step == window:
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(mark(h))
        n = F.size(h) - step
        longer = F.when(n <= 0, F.array().cast("array<bigint>")).otherwise(F.zip_with(F.slice(h, 1, n), F.slice(h, step + 1, n), lambda a, b: F.xxhash64(a, b)))
        return once(longer, lambda x: fold(x, 2 * step))

    return once(F.transform(found, lambda w: F.xxhash64(w)), lambda h: fold(h, 1))


def word_lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^ \\t-\\r]"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return once(word_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measures(text: Column, found: Column) -> dict[str, Column]:
    """The figures that the rules use, of a text and its words; all are 0 for null or empty text."""
    blank = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size(found).cast("long"),
        "word_chars": F.length(F.concat_ws("", found)).cast("long"),
        "n_symbols": F.regexp_count(blank, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeated_words(found),
        "n_lines": F.size(word_lines(text)).cast("long"),
        "n_upper": F.regexp_count(blank, F.lit("\\p{Lu}")).cast("long"),
    }


#: Measures that every document is asked for; the others are built only where the cascade asks for them.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_measures(text: Column) -> Column:
    """The base figures as one struct, with the text split into words once."""
    return once(words(text), lambda w: F.struct(*(v.alias(k) for k, v in measures(text, w).items() if k in BASE)))


@dataclass(frozen=True)
class Rule:
    """Rejects when ``test`` of the measures it ``uses`` is true."""

    name: str
    uses: tuple[str, ...]
    test: object

    def expression(self, found: dict[str, Column]) -> Column:
        return F.coalesce(self.test(*(found[x] for x in self.uses)), F.lit(False))


#: The first two are the contract's base rules; the others reject symbol noise, shouting, and pages of repeated lines.
RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 20),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > 3 * n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 20 * n)),
    Rule("shouting", ("n_upper", "word_chars"), lambda u, c: 2 * u > c),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: (d >= 3) & (2 * d > n)),
)


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` texts, chosen by a hash of id and text over the whole table, as a written table of one file.

    Which rows they are depends on neither files nor partitions. The expected number is ``rows``.
    """
    share = min(1.0, rows / max(1, docs.count()))
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"), F.col("text")), F.lit(1 << 30))
    return Scratch(docs.sparkSession, "op10").write(docs.where(place < int(share * (1 << 30))).select("text").coalesce(1), "sample")


def order_rules(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, clock=time.perf_counter) -> list[Rule]:
    """Rules by rows rejected per second among those that the rules before them leave; ties keep the given order.

    ``docs`` has doc_id and text. Only counts of equal verdicts, at most one for each set of rules, reach the driver.
    """
    sample, text = sample_of(docs, sample_rows), F.col("text")

    def seconds(test: Column) -> float:
        times = []
        for _ in range(2):  # the first compiles
            began = clock()
            sample.agg(F.count_if(test)).first()
            times.append(clock() - began)
        return times[1]

    tests = [once(words(text), _verdict(rule, text)) for rule in rules]
    verdicts = sample.groupBy(*(t.alias(f"r{i}") for i, t in enumerate(tests))).count().collect()
    if not verdicts:
        return list(rules)
    idle = seconds(F.length(text) < 0)
    cost = [max(seconds(t) - idle, 1e-4) for t in tests]
    left, order = [(tuple(v)[:-1], v["count"]) for v in verdicts], []
    while len(order) < len(rules):
        rates = {i: sum(n for v, n in left if v[i]) / cost[i] for i in range(len(rules)) if i not in order}
        best = max(rates, key=lambda i: (rates[i], -cost[i] if not rates[i] else 0.0, -i))
        order.append(best)
        left = [(v, n) for v, n in left if not v[best]]
    return [rules[i] for i in order]


def _verdict(rule: Rule, text: Column):
    return lambda w: rule.expression(measures(text, w))


def first_failed(rules, found: dict[str, Column]) -> Column:
    """Name of the first rule of the chain that rejects, else null; CASE stops at the first true branch."""
    out = None
    for rule in rules:
        test = rule.expression(found)
        out = F.when(test, rule.name) if out is None else out.when(test, rule.name)
    return out


def apply_rules(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with the columns of ``docs``.

    Null and empty texts have no words and go. Repeated rows are judged alike. Other columns pass through,
    whatever their names; an empty table stays empty.
    """
    ordered = order_rules(docs, rules, sample_rows)
    text = F.col("text")
    return docs.where(once(words(text), lambda w: first_failed(ordered, measures(text, w))).isNull())


def judge(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, counted=None) -> DataFrame:
    """doc_id, the base measures, ``base_failed`` and ``kept`` for every row, in one pass.

    ``kept`` is the verdict of the cascade over rows that pass the base rules. Base measures are owed to every
    row and are read by the rules; all others are expressions over the text inside the chain, so they are built
    only for rows that reach their rule. ``counted`` may wrap a measure's expression (name, column), for tests.
    """
    ordered = order_rules(docs, rules, sample_rows)
    text = F.col("text")
    got = docs.select("doc_id", "text", base_measures(text).alias("found"))
    got = got.select("doc_id", "text", *(F.col(f"found.{k}").alias(k) for k in BASE))
    lazy = {k: v for k, v in measures(text, F.array().cast("array<string>")).items() if k not in BASE}
    have = {k: F.col(k) for k in BASE} | {k: counted(k, v) if counted else v for k, v in lazy.items()}
    by_name = {r.name: r for r in rules}
    failed = by_name["few_words"].expression(have) | by_name["repeated_words"].expression(have)
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise(first_failed(ordered, have).isNull())
    return got.withColumn("base_failed", failed).withColumn("kept", verdict).select("doc_id", *BASE, "base_failed", "kept")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    from .shared import documents

    return judge(documents(spark, sf_dir))


ORACLE = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
    x AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
    r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM x) WHERE n > 1),
    c AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM r) GROUP BY 1),
    m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '\\p{Lu}')) AS n_upper FROM d LEFT JOIN c ON c.doc_id = d.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 2 * n_upper > word_chars OR (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines)) AS kept FROM m
"""
