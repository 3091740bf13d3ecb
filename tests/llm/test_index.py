"""Search, suffix sorting and the manifest against brute force, with nulls, ties, repeated rows, long texts and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkgraph.llm.shared import Scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(rows, items, most=10):
    held = [(r[0], Counter(terms(r[1]))) for r in rows]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in set(items):
        scored = []
        for doc, c in held:
            m = 100 - 75 + (75 * c.total() * n_docs) // n_terms
            score = sum(q * weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in Counter(terms(text)).items() if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:most])]
    return Counter(out)


@pytest.fixture(scope="module")
def items(rows):
    base = [r[1] for r in rows if r[1]]
    return [(1, base[5]), (2, "the OF and\x00to über " * 3), (3, None), (4, ""), (5, "nothingknown"), (6, base[8] + " alpha"), (6, "alpha beta"), (1, base[5]), (None, "gamma delta"), (7, "rep")]


@pytest.mark.parametrize("shard, per_pass", [(8 << 20, 1 << 20), (500, 40)])
def test_search(spark, docs, rows, items, shard, per_pass):
    from larkgraph.llm import op11_search as q

    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, rank string, doc_id int")
    got = q.rank(docs, table, Scratch(spark, "t11"), shard_bytes=shard, pass_terms=per_pass).collect()
    assert Counter(tuple(r) for r in got) == brute_search(rows, items)


def test_search_takes_ties_by_id_over_shards(spark):
    from larkgraph.llm import op11_search as q

    docs = spark.createDataFrame([(99 - i, "same words here" if i % 3 else "other text of its own") for i in range(100)] + [(None, "same words here")], "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    got = sorted(tuple(r) for r in q.rank(docs, items, Scratch(spark, "t11t"), shard_bytes=40).collect())
    want = sorted(99 - i for i in range(100) if i % 3)[:10]
    assert [g[2] for g in got] == want and [g[1] for g in got] == list(range(1, 11))


def test_best_keeps_ties_by_id():
    from larkgraph.llm.op11_search import best

    rng = np.random.default_rng(3)
    for n in (0, 1, 9, 10, 11, 400):
        score, ids, real = rng.integers(0, 4, n), rng.permutation(n), rng.random(n) > 0.1
        want = sorted((i for i in range(n) if score[i] > 0), key=lambda i: (-score[i], not real[i], ids[i]))[:10]
        assert best(score, ids, real, 10).tolist() == want


def test_postings_hold_every_term_of_every_document(rows):
    import pyarrow as pa

    from larkgraph.llm import op11_search as q
    from larkgraph.llm.textblocks import ALNUM, blocks

    (block,) = blocks(pa.array([r[1] for r in rows], pa.string()), ALNUM, lower=True)
    corpus = q.Corpus(sum(1 for r in rows if terms(r[1])), sum(len(terms(r[1])) for r in rows))
    key, starts, places, impacts = q.postings(block.hashes, block.bounds, corpus)
    assert (np.diff(key.astype(object)) > 0).all() and len(places) == sum(len(set(terms(r[1]))) for r in rows) == starts[-1]
    assert all((np.diff(places[a:b]) > 0).all() for a, b in zip(starts, starts[1:])) and (impacts > 0).all()


def test_search_without_terms(spark, docs, empty, items):
    from larkgraph.llm import op11_search as q

    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    blank = spark.createDataFrame([(1, None), (2, " - ")], "doc_id long, text string")
    for d, i in ((empty, some), (docs, none), (blank, some)):
        assert q.rank(d, i, Scratch(spark, "t11e")).count() == 0


def brute_removed(rows, size=50):
    first = {}
    for r in rows:
        data, doc = (r[1] or "").encode(), (1 << 63) - 1 if r[0] is None else r[0]
        for i in range(len(data) - size + 1):
            key = data[i : i + size]
            first[key] = min(first.get(key, doc), doc)
    out = []
    for r in rows:
        data, doc = (r[1] or "").encode(), (1 << 63) - 1 if r[0] is None else r[0]
        gone = bytearray(len(data))
        for i in range(len(data) - size + 1):
            if first[data[i : i + size]] < doc:
                gone[i : i + size] = b"\x01" * size
        spans = [(m.start(), m.end()) for m in re.finditer(b"\x01+", bytes(gone))]
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((r[0], len(data), sum(gone), tuple(spans), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def removed(frame):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], tuple((s["start"], s["end"]) for s in r["spans"]), r["kept_sha256"]) for r in frame.collect())


@pytest.mark.parametrize("options", [{}, {"piece": 137}, {"frequent": 2}, {"frequent": 5, "piece": 1000, "bucket_bytes": 2000}])
def test_suffixes(spark, docs, rows, options):
    from larkgraph.llm import op12_suffixes as q

    assert removed(q.repeats(docs, Scratch(spark, "t12"), **options)) == brute_removed(rows)


def test_suffixes_of_hard_texts(spark, monkeypatch):
    """Runs of one byte, periods, strings that end with a text, shared edges, equal ids with different texts."""
    from larkgraph.llm import op12_suffixes as q

    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    core = noise(400)
    texts = ["x" * 49, "x" * 50, "x" * 51, "x" * 300, "ab" * 100, "b" + "ab" * 60, core, core[:200] + noise(60) + core[200:], noise(30) + core[100:149], noise(30) + core[100:150], core[100:151] + noise(9)]
    texts += [core[i : i + 120] + noise(80) + core[i + 130 : i + 300] for i in range(0, 200, 23)]
    texts += ["".join(rng.choice("ab") for _ in range(60)) for _ in range(40)] + ["\x00" * 70, "é" * 60, "xé" * 40, core[::-1], core]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts)) + [(ids[7], core[50:260]), (ids[6], core), (None, core[3:90]), (None, core[3:91])]
    monkeypatch.setattr(q, "BLOCK_BYTES", 900)  # many blocks
    monkeypatch.setattr(q, "SORTED", 40)  # and few suffixes at a time
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_removed(rows)
    for options in ({}, {"frequent": 3, "bucket_bytes": 1000}, {"piece": 64}):
        assert removed(q.repeats(docs, Scratch(spark, "t12h"), **options)) == want


def test_sorted_suffixes_are_the_equal_ones():
    from larkgraph.llm.op12_suffixes import sort_suffixes

    rng = np.random.default_rng(2)
    sizes = rng.integers(50, 80, 60)
    data = rng.integers(97, 99, sizes.sum()).astype(np.uint8)
    begin = np.append(0, np.cumsum(sizes))[:-1]
    for i in range(0, 60, 4):  # one shares its beginning with the next, at the same distance from the anchor
        n = min(sizes[i], sizes[i + 1])
        data[begin[i + 1] : begin[i + 1] + n] = data[begin[i] : begin[i] + n]
    group, before, first = np.arange(60) // 4, np.full(60, 30), rng.integers(0, 5, 60)
    got = sort_suffixes(data, begin, sizes, before, group, first)
    least = defaultdict(lambda: 9)
    seen = [(s, k, (group[s], k, data[begin[s] + k : begin[s] + k + 50].tobytes())) for s in range(60) for k in range(sizes[s] - 49)]
    for s, _, key in seen:
        least[key] = min(least[key], first[s])
    want = np.zeros(60, np.uint32)
    for s, k, key in seen:
        want[s] |= np.uint32((first[s] > least[key]) << k)
    assert (got == want).all() and got.any()


def test_suffixes_of_nothing(spark, empty):
    from larkgraph.llm import op12_suffixes as q

    assert q.repeats(empty, Scratch(spark, "t12e")).count() == 0
    short = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 49), (4, "a" * 49)], "doc_id long, text string")
    assert [r["n_removed"] for r in q.repeats(short, Scratch(spark, "t12s")).collect()] == [0] * 4


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, cut=False):
    doc, text, lang, source, n = row[:5]
    if cut and text is not None:
        text = text.replace("\n", "")
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def tree(nodes):
    """The root, and each node's siblings level by level as (left, right)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(paths):
            start = at[i] // 3 * 3
            p.append((level[start : at[i]], level[at[i] + 1 : start + 3]))
            at[i] //= 3
        level = [h(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], paths


def brute_manifest(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in names:
        own[s] = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
    inner = {s: tree([brute_leaf(r) for r in own[s]]) for s in names}
    root, above = tree([inner[s][0] for s in names])
    out = []
    for s, up in zip(names, above):
        for r, path in zip(own[s], inner[s][1]):
            whole = path + up
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = brute_leaf(r, even)
            for left, right in whole:
                folded = h(*left, folded, *right)
            out.append((r[0], brute_leaf(r), inner[s][0], root, h(*(x for left, right in whole for x in left + right)), folded, folded == root))
    return Counter(out)


def query_manifest(spark, docs, tmp_path):
    from larkgraph.llm import op13_merkle as q

    docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return Counter(tuple(r) for r in q.op13_merkle(spark, str(tmp_path)).collect())


def test_manifest(spark, docs, rows, tmp_path):
    got = query_manifest(spark, docs, tmp_path)
    assert got == brute_manifest(rows)
    assert {v[6] for v in got} == {True, False}


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (3,), (4, 1), (9, 10, 28, 1, 2), (82,)])
def test_manifest_of_every_shape(spark, tmp_path, sizes):
    rows = [(1000 * s + 7 * i, f"text {i}\n", "en", f"s{s}" if s else None, i) for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert query_manifest(spark, docs, tmp_path) == brute_manifest(rows)


def test_manifest_of_many_sources_and_of_none(spark, empty, tmp_path):
    from larkgraph.llm import op13_merkle as q

    rows = [(i, None, None, f"ä{i % 31}", None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert query_manifest(spark, docs, tmp_path) == brute_manifest(rows)
    assert q.manifest(empty, Scratch(spark, "t13")).count() == 0


def test_a_proof_is_of_its_own_row_only(spark):
    from larkgraph.llm import op13_merkle as q

    docs = spark.createDataFrame([(i, f"t{i}", "en", "a", i) for i in range(11)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = q.manifest(docs, Scratch(spark, "t13p"), other=F.lit("0" * 64)).withColumn("good", q.fold(F.col("leaf"), F.col("steps"))).withColumn("bad", q.fold(F.col("other"), F.col("steps"))).collect()
    assert all(r["good"] == r["root"] != r["bad"] for r in rows)
