import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `text_1` string, label int"
WORDS = "the of and to alpha beta gamma delta word Word, über straße ñandú | # $$ 12 a1 x".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randrange(60))]) for _ in range(n))


def make_rows():
    """Copies, near copies, shared passages, nulls in every column, odd spaces, an empty and a long text, repeated rows."""
    rng = random.Random(5)
    base = [sentence(rng, n) for n in (3, 8, 19, 20, 25, 60, 120, 200, 300)]
    texts = list(base) + [base[5], base[6], base[6]]
    for t in (base[6], base[7], base[8]):
        for step in (90, 40, 12, 6):
            words = t.split(" ")
            texts.append(" ".join(w if i % step else "changed" for i, w in enumerate(words)))
    texts += [sentence(rng, 30) + " " + base[5] + "\n" + sentence(rng, 30), base[5] + "\t" + base[5] + "\x0b" + base[4]]
    texts += ["", None, " \n\t\x0c\r ", "one", "ä ö ü x", "rep eat " * 40, "line one\nline one\n\nline two\nline one", sentence(rng, 9000)]
    rows = [(i * 3 % 97 + 100 * (i // 97), t, ("en", "de", None)[i % 3], ("b", "a", None, "ä")[i % 4], None if t is None else len(t), "clash", i) for i, t in enumerate(texts)]
    rows += [rows[4], (None, base[7], "en", "a", 3, None, None), (None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
