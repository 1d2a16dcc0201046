import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, th string, bucket int, n int, lo int, fold int"


def _words(rng, n, lexicon):
    return [rng.choice(lexicon) for _ in range(n)]


def made_texts(seed=3):
    """Texts with copies, near copies, shared passages, repeated lines, odd characters and extremes."""
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice("abcdeéñxyz") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    passage = " ".join(_words(rng, 70, lexicon))
    out = []
    for _ in range(14):
        w = _words(rng, rng.randint(60, 160), lexicon)
        out.append("\n".join(" ".join(w[i:i + 20]) for i in range(0, len(w), 20)))
    base = out[0].split(" ")
    for k in range(8):
        near = list(base)
        for _ in range(1 + k):
            near[rng.randrange(len(near))] = rng.choice(lexicon)
        out.append(" ".join(near))
    out += [out[1], out[1], out[2].upper()]
    for _ in range(3):
        out.append(" ".join(_words(rng, 30, lexicon)) + "\n" + passage + "\n" + " ".join(_words(rng, 20, lexicon)))
    out += ["", None, " \n\t ", "one", "one two", "one two", "a b c", "same line here\nother\nsame line here\nSAME line here!",
            "x" * 900, "ab " * 1200, " ".join(_words(rng, 6000, lexicon)), "##| $ *** " * 30 + " ".join(_words(rng, 30, lexicon))]
    return out


def made_rows(seed=3):
    rows = [(i, t, "en", ["a", "b", None, "c"][i % 4] if i % 3 else "a", len(t or ""), i, "t", 1, 2, 3, 4) for i, t in enumerate(made_texts(seed))]
    rows.append(rows[3])  # a row twice
    rows.append((None, "no id at all " * 20, None, None, None, None, None, None, None, None, None))
    rows.append((5, "another text under a known id " * 10, None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(made_rows(), SCHEMA).repartition(3, F.xxhash64("text")).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *names):
    """Rows as a sorted list, nulls first."""
    names = names or df.columns
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=lambda t: [(x is not None, x) for x in t])
