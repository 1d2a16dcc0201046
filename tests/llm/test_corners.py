"""Corpora at the edges: one source, whole ratios, nothing but empty texts; the pipeline on odd rows."""

import random
from collections import defaultdict

import pytest

from servelens.llm import mixing

from .conftest import SCHEMA, made_rows

KIND = "doc_id long, source string, text string"


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def mixed(spark, rows):
    return mixing.mix(spark.createDataFrame(rows, KIND)).collect()


@pytest.mark.parametrize(("rows", "copies"), [
    ([(i, "a", words(i + 1)) for i in range(6)], 1),  # one source: its share is all there is
    ([(1, "a", words(7))], 1),
    ([(1, None, None)], 1),
    ([(i, "a", "") for i in range(3)], 1),
    ([(1, "a", words(10)), (2, "b", words(20)), (3, "c", words(30))], 1)])
def test_whole_ratios(spark, rows, copies):
    got = mixed(spark, rows)
    assert len(got) == len(rows) and {r.copies for r in got} == {copies}


def test_ratios_of_two_and_three(spark):
    # Weights 1, 2, 3 over sizes 40, 20, 20: the third is full at 60, of the rest the second at 40 / 3 * 2 < 60.
    got = {r.source: r for r in mixed(spark, [(1, "a", words(40)), (2, "b", words(20)), (3, "c", words(20))])}
    total = {s: r.target for s, r in got.items()}
    assert sum(total.values()) == pytest.approx(80) and all(r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1) for r in got.values())
    twice = mixed(spark, [(i, s, words(10)) for i, s in enumerate("aaaaabc")])  # targets 70/6, 140/6 and 30 of sizes 50, 10 and 10
    assert {r.source: r.copies for r in twice if r.source == "c"} == {"c": 3}


def test_two_fractions_that_end_together(spark):
    # Equal sizes and fractions of a half: one move makes both integral.
    rows = [(i, "a", words(8)) for i in range(4)] + [(10 + i, "b", words(8)) for i in range(2)]
    got = defaultdict(int)
    for r in mixed(spark, rows):
        got[r.source] += r.taken
    assert got == {"a": 16, "b": 32}


def test_targets_are_met_with_long_documents(spark):
    rng = random.Random(3)
    rows, i = [], 0
    for source in "abcdefg":
        for _ in range(60):
            rows.append((i, source, words(max(1, int(rng.lognormvariate(4, 1.3))))))
            i += 1
        rows.append((i, source, words(4000)))
        i += 1
    got = mixed(spark, rows)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        ratio = r.target / r.source_size
        assert r.copies in (int(ratio), int(ratio) + 1) and r.taken == r.size * r.copies <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 0.005 * target[s] for s in target)


@pytest.fixture
def corpus(spark, tmp_path):
    def write(rows, labels=(), items=()):
        for name, data, schema in (("documents", rows, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int, text string, lang string"),
                                   ("benchmark", items, "item_id long, text string, doc_id long, source string")):
            spark.createDataFrame(list(data), schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)
    return write


def test_pipeline_on_odd_rows(spark, corpus):
    """Nulls, empty texts, repeated rows, ids that repeat and columns that clash with those of the other tables."""
    import corpus_pipeline
    rows = made_rows()
    folder = corpus(rows, [(r[0], i % 2, 0, "x", "y") for i, r in enumerate(rows[:30])], [(1, None, 1, "s"), (2, "", None, None), (None, words(30), 3, "a")])
    out = corpus_pipeline.run(spark, folder)
    got = out.collect()
    assert got and {"shard", "slot"} <= set(out.columns) and all(0 <= r.shard < 16 for r in got)
    assert {r.doc_id for r in got} <= {r[0] for r in rows}


def test_pipeline_on_one_source(spark, corpus):
    import corpus_pipeline
    rng = random.Random(8)
    rows = [(i, " ".join(f"{rng.choice('abcdef')}{rng.randint(0, 500)}" for _ in range(80)), "en", "only", 0, 0, "t", 0, 0, 0, 0) for i in range(20)]
    assert {r.doc_id for r in corpus_pipeline.run(spark, corpus(rows)).collect()} == set(range(20))


def test_pipeline_on_nothing(spark, corpus):
    import corpus_pipeline
    assert corpus_pipeline.run(spark, corpus([])).collect() == []


def test_stages_state_their_cases():
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    for _, stage in corpus_pipeline.STAGES:
        assert "null" in stage.__doc__ and "empty" in stage.__doc__, stage.__name__
