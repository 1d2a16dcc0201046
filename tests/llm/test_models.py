"""Learned and random operators: laws, held out accuracy, brute force where there is any; the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from servelens.llm import chat, classlm, mixing, quality, toxicity

from .conftest import SCHEMA, made_rows, rows_of


def bucket(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


# ---- op 2


def test_base_scores(docs):
    rows = made_rows()
    seen = Counter()
    for r in rows:
        if bucket(r[0]) != 1:
            seen.update([*(r[1] or "").encode().lower().split(), b""])
    n, v = sum(seen.values()), len(seen)
    want = []
    for r in rows:
        w = [*(r[1] or "").encode().lower().split(), b""]
        want.append((r[0], bucket(r[0]) == 1, len(w), sum(seen[x] > 0 for x in w), n, round(sum(math.log10((seen[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)))
    got = classlm.scored(docs).withColumn("base_score", F.round("base_score", 6))
    assert rows_of(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score") == sorted(want, key=lambda t: [(x is not None, x) for x in t])


def test_classes_predict_better_than_words_alone(spark, monkeypatch):
    """Two kinds of words take turns: the classes see it, single words don't."""
    monkeypatch.setattr(classlm, "HEAD", 20)  # most words' counts come by the join
    rng = random.Random(2)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice((a, b)[j % 2]) for j in range(60))) for i in range(150)]
    got = [r for r in classlm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got) + 0.08 * sum(r.n_tokens for r in got)  # 0.3 at best; the endings tell little


def test_word_probabilities_add_up():
    """Next words' probabilities, one unknown word per ending included, don't exceed one."""
    head = {b"ab": 4, b"cd": 3, b"xb": 1, b"yb": 2, b"": 3}
    units = classlm.Units([b"ab", b"cd"], [b"xb"])
    counts = np.array([[0, 3, 1, 0, 0], [1, 0, 0, 1, 1], [0, 0, 0, 1, 1], [0, 0, 0, 0, 1], [3, 0, 1, 0, 0]])
    m = classlm.Model(units, counts, head, {2: (1, 1), 3: (2, 1)}, 13, 5)
    for prev in range(units.size):
        total = 0.0
        for word, c in {**head, b"?b": 0}.items():
            u = units.end if word == b"" else units.of([word])[0]
            p = m.step[m.label[prev], m.label[u]] + m.emit[u] - m.share[u]
            total += 10 ** (p + (math.log10(c + 0.5) if u in (2, 3) else 0))
        assert total <= 1 + 1e-9


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(0)
    counts = rng.poisson(0.4, (40, 40))
    counts[:20, 20:] += 5

    def likelihood(label):
        hot = np.eye(4)[label]
        t = hot.T @ counts @ hot
        g = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return g(t) - g(t.sum(0)) - g(t.sum(1))

    scores = [likelihood(classlm.exchange(counts, 4, sweeps)) for sweeps in (0, 1, 2, 8)]
    assert all(y >= x - 1e-6 for x, y in zip(scores, scores[1:], strict=False)) and scores[-1] > scores[0]


def test_scoring_nothing(none, spark):
    assert classlm.scored(none).collect() == []
    got = classlm.scored(spark.createDataFrame([(i, "a") for i in range(40) if bucket(i) == 1][:1], "doc_id long, text string")).collect()[0]
    assert (got.train_tokens, got.n_known, got.n_tokens) == (0, 0, 2) and got.base_score == 0


# ---- op 7


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_statistics(docs):
    want = sorted(((r[0], *brute_statistics(r[1])) for r in made_rows()), key=lambda t: [(x is not None, x) for x in t])
    assert rows_of(quality.statistics(docs, "doc_id"), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want


@pytest.fixture(scope="module")
def judged_corpus(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(60, 90))]
        kind = i % 8
        if kind == 0:
            w = [x + rng.choice(["###", "$$$"]) for x in w]
        elif kind == 1:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        if i < 250:
            labels.append((i, int(kind > 1), 0))
    labels += [(None, 0, 0), (3, None, 0), (9999, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_hold_out(judged_corpus):
    docs, labels = judged_corpus
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    assert all(r.kept == (i % 8 > 1) for i, r in got.items() if i >= 250)
    assert {r.rule for r in got.values()} - {0}
    assert quality.good_documents(docs, labels).count() == sum(r.kept for r in got.values())


def test_no_labels_no_rules(docs, none, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, empty).collect()
    assert len(got) == len(made_rows()) and all(r.kept != r.base_failed for r in got)
    assert quality.judged(none, empty).collect() == []
    assert quality.good_documents(docs, empty).columns == docs.columns


# ---- op 8


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        left = total - sum(full.values())
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return {**full, **share}
        full |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 2, "c": 300, None: 4}, {"a": 5}, {"a": 0, "b": 7}, {"d": 1, "e": 1, "f": 1, "g": 1000}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    want = brute_targets(sizes)
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice((1, 3, 10, 40, 150)), "en", rng.choice(("a", "b", "b", "b", None)), 0, 0, "", 0, 0, 0, 0) for i in range(600)] + [(700, None, "en", "a", 0, 0, "", 0, 0, 0, 0)] * 3
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_mix_meets_targets(sources):
    got = mixing.mix(sources).collect()
    assert len(got) == 603
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        ratio = r.target / r.source_size
        assert r.taken == r.size * r.copies and r.taken <= 3 * r.size
        assert r.size == 0 or r.copies in (math.floor(ratio), math.ceil(ratio))
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows) / 2
    again = mixing.mix(sources.repartition(2))
    assert rows_of(again) == sorted((tuple(r) for r in got), key=lambda t: [(x is not None, x) for x in t])


def test_rounding_is_fair(spark):
    """Over many seeds a document is taken as often as its fraction says."""
    rows = spark.createDataFrame([(i, "s", 0, 1 + i % 4) for i in range(12)], "doc_id long, source string, crc long, size long")
    targets = spark.createDataFrame([("s", 30, 12.0, 12)], "source string, source_size long, target double, n long")
    taken = Counter()
    for seed in range(40):
        taken.update({r.doc_id: r.copies for r in mixing.copies(rows, targets, seed, block=4).collect()})
    assert 0.3 < sum(taken.values()) / 480 < 0.5 and min(taken[i] for i in range(12)) >= 5


def test_mixed_documents(sources, none):
    want = Counter()
    for r in mixing.mix(sources).collect():
        want[r.doc_id] += r.copies
    out = mixing.mixed_documents(sources)
    assert out.columns == sources.columns
    assert Counter(r.doc_id for r in out.collect()) == +want
    assert mixing.mix(none).collect() == [] and mixing.mixed_documents(none).collect() == []


# ---- op 9


def test_index_equals_brute_force():
    rng = random.Random(3)

    def vector():
        v = {t: rng.random() for t in rng.sample(range(20), rng.randint(1, 6))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    points = [vector() for _ in range(300)]
    points += points[:20]  # ties
    index = toxicity.BlockMaxIndex(points, 20, block=16)
    for _ in range(40):
        q = vector()
        cosines = [round(sum(q[t] * p.get(t, 0) for t in q), 12) for p in points]
        want = sorted(((-c, i) for i, c in enumerate(cosines) if c > 0))[:7]
        got = index.nearest(q, 7)
        assert [(i, round(s, 9)) for s, i in got] == [(i, round(-c, 9)) for c, i in want]


def test_toxic_words_are_learned(spark):
    rng = random.Random(9)
    plain, bad = [f"p{i}" for i in range(200)], ["nasty", "vile", "foul", "grossly", "grossen", "grossar"]
    rows, labels = [(5000, None), (5001, ""), (None, "nasty text")], [(None, 0, 1), (7, 1, None), (9999, 1, 1)]
    for i in range(600):
        w = rng.choices(plain, k=40)
        if i % 6 == 0:
            w[rng.randrange(40)] = rng.choice(bad).upper() + ","
        rows.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, 1, int(i % 6 == 0)))
    got = {r.doc_id: r for r in toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [r for i, r in got.items() if i is not None and i < 600 and (r.held_out or i >= 400)]
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    assert got[5000].score == got[5001].score < 0.3 and got[None].predicted == 1 and got[0].evidence
    assert all(r.held_out == (bucket(i) == 0) for i, r in got.items())


def test_every_example_and_term_counts(spark, monkeypatch):
    """More examples and telling words than one index held; shards of a few points find what all points at once do."""
    rng = random.Random(4)
    bad = [f"b{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(300)]
    rows = [(i, " ".join([rng.choice(["x", "y", "z"]), *(rng.sample(bad, 1 + i % 3) if i % 7 == 0 else [])])) for i in range(30_000)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(30_000)], "doc_id long, quality int, toxic int")
    numbers = toxicity.learn(docs_, labels)
    assert set(numbers) == {w.encode() for w in bad}
    taught = [t for i, t in rows if bucket(i) != 0]
    assert len(taught) > 20_000
    whole = {r.doc_id: r for r in toxicity.scored(docs_, labels).collect()}
    monkeypatch.setattr(toxicity, "SHARD", 500)
    monkeypatch.setattr(toxicity, "ASKED", 400)
    cut = {r.doc_id: r for r in toxicity.scored(docs_, labels).collect()}
    assert whole == cut and len(cut) == len(rows)

    def vector(text):
        return Counter(numbers[w.encode()] for w in text.split() if w.encode() in numbers)

    df = Counter(t for _, text in rows for t in vector(text))
    idf = [math.log((len(rows) + 1) / df[t]) for t in range(len(numbers))]

    def weights(v):
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in v.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    points = defaultdict(lambda: [0, 0])
    for i, text in rows:
        if bucket(i) != 0:
            p = points[tuple(sorted(vector(text).items()))]
            p[0] += 1
            p[1] += i % 7 == 0
    n, y = (sum(p[k] for p in points.values()) for k in (0, 1))
    prior = (y + 0.5) / (n + 1)
    known = [(weights(dict(v)), *p) for v, p in points.items() if v]
    for i in range(0, 2_100, 21):
        q = weights(vector(rows[i][1]))
        near = sorted(((sum(x * w.get(t, 0.0) for t, x in q.items()), a, b) for w, a, b in known), key=lambda p: -p[0])[:15]
        lowest = near[-1][0]
        if sum(abs(sum(x * w.get(t, 0.0) for t, x in q.items()) - lowest) < 1e-9 for w, *_ in known) > 1:
            continue  # a tie for the last place
        near = [p for p in near if p[0] > 0]
        want = (sum(c * c * b for c, _, b in near) + 0.5 * prior) / (sum(c * c * a for c, a, _ in near) + 0.5)
        assert abs(cut[i].score - want) < 1e-9


def test_toxicity_without_examples(docs, none, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.scored(docs, empty).collect()} == {0.0}
    assert toxicity.scored(none, empty).collect() == []


# ---- op 10


def test_pairs(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "good one"), (0, 2, "user", "bye"),
        (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", None), (1, 3, "assistant", "worse"),
        (4, 0, "user", "alone"), (4, 1, "assistant", "x"), (6, 0, "user", "no answer"), (None, 0, "user", "?"), (8, 0, None, "a"), (8, 0, None, "a"), (8, 1, "assistant", "b"),
        (9, 0, "assistant", "b")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pair_id int")
    got = {r.pair_id: r for r in chat.preference_pairs(chat.pairs_from_replies(turns)).collect()}
    assert set(got) == {0, 1, 4, 8, 9}
    r = got[0]
    assert (r.n_prompt_turns, r.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert (r.chosen, r.rejected) == ("<|assistant|>\ngood one<|end|>\n", "<|assistant|>\nworse<|end|>\n")
    (m,) = r.chosen_mask
    assert r.chosen[m.start: m.start + m.length] == "good one<|end|>"
    assert got[1].n_prompt_turns == 3 and got[1].prompt.count("<|user|>") == 2 and got[1].rejected == "<|assistant|>\ngood one<|end|>\n"
    assert (got[4].n_prompt_turns, got[4].n_rejected_turns, got[4].rejected) == (1, 0, "")
    assert (got[8].n_prompt_turns, got[8].chosen, got[8].rejected) == (3, "", "")
    assert chat.preference_pairs(chat.pairs_from_replies(turns.where("false"))).collect() == []


# ---- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(12)
    lexicon = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    item = " ".join(rng.choices(lexicon, k=25))
    rows, labels = [], []
    for i in range(160):
        w = rng.choices(lexicon, k=rng.randint(60, 120))
        if i % 10 == 0:
            w = [x + "$$$" for x in w]
        if i % 10 == 1:
            w[20:45] = item.split()
        rows.append((i, " ".join(w), "en", "ab"[i % 2], 0))
        if i % 10 == 2:
            rows.append((1000 + i, rows[-1][1], "en", "a", 0))
        labels.append((i, int(i % 10 != 0), 0))
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
                               ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left, columns = {r[0] for r in rows}, docs.columns
    for (name, stage), gone in zip(corpus_pipeline.STAGES, ({i for i in range(0, 160, 10)}, {i + 1000 for i in range(2, 160, 10)}, {i for i in range(1, 160, 10)}, None, None), strict=True):
        docs = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            docs.write.parquet(str(tmp_path / name.replace(" ", "-")))
            docs = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
            assert docs.columns == columns
        if gone is not None:
            left -= gone
            assert {r.doc_id for r in docs.collect()} == left
    assert rows_of(corpus_pipeline.run(spark, str(tmp_path))) == rows_of(docs)
