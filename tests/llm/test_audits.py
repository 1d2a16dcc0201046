"""Fingerprints, source divergence and collocations against brute force on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from servelens.llm import collocations, divergence, merkle
from servelens.llm.queries import ORACLES

from .conftest import SCHEMA, made_rows, rows_of


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spread_rows():
    """The odd rows over three languages and their nulls, with phrases that come back."""
    rng = random.Random(9)
    rows = [(i, r[1], ["en", "de", None, "und", ""][i % 5], r[3], *r[4:]) for i, r in enumerate(made_rows())]
    words = ["the", "of", "New", "york", "city", "hall", "é", "x-y"]
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(40)) + ["; ", "\n", "\t", " "][i % 4] + "new York City Hall, new york. NEW"
        rows.append((1000 + i, text, ["en", None][i % 2], ["a", "b", None, ""][i % 4], 1, 1, "t", 1, 1, 1, 1))
    return rows


@pytest.fixture(scope="module")
def spread(spark):
    return spark.createDataFrame(spread_rows(), SCHEMA).repartition(3, F.xxhash64("text")).cache()


# ---- op 12


def brute_audit(rows, least, top):
    docs = [(r[2] or "", r[3] or "", re.findall("[a-z\u0080-\U0010ffff]+", lower(r[1]))) for r in rows]
    df, groups, count = defaultdict(Counter), set(), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        groups.add((lang, source))
        count[lang, source].update(terms)
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in df.items()}

    def shares(lang, counter):
        terms, total = kept[lang], sum(counter[t] for t in kept[lang])
        return {t: 1 + 10**9 * (counter[t] + 5) // (total + 5 * len(terms)) for t in terms}

    p = {g: shares(g[0], count[g]) for g in groups}
    q = {lang: shares(lang, sum((count[g] for g in groups if g[0] == lang), Counter())) for lang in kept}
    out = []
    for lang, source in groups:
        mine = p[lang, source]
        pairs = [(sum(abs(mine[t] - p[o][t]) for t in mine), o[1]) for o in groups if o[0] == lang and o[1] != source]
        terms = [(mine[t] - q[lang][t], t) for t in mine if count[lang, source][t] and mine[t] > q[lang][t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "partial"), [(30, 50, 1 << 19), (2, 5, 1), (1, 50, 40)])
def test_audit(spread, monkeypatch, least, top, partial):
    monkeypatch.setattr(divergence, "PARTIAL", partial)
    got = divergence.audit(spread, least, top)
    assert [f.name for f in got.schema] == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(got) == brute_audit(spread_rows(), least, top)


def test_shards_add_up(spread):
    kept, groups = divergence.term_counts(spread, 2)
    assert rows_of(divergence.source_distances(kept, groups, 7)) == rows_of(divergence.source_distances(kept, groups))


def test_partial_tables_are_flushed(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(divergence, "PARTIAL", 10)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 40, "source": ["s"] * 40, "text": [f"a{'b' * i} shared" for i in range(40)]})
    parts = list(divergence._partials(batch.slice(i, 1) for i in range(40)))
    assert len(parts) > 1
    assert sum(n for b in parts for t, n in zip(b.column("term").to_pylist(), b.column("n").to_pylist(), strict=True) if t == "shared") == 40


def test_shares_beyond_64_bits(spark):
    n = 10**17
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(3 * n), F.lit(7)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (3 * n + 35)


def test_audit_of_nothing(none):
    assert divergence.audit(none).collect() == []


# ---- op 13


def brute_phrases(rows, least, cover, top):
    f, totals = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(r[1])):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang] += len(words)
            for m in range(1, 5):
                f[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in good.items():
            holders = [b for q, b in good.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= cover * a for b in holders):
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "held"), [(30, 2000, collocations.HELD), (2, 40, 50), (3, 2000, 1)])
def test_collocations(spread, monkeypatch, least, top, held):
    monkeypatch.setattr(collocations, "BURST", 8)
    got = collocations.collocations(spread, least, top, held=held)
    assert dict(got.dtypes) == dict.fromkeys(["rank", "a", "l", "r", "n", "score"], "bigint") | {"lang": "string", "phrase": "string"}
    assert rows_of(got) == brute_phrases(spread_rows(), least, 80, top)


def test_a_full_bit_map_changes_nothing(spread, monkeypatch):
    monkeypatch.setattr(collocations, "bit_map", lambda keys: np.full(1 << (collocations.BITS - 6), (1 << 64) - 1, np.uint64))
    assert rows_of(collocations.collocations(spread, 3)) == brute_phrases(spread_rows(), 3, 80, 2000)


def test_another_seed_where_words_share_a_number(spread, monkeypatch):
    real = collocations._numbers

    def clashing(batch, data, starts, ends, text, seed, other=False):
        ids = real(batch, data, starts, ends, text, seed, other)
        return ids if other or seed else ids % np.uint64(3) + np.uint64(1)

    monkeypatch.setattr(collocations, "_numbers", clashing)
    assert rows_of(collocations.collocations(spread, 3)) == brute_phrases(spread_rows(), 3, 80, 2000)


def test_trie_bursts_spills_and_keeps_counts():
    rng = np.random.default_rng(1)
    trie, got, want = collocations.HatTrie(3, held=500, burst=20), Counter(), Counter()
    runs = []
    for _ in range(30):
        ids = rng.zipf(1.5, (200, 3)).astype(np.uint64)
        want.update(map(tuple, ids.tolist()))
        runs += list(trie.add(ids))
        assert trie.count <= 500
    assert runs and trie.inner
    runs += list(trie.rest())
    for keys, ids, n in runs:
        assert (keys[1:] >= keys[:-1]).all()
        for k, m in zip(map(tuple, ids.tolist()), n.tolist(), strict=True):
            got[k] += m
    assert got == want
    prefix = {tuple(r[:2]): k >> np.uint64(52) for keys, ids, _ in runs for k, r in zip(keys, ids.tolist(), strict=True)}
    assert all(prefix[tuple(r[:2])] == k >> np.uint64(52) for keys, ids, _ in runs for k, r in zip(keys, ids.tolist(), strict=True))


def test_scores_beyond_64_bits(spark):
    a = 9 * 10**15
    assert spark.range(1).select(collocations._score(F.lit(a), F.lit(a + 1) + F.lit(a)).alias("s")).first().s == 2_000_000 * a // (2 * a + 1)


def test_collocations_of_nothing(none):
    assert collocations.collocations(none).collect() == []


# ---- op 11


def brute_edits(rows):
    def order(r):
        return r[0] is None, r[0] or 0

    ids = [r[0] for r in rows]
    assert len(set(ids)) == len(ids)
    rows = sorted(rows, key=order)
    out = []
    for r, following in zip(rows, rows[1:] + rows[:1], strict=True):
        text, nxt = r[1] or "", following[1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        prints = [merkle.fingerprint(t) for t in (text, edited, nxt)]
        out.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1], merkle.likeness(prints[0], prints[1]), merkle.likeness(prints[0], prints[2])))
    return sorted(out, key=lambda t: [(x is not None, x) for x in t])


def unique_rows():
    seen, out = set(), []
    for r in spread_rows():
        if r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out + [(None, "a text without id. " * 9, *[None] * 9)]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_edit_audit(spark, parts):
    rows = unique_rows()
    got = merkle.edit_audit(spark.createDataFrame(rows, SCHEMA).repartition(3), parts)
    assert rows_of(got) == brute_edits(rows)


def test_edit_audit_of_few_and_equal_rows(spark, none):
    assert merkle.edit_audit(none, 3).collect() == []
    one = spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")
    row = merkle.edit_audit(one, 3).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1.0
    same = spark.createDataFrame([(1, "x y"), (1, "x y"), (1, "x y"), (2, None)], "doc_id long, text string")
    got = merkle.edit_audit(same, 5).collect()
    assert len(got) == 4
    assert Counter(r.near_next for r in got) == {1.0: 2, 0.0: 2}  # two equal rows follow one another, the third meets the empty text


def test_cuts_lose_nothing():
    for r in spread_rows():
        text = r[1] or ""
        assert "".join(x for line in text.splitlines(keepends=True) for x in merkle._leaves(line)) == text
        lengths = [merkle._length(x) for x in merkle._split(merkle.fingerprint(text).partition("|")[2], ";", "/")]
        assert sum(lengths) == len(text)


def test_roots_tell_texts_apart():
    texts = {lower(r[1]) for r in spread_rows()} | {"a b", "a\nb", "a\n\nb", "b\na", "a. b.", "a.\nb.", "b. a."}
    roots = {merkle.fingerprint(t).partition("|")[0] for t in texts}
    assert len(roots) == len(texts)
    assert merkle.fingerprint(None) == merkle.fingerprint("")


def test_likeness_and_spans():
    rng = random.Random(2)
    sentences = [" ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(6)) + ". " for _ in range(60)]
    lines = ["".join(sentences[i:i + 3]) + "\n" for i in range(0, 60, 3)]
    old = "".join(lines)
    new = "".join(lines[:7]) + "A new sentence. " + "".join(lines[7:])
    a, b = merkle.fingerprint(old), merkle.fingerprint(new)
    assert merkle.likeness(a, a) == 1.0 and 0.95 < merkle.likeness(a, b) < 1.0 and merkle.likeness(a, b) == merkle.likeness(b, a)
    removed, added = merkle.differing(a, b)
    at = len("".join(lines[:7]))
    assert removed == [] and added == [(at, len("A new sentence. "))]
    assert merkle.likeness(a, merkle.fingerprint("")) == 0.0 and merkle.differing(a, merkle.fingerprint(""))[0] == [(0, len(old))]
    half = merkle.fingerprint(old[: len(old) // 2])
    assert abs(merkle.likeness(a, half) - 2 / 3) < 0.05
    swapped = merkle.fingerprint("".join(reversed(lines)))
    assert 0.9 < merkle.likeness(a, swapped) < 1.0


def test_changes_between_versions(spark):
    kind = "doc_id long, text string, fingerprint string"
    old = spark.createDataFrame([(1, "One. Two. ", "x"), (2, "Same. ", "x"), (3, "Gone. ", "x"), (None, None, "x")], kind)
    new = spark.createDataFrame([(1, "One. Three. ", "x"), (2, "Same. ", "x"), (4, "Came. ", "x"), (None, "", "x")], kind)
    got = {r.doc_id: (r.removed, r.added) for r in merkle.changes(merkle.fingerprints(old), merkle.fingerprints(new)).collect()}
    assert got == {1: ([(5, 5)], [(5, 7)]), 3: ([(0, 6)], []), 4: ([], [(0, 6)])}


def test_twins_are_registered():
    assert {"op12_source_divergence", "op13_phrase_trie"} <= ORACLES.keys()
